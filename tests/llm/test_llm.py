"""The training-data operators against brute force, on small tables with odd rows in them."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spindrift.llm import decontaminate, hilbert, html, lines, minhash, nearest, packing, passages, reputation, toxicity
from spindrift.llm._base import components, table
from spindrift.llm._text import shingle_sets

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def corpus(spark):
    """Odd rows: null, empty, one word, copies, near copies, a very long text, a null id, a repeated row."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 120))) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(25, 60):  # a few words of a base text replaced
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(60, None), (61, ""), (62, "one"), (63, "ONE"), (64, " \t\n"), (65, base[0]), (66, base[0].upper()), (67, "ä É two"), (68, " ".join(rng.choices(vocabulary, k=30_000))), (69, "two words"), (70, "two words"), (70, "two words"), (None, base[1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_shingles_are_exact(corpus):
    texts = [r[1] for r in corpus]
    for text, got in zip(texts, shingle_sets(pa.array(texts), 2), strict=True):
        w = words(text)
        assert len(got) == (len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1020)]
    df = spark.createDataFrame(links, "a long, b long")
    one, many = (sorted(map(tuple, components(spark, df, most=m).collect())) for m in (10**6, 0))
    assert one == many and dict(one)[1020] == 1000


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, corpus, n, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)  # so that blocks and samples are used as well
    monkeypatch.setattr(minhash, "SAMPLE", 24)
    sets = {}
    for i, t, *_ in corpus:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sorted(k for k in sets if k is not None)]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_duplicates(spark, frame(spark, corpus), words=n).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [minhash.BLOCK, 7])
def test_family_of_half_copies(spark, block, monkeypatch):
    """Many documents of one family, most of them too unlike to be linked: no link is lost, none is made up."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SAMPLE", 64)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 4, 9, 14])):
            w[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(3, "another text under a known id"), (3, "another text under a known id"), (4, texts[0])]
    sets = [frozenset(zip(t.split(), t.split()[1:], strict=False)) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = 0
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                n += 1
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    got = collections.Counter((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in minhash.near_duplicates(spark, frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), words=2).collect())
    want = collections.Counter((i, least[find(k)], i == least[find(k)], len(sets[k])) for k, (i, _) in enumerate(rows))
    assert got == want and 1 < len(set(least.values())) < 100 < n
    kept = minhash.one_of_each(spark, frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(i, t) for k, (i, t) in enumerate(rows) if i == least[find(k)]})


def test_edit_distance():
    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    rng = random.Random(2)
    for _ in range(4000):
        a = bytes(rng.choices(b"abc", k=rng.randrange(12)))
        b = bytearray(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = bytes(rng.choices(b"abc", k=rng.randrange(2)))
        for k in (1, 2, 3):
            assert lines.within(a, bytes(b), k) == (distance(a, bytes(b)) <= k)


def test_line_dedup(spark):
    long = "this is a line that is long enough to be compared"
    rows = [
        (1, f"{long}\nshort\n\nother line that stays where it is, whole"),
        (2, f"short\n{long}\n{long}"),
        (3, long.replace("enough", "enouhg")),
        (4, None), (5, ""), (6, "\n\n"), (7, long + "!!"), (8, long + "!!!"), (9, long[:-6]), (None, long),
        (10, "é" * 30), (11, "é" * 29 + "e"), (12, "x" * 5000), (13, "x" * 4999),
    ]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in rows]).withColumnsRenamed({"lang": "line", "source": "doc"})
    got = {r.doc_id: r.text for r in lines.without_repeats(spark, docs).collect()}
    assert got == {1: rows[0][1], 2: "short", 3: "", 4: None, 5: "", 6: "\n\n", 7: "", 8: "", 9: long[:-6], None: long, 10: "é" * 30, 11: "", 12: "x" * 5000, 13: ""}
    assert lines.without_repeats(spark, docs.limit(0)).count() == 0
    kept = lines.fewer_lines(spark, frame(spark, [(1, long, "en", "s", len(long)), (2, f"a\n{long}", "en", "s", 99)])).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in kept] == [(long, len(long)), ("a", 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [lines.PAIRS, 4])
def test_line_join_against_brute_force(spark, most, monkeypatch):
    """Families of lines that share most of their bytes, so that keys are hot; repeated ids with other texts."""
    monkeypatch.setattr(lines, "BLOCK", 5)
    rng = random.Random(8)
    rows = []
    for _ in range(4):
        base = "".join(rng.choices("abcdefgh ", k=rng.randint(26, 40)))
        for _ in range(40):
            made = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(made))
                made[at : at + rng.randint(0, 1)] = rng.choices("abcxé", k=rng.randint(0, 2))
            rows.append("".join(made))
    rng.shuffle(rows)
    texts = [(k // 3 % 20, "\n".join(rows[k : k + 3])) for k in range(0, len(rows), 3)]  # ids come several times
    docs = frame(spark, [(i, t, None, None, 0) for i, t in texts])
    got = {(r.doc, r.text, n) for r in lines.repeats(spark, docs, least=20, shortest=1, most=most).collect() for n in r.gone}
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    first = {}
    every = sorted((i, hashes[t], n, line) for i, t in texts for n, line in enumerate(t.split("\n")))
    for i, h, n, line in every:
        first.setdefault(line, (i, h, n))
    near = {x for x in first if len(x.encode()) >= 20 and any(first[y] < first[x] and len(y.encode()) >= 20 and distance(x.encode(), y.encode()) <= 2 for y in first)}
    want = {(i, h, n) for i, h, n, line in every if line.strip() and (line in near or first[line] != (i, h, n))}
    assert got == want and 20 < len(near) < len(first)


def test_equal_rows_keep_their_lines_once(spark):
    docs = frame(spark, [(1, "one line\n\nsecond line", "en", "s", 0)] * 3 + [(1, "second line\nthird", "en", "s", 0)])
    got = sorted((r.text, r.n_removed) for r in lines.without_repeats(spark, docs, shortest=1).collect())
    both = [x for x in got if x != ("", 2)]
    assert got.count(("", 2)) == 2 and sorted("\n".join(t for t, _ in both).split()) == sorted("one line second line third".split())
    with pytest.raises(ValueError):
        lines.without_repeats(spark, docs.withColumnRenamed("lang", "n_removed"))


def test_short_lines_repeat_too(spark, tmp_path):
    """The query and the stage remove exact repeats of every length but blank lines."""
    texts = ["All rights reserved.\n\n}\n \t\nx", "x\nAll rights reserved.\n\nAll rights reserved\n \t\né", "é\nAll rights reserved."]
    docs = frame(spark, [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: texts[0], 1: "\nAll rights reserved\n \t\né", 2: ""}
    assert {r.doc_id: r.text for r in lines.op8_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in lines.fewer_lines(spark, docs).collect()} == want


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"word{k}" for k in range(400)]

    def text(toxic, k):
        w = rng.choices(plain, k=rng.randint(5, 60))
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["vileness", "slurword"])
        return " ".join(w)

    rows = [(k, text(k % 5 == 0, k), None, None, 0) for k in range(800)] + [(900, None, None, None, 0), (901, "", None, None, 0), (None, "slurword", None, None, 0), (902, "slurword " * 30_000, None, None, 0)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(800)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(spark, frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # Labels of held-out rows change nothing.
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert sorted(map(str, toxicity.toxicity(spark, frame(spark, rows), other).collect())) == sorted(map(str, got))
    assert all(r.score < 1e-9 for r in toxicity.toxicity(spark, frame(spark, rows[:5]), labels.limit(0)).collect())


def test_factorization_learns_pairs():
    """Neither term tells anything alone; both together do."""
    rng = np.random.default_rng(0)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    rows = [[k for k, on in ((11, x), (22, y), (33, True)) if on] for x, y in zip(a, b, strict=True)]
    model = toxicity.fit((a ^ ~b).astype(float) * (rng.random(3000) < 2), np.concatenate(rows), np.array([len(r) for r in rows]), epochs=60)
    assert len(model.buckets) <= 2  # a constant term has no chi square
    both = toxicity.fit((a & b).astype(float), np.concatenate(rows), np.array([len(r) for r in rows]), epochs=60)
    f = {int(x): k for k, x in enumerate(both.buckets)}
    assert float(both.v[f[11]] @ both.v[f[22]]) > 0.5
    # Neither term has a chi square of its own here, beside terms that tell nothing at all.
    noise = rng.random((4000, 60)) < 0.3
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    rows = [[*np.flatnonzero(x) + 100, *([11] if p else []), *([22] if q else [])] for x, p, q in zip(noise, a, b, strict=True)]
    flat, lengths = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
    model = toxicity.fit((a ^ b).astype(float), flat, lengths)
    f = {int(x): k for k, x in enumerate(model.buckets)}
    assert {11, 22} <= set(f) and len(f) < 20
    keep = np.isin(flat, model.buckets)
    row, at = np.repeat(np.arange(4000), lengths)[keep], np.array([f[x] for x in flat[keep].tolist()])
    z, _ = toxicity._raw(at, row, 4000, model.w0, model.w, model.v)
    assert ((z > 0) == (a ^ b)).mean() > 0.98
    for k in range(0, 4000, 371):  # against the sum over pairs, written out
        mine = at[row == k]
        pairs = sum(float(model.v[i] @ model.v[j]) for n, i in enumerate(mine) for j in mine[n + 1 :])
        assert abs(z[k] - (model.w0 + model.w[mine].sum() + pairs)) < 1e-9


def test_hilbert_curve():
    import itertools

    points = np.array(list(itertools.product(range(8), repeat=3)))
    h = hilbert.hilbert_index(points, 3)
    assert sorted(h) == list(range(512)) and (np.abs(np.diff(points[np.argsort(h)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n", [0, 3, 72])
def test_shards(spark, corpus, n):
    rows = corpus[:n] if n < 72 else corpus
    got = hilbert.shards(spark, frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 40 and r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["don't we'll <|endoftext|> x", "a\x1cb", "E\u0301 \u01c5 \u0130x \u039f\u0394\u039f\u03a3", "a-b 12 3,4 foo_bar\u00a0\u3000z", "x'S 'tis", "\ufb01 \u2460 q", "\U0001f600!? a\u2019b", "ÀÖÑßÿ×÷", "a\x00b \x7f"]
    rows = corpus + [(200 + k, t, None, None, 0) for k, t in enumerate(odd)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text, *_ in rows:
        want[i, len(t.encode(text or "", add_special_tokens=False).ids) + 1] += 1
    got = packing.pack(spark, frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 70:
            ids = [*t.encode(dict((i, x) for i, x, *_ in rows)[r.doc_id] or "", add_special_tokens=False).ids, 1]
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n * c for (_, n), c in want.items())
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark, frame(spark, [])).count() == 0


def test_patterns_cover_and_beat_first_fit():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(np.exp(rng.normal(4, 0.8, 20_000)).astype(int), 255), minlength=256)[:256]
    found = packing.patterns(demand, 256)
    sizes = np.arange(1, 257)
    assert all(p @ sizes <= 256 for p, _ in found)
    assert np.allclose(sum(p * x for p, x in found), demand)
    slots, n = packing.plan(demand, 256)
    assert n <= 1.02 * (demand @ sizes) / 256 + 2
    ranks = collections.defaultdict(list)
    fill = collections.Counter()
    for size, low, high, first, each in slots:
        ranks[size] += range(low, high)
        for r in range(low, high):
            fill[first + (r - low) // each] += size
    assert all(sorted(r) == list(range(demand[s - 1])) for s, r in ranks.items()) and max(fill.values()) <= 256


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    x[100:140] = x[20]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] * 16), (4080, []), (None, [1.0] * 16), (4100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.search(spark, df, df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[v]) < 1e-9 and v != q for _, v, s in found)
        assert found == sorted(found, key=lambda r: (-r[2], r[1]))
        s = x @ x[q]
        s[q] = -np.inf
        hit += sum(f[2] >= np.sort(s)[-20] - 1e-9 for f in found)
    assert hit >= 0.9 * 20 * len(got)
    few = df.where("vec_id < 5")
    assert len(nearest.search(spark, few, few.where("vec_id = 0")).collect()) == 4
    assert nearest.search(spark, df.limit(0), df.limit(0)).count() == 0


def test_partitions_spare_most_rows():
    """Vectors with structure: the router finds the neighbours in few of the parts."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 24)) + 4 * rng.normal(size=(40, 24))[rng.integers(0, 40, 6000)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = nearest.fit(x[rng.permutation(6000)[:4000]], 6000)
    parts = model.weights.shape[1]
    order = np.argsort(-(x @ model.weights[:-1] + model.weights[-1]), 1)
    at = order[:, 0]
    assert parts == nearest.LEAST_PARTS and model.probes < parts and np.bincount(at, minlength=parts).max() < 0.25 * len(x)
    near = nearest._neighbours(x, 20)[::20]
    asked = order[::20, : model.probes]
    assert np.mean([np.isin(at[n], p).mean() for n, p in zip(near, asked, strict=True)]) >= 0.9
    assert np.mean([np.isin(at, p).mean() for p in asked]) <= 0.5


@pytest.mark.parametrize("rows", [0, 1, 2, 47, 48])
def test_few_vectors_are_one_part(rows):
    model = nearest.fit(np.eye(64)[:rows], rows)
    assert model.weights.shape[1] == max(1, rows // nearest.LEAST_FIT) and 1 <= model.probes <= model.weights.shape[1]


def test_passages(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(5000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    shared, near = make(60), make(90)
    changed = list(near)
    changed[45] = "changed"
    rows = [(1, make(80) + shared + make(70)), (2, make(30) + shared), (3, shared + make(10)), (4, make(200)), (5, near + make(40)), (6, make(40) + changed), (7, make(49)), (8, []), (9, make(20) + make(50) * 2)]
    texts = [(k, " ".join(w)) for k, w in rows] + [(10, None), (None, " ".join(shared))]
    docs = frame(spark, [(k, t, None, None, 0) for k, t in texts])
    got = sorted(map(tuple, passages.repeated_passages(spark, docs).collect()))
    assert got == [(2, 30, 90, 1, 80, 140), (3, 0, 60, 1, 80, 140), (6, 40, 130, 5, 0, 90)]
    assert passages.repeated_passages(spark, docs.limit(0)).count() == 0


def test_passages_behind_partial_copies(spark):
    """Earlier documents that hold only parts of a passage do not hide it from two later ones."""
    rng = random.Random(11)
    text = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], []
    for k in range(60):
        passage, n = text(50 + k % 3 * 10), 4 * k
        for j, part in enumerate((passage[:45], passage[-45:], passage, passage)):
            rows.append((n + j, " ".join(text(30) + part + text(30))))
        want.append((n + 3, n + 2, 30, 30 + len(passage)))
    got = [r for r in passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id % 4 == 3]
    for doc, first, low, high in want:
        mine = [r for r in got if r.doc_id == doc]
        for at in range(low, high - 49):
            assert any(r.first_doc_id == first and r.start_word <= at and r.end_word >= at + 50 and r.first_start_word <= at and r.first_end_word >= at + 50 for r in mine), (doc, at, mine)


def test_near_passages_beside_weaker_text():
    """Every pair of stretches on one diagonal that brute force finds alike lies within a reported passage."""
    rng = np.random.default_rng(3)

    def compare(n, changed, before=0):
        w = rng.integers(1, 1 << 60, n + 4 + 2 * before)
        other = w.copy()
        other[[before + c for c in changed]] = rng.integers(1, 1 << 60, len(changed))
        a, b = (np.array([hash(tuple(t[k : k + 5].tolist())) & (1 << 63) - 1 for k in range(len(t) - 4)], np.uint64) for t in (w, other))
        got = passages.verify(a, b, [(f, len(a) // 2, len(a) // 2, len(a) // 2, len(a) - len(a) // 2 - 1) for f in range(2)])
        miss = np.concatenate(([0], np.cumsum(a != b)))
        wanted = [(p, q) for p in range(len(a)) for q in range(p + 46, len(a) + 1) if a[p] == b[p] and a[q - 1] == b[q - 1] and (m := miss[q] - miss[p]) <= (q - p) / 9]
        for p, q in wanted:
            assert any(x <= p and q <= y and u <= p and q <= v for x, y, u, v in got), (n, changed, p, q, got)
        for x, y, u, v in got:
            s, t = set(a[x:y].tolist()), set(b[u:v].tolist())
            assert min(y - x, v - u) >= 46 and len(s & t) >= 0.8 * len(s | t)
        return wanted, got

    wanted, _ = compare(446, [*range(24, 150, 48), *range(165, 450, 27)])
    assert max(q - p for p, q in wanted) >= 140
    for changed in (0, 2, 4, 45, 47, 49):
        assert compare(46, [changed])[1] == [(0, 46, 0, 46)]
    for _ in range(20):
        compare(300, sorted(rng.choice(300, 9, replace=False).tolist()), before=5)


def test_nodes_of_the_cartesian_tree():
    from spindrift.llm._text import U, mix

    rng = np.random.default_rng(1)
    for _ in range(100):
        n = rng.integers(0, 60)
        x, whole = rng.integers(0, 20, n).astype(U), rng.random(n) > 0.05
        v = [(int(mix(np.array([a ^ U(3)], U))[0]) % 2**63 >> 28, i) if w else (-1, i) for i, (a, w) in enumerate(zip(x, whole, strict=True))]
        want = []
        for i in np.flatnonzero(whole):
            a = b = int(i)
            while a and v[a - 1] > v[i]:
                a -= 1
            while b + 1 < n and v[b + 1] > v[i]:
                b += 1
            if b - a >= 5:
                want.append((int(i), a, b))
        assert list(zip(*(r.tolist() for r in passages.nodes(x, whole, 3, 6)), strict=True)) == want


def test_reputation(spark):
    urls = ["https://WWW.Example.com/en/a?x#y", "http://example.com/en/", "http://example.com/fr", "http://a.net/es/x", "ftp://host", "nourl", None, "http://bad.org/x", "http://com/", "http://x.com?q=/", "a://b://c/d"]
    pages = spark.createDataFrame([(k, u, u) for k, u in enumerate(urls)] + [(100 + k, f"http://bad.org/{k}", "") for k in range(60)] + [(200 + k, f"http://good.org/{k}", "") for k in range(60)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(100 + k, 1) for k in range(60)] + [(200 + k, 0) for k in range(60)] + [(None, 1), (3, None)], "page_id long, bad int")
    got = {r.page_id: r for r in reputation.judge(spark, pages, outcomes).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(urls))] == [
        ("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("example.com", "/fr", "com/"), ("a.net", "/es/x", "net/es/"), ("host", "", None), ("", "", None), ("", "", None),
        ("bad.org", "/x", None), ("com", "/", "com/"), ("x.com", "", None), ("b:", "//c/d", None),
    ]
    assert [got[k].verdict for k in (0, 1, 2, 3, 7, 8, 200, 100)] == ["allow", "block", "allow", "block", "block", "allow", "allow", "block"]
    assert reputation.judge(spark, pages.limit(0), outcomes).count() == 0


def test_html():
    page = '<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><a href="#">menu</a></nav><div class="cookie-notice">We use</div><article><h1>Title &amp; more</h1><p><b>First  long paragraph<br>with text<p>Of.</p><div class="ad">Buy</div><p>Second&nbsp;paragraph that is long</article><section id="comments"><p>Nice one</p></section><script>var t="</p>";</script><footer>F</footer>'
    assert html.main_text(page) == "Title & more\nFirst long paragraph with text\nOf.\nSecond paragraph that is long"
    assert html.main_text("<div><h1>A title</h1><p>Some text that is long enough to count</p></div><div class='sidebar'>s</div>") == "A title\nSome text that is long enough to count"
    for nothing in (None, "", "<html></html>", "<nav>x</nav>", "<script>x"):
        assert html.main_text(nothing) == ""
    assert html.main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">{}</div><div class="sidebar">s</div>', '<div id="page" class="social-science">{}</div>', '<div class="ad-free"><article>{}</article></div>'])
def test_names_that_only_sound_like_boilerplate(wrap):
    inner = "<h1>Head</h1><p>A long paragraph of the page that matters very much</p><p>Ok.</p>"
    assert html.main_text(wrap.format(inner)) == "Head\nA long paragraph of the page that matters very much\nOk."


def test_names_of_boilerplate_beside_an_article():
    for name in ("comment-list", "comment-thread", "site-comments"):
        assert html.main_text(f'<article>Short text.</article><div class="{name}"><p>A comment that is longer than the article by far</p></div>') == "Short text."


def test_ratios_choose_the_region(monkeypatch):
    """Nothing but text and tags tells menu and imprint from the article here."""
    links = "".join(f"<li><a>Section number {k}</a></li>" for k in range(40))  # more text than the article
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><p>A long paragraph of text goes here and goes on.</p><p>Ok.</p><p>Another long paragraph of text goes here.</p></div><div>Copyright</div></body>"
    want = "Title\nA long paragraph of text goes here and goes on.\nOk.\nAnother long paragraph of text goes here."
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "threshold", lambda x: 0.0)
    assert html.main_text(page) != want


def test_html_of_pages(spark):
    got = {r.page_id: r for r in html.op9_html_main_text(spark, SF).collect()}
    for p in table(spark, SF, "pages").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|$)", p.html, re.S)[1]
        parts = re.split(r"<[^>]*>", re.sub(r"</?b>|<br>", " ", body))
        import html as entities

        assert got[p.page_id].text == "\n".join(x for x in (" ".join(entities.unescape(y).split()) for y in parts) if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_seeds_are_lossless():
    import itertools

    for wrong in itertools.combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(at + o not in wrong for o in s) for s in decontaminate.SEEDS for at in range(decontaminate.WINDOW - s[-1]))


def test_decontamination(spark):
    rng = random.Random(5)
    vocabulary = [f"b{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(14, 40)))) for k in range(12)] + [(50, "just four words here"), (51, None), (None, "x " * 20), (52, "")]
    rows = [(100, None), (101, ""), (102, "so JUST four, words here!"), (None, items[0][1])]
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 60))
        if k % 2:
            part = rng.choice(items[:12])[1].split()
            for _ in range(rng.randint(0, 5)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[rng.randrange(3) :]
        rows.append((k, " ".join(w)))
    split = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    want = {}
    for i, t in rows:
        for item, text in items:
            a, b = split(t), split(text)
            n = min(13, len(b))
            if i is None or item is None or not n:
                continue
            allowed = 2 if n == 13 else 0
            for shift in range(-len(b), len(a) + 1):
                ok = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                inside = [0 <= k + shift < len(a) for k in range(len(b))]
                if any(all(inside[k : k + n]) and sum(ok[k : k + n]) >= n - allowed for k in range(len(b) - n + 1)):
                    want.setdefault(i, set()).add(item)
    got = decontaminate.contaminated(spark, frame(spark, [(i, t, None, None, 0) for i, t in rows]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: set(r.item_ids) for r in got} == want and len(want) > 10
    clean = decontaminate.clean(spark, frame(spark, [(i, t, None, None, 0) for i, t in rows]), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - set(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] >= counts[3] >= counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]
    assert sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()))


def test_reputation_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    found = c.execute(reputation.ORACLE)
    names = [d[0] for d in found.description]
    df = reputation.op7_host_reputation(spark, "/root/testdata/sf0.01").select(names)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found.fetchall()))


def test_passages_of_texts_that_repeat_themselves():
    """Many shifts of a repetitive text: a passage met on one of them is found, and all that is found is alike."""
    rng = np.random.default_rng(8)
    noise = lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)
    chorus, passage = noise(3), noise(80)
    near = passage.copy()
    near[40] = noise(1)[0]
    a = np.concatenate((np.tile(chorus, 200), passage, np.full(300, chorus[0]), noise(200)))
    b = np.concatenate((np.tile(chorus[::-1], 60), near, np.full(120, noise(1)[0])))
    met = [(f, x, y, 60, 60) for f in range(2) for x in range(80, 1000, 7) for y in range(70, 240, 17)]
    got = passages.verify(a, b, [*met, *((f, 640, 220, 40, 39) for f in range(2))])
    assert any(p <= 600 and q >= 680 and u <= 180 and v >= 260 for p, q, u, v in got), got
    for p, q, u, v in got:
        s, t = set(a[p:q].tolist()), set(b[u:v].tolist())
        assert min(q - p, v - u) >= 46 and len(s & t) >= 0.8 * len(s | t)


def test_passages_repeated_ids_and_empty(spark):
    """Rows of one id with texts of unlike lengths do not break the rounds; empty tables and texts give nothing."""
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[100:300])), (2, " ".join(words[100:170])), (3, ""), (4, None), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(spark, docs).collect()
    assert {r.doc_id for r in got} == {2} and {r.first_doc_id for r in got} == {1}
    assert passages.repeated_passages(spark, docs.where("doc_id = 3")).collect() == []
    assert passages.repeated_passages(spark, docs.limit(0)).collect() == []


def test_near_passages_against_brute_force(spark):
    """Every pair of windows of two documents that brute force finds alike has shingles that the passages put in one class."""
    rng = random.Random(23)
    fresh = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(60):
        passage = fresh(50 + k % 3 * 15)
        if k % 5 == 4:
            passage[20:26] = passage[10:16]  # repeats within a window
        near = list(passage)
        for at in ([3], [25], [len(near) - 2], [0, len(near) - 1])[k % 4]:
            near[at] = fresh(1)[0]
        if k % 7 == 6:
            near.insert(len(near) // 2, fresh(1)[0])
        # Earlier documents hold parts, and what is least under any function is in one of them.
        for part in (passage[:40], passage[-40:], near[:38], near[-38:], passage, near, near):
            rows.append((len(rows), " ".join(fresh(20) + part + fresh(20))))
    line = fresh(30)
    rows += [(len(rows) + k, " ".join(fresh(20) + line + fresh(20))) for k in range(40)]
    got = passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shingled = {k: [tuple(w[x : x + 5]) for x in range(len(w) - 4)] for k, t in rows for w in [t.split()]}
    windows = {k: [frozenset(s[x : x + 46]) for x in range(len(s) - 45)] for k, s in shingled.items()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in got:
        mine, theirs = shingled[r.doc_id][r.start_word : r.end_word - 4], shingled[r.first_doc_id][r.first_start_word : r.first_end_word - 4]
        assert r.doc_id > r.first_doc_id and min(len(mine), len(theirs)) >= 46
        assert 5 * len(set(mine) & set(theirs)) >= 4 * len(set(mine) | set(theirs))
        for s in set(mine) & set(theirs):
            up[find((s, r.doc_id))] = find((s, r.first_doc_id))
    alike = 0
    for n in range(0, 420, 7):
        for a in range(n, n + 7):
            for b in range(n, a):
                for u in windows[a]:
                    for v in windows[b]:
                        if 5 * len(u & v) >= 4 * len(u | v):
                            alike += 1
                            assert any(find((s, a)) == find((s, b)) for s in u & v), (a, b)
    assert alike and not any(r.doc_id >= 420 for r in got)


def test_near_copies_are_not_told_in_pairs(spark):
    """A family of near copies costs rows in proportion to its size; each copy is told with the first."""
    rng = random.Random(29)
    base = [f"f{k}" for k in range(130)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        copy = list(base)
        for at in (42, 86):
            copy[at + rng.randrange(-3, 4)] = f"x{k}-{at}"
        rows.append((k, " ".join(copy)))
    got = passages.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.first_doc_id == 0} == set(range(1, 40))
    assert len(got) < 4 * len(rows), len(got)


def test_prefixes_against_brute_force():
    """Each of the least values of a window has a place whose windows reach from before it to behind it, and their sizes bound its own."""
    rng = np.random.default_rng(5)
    s = rng.integers(1, 1 << 63, 1200).astype(np.uint64)
    s[200:420] = s[rng.integers(190, 215, 220)]  # repeats within windows
    s[600:700] = s[450:550]  # and a stretch that comes again
    whole = np.ones(len(s), bool)
    whole[[300, 301, 800]] = False
    c, low, high, _, fewest, most = passages.prefixes(s, whole, np.zeros(0, np.uint64))
    value = passages.mix(s ^ np.uint64(1)) >> np.uint64(1)
    seen = set()
    for w in range(len(s) - 45):
        held = tuple(s[w : w + 46].tolist())
        if not whole[w : w + 46].all() or len(set(held)) < 46 and held in seen:
            continue
        seen.add(held)
        least = np.unique(value[w : w + 46])
        least = least[: len(least) - math.ceil(0.8 * len(least) - 1e-9) + 1]
        mine = (w <= c) & (c < w + 46) & (low <= w) & (w <= high) & (fewest <= len(set(held))) & (len(set(held)) <= most)
        assert set(least.tolist()) <= set(value[c[mine]].tolist()), w
