"""Near-duplicate documents by a MinHash signature-coordinate inverted join.

A document's set is its distinct word shingles as 64-bit hashes.  The hash range is cut into `COORDS`
equal ranges; coordinate i of the signature is the smallest hash of the set in range i (one-permutation
MinHash: a coordinate filled on either side agrees with probability equal to the Jaccard similarity).
The hash itself tells its coordinate, so a signature is a list of coordinate-value tokens.

1. Documents with one set form a class, a node of the graph; one text stands for it from here on.
2. Each node is posted under its coordinate-value tokens; tokens that nobody shares are dropped.
3. Prefix: with at least t of m coordinates to agree, two documents must share one of their m - t + 1
   rarest tokens (one global order by list length), so only those lists are merged; the long lists are
   skipped.  t lies `SIGMAS` standard deviations under the mean at the threshold.  Each list is merged in one
   task, which counts the agreeing coordinates of its members (a byte of each, so never too few) and keeps the
   members that agree in t with another one.  Lists of over `LONG` members keep them all.
4. Round one links the members of each list with a few pivots, where t coordinates agree and the full sets
   confirm it; that gives first components.  Pairs inside a component need no look, so a group of near copies
   costs a few rows a member, never all its pairs.
5. Round two takes the lists whose members still lie in different components, each set of members once, and
   compares them inside tasks, in blocks: every set is sent once a block, and only links between components
   come out.  Sets of up to `SAMPLE` shingles are compared whole, of larger ones the hashes under a power of
   two; where such a sample cannot tell (`SIGMAS` deviations), the documents meet again with their whole sets.
6. Links of round two are confirmed on the full sets as well.

Nothing is sampled away, capped or dropped.  Lost are a linked pair whose agreeing coordinates fall under t
(about one in three million at the threshold itself), and a link that 32-bit hashes, by a chance collision,
showed to be within a component that it was not (about one in a million of the pairs that just miss).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import components, discard, lean, runs, small_batches, staged, table
from ._text import U, mix, shingle_sets

COORDS = 64
SIGMAS = 5
LONG = 4096  # members of a list that are held against each other at once
PIVOTS = 4  # pivots of a list's tokens
SAMPLE = 1024  # shingles of a set that are compared at first
BLOCK = 2048  # sets of a block of one list, or fewer
BLOCK_VALUES = 1 << 20

_EDGES = np.arange(COORDS, dtype=U) << U(64 - COORDS.bit_length() + 1)


def need(m: np.ndarray | int, percent: int):
    """Coordinates of m that must agree."""
    s = percent / 100
    return np.maximum(1, np.floor(m * s - SIGMAS * np.sqrt(m * s * (1 - s)))).astype(int)


def _signatures(words: int):
    def run(batches):
        for batch in batches:
            n, f1, f2, sigs, marks = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                at = np.searchsorted(s, _EDGES)
                filled = at < np.append(at[1:], len(s))
                sigs.append(s[at[filled]].astype(np.int64))
                mark = np.zeros(COORDS, np.uint8)
                mark[filled] = 1 + mix(s[at[filled]]) % U(255)  # 0: the coordinate is empty
                marks.append(mark.tobytes())
                n.append(len(s))
                f1.append(np.sum(mix(s), dtype=U))
                f2.append(np.sum(mix(s ^ U(0x5851F42D4C957F2D)), dtype=U))
            where = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
            flat = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(np.array(f1, U).astype(np.int64)), pa.array(np.array(f2, U).astype(np.int64)), pa.ListArray.from_arrays(pa.array(where), pa.array(flat)), pa.array(marks, pa.binary())],
                names=["doc", "hash", "n", "f1", "f2", "sig", "marks"],
            )

    return lean(run)


def _confirm(words: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def _members(percent: int):
    """Lists, sorted, (list, node, marks), to (list, node) of the members that agree well with another one."""

    def run(batches):
        open_ = None  # the list that came in pieces: it is long
        for t, cut in runs(batches, cap=LONG + 1):
            lists, node = np.asarray(t.column(0)), np.asarray(t.column(1))
            marks = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, COORDS)
            least = need((marks > 0).sum(1), percent)
            keep = np.zeros(len(node), bool)
            first, size = cut[:-1], np.diff(cut)
            if len(first) == 1 and size[0] > LONG:
                open_ = lists[0]
            whole = (size > LONG) | (lists[first] == open_ if open_ is not None else False)
            keep[np.flatnonzero(np.repeat(whole, size))] = True
            for low, n in zip(first[~whole & (size > 64)].tolist(), size[~whole & (size > 64)].tolist(), strict=True):
                x = marks[low : low + n]
                for k in range(n - 1):
                    near = np.flatnonzero(((x[k + 1 :] == x[k]) & (x[k] > 0)).sum(1) >= np.maximum(least[low + k], least[low + k + 1 : low + n])) + k + 1
                    if len(near):
                        keep[low + k] = True
                        keep[low + near] = True
            # Of the short lists all pairs at once: the k-th member of a list with the one `step` behind it.
            short = np.flatnonzero(np.repeat(~whole & (size <= 64), size))
            left = np.repeat(cut[1:], size) - np.arange(len(node)) - 1  # members behind
            for step in range(1, 64):
                at = short = short[left[short] >= step]
                if not len(at):
                    break
                same = ((marks[at] == marks[at + step]) & (marks[at] > 0)).sum(1) >= np.maximum(least[at], least[at + step])
                keep[at[same]] = True
                keep[at[same] + step] = True
            yield pa.RecordBatch.from_arrays([pa.array(lists[keep]), pa.array(node[keep])], names=["list", "node"])

    return lean(run)


def _samples(words: int, most: int | None):
    """(node, level, values): the high halves of a set's hashes under 2 ** (32 - level), sorted, as bytes.

    The level is the least at which `most` would be expected; None: all hashes, level 0."""

    def run(batches):
        for batch in batches:
            levels, values = [], []
            for s in shingle_sets(batch.column(1), words):
                level = max(0, (len(s) - 1) // most).bit_length() if most else 0
                high = (s >> U(32)).astype(np.uint32)  # the set is sorted
                levels.append(level)
                values.append(high[: max(1, np.searchsorted(high, 1 << (32 - level)))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels, pa.int32()), pa.array(values, pa.binary())], names=["node", "level", "values"])

    return lean(run)


def _compared(percent: int):
    """Cells, (cell, list, within, side, node, comp, level, values), to (list, a, b): links between different
    components (list null), and the documents of a list that need a look at their whole sets (a = b)."""
    share = percent / 100

    def cell(node, comp, side, level, raw, within) -> tuple[list, set]:
        # Large components first: what they have left to compare lies behind them.
        _, name, many = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((name, -many[name], side))
        node, comp, side, level = node[order], comp[order].copy(), side[order], level[order]
        sizes = np.array([len(raw[k]) // 4 for k in order.tolist()])
        flat = np.frombuffer(b"".join(raw[k] for k in order.tolist()), np.uint32)
        ends = np.cumsum(sizes)
        values, which = np.unique(flat, return_inverse=True)
        which, starts = which.astype(np.int32), ends - sizes
        at = np.arange(level.max() + 1)
        # Hashes of each set under each level's bound.
        under = np.stack([np.add.reduceat(flat < (1 << (32 - int(k))), starts, dtype=np.int64) for k in at], 1)
        mark = np.zeros(len(values), np.uint8)
        first = len(node) if within else int(np.searchsorted(side, 1))
        links, unsure = [], set()
        for k in range(first):
            others = np.arange(k + 1 if within else first, len(node))
            others = others[comp[others] != comp[k]]
            if not len(others):
                continue
            mine = which[starts[k] : ends[k]]
            mark[mine] = 1
            j = int(others[0])
            both = np.add.reduceat(mark[which[starts[j] :]], starts[j:] - starts[j], dtype=np.int64)[others - j]
            mark[mine] = 0
            deep = np.maximum(level[k], level[others])
            union = under[k, deep] + under[others, deep] - both
            whole = deep == 0
            for j in others[whole & (100 * both >= percent * union)].tolist():
                if comp[j] != comp[k]:
                    links.append((node[k], node[j]))
                    comp[comp == comp[j]] = comp[k]
            near = others[~whole & (both >= share * union - SIGMAS * np.sqrt(share * (1 - share) * union))]
            near = near[comp[near] != comp[k]]
            if len(near):
                unsure.add(node[k])
                unsure.update(node[near].tolist())
        return links, unsure

    def run(batches):
        for t, cut in runs(batches, 1 << 12):
            lists, within, side, node, comp, level = (np.asarray(t.column(k)) for k in range(1, 7))
            out: list[tuple] = []
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                x = slice(low, high)
                links, unsure = cell(node[x], comp[x], side[x], level[x], t.column(7).slice(low, high - low).to_pylist(), bool(within[low]))
                out += [(None, a, b) for a, b in links] + [(lists[low], a, a) for a in sorted(unsure)]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["list", "a", "b"])

    return lean(run)


def _each_once(lists: DataFrame) -> DataFrame:
    """`lists` (list, node, comp) without lists that have the members of another one, or one component only."""
    names = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"x{k}") for k in range(2)]
    held = lists.groupBy("list").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *names).where("lo < hi")
    return lists.join(held.groupBy("f", "x0", "x1").agg(F.min("list").alias("list")).select("list"), "list", "left_semi")


def _within_lists(spark: SparkSession, lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Staged result of `_compared` for lists (list, node, comp) with the sets (node, level, values)."""
    rows = lists.join(sets, "node")
    values = F.sum(F.octet_length("values") / 4)
    count = lists.join(sets.select("node", "values"), "node").groupBy("list").agg(F.ceil(F.greatest(F.count("*") / BLOCK, values / BLOCK_VALUES)).cast("int").alias("count")).where("count > 1")
    # Lists of several blocks are few and long; of one block a list is its own cell.
    count = staged(spark, count)
    rows = rows.join(count, "list", "left")
    one = F.col("count").isNull()
    own = F.pmod(F.xxhash64("node"), "count").cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("count"), F.lit(1)) - 1), lambda k: F.struct(F.least(k, F.coalesce(own, F.lit(0))).alias("i"), F.greatest(k, F.coalesce(own, F.lit(0))).alias("j"), F.when(k < own, 1).otherwise(0).alias("side")))
    cells = rows.select("list", "node", "comp", "level", "values", F.explode(grid).alias("g"))
    cells = cells.select(F.xxhash64("list", "g.i", "g.j").alias("cell"), "list", (F.col("g.i") == F.col("g.j")).cast("int").alias("within"), "g.side", "node", "comp", "level", "values")
    return staged(spark, cells.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(_compared(percent), "list long, a long, b long"))


def _components(spark: SparkSession, docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc, text, hash): (doc, hash, n, f1, f2) for each row, and (n, f1, f2, rep, component, n_links)
    for each class."""
    sigs = staged(spark, docs.select("doc", "text", "hash").mapInArrow(_signatures(words), "doc long, hash long, n long, f1 long, f2 long, sig array<long>, marks binary"))
    full = sigs.where("n > 0 and doc is not null")
    classes = staged(spark, full.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc", "hash")).alias("rep"), F.first("sig").alias("sig"), F.first("marks").alias("marks")))
    # f1 is a 64-bit hash of the set: it names the class.
    reps = classes.select(F.col("f1").alias("node"), "sig")
    m = F.size("sig")
    t = F.greatest(F.lit(1), F.floor(m * (percent / 100) - SIGMAS * F.sqrt(m * (percent / 100) * (1 - percent / 100)))).cast("int")

    tokens = reps.select("node", m.alias("m"), t.alias("t"), F.explode("sig").alias("token"))
    shared = staged(spark, tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"))
    ranked = tokens.join(shared, "token").groupBy("node", "m", "t").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("by"))
    # Tokens that nobody shares are the rarest: they fill the prefix first.
    ranked = ranked.withColumn("p", F.col("m") - F.col("t") + 1 - (F.col("m") - F.size("by"))).where("p > 0")
    ranked = ranked.join(classes.select(F.col("f1").alias("node"), "marks"), "node")
    posts = ranked.select(F.explode(F.slice(F.col("by.token"), F.lit(1), F.col("p"))).alias("list"), "node", "marks")
    posts = staged(spark, posts.repartition("list").sortWithinPartitions("list").mapInArrow(_members(percent), "list long, node long"))
    discard(spark, shared)

    # Texts of documents on any list.  Always dealt by id: a small side that happens to be broadcast here
    # would be shuffled on a larger corpus.
    some = classes.select(F.col("f1").alias("node"), "rep.doc", "rep.hash").join(posts.select("node").distinct(), "node", "left_semi")
    some = staged(spark, docs.join(some.hint("merge"), ["doc", "hash"]).select("node", "text").dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = some.select(F.col("node").alias("a"), F.col("text").alias("ta")), some.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return staged(spark, pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(words, percent), "a long, b long"))

    # Round one: in each list, the member with the least hash under one of `PIVOTS` seeds is the pivot.
    rank = F.struct(F.xxhash64("node", F.pmod("list", F.lit(PIVOTS))).alias("h"), F.col("node").alias("pivot"))
    pivots = posts.groupBy("list").agg(F.min(rank)["pivot"].alias("pivot"), F.count("*").alias("f")).where("f > 1").select("list", "pivot")
    stars = posts.join(pivots, "list").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    sides = reps.select("node", "sig", t.alias("t"))
    a, b = sides.toDF("a", "sa", "xa"), sides.toDF("b", "sb", "xb")
    stars = stars.join(a, "a").join(b, "b").where(F.size(F.array_intersect("sa", "sb")) >= F.greatest("xa", "xb")).select("a", "b")
    links = confirmed(stars)
    comp = staged(spark, components(spark, links).select("node", F.col("component").alias("comp")))
    lists = posts.join(comp, "node", "left").select("list", "node", F.coalesce("comp", "node").alias("comp"))

    # Round two: what lies in one list but in different components.
    lists = staged(spark, _each_once(staged(spark, lists)))
    mine = some.join(lists.select("node").distinct(), "node", "left_semi")
    sample = staged(spark, mine.mapInArrow(_samples(words, SAMPLE), "node long, level int, values binary"))
    met = _within_lists(spark, lists, sample, percent)
    again = met.where("list is not null").select("list", F.col("a").alias("node")).distinct().join(lists, ["list", "node"])
    more = met.where("list is null").select("a", "b")
    again = staged(spark, _each_once(staged(spark, again)))
    if not again.isEmpty():
        sets = staged(spark, some.join(again.select("node").distinct(), "node", "left_semi").mapInArrow(_samples(words, None), "node long, level int, values binary"))
        more = more.union(_within_lists(spark, again, sets, percent).select("a", "b"))
    more = confirmed(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = staged(spark, links.union(more).distinct())

    found = staged(spark, components(spark, links))
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = classes.select("n", "f1", "f2", "rep.doc", F.col("f1").alias("node")).join(found, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(spark, named)
    least = named.where("n_links is not null").groupBy("component").agg(F.min("doc").alias("least"))
    groups = staged(spark, named.join(least, "component", "left").select("n", "f1", "f2", F.col("doc").alias("rep"), F.coalesce("least", "doc").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    discard(spark, classes, posts, some, lists, sample, met, again, links, named, found, comp)
    return sigs.drop("sig", "marks"), groups


def near_duplicates(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of `docs`: (`id`, n_shingles, component_id, kept, class_id, n_links, hash).

    Documents link where 100 * intersection >= `percent` * union of their shingle sets.  class_id is the
    smallest id with the same set, n_links the verified links of that class found (a spanning set of its
    component), component_id the smallest id reachable.  A null or wordless text has no shingles and links
    with nothing; fewer words than `words` are one shingle.  A row with a null id is kept, with null
    component.  Rows of one id with different texts are rows like any others; hash (xxhash64 of the text) tells
    them apart.
    """
    small_batches(spark)
    docs = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash"))
    rows, groups = _components(spark, docs, words, percent)
    # A null id is in no class, and neither is a text without shingles.
    groups = groups.toDF("gn", "g1", "g2", "rep", "component", "n_links")
    rows = rows.join(groups, (rows.n == groups.gn) & (rows.f1 == groups.g1) & (rows.f2 == groups.g2) & rows.doc.isNotNull(), "left")
    mine = F.coalesce("component", "doc")
    return rows.select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), mine.alias("component_id"), F.coalesce(mine == F.col("doc"), F.lit(True)).alias("kept"), F.coalesce("rep", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "hash")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), words=2, percent=80).drop("hash")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays, by the sets of `op2` (two-word shingles).

    Of rows equal in id and text one stays.  Rows with a null id stay.
    """
    found = near_duplicates(spark, docs.select("doc_id", "text"), words=2, percent=80)
    marks = staged(spark, found.where("doc_id is not null").groupBy("doc_id", "hash").agg(F.max(~F.col("kept")).alias("gone"), F.count("*").alias("n")).where("gone or n > 1"))
    marks = marks.toDF("__doc", "__hash", "__gone", "__n")
    joined = docs.join(marks, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__hash")), "left")
    out = joined.where("__n is null").select(docs.columns)
    equal = joined.where("__n > 1 and not __gone")
    if marks.where("__n > 1 and not __gone").isEmpty():
        return out
    nth = F.row_number().over(Window.partitionBy("__doc", "__hash").orderBy(F.lit(0)))
    return out.union(equal.withColumn("__nth", nth).where("__nth = 1").select(docs.columns))
