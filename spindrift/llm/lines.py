"""Line deduplication by a segment-partition edit join.

A line repeats an earlier one if the two are equal or within `EDITS` byte edits.  A line of l bytes is cut
into EDITS + 1 segments; a line within EDITS edits of it holds at least one of them unchanged, close to its
place.  So each line is indexed under its segments with their number and its length, and probes the index
of each length from EDITS bytes shorter up to its own with the substrings that the segments can have moved
to.  Pairs that meet are verified on their bytes by a banded bit-parallel edit distance.

Only 64-bit keys travel for the search, dealt and sorted by key; each run of a key is compared in its task,
every line once in it, and what differs in too many bytes or byte pairs (parities in 64 bits tell) makes no
pair.  The bytes of a line travel only if the search found it a partner (a bitmap of fixed size tells the
rescan which lines to send; it lets too many through when full, never too few).

A key that more than `PAIRS` pairs of lines share is not paired there.  Its lines are dealt in blocks of
`BLOCK` with their bytes; a task verifies two blocks against each other and gives for each line the first
earlier one that is near, so that the rows made are as many as the lines, not their pairs.

Rows are told apart by id and a hash of the text; of equal rows the first goes on, the others repeat it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import discard, lean, runs, small_batches, staged, table
from ._text import _SPACE, U, _power, blocks, mix

EDITS = 2
LEAST = 24  # bytes; shorter lines take no part in the edit join
PAIRS = 1 << 14  # that one key makes at once
BLOCK = 4096  # lines of a block of a larger key, or fewer if they are long
BLOCK_BYTES = 1 << 24
_SEEN = 1 << 21  # lines that a task remembers to have sent
_BITS = 23  # the bitmap has 2 ** _BITS bits: 1 MB
_RAW = mix((np.arange(256, dtype=U) + U(1)) * U(0xA24BAED4963EE407))


def _segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of each segment: sizes differ by one at most, the longer ones last."""
    n = edits + 1
    small, longer = length // n, length % n
    out, start = [], np.zeros_like(length)
    for i in range(n):
        size = small + (i >= n - longer)
        out.append((start, size))
        start = start + size
    return out


class _Lines:
    """Lines of a block of texts, with hashes of any of their substrings."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, where, data = texts.buffers()
        offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(self.data)
        breaks = np.flatnonzero(self.data == 10)
        self.start = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
        self.end = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
        # A break at the very end of a text, or an empty text, leaves an empty line; order keeps them paired.
        self.text = np.repeat(np.arange(len(texts)), np.add.reduceat(np.concatenate((self.data == 10, [False])), offsets[:-1]) * (np.diff(offsets) > 0) + 1) if len(texts) else np.zeros(0, int)
        self.number = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)
        # Parity of the bytes in 32 buckets (low half) and of the byte pairs in 32 buckets (high half).
        one = U(1) << (_RAW[self.data] & U(31))
        two = U(1) << (mix(_RAW[self.data[:-1]] * U(3) + _RAW[self.data[1:]]) & U(31)) + U(32)
        self.ones = np.concatenate((np.zeros(1, U), np.bitwise_xor.accumulate(one)))
        self.pairs = np.concatenate((np.zeros(1, U), np.bitwise_xor.accumulate(two)))
        up, self.down = _power(n + 1)
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(_RAW[self.data] * up[:n], dtype=U)))

    def parity(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """One edit turns at most 2 bits of the low half and 4 of the high half (of a text of some length)."""
        return self.ones[low] ^ self.ones[high] ^ self.pairs[low] ^ self.pairs[high - 1]

    def hashed(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(U))


def _occurrences(least: int, shortest: int):
    """(line, doc, text, number) of the lines from `least` bytes on, and of those from `shortest` that are not blank."""

    def run(batches):
        for batch in batches:
            docs, texts = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for low, high in blocks(batch.column(1)):
                x = _Lines(batch.column(1).slice(low, high - low))
                on = _counted(x, least, shortest)
                yield pa.RecordBatch.from_arrays([pa.array(x.hashed(x.start[on], x.end[on]).astype(np.int64)), pa.array(docs[low:high][x.text[on]]), pa.array(texts[low:high][x.text[on]]), pa.array(x.number[on].astype(np.int32))], names=["line", "doc", "text", "number"])

    return lean(run)


def _counted(x: _Lines, least: int, shortest: int) -> np.ndarray:
    seen = np.concatenate(([0], np.cumsum(~_SPACE[x.data])))
    size = x.end - x.start
    return np.flatnonzero((size >= least) | ((size >= shortest) & (seen[x.end] > seen[x.start])))


def _keys(least: int, edits: int):
    """(key, line, parity, probe): a line's segments, and what it looks for among other lines' segments."""

    def run(batches):
        sent = np.zeros(0, U)  # sorted; a line that comes again in this task is not sent again
        for batch in batches:
            for low, high in blocks(batch.column(0)):
                x = _Lines(batch.column(0).slice(low, high - low))
                on = np.flatnonzero(x.end - x.start >= least)
                line, one = np.unique(x.hashed(x.start[on], x.end[on]), return_index=True)
                new = ~np.isin(line, sent, assume_unique=True)
                line, one = line[new], one[new]
                sent = np.union1d(sent, line) if len(sent) < _SEEN else line
                start, end = x.start[on][one], x.end[on][one]
                n, parity = end - start, x.parity(start, end)
                keys, lines, parities, probes = [], [], [], []

                def put(at, size, length, segment, which, probe):
                    key = mix(x.hashed(at, at + size) ^ mix((length * 16 + segment).astype(U)))
                    keys.append(key)
                    lines.append(line[which])
                    parities.append(parity[which])
                    probes.append(np.full(len(key), probe))

                every = np.arange(len(line))
                for short in range(edits + 1):
                    length = n - short
                    for i, (p, size) in enumerate(_segments(length, edits)):
                        if not short:
                            put(start + p, size, length, i, every, False)
                        first = max(-i, short - (edits - i))
                        for shift in range(first, min(i, short + edits - i) + 1):
                            fits = np.flatnonzero((p + shift >= 0) & (p + shift + size <= n))
                            put((start + p + shift)[fits], size[fits], length[fits], i, fits, True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(lines).astype(np.int64)), pa.array(np.concatenate(parities).astype(np.int64)), pa.array(np.concatenate(probes).astype(bool))], names=["key", "line", "parity", "probe"])

    return lean(run)


def _alike(p: np.ndarray, q: np.ndarray, edits: int) -> np.ndarray:
    """What `edits` edits at most can turn: false only if the lines are further apart."""
    turned = p ^ q
    return (np.bitwise_count(turned & 0xFFFFFFFF) <= 2 * edits) & (np.bitwise_count(turned.view(U) >> U(32)) <= 4 * edits)


def _expanded(left: np.ndarray, right: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all pairs within groups that begin at `first` with `left` rows, followed by `right` rows."""
    many = left * right
    group = np.repeat(np.arange(len(first)), many)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first[group] + k // right[group], first[group] + left[group] + k % right[group]


def _meet(edits: int, most: int):
    """Keys, sorted, to (hot, a, b, parity, probe): pairs of lines; hot: key and line of a key with more pairs."""

    def run(batches):
        open_ = None  # the key whose run came in pieces
        for t, _ in runs(batches, cap=1 << 18):
            key, line, parity = (np.asarray(t.column(k)) for k in range(3))
            probe = np.asarray(t.column(3)).astype(bool)
            same = (key[1:] == key[:-1]) & (probe[1:] == probe[:-1]) & (line[1:] == line[:-1])
            one = np.flatnonzero(np.concatenate(([True], ~same)))
            key, line, parity, probe = key[one], line[one], parity[one], probe[one]
            cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            probes = np.add.reduceat(probe.astype(np.int64), cut[:-1])
            first, left = cut[:-1], np.diff(cut) - probes
            hot = left * probes > most
            if len(t) >= 1 << 18 and len(first) == 1:
                hot[:] = True
                open_ = key[0]
            hot |= key[first] == open_ if open_ is not None else False
            pairs = np.flatnonzero(~hot & (left > 0) & (probes > 0) & (left + probes > 2))
            x, y = _expanded(left[pairs], probes[pairs], first[pairs])
            on = np.flatnonzero((line[x] != line[y]) & _alike(parity[x], parity[y], edits))
            a, b = np.minimum(line[x[on]], line[y[on]]), np.maximum(line[x[on]], line[y[on]])
            a, b = np.unique(np.stack((a, b)), axis=1) if len(a) else (a, b)
            rest = np.flatnonzero(np.repeat(hot, np.diff(cut)))
            n, m = len(a), len(rest)
            columns = [np.repeat([False, True], (n, m)), np.concatenate((a, key[rest])), np.concatenate((b, line[rest])), np.concatenate((np.zeros(n, np.int64), parity[rest])), np.concatenate((np.zeros(n, bool), probe[rest]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hot", "a", "b", "parity", "probe"])

    return lean(run)


def _chosen(least: int, bitmap: np.ndarray):
    """(line, bytes) of the lines whose bit is set, once in each block."""

    def run(batches):
        for batch in batches:
            for low, high in blocks(batch.column(0)):
                x = _Lines(batch.column(0).slice(low, high - low))
                on = np.flatnonzero(x.end - x.start >= least)
                line = x.hashed(x.start[on], x.end[on])
                bit = line & U((1 << _BITS) - 1)
                keep = np.flatnonzero((bitmap[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1))
                line, one = np.unique(line[keep], return_index=True)
                on = on[keep][one]
                raw = x.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(line.astype(np.int64)), pa.array([raw[a:b] for a, b in zip(x.start[on].tolist(), x.end[on].tolist(), strict=True)], pa.binary())], names=["line", "bytes"])

    return lean(run)


def within(a: bytes, b: bytes, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: columns of a band around the diagonal as bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    low, high = 0, len(a)  # common prefix, by bisection
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)  # common suffix
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a:
        return len(b) <= edits
    # b runs down the rows, a along the columns.  Bit r of column j is row j - up + r.
    m, width = len(b), 3 * edits + 2
    up, mask = width - 1 - edits, (1 << width) - 1
    where: dict[int, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, last = mask & ~((1 << up) - 1), 0, 1 << (width - 1)
    score = edits  # of the band's lowest cell, then of the lowest row
    for j, c in enumerate(a, 1):
        shift = j - up - 1
        found = where.get(c, 0)
        equal = (found >> shift if shift >= 0 else found << -shift) & mask
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & mask
        right, left = (minus | ~(zero | plus)) & mask, zero & plus
        if j + edits <= m:
            score += not zero & last
        else:
            row = 1 << (m - j + up)
            score += bool(right & row) - bool(left & row)
        if score > 2 * edits + 1:
            return False
        plus, minus = (left | ~((zero >> 1) | right)) & mask, (zero >> 1) & right
    return score <= edits


def _verified(edits: int):
    def run(batches):
        for batch in batches:
            keep = [within(a, b, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def _cells(edits: int):
    """Blocks of a hot key, (cell, probe, line, parity, bytes) in order of first occurrence within a cell, to
    (a, b): for each line the first earlier one on the other side that is within `edits`."""

    def run(batches):
        for t, cut in runs(batches):
            line, parity = np.asarray(t.column(2)), np.asarray(t.column(3))
            probe = np.asarray(t.column(1)).astype(bool)
            out = []
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                raw = t.column(4).slice(low, high - low).to_pylist()
                bags = np.stack([np.bincount(np.frombuffer(r, np.uint8), minlength=256) for r in raw]).astype(np.int32)
                for side in (False, True):
                    other = np.flatnonzero(probe[low:high] != side)
                    for k in np.flatnonzero(probe[low:high] == side).tolist():
                        earlier = other[: np.searchsorted(other, k)]
                        near = earlier[_alike(parity[low + earlier], parity[low + k : low + k + 1], edits) & (line[low + earlier] != line[low + k])]
                        near = near[np.abs(bags[near] - bags[k]).sum(1) <= 2 * edits]
                        found = next((j for j in near.tolist() if within(raw[j], raw[k], edits)), None)
                        if found is not None:
                            out.append((line[low + found], line[low + k]))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lean(run)


def _within_hot_keys(spark: SparkSession, hot: DataFrame, lines: DataFrame, first: DataFrame, edits: int) -> DataFrame:
    """(a, b) for the lines of keys with many pairs; a cell is a block of segments against a block of probes."""
    rows = staged(spark, hot.join(lines, "line").join(first.select("line", "at"), "line").select("key", "probe", "line", "parity", "bytes", "at"))
    side = rows.groupBy("key", "probe").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("bytes")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    # A side that holds one line of a key alone has a partner on the other side, or the key would not be here.
    sides = side.groupBy("key").agg(F.max(F.when(~F.col("probe"), F.col("blocks"))).alias("left"), F.max(F.when(F.col("probe"), F.col("blocks"))).alias("right")).where("left is not null and right is not null")
    rows = rows.join(sides, "key")
    own = F.pmod(F.xxhash64("line"), F.when(F.col("probe"), F.col("right")).otherwise(F.col("left")))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("left")).otherwise(F.col("right")) - 1)))
    cell = F.xxhash64("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("own")), F.when(F.col("probe"), F.col("own")).otherwise(F.col("other")))
    rows = rows.select(cell.alias("cell"), "probe", "line", "parity", "bytes", "at")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "at").drop("at")
    return rows.mapInArrow(_cells(edits), "a long, b long")


def repeats(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, shortest: int | None = None, most: int = PAIRS) -> DataFrame:
    """(doc, text, gone): for each id and text hash with any, the numbers (from 0) of its lines that repeat an
    earlier line.

    Earlier: by id, then text hash, then line number, of first occurrences.  A line goes if it is not the first
    occurrence of its bytes, or if a line within `edits` occurs first before it does.  Lines under `least` bytes
    have no part in the second, and under `shortest` (`least` if None) or blank stay.
    """
    small_batches(spark)
    docs = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).where("doc is not null and text is not null")
    seen = staged(spark, docs.mapInArrow(_occurrences(least, least if shortest is None else shortest), "line long, doc long, text long, number int"))
    first = staged(spark, seen.groupBy("line").agg(F.min(F.struct("doc", "text", "number")).alias("at"), F.count("*").alias("f")))
    keys = docs.select("text").mapInArrow(_keys(least, edits), "key long, line long, parity long, probe boolean")
    met = staged(spark, keys.repartition("key").sortWithinPartitions("key", "probe", "line").mapInArrow(_meet(edits, most), "hot boolean, a long, b long, parity long, probe boolean"))
    pairs = staged(spark, met.where("not hot").select("a", "b").distinct())
    hot = met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("line"), "parity", "probe")
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b")).union(hot.select("line"))
    bit = F.col("line").bitwiseAND((1 << _BITS) - 1)
    marks = wanted.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(line & 63 as int))").alias("mark")).groupBy("word").agg(F.bit_or("mark").alias("mark"))
    bitmap = np.zeros(1 << (_BITS - 6), np.int64)
    for word, mark in marks.collect():  # at most 2 ** (_BITS - 6) rows
        bitmap[word] = mark
    lines = staged(spark, docs.select("text").mapInArrow(_chosen(least, bitmap.view(U)), "line long, bytes binary").dropDuplicates(["line"]))
    pairs = pairs.join(lines.select(F.col("line").alias("a"), F.col("bytes").alias("ba")), "a").join(lines.select(F.col("line").alias("b"), F.col("bytes").alias("bb")), "b")
    near = pairs.select("a", "b", "ba", "bb").mapInArrow(_verified(edits), "a long, b long")
    if not hot.isEmpty():
        near = near.union(_within_hot_keys(spark, hot, lines, first, edits)).distinct()
    near = staged(spark, near)
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    earliest = both.join(first.select(F.col("line").alias("b"), F.col("at").alias("other")), "b").groupBy(F.col("a").alias("line")).agg(F.min("other").alias("other"))
    told = staged(spark, first.join(earliest, "line", "left").select("line", F.when(F.col("other") < F.col("at"), None).otherwise(F.col("at")).alias("at"), "f", F.coalesce(F.col("other") < F.col("at"), F.lit(False)).alias("late")).where("f > 1 or late"))
    gone = seen.join(told, "line").where("late or doc <> at.doc or text <> at.text or number <> at.number")
    gone = staged(spark, gone.groupBy("doc", "text").agg(F.array_sort(F.collect_set("number")).alias("gone")))
    discard(spark, seen, first, met, lines, near, told)
    return gone


def without_repeats(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, shortest: int | None = None, removed: str = "n_removed") -> DataFrame:
    """`docs`, each row as it is but for the lines that repeat an earlier one, with their number beside it in
    the column `removed` (which `docs` must not have).

    Rows with null id or text, and texts without such lines, are untouched; a text may be left empty, its row
    stays.  Rows of one id with different texts are rows like any others.  Of rows equal in id and text the
    first is treated so, the others lose all lines that count (those not blank, from `shortest` bytes on).
    """
    if removed in docs.columns:
        raise ValueError(f"the table has a column {removed} already")
    shortest = least if shortest is None else shortest
    key, hash, many, nth = "__doc", "__text", "__gone", "__nth"
    # Dealt by id at every size, so that plans do not change with the input.
    gone = repeats(spark, docs, id, text, edits, least, shortest).toDF(key, hash, many)
    whole = docs.where(F.col(id).isNotNull() & F.col(text).isNotNull())
    mine = [F.col(id).cast("long"), F.xxhash64(text)]
    joined = whole.join(gone.hint("merge"), (mine[0] == F.col(key)) & (mine[1] == F.col(hash)), "left")
    joined = joined.withColumn(nth, F.row_number().over(Window.partitionBy(*mine).orderBy(F.lit(0))))
    counted = lambda line: (F.octet_length(line) >= least) | ((F.octet_length(line) >= shortest) & line.rlike(r"[^\x20\x09-\x0D]"))
    split = F.split(F.col(text), "\n", -1)
    stay = F.when(F.col(nth) > 1, F.filter(split, lambda line: ~counted(line))).when(F.col(many).isNotNull(), F.filter(split, lambda _, i: ~F.array_contains(F.col(many), i)))
    n = F.when(F.col(nth) > 1, F.size(F.filter(split, counted))).otherwise(F.coalesce(F.size(many), F.lit(0)))
    names = [F.coalesce(F.array_join(stay, "\n"), F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns]
    untouched = docs.where(F.col(id).isNull() | F.col(text).isNull()).withColumn(removed, F.lit(0))
    return joined.select(*names, n.alias(removed)).union(untouched)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), shortest=1).select("doc_id", "text", "n_removed")


def fewer_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: the documents with their first occurrences only; n_chars follows the text."""
    removed = "__removed"
    out = without_repeats(spark, docs, shortest=1, removed=removed).withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
