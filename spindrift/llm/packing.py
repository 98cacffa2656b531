"""Packing documents into sequences by cutting-stock column generation.

1. Every whole text is turned into ids (plus the end id) on the executors and cut into pieces of
   `SEQUENCE` ids and one remainder.
2. Piece lengths, rounded up to `STEP` ids, form a histogram of at most SEQUENCE / STEP classes: the only
   thing that the driver sees.
3. Linear program: cover the histogram by as few patterns (multisets of classes that fit one sequence) as
   possible.  Columns are priced by a knapsack dynamic program under the current duals.
4. The solution is rounded down.  Pieces are ranked within their class (in salted groups, whose sizes give
   the offsets), and ranks are assigned to the patterns' slots.  What rounding leaves, less than one pattern
   each, is placed first-fit by falling length.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import lean, small_batches, staged, table
from ._text import _VALUE, U, _power, blocks, mix

SEQUENCE = 2048
STEP = 4
END_ID = 1
_UNITS = 1_200_000  # distinct units whose ids a worker remembers

# Classes of bytes: white space, letters (ASCII, and the Latin-1 letters behind \xC3), digits, signs.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
# Bytes that make the tokenizer look at the whole stretch between white space: the apostrophe of its
# contractions, the start of its own marks, control bytes, and characters beyond Latin-1 letters.
_HARD = np.zeros(256, bool)
_HARD[[*range(9), *range(14, 32), 39, 60, 127, 0x97, 0xB7, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own, with the ids of repeated units remembered.

    A unit is a run of letters, digits or signs, or a whole stretch between white space if that has a hard
    byte.  Holds for tokenizers that lower-case, drop white space, never let a word span white space, split
    letters from signs, and run a byte-level BPE model on each word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ...
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)  # unit k has the ids flat[at[k]:at[k + 1]]

    def _unit(self, unit: str, run: bool) -> list[int]:
        if not run:
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        unit = unit.lower()
        if not unit.isascii():
            unit = "".join(map(self.letters.__getitem__, unit.encode()))
        return [t.id for t in self.model.tokenize(unit)]

    def _learn(self, keys: list[int], units: list[tuple[str, bool]]) -> None:
        found: list[int] = []
        ends, done = [], len(self.known)
        for unit, run in units:
            found.extend(self._unit(unit, run))
            ends.append(len(found))
        self.known.update(zip(keys, range(done, done + len(keys)), strict=True))
        base = int(self.at[done])
        self.at = _grown(self.at, done + len(keys) + 1)
        self.at[done + 1 : done + len(keys) + 1] = base + np.array(ends)
        self.flat = _grown(self.flat, base + len(found))
        self.flat[base : base + len(found)] = found

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the place of each text's first, with one more for the end."""
        if len(self.known) > _UNITS:
            self.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, where, data = texts.buffers()
        offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        kind = _CLASS[data]
        cut = np.ones(n + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        gap = np.zeros(n + 1, bool)  # a stretch begins
        gap[offsets] = True
        gap[1:-1] |= (kind[1:] == 0) != (kind[:-1] == 0)
        gap[[0, n]] = True
        cut |= gap
        stretch = np.flatnonzero(gap)
        hard = np.logical_or.reduceat(_HARD[data], stretch[:-1])
        if hard.any():
            inside = np.repeat(hard, np.diff(stretch))
            cut[:-1] &= ~inside | gap[:-1]
        bound = np.flatnonzero(cut)
        low, high = bound[:-1], bound[1:]
        real = kind[low] > 0
        low, high = low[real], high[real]
        up, down = _power(n + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(_VALUE[data] * up[:n], dtype=U)))
        keys = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(U))
        keys, one, index = np.unique(keys, return_index=True, return_inverse=True)
        keys = keys.tolist()
        place = list(map(self.known.get, keys))
        new = [k for k, x in enumerate(place) if x is None]
        if new:
            raw = data.tobytes()
            at = one[new]
            whole = hard[np.searchsorted(stretch, low[at], "right") - 1] | (kind[low[at]] == 2)
            self._learn([keys[k] for k in new], [(raw[a:b].decode(), not h) for a, b, h in zip(low[at].tolist(), high[at].tolist(), whole.tolist(), strict=True)])
            place = list(map(self.known.get, keys))
        begin = self.at
        place = np.asarray(place, np.int64)
        first, size = begin[place][index], (begin[place + 1] - begin[place])[index]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1])] if len(ends) else np.zeros(0, np.uint32)
        return ids, np.concatenate(([0], ends))[np.searchsorted(low, offsets)]


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate((x, np.zeros(max(n - len(x), len(x)), x.dtype)))


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process, whatever the number of tasks."""
    kept = sys.modules.setdefault("_spindrift_kept", types.ModuleType("_spindrift_kept"))
    if path not in (all_ := kept.__dict__.setdefault("encoders", {})):
        all_[path] = Encoder(path)
    return all_[path]


def _pieces(path: str, sequence: int, end_id: int):
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        encode = _encoder(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in blocks(texts):
                out = []
                ids, first = encode(texts.slice(low, high - low))
                for k, doc in enumerate(docs[low:high]):
                    mine = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(mine), sequence):
                        part = mine[at : at + sequence]
                        out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(mine)))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return lean(run)


def _greedy(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first feasible basis: fill a pattern with the largest sizes left, use it until one of them is gone.

    Each pattern uses up one size and holds none that went before, so the basis is triangular.
    """
    n, left = len(size), demand.copy()
    basis, x, open_ = np.zeros((n, n)), np.zeros(n), np.ones(n, bool)
    while open_.any():
        column, free = np.zeros(n), room
        for k in np.flatnonzero(open_)[::-1]:
            if size[k] <= free:
                column[k] = free // size[k] if left[k] >= free // size[k] else max(1, int(left[k]))
                free -= int(column[k]) * size[k]
        on = np.flatnonzero(column)
        ratio = left[on] / column[on]
        k = on[int(ratio.argmin())]
        basis[:, k], x[k] = column, ratio.min()
        left = np.maximum(left - x[k] * column, 0)
        left[k], open_[k] = 0, False
    return basis, x


def patterns(demand: np.ndarray, room: int, rounds: int = 3000, near: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Column generation for the cutting-stock program.

    demand[k] pieces of size k + 1 (under or equal to `room`).  Returns the basic patterns (a count for each
    size) with their fractional uses; the uses cover the demand exactly.  Pricing ends at optimality, within
    `near` of the dual bound, or after `rounds` columns: each of these leaves a feasible solution.
    """
    size = np.flatnonzero(demand) + 1
    n, d = len(size), demand[size - 1].astype(float)
    basis, x = _greedy(size, d, room)
    inverse = np.linalg.inv(basis) if n else basis
    for _ in range(rounds if n else 0):
        dual = inverse.sum(0)
        best, pick = np.zeros(room + 1), np.full(room + 1, -1)
        for w in range(1, room + 1):  # unbounded knapsack; -1 leaves a unit empty
            fits = np.searchsorted(size, w, "right")
            best[w] = best[w - 1]
            if fits:
                value = best[w - size[:fits]] + dual[:fits]
                k = int(value.argmax())
                if value[k] > best[w] + 1e-12:
                    best[w], pick[w] = value[k], k
        if best[room] <= 1 + near:
            break
        column, w = np.zeros(n), room
        while w > 0:
            if pick[w] < 0:
                w -= 1
            else:
                column[pick[w]] += 1
                w -= size[pick[w]]
        move = inverse @ column
        up = np.flatnonzero(move > 1e-9)
        ratio = x[up] / move[up]
        out = up[int(ratio.argmin())]
        step = max(0.0, float(ratio.min()))
        x = x - step * move
        x[out] = step
        basis[:, out] = column
        row = inverse[out] / move[out]
        inverse = inverse - np.outer(move, row)
        inverse[out] = row
        if _ % 200 == 199:  # keep rounding errors small
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ d, 0)
    full = []
    for k in range(n):
        whole = np.zeros(room, np.int64)
        whole[size - 1] = basis[:, k].round().astype(np.int64)
        full.append((whole, float(max(x[k], 0))))
    return full


def plan(demand: np.ndarray, room: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots for ranks: (size, first rank, rank behind the last, first sequence, pieces a sequence), and the
    number of sequences.  Rank r of a size lies in sequence first + (r - first rank) // pieces."""
    slots, used, sequences = [], np.zeros(room, np.int64), 0
    for pattern, x in patterns(demand, room):
        on = np.flatnonzero(pattern)
        times = int(np.floor(x + 1e-6))
        if len(on):
            times = min(times, int(((demand[on] - used[on]) // pattern[on]).min()))
        if times <= 0 or not len(on):
            continue
        for k in on:
            slots.append((int(k) + 1, int(used[k]), int(used[k] + times * pattern[k]), sequences, int(pattern[k])))
            used[k] += times * pattern[k]
        sequences += times
    left = demand - used
    free: list[int] = []  # room in the sequences of this last part
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    for k in range(room - 1, -1, -1):
        size, rank, n = k + 1, int(used[k]), int(left[k])
        while n > 0:
            at = next((r for r in range(size, room + 1) if by_room[r]), None)  # tightest that fits
            if at is None:
                free.append(room)
                by_room[room].append(len(free) - 1)
                at = room
            s = by_room[at].pop()
            take = min(n, at // size)
            slots.append((size, rank, rank + take, sequences + s, take))
            by_room[at - take * size].append(s)
            rank, n = rank + take, n - take
    return slots, sequences + len(free)


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, step: int = STEP, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: `id`, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone.  Null and repeated ids are packed row by row like any other;
    equal pieces may trade places.  An empty table packs into nothing.  Other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    small_batches(spark)
    rows = docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text"))
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = rows.mapInArrow(_pieces(tokenizer, sequence, end_id), "doc long, start long, length long, ids_crc32 long, doc_tokens long")
    made = staged(spark, made.withColumn("size", F.ceil(F.col("length") / step).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc", "start", "ids_crc32"), F.lit(salts)).cast("int")))
    room = sequence // step
    groups = staged(spark, made.groupBy("size", "salt").count())
    demand = np.zeros(room, np.int64)
    for r in groups.groupBy("size").agg(F.sum("count").alias("n")).collect():  # at most `room` rows
        demand[r["size"] - 1] = r["n"]
    slots, _ = plan(demand, room)
    slots = spark.createDataFrame(slots, "size int, low long, high long, first long, each long")
    before = groups.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc", "start", "ids_crc32")) - 1
    # `before` has at most room * salts rows, `slots` a few for each of `room` patterns.
    at = made.withColumn("place", place).join(F.broadcast(before), ["size", "salt"]).withColumn("rank", F.col("before") + F.col("place"))
    at = at.join(F.broadcast(slots), "size").where("rank >= low and rank < high").withColumn("sequence_id", F.expr("first + (rank - low) div each"))
    earlier = Window.partitionBy("sequence_id").orderBy("size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return at.select(F.col("doc").alias(id), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def op4_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
