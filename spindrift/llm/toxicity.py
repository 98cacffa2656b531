"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and the 5-grams of `^word$`, hashed to `BUCKETS`
buckets.  The machine is fitted on at most `SAMPLE` labelled rows (those with the least hash of the id):
the buckets whose presence tells the classes apart best (chi square) become its features, with those that do
so only in pairs (`_paired`), and

    score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)

over the features present; the second sum is what lets an insult next to a group mention weigh more than
the two apart.  Every row is then scored from its whole text, a batch at a time; the model is a few hundred
kilobytes whatever the input.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import lean, small_batches, staged, table

BUCKETS = 1 << 20
FEATURES = 2048
RANK = 8
SAMPLE = 8_000  # labelled rows that a fit sees at most
GRAM = 5
LEAST_CHI2 = 12.0
PAIR_TERMS = 1024  # the terms tried in pairs: those whose presence varies most
PAIR_FEATURES = 256  # of them become features at most
LEAST_PAIR = 36.0  # squared standard errors of a pair's interaction; half a million pairs are tried
_CACHE = 50_000  # distinct words whose terms a worker remembers

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    buckets: np.ndarray  # sorted, of the features
    w0: float
    w: np.ndarray
    v: np.ndarray


def _terms(word: str) -> list[int]:
    ringed = f"^{word}$"
    grams = {ringed[k : k + GRAM] for k in range(len(ringed) - GRAM + 1)}
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (f"w {word}", *sorted(grams))]


def _presence(batches):
    """Distinct buckets of each text."""
    known: dict[str, list[int]] = {}
    for batch in batches:
        rows = []
        for text in batch.column(2).to_pylist():
            found: set[int] = set()
            for word in set(_WORD.findall((text or "").lower())):
                if (x := known.get(word)) is None:
                    x = _terms(word)
                    if len(known) < _CACHE:
                        known[word] = x
                found.update(x)
            rows.append(np.fromiter(found, np.int32, len(found)))
        where = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(where), pa.array(flat))], names=["id", "y", "terms"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _raw(flat, row, n, w0, w, v):
    """Score before the sigmoid, of n rows given as (row, feature) pairs, and the sums of the factors."""
    sums = np.stack([np.bincount(row, v[flat, k], n) for k in range(v.shape[1])], 1) if len(flat) else np.zeros((n, v.shape[1]))
    squares = np.bincount(row, (v[flat] ** 2).sum(1), n) if len(flat) else np.zeros(n)
    return w0 + (np.bincount(row, w[flat], n) if len(flat) else 0) + 0.5 * ((sums**2).sum(1) - squares), sums


def _paired(y: np.ndarray, flat: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets that tell something in pairs: the log odds of label 1 with both terms present are far from what
    the terms give one by one.  `a` and `b` count the rows of label 1 and 0 with each bucket."""
    n, p = len(y), float(y.sum())
    spread = (a + b) * (n - a - b)
    terms = np.sort(np.lexsort((np.arange(BUCKETS), -spread))[:PAIR_TERMS])
    terms = terms[spread[terms] > 0]
    at = np.full(BUCKETS, -1)
    at[terms] = np.arange(len(terms))
    keep = at[flat] >= 0
    flat, row = at[flat[keep]], row[keep]
    both = np.zeros((2, len(terms), len(terms)), np.float32)  # rows of label 0 and 1 with both terms
    for low in range(0, n, 512):
        some = slice(*np.searchsorted(row, (low, low + 512)))
        x = np.zeros((min(512, n - low), len(terms)), np.float32)
        x[row[some] - low, flat[some]] = 1
        for label in (0, 1):
            mine = x[y[low : low + 512] == label]
            both[label] += mine.T @ mine
    best = np.zeros(len(terms))
    for low in range(0, len(terms), 128):
        odds, error = 0.0, 0.0
        for label, one, rows, sign in ((1, a[terms], p, 1), (0, b[terms], n - p, -1)):
            c11 = both[label, low : low + 128]
            i, j = one[low : low + 128, None], one[None, :]
            cells = [x + 0.5 for x in (c11, i - c11, j - c11, rows - i - j + c11)]
            odds = odds + sign * (np.log(cells[0]) - np.log(cells[1]) - np.log(cells[2]) + np.log(cells[3]))
            error = error + sum(1 / x for x in cells)
        gain = odds**2 / error
        gain[np.arange(len(gain)), np.arange(low, low + len(gain))] = 0  # a term with itself
        best[low : low + 128] = gain.max(1, initial=0)
    order = np.lexsort((terms, -best))[:PAIR_FEATURES]
    return terms[order[best[order] >= LEAST_PAIR]]


def fit(y: np.ndarray, flat: np.ndarray, lengths: np.ndarray, epochs: int = 30, step: float = 0.05, decay: float = 1e-3) -> Model:
    """Fit on rows with labels `y` and their buckets laid end to end.  One class only: its rate, for all."""
    n, row = len(y), np.repeat(np.arange(len(y)), lengths)
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 0.0
    start = float(np.log(rate / (1 - rate))) if n else -30.0
    if not n or y.min() == y.max():
        return Model(np.zeros(0, np.int64), start, np.zeros(0), np.zeros((0, RANK)))
    p, q = float(y.sum()), float(n - y.sum())
    a, b = np.bincount(flat, y[row], BUCKETS), np.bincount(flat, 1 - y[row], BUCKETS)
    with np.errstate(all="ignore"):
        chi2 = np.nan_to_num(n * (a * (q - b) - b * (p - a)) ** 2 / (p * q * (a + b) * (n - a - b)), posinf=0)
        chi2 = np.where((a + b == n) | (a + b < 3), 0, chi2)
    best = np.lexsort((np.arange(BUCKETS), -chi2))[:FEATURES]
    best = np.union1d(best[chi2[best] >= LEAST_CHI2], _paired(y, flat, row, a, b))
    at = np.full(BUCKETS, -1)
    at[best] = np.arange(len(best))
    keep = at[flat] >= 0
    flat, row = at[flat[keep]], row[keep]
    order = np.argsort(row, kind="stable")
    flat, row = flat[order], row[order]
    first = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(7)
    w0, w, v = start, np.zeros(len(best)), rng.normal(0, 0.01, (len(best), RANK))
    m1, m2, t = np.zeros((len(best), RANK + 1)), np.zeros((len(best), RANK + 1)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            size = first[rows + 1] - first[rows]
            mine = np.repeat(np.arange(len(rows)), size)
            f = flat[np.repeat(first[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            z, sums = _raw(f, mine, len(rows), w0, w, v)
            err = (_sigmoid(z) - y[rows]) / len(rows)
            g = np.zeros((len(best), RANK + 1))
            each = np.concatenate((err[mine, None], err[mine, None] * (sums[mine] - v[f])), 1)
            for k in range(RANK + 1):
                g[:, k] = np.bincount(f, each[:, k], len(best))
            g[:, 0] += decay * w / len(rows)
            g[:, 1:] += decay * v
            t += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            move = step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            w, v = w - move[:, 0], v - move[:, 1:]
            w0 -= step * err.sum()
    return Model(best, float(w0), w, v)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of `labels` joined with their texts (null labels and texts: skipped)."""
    small_batches(spark)
    chosen = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = staged(spark, chosen.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    # `chosen` has at most `sample` rows of 12 bytes.
    found = rows.join(F.broadcast(chosen), "id").select("id", "y", "text")
    got = found.mapInArrow(lean(_presence), "id long, y int, terms array<int>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    terms = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lengths = np.asarray(pc.list_value_length(terms), np.int64)
    return fit(np.asarray(got["y"], np.float64), np.asarray(pc.list_flatten(terms), np.int64), lengths)


def _score(model: Model):
    def run(batches):
        at = {int(b): k for k, b in enumerate(model.buckets)}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            flat: list[int] = []
            size = []
            for text in batch.column(1).to_pylist():
                found: set[int] = set()
                for word in set(_WORD.findall(text.lower())) if text else ():
                    x = known.get(word)
                    if x is None:
                        x = tuple(at[b] for b in _terms(word) if b in at)
                        if len(known) < _CACHE:
                            known[word] = x
                    if x:
                        found.update(x)
                flat.extend(sorted(found))
                size.append(len(found))
            n = len(size)
            z, _ = _raw(np.array(flat, np.int64), np.repeat(np.arange(n), size), n, model.w0, model.w, model.v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z + np.zeros(n)))], names=["doc", "score"])

    return lean(run)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score) for each row; a null or empty text gets the score of no terms."""
    return docs.select(F.col(id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_score(model), "doc long, score double")


def held_out(id: str):
    """Rows that no model may learn from: crc32 of the id as text, modulo 5, is 0.  A null id is held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs`: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only labelled rows that are not held out are learned from.  Empty, null and very long texts are scored
    like any other; repeated rows get equal scores; without usable labels every score is the label rate
    (0 if there are none).  Other columns of `docs` and `labels` are ignored, whatever their names.
    """
    model = train(spark, docs, labels.where(~held_out("doc_id")))
    return score(docs, model).select(F.col("doc").alias("doc_id"), held_out("doc").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def harmless(docs: DataFrame, model: Model, at: float = 0.5) -> DataFrame:
    """Pipeline stage: the rows of `docs` that score under `at`, as they are (columns doc_id and text)."""
    rate = _score(model)

    def run(batches):
        for batch in batches:
            # The score is used where it is made, so that no join has to find its row again.
            two = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text")], names=["doc", "text"])
            for out in rate([two]):
                yield batch.filter(pc.less(out.column(1), at))

    return docs.mapInArrow(lean(run), docs.schema)
