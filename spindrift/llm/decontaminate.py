"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are the runs of letters and digits of the lower-cased text.  A seed is a mask of positions; its hash at
a word covers the words under the mask only, so substitutions elsewhere do not change it.  The two masks of
`SEEDS` together are lossless: whichever two words of a passage of `WINDOW` are substituted, one of them still
hits.  Every position of every document is hashed and joined with the hashes of the benchmark.  A hit fixes
an alignment; it is verified word by word: a document is contaminated if, along an alignment, `WINDOW`
consecutive words of an item (all, if it has fewer) agree but for `SUBSTITUTIONS` (of fewer words: none).

The hash table of the benchmark is broadcast only up to `BROADCAST` rows; beyond that the join is dealt by
hash.  Documents are read twice, once for hits and once, if they have any, for the words around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import staged, table

# Found by exhaustive check over all pairs of substituted positions in 13 words.
SEEDS = ((0, 1, 2, 3, 7, 8), (0, 4, 6, 7, 8, 9))
WINDOW, SUBSTITUTIONS = 13, 2
BROADCAST = 500_000  # rows of 8 bytes


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null is no words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def seeded(rows: DataFrame, keep: Sequence[str], seeds: Sequence[Sequence[int]]) -> DataFrame:
    """(keep..., at, hash): one row for each word position of `words` and seed that fits there."""
    # Column k of the zipped array is the text shifted by k words; positions past the end are null.
    used = sorted({k for s in seeds for k in s})
    shifted = [F.col("words") if k == 0 else F.slice("words", k + 1, F.greatest(F.size("words") - k, F.lit(0))) for k in used]
    zipped = rows.select(*keep, F.posexplode(F.arrays_zip(*[c.alias(f"w{k}") for k, c in zip(used, shifted)])).alias("at", "w"))
    hashed = [F.when(F.col(f"w.w{s[-1]}").isNotNull(), F.xxhash64(F.lit(n), *[F.col(f"w.w{k}") for k in s])) for n, s in enumerate(seeds)]
    return zipped.select(*keep, "at", F.explode(F.array(*hashed)).alias("hash")).where("hash is not null")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc_id, item_ids): the documents that hold a passage of the benchmark, with the sorted items.

    Null ids take no part; null and empty texts, and items without words, match nothing.  Items shorter than
    the longest seed are compared as a whole, word by word.  Repeated rows count once.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item"), words_of(F.col(text)).alias("words")).where("item is not null and size(words) > 0")
    items = staged(spark, items.dropDuplicates())
    docs = docs.select(F.col(id).cast("long").alias("doc"), words_of(F.col(text)).alias("words")).where("doc is not null")
    short, long = items.where(F.size("words") < WINDOW), items.where(F.size("words") >= WINDOW)

    probes = staged(spark, seeded(long, ["item"], SEEDS).distinct())
    hashes = probes.select("hash").distinct()
    hashes = F.broadcast(hashes) if probes.count() <= BROADCAST else hashes
    found = seeded(docs, ["doc"], SEEDS).join(hashes, "hash", "left_semi")
    hits = found.join(probes.withColumnRenamed("at", "item_at"), "hash").select("doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = staged(spark, hits)

    texts = docs.join(hits.select("doc").distinct().hint("merge"), "doc", "left_semi").dropDuplicates()
    aligned = hits.join(texts, "doc").join(long.withColumnRenamed("words", "wanted"), "item")
    low, n = F.greatest(F.lit(0), -F.col("shift")), F.size("wanted")
    high = F.least(n, F.size("words") - F.col("shift"))  # item words low .. high - 1 lie within the document
    mine, theirs = F.slice("words", low + F.col("shift") + 1, high - low), F.slice("wanted", low + 1, high - low)
    same = F.zip_with(mine, theirs, lambda x, y: (x == y).cast("int"))
    aligned = aligned.where(high - low >= WINDOW).select("doc", "item", same.alias("same"))
    enough = F.exists(F.sequence(F.lit(1), F.size("same") - (WINDOW - 1)), lambda k: F.aggregate(F.slice("same", k, WINDOW), F.lit(0), lambda a, x: a + x) >= WINDOW - SUBSTITUTIONS)
    pairs = aligned.where(enough).select("doc", "item").distinct()

    # Items shorter than a window: all their words, in a row.
    if not short.isEmpty():
        n = [r[0] for r in short.select(F.size("words")).distinct().orderBy(F.size("words")).collect()]  # under WINDOW values
        for size in n:
            whole = tuple(range(size))
            wanted = seeded(short.where(F.size("words") == size), ["item"], [whole]).select("item", "hash").distinct()
            wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
            pairs = pairs.union(seeded(docs, ["doc"], [whole]).join(wanted, "hash").select("doc", "item").distinct())
    return pairs.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("item_ids")).select(F.col("doc").alias(id), "item_ids")


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: the documents without passages of the benchmark."""
    found = staged(spark, contaminated(spark, docs, benchmark).select("doc_id"))
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
