"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

A document holds an item if it has at least 80 % of the item's distinct 5-word shingles
(an item of fewer words is one shingle of all its words).  A MinHash signature of a long
document can't show a short item, so the sketches are on the item side:

1. Items are partitioned by size: class c holds the items of up to u = 2^c shingles.
2. All items of a class share one sketch length k = floor(u / 5) + 1, from the upper size of
   the class as in containment LSH: an item keeps its k smallest shingle hashes (a bottom-k
   MinHash).  A document that lacks at most a fifth of the shingles has one of these k.
3. The shingle hashes of whole documents probe the sketches; hits are candidates.  The probe
   is a hash join inside one generated stage: no text is shuffled and nothing is missed.
4. Candidates are verified by exact containment of shingle strings.

Sketches, candidates and items are broadcast only while a count has shown them to have at
most `broadcast_rows` rows; beyond that the same joins run as shuffles.

Defined results: null and blank texts or items match nothing; a null doc_id matches like any
other; rows of one doc_id are told apart by a hash of their text, equal rows are reported once;
repeated items are items of their own; a text of any length is probed whole; at exactly the
threshold an item counts as held; an empty table on either side gives an empty result and keeps
all documents; `decontaminate` carries all other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, stored, table, words

SHINGLE = 5
THRESHOLD = 0.8


def _gram(array: Column, at: Column, length: int) -> list[Column]:
    return [F.get(array, at + k) for k in range(length)]


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item_id, length (words a shingle), shingles (distinct), n."""
    w = items.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("length", F.least(F.size("w"), F.lit(shingle)))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.array_join(F.slice("w", i, F.col("length")), " "))
    return w.select("item_id", "length", F.array_distinct(grams).alias("shingles")).withColumn("n", F.size("shingles"))


def sketches(items: DataFrame) -> DataFrame:
    """length, h, item_id: the bottom-k hashes of every item, k by the upper size of its class."""
    hashes = F.transform("shingles", lambda s: F.aggregate(F.split(s, " "), F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    k = (F.floor(upper / 5) + 1).cast("int")
    return items.select("item_id", "length", F.explode(F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)).alias("h"))


def _hash(array: Column, at: Column, length: int) -> Column:
    h = F.lit(0).cast("long")
    for word in _gram(array, at, length):
        h = F.xxhash64(h, word)
    return h


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, item_id, n_shared, n_shingles of every document and item that it holds."""
    if not 0.8 <= threshold <= 1:
        raise ValueError("the sketches are for thresholds of 0.8 and more")
    known = stored(item_shingles(items, shingle))
    probe = stored(sketches(known))
    lengths = sorted(r[0] for r in known.select("length").distinct().collect()) or [shingle]  # `shingle` values at most
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.lower("text")).alias("w")).where(F.size("w") >= lengths[0])
    # one scan for all lengths: a position gives a hash of every length that fits
    starts = rows.select("doc_id", "text_hash", "w", F.explode(F.sequence(F.lit(0), F.size("w") - lengths[0])).alias("at"))
    each = [F.struct(F.lit(n).alias("length"), F.when(F.col("at") + n <= F.size("w"), _hash(F.col("w"), F.col("at"), n)).alias("h")) for n in lengths]
    hashed = starts.select("doc_id", "text_hash", (F.explode(F.array(*each)) if len(each) > 1 else each[0]).alias("x")).select("doc_id", "text_hash", "x.*")
    hits = hashed.join(small(probe, broadcast_rows), ["length", "h"]).select("doc_id", "text_hash", "item_id")
    candidates = stored(hits.distinct())
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_hash") == F.col("c.text_hash"))
    pairs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d").join(small(candidates, broadcast_rows).alias("c"), same).select("d.*", "c.item_id")
    pairs = pairs.join(small(known, broadcast_rows), "item_id").select("doc_id", "text_hash", "item_id", "n", "length", "shingles", words(F.lower("text")).alias("w"))
    # positions are exploded, so that the words of a text are split once and not again for each of its shingles
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at")
    grams = pairs.select("doc_id", "text_hash", "item_id", "n", "shingles", "w", "length", at)
    grams = grams.select("doc_id", "text_hash", "item_id", "n", "shingles", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("gram"))
    shared = grams.where(F.array_contains("shingles", F.col("gram"))).groupBy("doc_id", "text_hash", "item_id", F.col("n").alias("n_shingles")).agg(F.countDistinct("gram").alias("n_shared"))
    return shared.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles")).select("doc_id", "text_hash", "item_id", "n_shared", "n_shingles")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of `docs` that hold no item."""
    bad = stored(contaminated(docs, items, broadcast_rows=broadcast_rows).select(F.col("doc_id").alias("id"), "text_hash").distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_hash"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash"))
    return packed.join(small(bad, broadcast_rows), same, "left_anti").select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles"))


OP4_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts
), placed AS (
  SELECT kind, id, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w
), grams AS (
  SELECT kind, id, n_words, i, list(word) OVER (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM placed
), items AS (
  SELECT DISTINCT id AS item_id, least(n_words, 5) AS k, array_to_string(g[1 : least(n_words, 5)], ' ') AS s
  FROM grams WHERE kind = 'b' AND len(g) >= least(n_words, 5)
), docs AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(g[1 : k], ' ') AS s
  FROM grams, (SELECT DISTINCT k FROM items) WHERE kind = 'd' AND len(g) >= k
), n AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM docs JOIN items USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles)
"""
