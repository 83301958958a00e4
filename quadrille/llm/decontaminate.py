"""Benchmark decontamination: short test items found inside long documents. Native: DataFrame functions only.

Words are maximal runs of letters and digits, lower-cased; shingles are five consecutive words, and an item of fewer words has
one shingle of all of them. A document holds
an item if it contains at least 0.8 of the item's distinct shingles. Items are partitioned by size: within a class
of at most u shingles, a bottom-k MinHash sketch of k = u - ceil(0.8 u) + 1 hashes stands for the item. An
item with 0.8 of its shingles in a document lacks fewer than k of them, so at least one sketch hash is in it: the
search for sketch hashes among the documents' shingle hashes loses no document, however long. Any k shingles of an item have this
property, so hashes that many items share, or that one document in SAMPLE holds often, come last in the order of the sketch: a stock phrase makes
no candidates of the documents that have it while the item has rarer words. The candidates are
verified by the exact containment of the shingles themselves.

Both the sketches and the candidates are written tables of known size. Spark broadcasts them below
spark.sql.autoBroadcastJoinThreshold, and sorts and merges (with skew handling) above it.

Rows: null and empty texts have no shingles and match nothing. Repeated
rows and ids give one row for each pair of ids, with the highest containment. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm import common

WIDTH = 5
#: The containment looked for, as a fraction.
SHARE = (4, 5)
#: For the order of a sketch only: one document in SAMPLE is read for the shingles that are common.
SAMPLE = 64
_APART = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _APART), "")


def _starts(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """Hashes of the word shingles, repeats included."""
    return F.transform(_starts(w, width), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)]))


def shingles(w: Column, width: int = WIDTH) -> Column:
    """The distinct word shingles themselves."""
    return F.array_distinct(F.transform(_starts(w, width), lambda i: F.concat_ws(" ", F.slice(w, i, width))))


def short(w: Column, width: int = WIDTH) -> Column:
    """Whether all the words make one shingle of their own."""
    return (F.size(w) > 0) & (F.size(w) < width)


def sketch_size(n: Column, share: tuple[int, int] = SHARE) -> Column:
    """Hashes in the sketch of an item of n shingles, by its size class."""
    a, b = share
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    return upper - F.floor((upper * a + (b - 1)) / b).cast("int") + 1


def sketches(items: DataFrame, share: tuple[int, int] = SHARE, seen: DataFrame | None = None) -> DataFrame:
    """hash, item_id: the sketch of each item with five words or more; seen: hash, in_docs of common shingles."""
    sized = items.select("item_id", F.array_distinct(shingle_hashes(F.col("w"))).alias("hs")).withColumn("n", F.size("hs")).filter("n > 0")
    each = sized.select("item_id", "n", F.explode("hs").alias("hash"))
    each = each.join(each.groupBy("hash").agg(F.count("*").alias("in_items")), "hash")
    each = each.withColumn("in_docs", F.lit(0)) if seen is None else each.join(seen, "hash", "left")
    # counts by powers of two: within one the order is that of MinHash
    level = lambda c: F.floor(F.log2(F.coalesce(F.col(c), F.lit(0)) + F.lit(1.0)))
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(level("in_docs"), level("in_items"), "hash")))
    return placed.filter(F.col("place") <= sketch_size(F.col("n"), share)).select("item_id", "hash")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: the pairs at or above the share."""
    a, b = share
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the words are a column of their own: inside a lambda the expression would be evaluated for every shingle
    worded = texts.select("doc_id", words(F.col("text")).alias("w"))
    asked_for = items.select(F.explode(shingle_hashes(F.col("w"))).alias("hash")).distinct()
    sampled = worded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(shingle_hashes(F.col("w")))).alias("hash"))
    seen = sampled.join(asked_for, "hash").groupBy("hash").agg(F.count("*").alias("in_docs"))
    sketch = common.materialise(sketches(items, share, common.materialise(seen, "seen")), "sketches")
    probes = worded.select("doc_id", F.explode(shingle_hashes(F.col("w"))).alias("hash"))
    found = probes.join(sketch, "hash").select("doc_id", "item_id").distinct()
    # at most WIDTH - 1 lengths; a length that no item has costs nothing
    for n in sorted(r[0] for r in items.filter(short(F.col("w"))).select(F.size("w")).distinct().collect()):
        whole = items.filter(F.size("w") == n).select("item_id", shingle_hashes(F.col("w"), n)[0].alias("hash"))
        found = found.union(worded.select("doc_id", F.explode(shingle_hashes(F.col("w"), n)).alias("hash")).join(whole, "hash").select("doc_id", "item_id").distinct())
    candidates = common.materialise(found, "candidates")

    all_words = F.concat_ws(" ", "w")
    whole = items.select("item_id", F.when(short(F.col("w")), F.array(all_words)).otherwise(shingles(F.col("w"))).alias("item"), short(F.col("w")).alias("is_short"))
    asked = candidates.join(whole, "item_id").withColumnRenamed("doc_id", "_doc")
    held = worded.join(candidates.select(F.col("doc_id").alias("_any")).distinct(), F.col("doc_id").eqNullSafe(F.col("_any")), "left_semi")
    pairs = held.select("doc_id", shingles(F.col("w")).alias("doc"), F.concat(F.lit(" "), all_words, F.lit(" ")).alias("line")).join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")))
    within = F.col("line").contains(F.concat(F.lit(" "), F.get("item", 0), F.lit(" "))).cast("int")
    n_shared = F.when(F.col("is_short"), within).otherwise(F.size(F.array_intersect("item", "doc")))
    counted = pairs.select("doc_id", "item_id", n_shared.cast("long").alias("n_shared"), F.size("item").cast("long").alias("n_shingles"))
    found = counted.filter(F.col("n_shared") * b >= F.col("n_shingles") * a).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("m"))
    return found.select("doc_id", "item_id", "m.n_shared", "m.n_shingles", (F.col("m.n_shared") / F.col("m.n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item."""
    gone = common.materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable] = {"op1_decontaminate": op1_decontaminate}
SQL: dict[str, str] = {
    "op1_decontaminate": r"""
    with dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
    iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from benchmark),
    di as (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw),
    ii as (select item_id, w, unnest(range(1, len(w) - 3)) as i from iw),
    ds as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s from di),
    s as (select distinct item_id, array_to_string(w[i:i + 4], ' ') as s from ii),
    n as (select item_id, count(*) as n_shingles from s group by item_id),
    h as (select doc_id, item_id, count(*) as n_shared from ds join s using (s) group by doc_id, item_id)
    select doc_id, item_id, n_shared, n_shingles, cast(n_shared as double) / cast(n_shingles as double) as containment
    from h join n using (item_id) where n_shared * 5 >= n_shingles * 4
    """
}
