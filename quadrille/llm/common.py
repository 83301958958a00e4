"""Helpers shared by the corpus operators: shared scratch tables, code shipping, Arrow glue."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_scratch: dict[str, list[str]] = {}

#: ASCII white space, the only separator of words in these operators.
SPACE = "[\\x20\\x09-\\x0D]"


#: Rows of an Arrow batch where the session has Spark's default of 10000: texts are long, and a task holds a few batches at once.
BATCH_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; hold Arrow batches to BATCH_ROWS unless the session sets its own."""
    if spark.conf.get(_ROWS_KEY, "1") != spark.conf.get(_ROWS_KEY, "2"):  # not set: each default comes back
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quadrille-"), "quadrille_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared one. It goes with `clear_scratch`, at the latest when the driver's JVM ends in good order."""
    path = f"{shared_dir(spark)}/quadrille-{uuid.uuid4().hex[:12]}-{label}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p)
    store.deleteOnExit(p)
    return path


def scratch_mark(spark: SparkSession) -> int:
    """How many scratch folders were given out: where `clear_scratch` may begin."""
    return len(_scratch.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, since: int = 0, but_last: bool = False) -> None:
    """Delete the written tables of operator calls since a mark, or all but the last. Call it only when their results are no longer read."""
    conf = spark._jsc.hadoopConfiguration()
    paths = _scratch.get(spark.sparkContext.applicationId, [])
    gone = paths[since : len(paths) - but_last]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    paths[since:] = paths[since + len(gone) :]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written once with a key of each row whatever its doc_id; and the name of the key, one that docs does not use."""
    name, used = "_row", {c.lower() for c in docs.columns}
    while name in used:
        name += "_"
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(rows: DataFrame, key: str, gone: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs of those keyed rows that are not in gone (row)."""
    left = rows.join(materialise(gone.select(F.col("row").alias(key)), "gone"), key, "left_anti")
    return left.drop(key).select(*[f"`{c}`" for c in docs.columns])


def later_of_each(rows: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """row of the keyed rows in a group (labels: row, root) but the one of the smallest doc_id, null last; rows without a group are not in it."""
    named = rows.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id")).join(labels, "row")
    stay = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select(F.col("m.row").alias("row"))
    return labels.join(stay, "row", "left_anti").select("row")


def map_rows(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over just these columns."""
    ship(df.sparkSession)
    return df.select(*columns).mapInArrow(fn, schema)


def texts_of(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text of documents, null text as empty; then the key columns."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def by_id(df: DataFrame, parts: int, column: str) -> DataFrame:
    """df in `parts` partitions, that of a row given by a column of numbers from 0."""
    if hasattr(df, "repartitionById"):
        return df.repartitionById(parts, column)
    return df.repartition(parts, column)
