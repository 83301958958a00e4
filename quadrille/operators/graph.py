"""Connected components of an edge table, by contraction in rounds, and joins on keys that a large share of the rows may have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one row in HOT has it, so there are at most HOT of them; parts that its rows are dealt to.
HOT, SALTS = 1000, 64


def join_on_hot(many: DataFrame, one: DataFrame, key: str, within: str, how: str = "inner", rows: str | None = None) -> DataFrame:
    """many joined with one (unique in the column key): the rows of a hot key are dealt by the column within to SALTS tasks.

    rows: a column of one that counts the rows of the key in many, where it is known; it is dropped."""
    if rows is None:
        counted = many.groupBy(key).agg(F.count("*").alias("_rows"))
        n = many.count()
    else:
        counted = one.select(key, F.col(rows).alias("_rows"))
        n = one.agg(F.sum(rows)).first()[0] or 0
        one = one.drop(rows)
    hot = [r[0] for r in counted.filter(F.col("_rows") * HOT > n).select(key).filter(F.col(key).isNotNull()).collect()]
    if not hot:
        return many.join(one, key, how)
    is_hot = F.col(key).isin(hot)
    left = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(within), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, root for every node of the edges (u, v): equal roots for connected nodes.

    In each round a node moves to the first of itself and its neighbours, and edges follow their ends. Even rounds
    order nodes by value, which finishes stars at once; odd ones by a hash that differs each time, which shrinks any
    graph, long chains too, by a constant share. Aggregates combine a node with very many neighbours before the shuffle;
    joins deal its rows to many tasks. Rounds go on until no edge is left. cut (table, label) writes a table out and reads it back,
    which ends its lineage.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    now, labels, turn = cut(tidy(edges), "edges"), None, 0
    while True:
        both = now.union(now.select("v", "u")).toDF("node", "near")
        if turn % 2:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))
        else:
            rank = lambda c: F.struct(F.col(c).alias("h"), F.col(c).alias("n"))
        move = cut(both.groupBy("node").agg(F.min(rank("near")).alias("near")).select("node", F.least(rank("node"), F.col("near"))["n"].alias("to")), "move")
        if labels is None:
            labels = move.withColumnRenamed("to", "root")
        else:
            labels = cut(join_on_hot(labels, move.withColumnRenamed("node", "root"), "root", "node", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = join_on_hot(now, move.toDF("u", "nu"), "u", "v")
        ends = join_on_hot(ends, move.toDF("v", "nv"), "v", "u")
        now = cut(tidy(ends.select(F.col("nu").alias("u"), F.col("nv").alias("v"))), "edges")
        turn += 1
        if now.isEmpty():
            return labels
