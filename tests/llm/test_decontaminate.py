import re

import duckdb

from quadrille.llm import decontaminate


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = set()
    for d, text in docs:
        have = grams(text)
        for i, item in items:
            need = grams(item)
            if need and len(need & have) * 5 >= len(need) * 4:
                out.add((d, i, len(need & have), len(need)))
    return out


def test_rows(spark):
    item = " ".join(f"i{k}" for k in range(34))
    few = item.split()
    rows = [
        (1, "Before it, " + item.upper() + "! after"),
        (2, " ".join(few[:24]) + " gap " + " ".join(few[24:])),
        (3, " ".join(few[:27])),
        (4, " ".join(few[:10])),
        (5, None),
        (6, ""),
        (7, "w " * 50_000 + item),
        (8, " ".join(few[:12] + ["x"] + few[12:20] + ["y"] + few[20:])),
        (1, "again " + item),
        (None, item),
        (9, "one two three four five"),
    ]
    items = [(10, item), (11, None), (12, "four words are few"), (13, "One, two, three, four, five."), (14, item)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, hash int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == brute(rows, items)
    assert {r[0] for r in got} >= {1, 2, 7, None, 9} and not {r[0] for r in got} & {4, 5, 6}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 == decontaminate.contaminated(docs, bench.limit(0)).count()
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {r[0] for r in got}


def test_short_items_and_stock_phrases(spark):
    stock = "which of the following statements is the right one here"
    items = [(n, f"{stock} a{n} b{n} c{n} d{n} e{n} f{n}") for n in range(30)] + [(100, "Zebra"), (101, "blue zebra, twice"), (102, " . "), (103, "two words")]
    rows = [(n, f"{stock} and other things {n}") for n in range(200)]
    rows += [(300, items[3][1]), (301, "a blue Zebra twice over"), (302, "zebras two"), (303, "two. words"), (None, "zebra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:4] for r in decontaminate.contaminated(docs, bench).collect()}
    want = brute(rows, items) | {(301, 100, 1, 1), (301, 101, 1, 1), (303, 103, 1, 1), (None, 100, 1, 1)}
    assert got == want and (300, 3, 12, 12) in got
    worded = bench.select("item_id", decontaminate.words(bench["text"]).alias("w"))
    held = decontaminate.sketches(worded).groupBy("hash").count().filter("count > 1").count()
    assert held == 0  # the phrase that all items share stands in no sketch


def test_sketches_reach_every_match(spark):
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n + 4))) for n in range(1, 70)], "item_id long, text string")
    rows = decontaminate.sketches(items.select("item_id", decontaminate.words(items["text"]).alias("w"))).groupBy("item_id").count().collect()
    for r in rows:
        n = r.item_id
        assert r["count"] >= n - -(-4 * n // 5) + 1 or r["count"] == n


def test_query_matches_sql_and_brute_force(spark, sf_dir):
    got = {tuple(r) for r in decontaminate.op1_decontaminate(spark, sf_dir).collect()}
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert got == set(duckdb.sql(decontaminate.SQL["op1_decontaminate"]).fetchall())
    read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    assert {g[:4] for g in got} == brute(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = decontaminate.op1_decontaminate(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
