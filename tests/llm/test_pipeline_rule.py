"""The pipeline against plain code by the rule of its near-dedup stage (five words, Jaccard 0.8), and on awkward rows and tables."""

import pyarrow as pa
import pytest

import corpus_pipeline
from quadrille.llm import bpe, quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact import brute as exact_groups
from tests.llm.test_near import brute_kept


def test_run_against_plain_code_with_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    logit, bias = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r, s in zip(rows, quality.scores(pa.array([t for _, t in rows]), logit, bias), strict=True) if s >= quality.KEEP]
    stay = {keep for _, keep, _, _ in exact_groups(rows)}
    rows = [r for r in rows if r[0] in stay]
    rows = [rows[i] for i in brute_kept(rows)[0]]
    gone = {d for d, *_ in leaks(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    codec = bpe.Codec.load(*bpe.public_vocabulary())
    want = {i: codec.encode(t) for i, t in rows if i not in gone}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)


ITEM = "which five little words make up this test item of the benchmark table here"


def tables(spark, folder, rows, labels=(), items=()):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2, 3.0, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string, root int, N_Tokens double, hash string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "KEEP", 0.0)
    monkeypatch.setattr(quality.drop_rejected, "__defaults__", (0.0,))
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long.replace("w7 ", "x ")), (6, "one two three four five six seven"), (6, "one two three four five six seven"), (None, "no id at all, but words enough to count"), (None, None), (7, f"before {ITEM} after"), (8, "another text that stands alone in this table")]
    folder, docs = tables(spark, tmp_path, rows, [(4, 1, 0), (8, 0, 0), (None, None, None)], [(1, ITEM), (2, None), (3, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    got = corpus_pipeline.run(spark, folder)
    assert [c for c in got.columns if c.lower() == "n_tokens"] == ["n_tokens"] and {"_row", "root", "hash"} <= set(got.columns)
    left = got.collect()
    # of empty texts the longest stays, of the near copies the first
    assert sorted((r.doc_id for r in left), key=str) == sorted([3, 4, 6, None, 8], key=str)
    assert all(r.round_trip and r._row == "x" and r.root == 2 for r in left)


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, monkeypatch, empty):
    monkeypatch.setattr(quality.drop_rejected, "__defaults__", (0.0,))
    rows = [] if empty == "documents" else [(1, "some words that make a text"), (2, f"has {ITEM} in it")]
    labels = [] if empty == "labels" else [(1, 1, 0), (2, 0, 0)]
    folder, _ = tables(spark, tmp_path, rows, labels, [] if empty == "benchmark" else [(1, ITEM)])
    want = {"documents": [], "labels": [1], "benchmark": [1, 2]}[empty]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == want
