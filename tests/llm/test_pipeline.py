import corpus_pipeline
from quadrille.llm import bpe, quality
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_exact import brute as exact_groups
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_run_against_plain_code(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    logit, bias = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import pyarrow as pa

    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r, s in zip(rows, quality.scores(pa.array([t for _, t in rows]), logit, bias), strict=True) if s >= quality.KEEP]
    stay = {keep for _, keep, _, _ in exact_groups(rows)}
    rows = [r for r in rows if r[0] in stay]
    label = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    rows = [r for r in rows if label[r[0]] == r[0]]
    gone = {d for d, *_ in leaks(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    codec = bpe.Codec.load(*bpe.public_vocabulary())
    want = {i: codec.encode(t) for i, t in rows if i not in gone}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: list(r.token_ids) for r in got} == want and len(got) == len(want)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    assert set(columns) - {"text"} <= set(got[0].asDict())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
