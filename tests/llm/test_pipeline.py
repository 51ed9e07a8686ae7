"""The pipeline against brute force on the small tables."""
import corpus_pipeline
from freightline.llm import neardup, pii, quality

from test_operators import brute_components


def test_pipeline_rows(spark, sf_small, sample):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, states[-1], sf_small)
        states.append(quality.materialise(out, "stage"))
    assert all(s.columns == docs.columns for s in states[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    kept = {r.doc_id for r in quality.op9_quality_divergence(spark, sf_small).filter("kept").collect()}
    assert ids[1] == kept
    left = [(i, t) for i, t, _ in sample if i in kept]
    components = brute_components(left, percent=neardup.STAGE_PERCENT)
    assert ids[2] == {c for _, c in components.values()}
    import duckdb
    items = [t for t, in duckdb.connect().execute(f"SELECT text FROM '{sf_small}/benchmark.parquet'").fetchall()]
    texts = dict(left)
    assert ids[3] == {i for i in ids[2] if not any(x in texts[i] for x in items)} == ids[4] == ids[5]
    for r in states[4].collect():
        old = texts[r.doc_id]
        found = pii.detect(old)
        assert (r.text == old) == (not found) and not any(old[a:b] in r.text for a, b, _, _ in found)
        assert r.n_chars == len(r.text)
    assert states[5].agg({"length": "sum"}).first()[0] == sum(len(r.ids) for r in states[5].collect())
