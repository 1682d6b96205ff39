import corpus_pipeline as pipeline
from test_corpus import linked
from test_secrets_pii import BASE_PII, brute

from supplylens.llm import quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, cur, seen = docs.columns, docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, cur, sf)
        out.write.parquet(f"{sf}/stage{k}")
        cur = spark.read.parquet(f"{sf}/stage{k}")
        seen.append(cur)
        if k < len(pipeline.STAGES) - 1:
            assert cur.columns == columns
    kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in seen[0].collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in seen[0].collect()]
    roots, _ = linked(rows, pipeline.WORDS, pipeline.PERCENT)
    one = seen[1].collect()
    assert len(one) == len(set(roots)) and {r["doc_id"] for r in one} == {min(k for (k, _), r in zip(rows, roots, strict=True) if r == g) for g in set(roots)}
    for r in seen[2].collect():
        assert not brute(BASE_PII, r["text"]) and r["n_chars"] == len(r["text"])
    pieces = seen[3].collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in one}
    assert pipeline.run(spark, sf).count() == len(pieces)
