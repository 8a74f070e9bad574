import corpus_pipeline
from encore.llm import bands, mil
from encore.llm.frames import shared_folder
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_decides_as_brute_force_does(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    model = mil.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    toxic = {r["doc_id"] for r in mil.toxicity(docs, model).collect() if r["predicted"]}
    judge = bands.Judge(bands.Limits())

    def near(texts):
        _, roots = brute.near_components(texts)
        return {i: t for i, t in texts.items() if roots[i] == i}

    rules = [
        lambda x: {i: t for i, t in x.items() if i not in toxic},
        lambda x: {i: t for i, t in x.items() if not brute.base_counts(t)["base_failed"] and not judge.compression(t.encode())[3]},
        near,
        lambda x: {i: t for i, t in x.items() if not brute.leaks(t, items)[1]},
    ]
    for (_, stage), rule in zip(corpus_pipeline.STAGES[:-1], rules, strict=True):
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns
        folder = shared_folder(spark, "test-stage")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
        kept = rule(kept)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in packed} == set(kept)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()} == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed}
    assert 0 < len(kept) < 200
