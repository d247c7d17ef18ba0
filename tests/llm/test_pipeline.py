import corpus_pipeline
from helpers import awkward, frame, near_components
from test_classifiers import corpus

import __spark_entry__ as entry
from recspark.llm import mixing


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join",
        "mixing sources to target weights", "best-fit packing"]
    found = entry.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert {n.split("_")[0] for n in found if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_stages(spark, tmp_path):
    rows, labels = corpus(250, 6)
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(awkward())]
    rows += [(2000 + i, rows[i][1] + " extra", *rows[i][2:]) for i in range(0, 60, 3)]
    docs = frame(spark, rows)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    def run(name, df):
        out = steps[name](spark, df, str(tmp_path))
        out.write.parquet(path := f"{tmp_path}/{name.replace(' ', '-')}")
        return spark.read.parquet(path)

    good = run("quality classifier", docs)
    kept = {r["doc_id"] for r in good.collect()}
    truth = {i: q for i, q, _ in labels}
    assert sum(truth[i] for i in truth if i in kept) >= 0.98 * sum(truth.values())
    assert sum(1 - truth[i] for i in truth if i in kept) <= 0.1 * len(truth)
    assert good.columns == docs.columns

    single = run("exact dedup", good)
    texts = {}
    for r in good.collect():
        texts[r["text"] or ""] = max(texts.get(r["text"] or "", -1), r["doc_id"])
    assert {(r["text"] or "", r["doc_id"]) for r in single.collect()} == set(texts.items())
    assert single.columns == docs.columns

    near = run("n-gram Jaccard join", single)
    want = {c for _, _, c in near_components([tuple(r) for r in single.collect()])}
    assert {r["doc_id"] for r in near.collect()} == want and near.columns == docs.columns

    mixed = run("mixing sources to target weights", near)
    plan = mixing.mix(near).collect()
    assert mixed.count() == sum(r["copies"] for r in plan) and mixed.columns == docs.columns

    packed = run("best-fit packing", mixed).collect()
    assert sorted({r["doc_id"] for r in packed}) == sorted({r["doc_id"] for r in mixed.collect()})
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()
