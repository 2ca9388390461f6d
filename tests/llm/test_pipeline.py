"""The pipeline, stage by stage, on a small corpus with planted toxic, bad and near-equal documents."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

import corpus_pipeline
from test_operators import plain_groups


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    prose = lambda n=90: " ".join("".join(rng.choices("abcdeou", k=rng.randint(2, 8))) for _ in range(n)) + "."
    clean = [(i, prose()) for i in range(300)]
    toxic = [(1000 + i, prose(40) + " you worthless cretin " + prose(40)) for i in range(80)]
    bad = [(2000 + i, " ".join(w + "###$$$" for w in prose().split())) for i in range(60)]
    base = prose(400)
    copies = [(3000 + i, base + ("!" * (i % 2))) for i in range(20)]
    odd = [(4000, None), (4001, ""), (None, prose()), (5000, prose(3000))]
    rows = [(i, t, rng.choice(["en", "de"]), "hot" if i and i % 3 else "s1", len(t or "")) for i, t in clean + toxic + bad + copies + odd]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:200]] + [(i, 1, 1) for i, _ in toxic[:60]] + [(i, 0, 0) for i, _ in bad[:40]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {"clean": {i for i, _ in clean}, "toxic": {i for i, _ in toxic}, "bad": {i for i, _ in bad}, "copies": {i for i, _ in copies}}


def test_stages(spark, corpus):
    path, planted = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        docs = stage(spark, docs, path).cache()
        if name != "packing":
            assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            groups = plain_groups(texts)
            assert kept[name] == {d for d, t in texts if groups[t] == d}
    assert not kept["toxicity"] & planted["toxic"] and len(kept["toxicity"] & planted["clean"]) >= 297
    assert not kept["quality"] & planted["bad"] and len(kept["quality"] & planted["clean"]) >= 290
    assert len(kept["near_dedup"] & planted["copies"]) == 1 and len(kept["near_dedup"] & planted["clean"]) >= 290
    assert kept["packing"] == kept["mixing"] <= kept["near_dedup"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]


def test_run_is_the_stages_in_turn(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(corpus_pipeline.run(spark, path).select(keys).collect(), key=str) == sorted(docs.select(keys).collect(), key=str)


def test_odd_tables(spark, corpus):
    """Repeated rows, extra columns of names that the stages use inside, and no rows at all."""
    path, _ = corpus
    odd = ("mix_weight", "mix_copies", "mix_tokens", "_mix_lang", "mix_topic", "node", "fp", "least", "features", "score", "kept", "piece", "length", "chunk", "toxic", "quality")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.union(docs.filter("doc_id < 40")).withColumns({c: F.lit(c) for c in odd})
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, path).cache(), stage(spark, empty, path)
        assert empty.count() == 0 and docs.count() > 0
        if name != "packing":
            assert empty.columns == docs.columns and docs.filter(" or ".join(f"`{c}` <> '{c}'" for c in odd)).count() == 0
            twice = docs.filter("doc_id < 40").groupBy("doc_id").count()
            assert twice.filter("count <> 2").count() == 0
