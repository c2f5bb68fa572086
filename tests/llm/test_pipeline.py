import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import TEXTS, awkward

BENCH = "seven silver swans swam silently over shining summer seas near small stone shores"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = tmp_path_factory.mktemp("sf")
    clean = [(100 + k, " ".join(f"w{(k * 37 + j * j) % 997}" for j in range(60))) for k in range(60)]
    toxic = [(200 + k, clean[k][1] + " moron clown moron stupid clown") for k in range(30)]
    special = [
        (300, clean[3][1]),
        (301, "some text before " + BENCH.upper() + "! and after"),
        (302, "unique opening here token = abcdefgh12345 and a closing"),
    ]
    rows = clean + toxic + special + list(TEXTS)
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        after[name] = ids(out)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert not set(after["toxicity"]) & {str(200 + k) for k in range(30)} and {str(100 + k) for k in range(60)} <= set(after["toxicity"])
    assert "300" not in after["near_dedup"] and after["near_dedup"].count("None") == 1 and "2" not in after["near_dedup"]
    assert set(after["near_dedup"]) - set(after["decontamination"]) == {"301"}
    assert after["secrets"] == after["decontamination"]
    secret = docs.filter("doc_id = 302").first()
    assert secret.text == "unique opening here [SECRET] and a closing" and secret.n_chars == len(secret.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert ids(packed.select("doc_id").distinct()) == sorted(set(after["secrets"]))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_stages_take_awkward_and_empty_tables(spark, folder):
    for docs in (awkward(spark), awkward(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert out.count() <= max(docs.count(), 1) * 3, name
