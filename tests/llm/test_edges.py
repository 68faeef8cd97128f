"""Null ids, repeated rows and extra columns whose names the operators use themselves."""

import pytest
from pyspark.sql import functions as F

from quillmill.llm import collisions, images, interpolation, jaccard, language, licenses, lloyd, packing, registry, resampling, secret_scan, segmentations, suffixes, token_store

from .helpers import awkward, docs, prose

CLASH = ["_kept", "_id", "_mark", "_i", "_m", "_low", "_bits0", "secret_spans", "row", "id", "mark", "key", "n", "range", "block", "kind", "lang_pred", "score", "rejected", "rank", "salt", "train", "component_id"]
OPS = {"op3": jaccard.op3_jaccard, "op4": secret_scan.op4_secrets, "op5": language.op5_language, "op6": token_store.op6_token_store, "op7": interpolation.op7_interpolation, "op8": packing.op8_packing, "op10": suffixes.op10_suffixes, "op11": licenses.op11_licenses, "op13": resampling.op13_resampling}


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edges")
    base = docs(spark, [*awkward(), prose(1, 80), prose(1, 80)])
    nulls = base.where("doc_id in (4, 8, 13)").withColumn("doc_id", F.lit(None).cast("long"))
    odd = base.where("doc_id = 5").select(F.lit(99).cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    every = base.union(nulls).union(odd).union(base.where("doc_id in (5, 13)"))
    every.withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{path}/documents.parquet")
    base.select(F.col("doc_id").alias("item_id"), "text").withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name", OPS)
def test_queries_take_them(spark, where, name):
    n = spark.read.parquet(f"{where}/documents.parquet").count()
    out = OPS[name](spark, where)
    got = out.collect()
    if name == "op8":
        assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] is None) > 0
    else:
        assert len(got) == n and sum(r["doc_id"] is None for r in got) == 3


@pytest.mark.parametrize("stage", [language.keep_confident, lambda s, d: jaccard.keep_one(d), lambda s, d: suffixes.strip(d), lambda s, d: secret_scan.redact(d)])
def test_stages_keep_columns(spark, where, stage):
    source = spark.read.parquet(f"{where}/documents.parquet")
    out = stage(spark, source)
    assert out.columns == source.columns and out.where("`row` <> 'x' or secret_spans <> 'x'").count() == 0 and out.count() > 0


def test_vectors_images_and_turns(spark, tmp_path):
    rows = [(1, [1.0] * 64, 0), (None, [1.0] * 64, 0), (2, None, None), (2, None, None), (1, [1.0] * 64, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit("x"), "v": F.lit(1), "p": F.lit(1)}).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert collisions.op2_collisions(spark, str(tmp_path)).count() == 5
    assert images.op1_images(spark, str(tmp_path)).count() == 5
    assert sorted((r["vec_id"] or 0, r["cluster"], r["distance"]) for r in lloyd.op12_lloyd(spark, str(tmp_path)).collect()) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    turns = [(None, 1, "u", "a b"), (1, None, "u", None), (1, 1, None, "c"), (1, 1, None, "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    assert segmentations.op9_segmentations(spark, str(tmp_path)).select("conv_id", "turn").distinct().count() == 3


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14))
