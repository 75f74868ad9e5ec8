"""The corpus pipeline stage by stage against brute force, on planted documents."""

import random

import corpus_pipeline
from movelog.llm import op03_bpe, op08_mixing
from movelog.llm.common import materialise
from movelog.llm.queries import QUERIES

import public_tokenizers
from pyspark.sql import functions as F

from .test_operators import DOCS, brute_components, odd  # noqa: F401


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    words = [a + b for a in ("tree", "river", "stone", "cloud", "walk", "green") for b in ("", "er", "ing", "s")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(500)]
    toxic = [k % 5 == 0 for k in range(500)]
    texts = [t + " blarg" + rng.choice(["a", "o", "ish"]) if x else t for t, x in zip(texts, toxic)]
    texts += [texts[k] + " end" for k in range(1, 40) if not toxic[k]] + [None, ""]
    rows = [(k, t, "en", f"s{k % 3}" if k % 2 else "hot", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(x)) for k, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe":
            assert docs.columns == before.columns
    assert not {k for k in range(500) if toxic[k]} & kept["toxicity"]
    assert len(kept["toxicity"]) >= len(rows) - sum(toxic) - 3
    alive = [(k, t) for k, t, *_ in rows if k in kept["toxicity"]]
    assert kept["near_dedup"] == {k for k, (_, c) in brute_components(alive, 5, 80).items() if c == k}
    assert kept["mixing"] == kept["near_dedup"] == kept["bpe"]
    assert docs.count() == len(kept["bpe"])  # mixing brings no duplicates back
    codec = op03_bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    by = {k: t or "" for k, t, *_ in rows}
    for r in docs.collect():
        assert r.n_tokens == len(codec.encode([by[r.doc_id]])[0]) // 4


def test_encoded_rows_have_their_place_in_the_mix(spark, tmp_path):
    rows = [(k, f"tree {k} stone", "en", f"s{k % 3}", 10) for k in range(200)]
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    mixed.write.option("maxRecordsPerFile", 37).parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in op08_mixing.schedule(spark.createDataFrame(rows, DOCS), epochs=1).orderBy("slot", "offset", F.xxhash64("doc_id")).collect()]
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(docs.inputFiles()) > 3
    found = corpus_pipeline.bpe(spark, docs, str(tmp_path)).orderBy("place").collect()
    assert [r.doc_id for r in found] == order and [r.place for r in found] == list(range(200))


def test_stages_on_odd_rows_and_none(spark, tmp_path, odd):  # noqa: F811
    """Nulls, repeats, very long texts and columns of inner names; no labelled row, so nothing is toxic."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("__gone", "__slot", "__order", "row"):
        odd = odd.withColumn(name, F.col("doc_id") * 2)  # noqa: F811
    for docs, wanted in ((odd, [11, 10, 10, 10]), (odd.limit(0), [0, 0, 0, 0])):
        for (name, stage), n in zip(corpus_pipeline.STAGES, wanted, strict=True):
            out = materialise(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert out.count() == n
            if name != "bpe":
                assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
            docs = out


def test_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
