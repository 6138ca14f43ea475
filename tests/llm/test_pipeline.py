"""The pipeline's stages against plain versions of themselves."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from verifold.llm import registry


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(30):
        text = " ".join(rng.choice(words, 60)) + "."
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows.append((30, rows[0][1] + " more.", "en", "s0", 1))
    rows.append((31, "too short", "en", "s1", 9))
    rows.append((32, rows[5][1] + " mail a@b.example now.", "en", "s1", 9))
    rows.append((33, None, None, None, None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).toPandas()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns
        results.append(rows)
    quality, dedup, pii, mixed = results
    assert set(quality.doc_id) == set(range(31)) | {32}
    assert set(dedup.doc_id) == set(range(30))
    assert set(pii.doc_id) == set(dedup.doc_id) and not any("@" in t for t in pii.text)
    assert set(mixed.doc_id) <= set(pii.doc_id)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas()
    assert Counter(packed.doc_id) == Counter(mixed.doc_id)


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_names():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
