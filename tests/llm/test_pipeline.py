"""The pipeline and the queries as a whole."""

import math
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pathloom.llm import neardup, queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR).checkpoint() if spark.sparkContext.getCheckpointDir() else stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns, name
        assert before * 0.5 < kept.count() <= docs.count()
        docs = kept
    left = Counter(r["component_id"] for r in neardup.near_duplicates(docs).collect())
    assert set(left.values()) == {1}


def test_run_returns_every_kept_document(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)
    assert 0 < out.count() <= spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_near_duplicate_stage_at_four_fifths(spark):
    rng = random.Random(8)
    rows, sets = [], {}
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((2 * k, " ".join(words)))
        for at in range(10, 10 + 25 * (5 + k % 3), 25):  # 5 to 7 changed words, 25 to 35 shingles of 296
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = {k: len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(40)}
    assert any(0.8 <= s < 0.85 for s in alike.values()) and any(s < 0.8 for s in alike.values())
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i % 2 == 0 or alike[i // 2] < 0.8)


@pytest.mark.parametrize("percent", [80, 85])
def test_miss_probability_of_the_bands(percent):
    m, s, least = neardup.collections(percent), percent / 100, neardup.sketch_least(percent)
    agree = s**neardup.WIDTH
    assert sum(math.comb(m, k) * agree**k * (1 - agree) ** (m - k) for k in (0, 1)) <= 1e-5
    assert sum(math.comb(64, k) * s**k * (1 - s) ** (64 - k) for k in range(least)) <= 1e-5
