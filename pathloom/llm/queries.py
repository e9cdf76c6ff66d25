"""One query per operator of this subpackage, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import bpe, classlm, decontaminate, langid, neardup, sharding, tokenstore, topk, toxicity, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenstore.store_path(spark)
    tokenstore.write_store(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenstore.read_digests(spark, path)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 0.8)


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_table(spark, sf_dir, "documents"), 8)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, factor=64.0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_corpus(_table(spark, sf_dir, "documents"))


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_decontaminate": op2_decontaminate,
    "op3_shards": op3_shards,
    "op4_bpe": op4_bpe,
    "op5_top_k": op5_top_k,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_class_lm": op8_class_lm,
    "op9_url_filter": op9_url_filter,
    "op10_language": op10_language,
}

ORACLE_SQL: dict[str, str] = {}

_WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{M}}\p{{N}}]+')"
_SETS = "SELECT {id}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {id}, {words} AS w FROM {table})"
ORACLE_SQL["op2_decontaminate"] = f"""WITH i AS (SELECT DISTINCT * FROM ({_SETS.format(id="item_id", words=_WORDS.format(t="text"), table="benchmark")})),
d AS (SELECT DISTINCT * FROM ({_SETS.format(id="doc_id", words=_WORDS.format(t="text"), table="documents")})),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(n_item) AS n_item FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9"""
ORACLE_SQL["op5_top_k"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s) WHERE rank <= 20"""
ORACLE_SQL["op6_near_duplicates"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, label) USING KEY (node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, min(r.label) FROM r JOIN e ON e.a = r.node JOIN recurring.r o ON o.node = e.b WHERE r.label < o.label GROUP BY e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.label AS component_id, r.label = d.doc_id AS kept FROM documents d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
