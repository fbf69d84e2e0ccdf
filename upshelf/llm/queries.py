"""Registered queries of the operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upshelf.llm import ann, bpe, dualtree, fingerprint, frames, jaccard, langid, linededup, linkrank, minhash, mixing, secrets, walsh

QueryFn = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(_table(spark, sf_dir, "documents"))


#: Fixed values of the contract: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkrank.judge(_table(spark, sf_dir, "pages"), RULES)


def op4_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_byte_gru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op11_walsh_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walsh.digests(_table(spark, sf_dir, "embeddings"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=85, den=100)


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (op1_block_matrix_ann, op2_weighted_sampling, op3_link_trust, op4_crf_secrets, op5_line_dedup, op6_byte_bpe, op7_byte_gru_langid, op8_token_frames,
                                                      op9_ngram_jaccard, op10_raked_mixture, op11_walsh_clusters, op12_dual_tree, op13_bayes_minhash)}


def _links(percent: int) -> str:
    """Components of documents whose 3-word shingle sets reach a Jaccard similarity of ``percent``."""
    return r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(s) AS t FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= @ * (na.n + nb.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""".replace("@", str(percent))


ORACLE_SQL: dict[str, str] = {
    "op1_block_matrix_ann": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op3_link_trust": linkrank.oracle(RULES),
    "op10_raked_mixture": mixing.oracle(),
    "op11_walsh_clusters": walsh.oracle(),
    "op12_dual_tree": dualtree.oracle(),
    "op13_bayes_minhash": "SELECT *, doc_id = component_id AS kept FROM (" + _links(85) + ")",
    "op9_ngram_jaccard": _links(90),
}


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, QueryFn]:
    return QUERIES | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
