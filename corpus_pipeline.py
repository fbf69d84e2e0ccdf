"""Corpus pipeline: the stages that turn ``documents`` into encoded training text.

Every stage reads what its predecessor wrote and returns the columns of
documents, the last one the token digests. Stages 1 to 4 keep extra columns,
whatever their names.

1. language: documents whose language cannot be told (no text, no letter) go;
   an unlabelled document takes the language found. A label that is there is
   never overruled: on a labelled table the stage only drops texts without a letter.
2. lines: of rows equal in doc_id and text (a null id is an id of its own) one
   stays; lines that repeat or nearly repeat an earlier line are cut out; a
   document that loses all its lines goes (its text stands earlier).
3. near copies: of rows linked by five-word shingles at a similarity of 0.8 or
   more, the one of smallest doc_id stays; rows without an id come last, rows
   of one id in order of the hashes of their texts.
4. mixture: documents are sampled by raked source, language and topic shares.
5. encoding: byte-level BPE ids of every whole text, decoded again.
"""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402

from upshelf.llm import bpe, jaccard, langid, linededup, mixing  # noqa: E402
from upshelf.llm.common import odd_ids, release, written  # noqa: E402


#: The columns of documents; a stage sees all others under numbered names that clash with nothing.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _extra_columns_kept(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*inner), sf_dir)
        return out.select(*inner).toDF(*docs.columns)
    return run


@_extra_columns_kept
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cols = docs.columns
    found = langid.predict(docs, langid.train(docs), *cols).where("lang_pred <> 'und'")
    return found.select(*[F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in cols])


def _single(docs: DataFrame) -> DataFrame:
    """One row of every equal (doc_id, text), that of the smallest other columns."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not odd_ids(docs):
        return docs
    least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("_"), *[f"`{c}`" for c in rest])).alias("_own"))
    return least.select(*[F.col("_own").getField(c).alias(c) if c in rest else c for c in docs.columns])


@_extra_columns_kept
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = linededup.dedup(_single(docs), least=1, nulls=True)
    left = cut.where("n_removed = 0 or trim(translate(text, '\\t\\n\\r', '   ')) <> ''")
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key stands in ``gone``. Where these are few, only rows that a bit set names meet them: whole
    texts are not dealt out to lose a few rows."""
    gone = written(gone, "near-gone")
    count = gone.count()
    release(rows.sparkSession)
    if not linededup._few(count, rows.count()):
        return rows.join(gone, key, "left_anti")
    rows = linededup._maybe(rows, gone, count, key)
    return rows.where("not maybe").unionByName(rows.where("maybe").join(gone, key, "left_anti"))


@_extra_columns_kept
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if not odd_ids(docs):
        found = jaccard.join(docs.select("doc_id", "text"), k=5, num=4, den=5)
        gone = found.where("component_id <> doc_id").select("doc_id").distinct()
        return _without(docs, gone, "doc_id").select(*docs.columns)
    # every row is compared under a number of its own, fixed by writing it
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    found = jaccard.join(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=4, den=5).select(F.col("doc_id").alias("_row"), "component_id")
    order = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("hash"), "_row").alias("at"))
    first = found.join(order, "_row").groupBy("component_id").agg(F.min("at").alias("at")).select("at._row")
    return _without(rows, rows.select("_row").join(first, "_row", "left_anti"), "_row").select(*docs.columns)


@_extra_columns_kept
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("encode", encode)]

#: A trained model, set-similarity links and BPE merges are not SQL; tests compare lines, links and merges with brute
#: force, and a whole run on a labelled table with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
