"""Operator 10: source mixing by iterative proportional fitting.

Documents fall in cells (source, language, topic); the tokens of the cells are
raked: in turn for each dimension, every cell is scaled so that the dimension's
totals meet their targets, round after round until all targets together are missed by
at most ``TOLERANCE`` of all tokens. Targets that no table with these cells can
meet end the rounds too: as soon as a round leaves more than ``PROGRESS`` of the gap it found.
The factor of a cell
(raked tokens / tokens) over the largest factor is the probability with which
its documents are kept, so the kept tokens meet the targets in expectation.
A token is a word between blanks or, in scripts written without blanks, a character. A
document is kept if a uniform number hashed from its id lies below it: the same
document is always judged alike, and nothing is drawn per task.

Targets are shares by value; a dimension without given targets takes its own
shares to the power ``ALPHA`` (below 1: small values gain). The cell table has
one row per combination present and stays a Spark table throughout.

Topic, unless the caller passes an expression, is the kind of text: ``table``,
``numbers``, ``noise`` (by shares of bars, digits and symbols), ``short`` or
``prose``.

Rules: null source or language is the value ``?``; null text is empty; given
targets without documents are dropped and the rest scaled to one; values
without a given target get none of the tokens and are not kept; cells without
tokens take the factor that raking gives them and do not count otherwise. Rows
that repeat an id are judged alike; a null id is judged by its text. Every row
gives one row. Empty table: no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upshelf.llm.common import forget, written

ALPHA, TOLERANCE, PROGRESS = 0.8, 1e-13, 0.95
#: Fixed values, ranges of code points: Thai and Lao, Burmese, Khmer, Hiragana and Katakana, Han.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{3FFFF}"
TOKEN = rf"[{UNSPACED}]|[^{UNSPACED}\x20\x09-\x0D]+"
DIMS = ("source", "lang", "topic")
Targets = dict[str, dict[str, float]]


def topic_of(text: str = "text") -> Column:
    n = F.length(text)
    share = lambda chars: (n - F.length(F.translate(text, chars, ""))) / n
    return (F.when(F.col("n_tokens") < 40, "short").when(share("|") > 0.02, "table")
            .when(share("0123456789") > 0.1, "numbers").when(share("!$%&*#") > 0.05, "noise").otherwise("prose"))


def described(docs: DataFrame, topic: Column | None = None, *more: str) -> DataFrame:
    """(<more>, doc_id, source, lang, topic, n_tokens, u) of every row; u is the document's uniform number."""
    d = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in more], *[pick_ for pick_ in (
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit("?")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("?")).alias("lang"))])
    d = d.withColumn("n_tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    u = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0
    return d.select(*[f"`in_{c}`" for c in more], "doc_id", "source", "lang",
                    (topic if topic is not None else topic_of()).alias("topic"), "n_tokens", u.alias("u"))


def rake(rows: DataFrame, targets: Targets | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, lang, topic, prob) of every cell. The driver sees one number a round."""
    spark, targets = rows.sparkSession, targets or {}
    cells = written(rows.groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "mix-counts")
    for dim in DIMS:
        if dim in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[dim].items()], f"{dim} string, given double")
            cells = cells.join(F.broadcast(given), dim, "left").withColumn(f"t_{dim}", F.coalesce("given", F.lit(0.0))).drop("given")
        else:
            cells = cells.join(cells.groupBy(dim).agg(F.pow(F.sum("tokens"), F.lit(alpha)).alias(f"t_{dim}")), dim)
    cells = written(cells.withColumn("w", F.col("tokens")), "mix-cells")
    for dim in DIMS:        # targets as shares of one: each value counts once
        norm = cells.where("tokens > 0").groupBy(dim).agg(F.max(f"t_{dim}").alias("t")).agg(F.sum("t")).first()[0]
        cells = cells.withColumn(f"t_{dim}", F.col(f"t_{dim}") / F.lit(norm or 1.0))
    gap, n = None, 0
    while True:
        # a value's totals are summed over its cells and joined back: no task holds all cells of a value
        step, n = cells.withColumn("gap", F.lit(0.0)), n + 1
        for dim in DIMS:
            step = step.join(step.groupBy(dim).agg(F.sum("w").alias("have")), dim)
            w = F.when(F.col("have") > 0, F.col("w") * F.col(f"t_{dim}") / F.col("have")).otherwise(0.0)
            step = step.withColumn("gap", F.col("gap") + F.abs(w - F.col("w"))).withColumn("w", w).drop("have")
        step = written(step, f"mix-{n}")
        last, gap = gap, step.agg(F.sum("gap")).first()[0] or 0.0
        if n > 1:
            forget(table)
        table, cells = step, step.drop("gap")
        # the first round only brings counts to shares of one
        if gap <= TOLERANCE or n > 2 and gap > PROGRESS * last:
            break
    factor = F.try_divide("w", "tokens")        # null for a cell without tokens
    top = cells.agg(F.max(factor)).first()[0]
    return cells.select(*DIMS, F.coalesce(factor / F.lit(top or 1.0), F.lit(1.0)).alias("prob"))


def mix(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, prob, kept) of every document."""
    rows = written(described(docs, topic), "mix-rows")
    return (rows.join(rake(rows, targets), list(DIMS))
            .select("doc_id", *DIMS, "n_tokens", F.round("prob", 6).alias("prob"), (F.col("u") < F.col("prob")).alias("kept")))


def sampled(docs: DataFrame, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """The kept documents, with the columns they came with."""
    cols = docs.columns
    rows = described(docs, topic, *cols)
    probs = rake(rows.select(*DIMS, "n_tokens"), targets)
    return rows.join(probs, list(DIMS)).where("u < prob").select(*[F.col(f"`in_{c}`").alias(c) for c in cols])


def oracle(alpha: float = ALPHA, rounds: int = 60) -> str:
    """The same in DuckDB SQL: one step a dimension, for more rounds than raking to the same precision takes."""
    share = lambda chars: f"(length(text) - length(translate(text, '{chars}', ''))) / length(text)"
    of = lambda name: f"CASE i % 3 " + " ".join(f"WHEN {i} THEN {name(d)}" for i, d in enumerate(DIMS)) + " END"
    have = f"sum(w) OVER (PARTITION BY {of(lambda d: d)})"
    keep = ", ".join([*DIMS, "tokens", *(f"t_{d}" for d in DIMS)])
    norm = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {alpha}) / (SELECT sum(t) FROM (SELECT pow(sum(tokens), {alpha}) AS t FROM cells GROUP BY {d} HAVING max(tokens) > 0)) AS t_{d}" for d in DIMS)
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '?') AS source, coalesce(lang, '?') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens FROM documents
), rows AS (
  SELECT doc_id, source, lang, n_tokens, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    CASE WHEN n_tokens < 40 THEN 'short' WHEN {share('|')} > 0.02 THEN 'table' WHEN {share('0123456789')} > 0.1 THEN 'numbers'
         WHEN {share('!$%&*#')} > 0.05 THEN 'noise' ELSE 'prose' END AS topic FROM d
), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
c AS (
  SELECT 0 AS i, {keep}, w FROM (SELECT *, tokens AS w, {norm} FROM cells)
  UNION ALL
  SELECT i + 1, {keep}, CASE WHEN {have} > 0 THEN w * {of(lambda d: f"t_{d}")} / {have} ELSE 0.0 END FROM c WHERE i < {3 * rounds}
),
p AS (SELECT source, lang, topic, coalesce((w / nullif(tokens, 0)) / max(w / nullif(tokens, 0)) OVER (), 1.0) AS prob FROM c WHERE i = {3 * rounds})
SELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob, u < prob AS kept FROM rows JOIN p USING (source, lang, topic)"""
