"""Operator 2 [native]: fingerprints by consistent weighted sampling.

Terms are words (runs without white space), weighted by how often they occur.
For sample i and term k with weight w, hashes of (k, i) give r, c ~ Gamma(2, 1)
(minus the logarithm of a product of two uniforms) and b uniform, and

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r.

The sample is the (k, t) of smallest ln a; two texts agree in a sample with a
chance equal to their generalised Jaccard similarity sum(min) / sum(max). A
sample is kept as one long: ln a in fixed point above a 23-bit hash of (k, t),
so a fingerprint is a row of plain ``min`` aggregates that merge anywhere.

The plan is built around one exchange of the text by document: words are
counted and sampled where their text lies.

Rules: null text is empty; a text without words has an empty fingerprint,
like only to another such one (likeness 1, else 0). Documents follow each
other by doc_id, null ids first; rows that repeat an id follow by their text's
hash, rows that repeat id and text are one document there and come out as
often as they came in. A single document follows itself. Empty table: no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm.common import parts_for, pick, written

SAMPLES = 24
_ID_BITS = 23


def sample(term: str, log_weight: str, i: int) -> Column:
    """Sample i of a term as a long: smaller is earlier, the low bits name (term, t); null without weight.

    Uniforms have 21 bits; the factors 2^-21 of a product are taken out of its logarithm."""
    one, two = f"xxhash64({term}, {2 * i})", f"xxhash64({term}, {2 * i + 1})"
    u = lambda h, s: f"((shiftrightunsigned({h}, {s}) & 2097151L) + 0.5D)"
    minus_ln = lambda h: f"({42 * math.log(2)!r}D - ln({u(h, 0)} * {u(h, 21)}))"
    r, b = minus_ln(one), f"({u(one, 42)} * {2.0 ** -21!r}D)"
    t = f"floor({log_weight} / {r} + {b})"
    ln_a = f"(ln({minus_ln(two)}) - {r} * ({t} - {b} + 1D))"
    name = f"(xxhash64({term}, {t}) & {(1 << _ID_BITS) - 1}L)"
    return F.expr(f"shiftleft(cast(({ln_a} + 128D) * 4294967296D as bigint), {_ID_BITS}) | {name}")


def fingerprints(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, a fingerprint under the name of each text column) of every group of keys.

    No exchange if the rows are dealt by the keys. The columns' texts are
    counted together, so what a term's hashes give is worked out once for all."""
    blank = F.array(*[F.translate(F.col(c), "\t\n\x0b\x0c\r", "     ") for c in columns])
    terms = texts.select(*keys, F.posexplode(blank).alias("v", "t"))
    terms = terms.select(*keys, "v", F.explode(F.split("t", " ")).alias("w"))
    terms = (terms.select(*keys, "v", F.when(F.col("w") != "", F.xxhash64("w")).alias("k"))
             .groupBy(*keys, "k").agg(*[F.sum(F.when(F.col("v") == j, 1).otherwise(0)).alias(f"f{j}") for j in range(len(columns))]))
    # the logarithm of no occurrences is null, and null samples take no part in a minimum
    log = lambda j: F.expr(f"ln(cast(if(k is null, 0, f{j}) as double))").alias(f"lw{j}")
    got = (terms.select(*keys, "k", *[log(j) for j in range(len(columns))]).groupBy(*keys)
           .agg(*[F.min(sample("k", f"lw{j}", i)).alias(f"s{j}_{i}") for i in range(samples) for j in range(len(columns))]))
    digit = lambda j, i: F.lpad(F.hex(F.col(f"s{j}_{i}").bitwiseAND((1 << _ID_BITS) - 1)), 6, "0")
    whole = lambda j: F.concat(*[digit(j, i) for i in range(samples)])
    return got.select(*keys, *[F.lower(F.coalesce(whole(j), F.lit(""))).alias(c) for j, c in enumerate(columns)])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples; two empty fingerprints are alike, an empty one and another are not."""
    part = lambda c, i: F.substring(c, 6 * i + 1, 6)
    same = sum((F.when(part(a, i) == part(b, i), 1).otherwise(0) for i in range(samples)), F.lit(0))
    return (F.when((F.col(a) == "") & (F.col(b) == ""), 1.0)
            .when((F.col(a) == "") | (F.col(b) == ""), 0.0).otherwise(same / samples))


def followers(rows: DataFrame) -> DataFrame:
    """(doc_id, th, n, m, next_id, next_th): each document with the next in ascending order, the last with the first.

    Rows are range-partitioned; a window finds the next within a part, and the
    first rows of the parts (one row a part) give the next across the border."""
    u = rows.groupBy("doc_id", "th").agg(F.max("n").alias("n"), F.count("*").alias("m"))
    part = written(u.repartitionByRange(parts_for(rows, 256), "doc_id", "th")
                   .withColumn("part", F.spark_partition_id()), "fp-order")
    me = F.struct("doc_id", "th")
    heads = part.groupBy("part").agg(F.min(me).alias("head"))
    order = Window.orderBy("part")
    around = heads.withColumn("after", F.lead("head").over(order)).withColumn("very_first", F.first("head").over(order))
    nxt = F.lead(me).over(Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "th"))
    got = (part.withColumn("nxt", nxt)
           .join(F.broadcast(around.select("part", F.coalesce("after", "very_first").alias("border"))), "part")
           .withColumn("nxt", F.coalesce("nxt", "border")))
    return written(got.select("doc_id", "th", "n", "m", F.col("nxt.doc_id").alias("next_id"), F.col("nxt.th").alias("next_th")),
                   "fp-next")


def _key(i: str, th: str) -> list[Column]:
    return [F.coalesce(i, F.lit(0)).alias("ki"), F.col(th).alias("kt")]


def edited_pairs(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((ki, kt, text, edited) dealt by the key (ki, kt), (ki, kt, doc_id, n, m, next_id, next_th))."""
    parts = parts or parts_for(docs, 4)
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("th", F.xxhash64("text", F.col("doc_id").isNull()))     # a null id is a key of its own
    order = followers(rows.select("doc_id", "th", F.length("text").cast("long").alias("n")))
    k = ["ki", "kt"]
    held = (rows.select(*_key("doc_id", "th"), "text").repartition(parts, *k)
            .groupBy(*k).agg(F.first("text").alias("text")))
    half = F.floor(F.col("n") / 2).cast("int")
    asked = (order.select(*_key("next_id", "next_th"), F.col("doc_id").alias("to_id"), F.col("th").alias("to_th"), half.alias("h"))
             .repartition(parts, *k))
    sent = (asked.join(held.hint("merge"), k)
            .select(*_key("to_id", "to_th"), F.left("text", F.col("h")).alias("tail"), "h").repartition(parts, *k))
    pairs = (held.hint("merge").join(sent.hint("merge"), k)
             .select(*k, "text", F.concat(F.left("text", F.length("text") - F.col("h")), "tail").alias("edited")))
    return pairs, order.select(*_key("doc_id", "th"), "doc_id", "n", "m", "next_id", "next_th")


def with_edited(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    pairs, order = edited_pairs(docs)
    k = ["ki", "kt"]
    prints = fingerprints(pairs, k, ["text", "edited"], samples)
    sha = pairs.select(*k, F.sha2(F.col("edited").cast("binary"), 256).alias("sha"))
    got = written(prints.join(sha.hint("merge"), k).join(order, k)
                  .withColumnsRenamed({"text": "fp", "edited": "fpe"}), "fp-prints")
    nxt = got.select(F.col("ki").alias("nki"), F.col("kt").alias("nkt"), F.col("fp").alias("fpn"))
    here = got.withColumns({"nki": F.coalesce("next_id", F.lit(0)), "nkt": F.col("next_th")})
    return (here.join(nxt, ["nki", "nkt"])
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
            .select("doc_id", F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), F.col("fp").alias("fingerprint"),
                    F.col("fpe").alias("edited_fingerprint"), likeness("fp", "fpe", samples).alias("near_edited"),
                    likeness("fp", "fpn", samples).alias("near_next")))
