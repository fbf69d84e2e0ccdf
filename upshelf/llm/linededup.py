"""Operator 5 [native]: line deduplication by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased. Every token has a code
that sorts by rarity first (the corpus counts of a fixed number of hash buckets
of words, the fullest ones; words of the others are rare) and by hash then; a line is the sorted array of its codes. Lines of equal sets
are one class. Classes of Jaccard similarity ``num / den`` or more are found by

* prefix: they share one of their ``n - ceil(t*n) + 1`` rarest tokens;
* length: ``t * larger <= smaller``;
* position: from the shared token on, either side is long enough;
* bits: a 128-bit map of each set bounds the overlap from above;
* verification of the candidates on their whole sets.

A line is removed if an earlier line (by doc_id, then line number) equals or
matches it. Prefix tokens in the fullest buckets are met in two steps:
every line of such a token is first compared with the token's earliest line, which removes the
members of a group of near copies; then only lines still there are compared
with all earlier ones. Lines below ``least`` distinct tokens (default: one) are
not compared. Sets too small to match
any but an equal one (up to three tokens at 0.8) need their class key alone. A
line written without blanks is one token: its repeats are found, near repeats not.

What is sent to all tasks has a bounded size: the bucket classes and, where few
lines or documents are to be looked at again, bit sets that name them (they may
name others too, which only costs time); where there are more, joins take their place.

A row's key is (doc_id, hash of its text): rows of equal key share their lines
and do not remove each other's; rows of one doc_id and different texts are
documents of their own, in order of their hashes. With ``nulls``, as in the
query and the pipeline, rows with null doc_id are such documents too, after
all others; without, they neither lose lines nor take lines from others. Where
a doc_id is odd (repeated, or null with ``nulls``), keys are numbered in this
order and the numbers stand for the ids.

Rules: null text is empty; blank lines stay. Every row gives one row; a line
that stays keeps its bytes. Empty table: no rows. Codes have 57 bits of hash."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upshelf.llm.common import forget, odd_ids, release, written
from upshelf.llm.linkrank import LOWER, UPPER

FREQUENT, BUCKETS, HOT = 1 << 15, 1 << 17, 32

#: Bits of a bit set at most, and rows that it names at most; more are met by a join.
BITS, NAMED = 1 << 22, 1 << 19
XY = ["x_doc", "x_line", "y_doc", "y_line"]


def _folded(text: Column) -> Column:
    """text with A-Z lower-cased and blanks for other white space inside lines. ``lower`` does it for ASCII without such
    white space, at a small part of the cost of ``translate``."""
    plain = F.length(text) == F.octet_length(text)
    for c in "\t\x0b\x0c\r":
        plain = plain & ~F.contains(text, F.lit(c))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER + "\t\x0b\x0c\r", LOWER + "    "))


def _words(line: str) -> Column:
    """The words of a folded line."""
    return F.array_remove(F.split(F.col(line), " "), "")


def _fixed(values: list[int], kind: str) -> Column:
    """A constant array, written as one string that the optimiser folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _hash(word: Column | str) -> Column:
    """57 bits of a word's hash."""
    return F.shiftrightunsigned(F.xxhash64(word), 7)


def _rarity(lines: DataFrame) -> Column:
    """Class of every bucket of word hashes: by the words that fall in it over all lines for the FREQUENT fullest
    buckets, 0 for the rest. At most BUCKETS counts reach the driver, whatever the vocabulary."""
    rows = (lines.select(F.explode(_words("line")).alias("w")).groupBy(_hash("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b"))
            .agg(F.count("*").alias("n")).collect())
    out = [0] * BUCKETS
    for r in sorted(rows, key=lambda r: (-r.n, r.b))[:FREQUENT]:
        out[r.b] = min(63, 1 + int(1.5 * math.log2(r.n)))
    release(lines.sparkSession)
    return _fixed(out, "int")


def _codes(line: str, classes: Column) -> Column:
    def code(h: Column) -> Column:
        # never null: arrays of codes are then sorted as plain numbers
        c = F.coalesce(F.get(classes, h.bitwiseAND(BUCKETS - 1)), F.lit(0))
        return F.shiftleft(c.cast("long"), 57).bitwiseOR(h)
    # a word is hashed once, and only distinct hashes are looked up
    return F.sort_array(F.transform(F.array_distinct(F.transform(_words(line), _hash)), code))


def _few(count: int, total: int) -> bool:
    """Whether so few of ``total`` rows are named that a bit set is worth its broadcast; else most rows are met anyway,
    and a join costs no more on large tables than on small ones."""
    return count <= NAMED and 8 * count <= total


def _maybe(frame: DataFrame, rows: DataFrame, count: int, *cols: str) -> DataFrame:
    """frame with ``maybe``: whether a row may be one of ``rows``, a written table of ``count`` rows, by these columns,
    told by a bit set sized by their number, as a table of at most BITS / 64 words that is broadcast."""
    h = F.pmod(F.xxhash64(*cols), F.lit(min(BITS, 1 << max(16, (8 * count).bit_length()))))
    word, bit = F.shiftright(h, 6).alias("_word"), h.bitwiseAND(63).cast("int")
    bits = (rows.select(word, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
            .groupBy("_word").agg(F.bit_or("b").alias("_bits")))
    met = frame.withColumn("_word", F.shiftright(h, 6)).join(F.broadcast(bits), "_word", "left")
    has = F.call_function("shiftright", F.col("_bits"), bit).bitwiseAND(1) == 1
    return met.withColumn("maybe", F.coalesce(has, F.lit(False))).drop("_word", "_bits")


def _lines(docs: DataFrame, fold: Callable[[Column], Column] = _folded) -> DataFrame:
    """(doc_id, line_no, line): the lines, folded unless told else, of every document with an id."""
    return (docs.select("doc_id", F.posexplode(F.split(fold(F.coalesce("text", F.lit(""))), "\n")).alias("line_no", "line"))
            .where("doc_id is not null"))


def _earlier(a: str, b: str) -> Column:
    return (F.col(f"{a}_doc") < F.col(f"{b}_doc")) | ((F.col(f"{a}_doc") == F.col(f"{b}_doc")) & (F.col(f"{a}_line") < F.col(f"{b}_line")))


def _bits(codes: str, half: int) -> Column:
    """One half of a 128-bit map of a set: a bit that only one of two sets has is a token the other lacks."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63).cast("int"))
    return F.aggregate(codes, F.lit(0).cast("long"),
                       lambda a, c: F.when(c.bitwiseAND(64) == 64 * half, a.bitwiseOR(bit(c))).otherwise(a))


def _likeliest(pairs: DataFrame) -> DataFrame:
    """One candidate x for every y: most shared prefix tokens, then the earliest."""
    best = F.max(F.struct("c", (-F.col("x_doc")).alias("d"), (-F.col("x_line")).alias("l"))).alias("p")
    return (pairs.groupBy("y_doc", "y_line").agg(best)
            .select((-F.col("p.d")).alias("x_doc"), (-F.col("p.l")).alias("x_line"), "y_doc", "y_line"))


def _verified(pairs: DataFrame, docs: DataFrame, total: int, classes: Column, num: int, den: int) -> DataFrame:
    """(y_doc, y_line) of the lines whose earlier candidate x links with them; ``total`` lines are compared in all.

    Texts are cut as they are, and only the lines of candidates folded. Their sets are written once for both sides, by a
    plan of its own: the joins' plans, kept and shown anew after each of their stages, then hold no classes."""
    pairs = written(pairs, "lines-pairs")
    ends = written(pairs.select(F.col("x_doc").alias("doc_id"), F.col("x_line").alias("line_no")).union(pairs.select("y_doc", "y_line")).distinct(), "lines-ends")
    release(docs.sparkSession)
    at, count, lines = ["doc_id", "line_no"], ends.count(), _lines(docs, lambda text: text)
    named = _maybe(lines, ends, count, *at).where("maybe") if _few(count, total) else lines.join(ends, at)
    held = written(named.select(*at, _folded(F.col("line")).alias("line")).select(*at, _codes("line", classes).alias("s")), "lines-held")
    release(docs.sparkSession)
    side = lambda s: held.toDF(f"{s}_doc", f"{s}_line", f"{s}_set")
    both = pairs.join(side("x"), ["x_doc", "x_line"]).join(side("y"), ["y_doc", "y_line"])
    over = F.size(F.array_intersect("x_set", "y_set"))
    hit = written(both.where(over * (num + den) >= (F.size("x_set") + F.size("y_set")) * num).select("y_doc", "y_line").distinct(), "lines-hit")
    release(docs.sparkSession)
    forget(pairs, ends, held)
    return hit


def removed(docs: DataFrame, num: int = 4, den: int = 5, least: int = 1) -> DataFrame:
    """(doc_id, line_no) of every line to remove, each once, as a written table."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 16))   # plans hold constant arrays: keep their text short
    lines = _lines(docs)
    classes = _rarity(lines)
    # the generator keeps the filter from working the codes out a second time
    sets = lines.select("doc_id", "line_no", F.explode(F.array(_codes("line", classes))).alias("s")).where(F.size("s") >= least)
    n = F.size("s")
    # 31 bits name a prefix token well enough to find candidates; the sign tells the commonest words
    name = lambda c: F.when(c >= 1 << 57, F.lit(-1)).otherwise(F.lit(1)) * (c.bitwiseAND((1 << 31) - 1) + 1)
    wide = n * (den - num) >= num                       # one token more or less still links
    none = F.array().cast("array<int>")
    prefix = F.transform(F.slice("s", F.lit(1), n - F.ceil(n * num / den).cast("int") + 1), lambda c: name(c).cast("int"))
    cards = written(sets.select("doc_id", "line_no", n.alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"),
                                *[F.when(wide, _bits("s", h)).alias(c) for h, c in enumerate(("lo", "hi"))],
                                F.when(wide, prefix).otherwise(none).alias("prefix")), "lines-cards")
    release(spark)
    total = cards.count()
    pos = F.struct("doc_id", "line_no")
    reps = written(cards.groupBy("k1", "k2").agg(F.min(pos).alias("p"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                                                  F.first("prefix").alias("prefix"))
                   .select("k1", "k2", F.col("p.doc_id").alias("doc"), F.col("p.line_no").alias("line"), "n", "lo", "hi", "prefix"), "lines-reps")
    release(spark)
    own = ("doc", "line", "n", "i", "lo", "hi")
    posts = lambda r, *more: r.select(F.posexplode("prefix").alias("i", "token"), "doc", "line", "n", "lo", "hi", *more)
    side = lambda s, p, *more: p.select("token", *[F.col(c).alias(f"{s}_{c}") for c in (*own, *more)])
    lacks = lambda s, t: sum(F.bit_count(F.col(f"{s}_{h}").bitwiseAND(F.bitwise_not(F.col(f"{t}_{h}")))) for h in ("lo", "hi"))

    def met(x_n: Column, y_n: Column) -> Column:
        """Whether x and y may link: order, sizes, what is left from the shared token on, and the bit maps."""
        need = (x_n + y_n) * num                        # (num + den) * overlap must reach this
        room = ((x_n - F.col("x_i")) * (num + den) >= need) & ((y_n - F.col("y_i")) * (num + den) >= need)
        bits = F.least(x_n - lacks("x", "y"), y_n - lacks("y", "x")) * (num + den) >= need
        return _earlier("x", "y") & (x_n * den >= y_n * num) & (y_n * den >= x_n * num) & room & bits

    may = met(F.col("x_n"), F.col("y_n"))
    common = posts(reps).where("token < 0")
    first = (common.groupBy("token").agg(F.min(F.struct(*own)).alias("p"), F.count("*").alias("k")).where(F.col("k") > HOT)
             .select("token", *[F.col(f"p.{c}").alias(f"x_{c}") for c in own]))
    star = side("y", common).join(first, "token").where(may)
    hit = _verified(_likeliest(star.groupBy(*XY).agg(F.count("*").alias("c"))), docs, total, classes, num, den)
    release(spark)
    # a line that is out already only serves as the earlier one: its size turns negative, which no y passes (as
    # a filter of one side it would part the two sides' exchange, which is now written once and read twice)
    out = hit.select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line"), F.lit(-1).alias("sign"))
    still = posts(reps.join(out, ["doc", "line"], "left").withColumn("n", F.col("n") * F.coalesce("sign", F.lit(1))))
    rest = side("x", still).join(side("y", still), "token").where(met(F.abs("x_n"), F.col("y_n"))).select(*XY).distinct()
    more = _verified(rest, docs, total, classes, num, den)
    found = hit.union(more).select(F.col("y_doc").alias("doc"), F.col("y_line").alias("line"))
    # a removed representative takes its class along; else its later copies go
    gone = reps.join(found.withColumn("hit", F.lit(True)), ["doc", "line"], "left").select("k1", "k2", "doc", "line", F.coalesce("hit", F.lit(False)).alias("hit"))
    copies = cards.select("k1", "k2", "doc_id", "line_no").join(gone, ["k1", "k2"])
    out = written(copies.where("hit or doc_id <> doc or line_no <> line").select("doc_id", "line_no").distinct(), "lines-gone")
    forget(cards, reps, hit, more)
    release(spark)
    return out


def _numbered(rows: DataFrame, nulls: bool) -> DataFrame:
    """rows, written, with the number of their key in the order of keys as doc_id; null ids without ``nulls`` stay null."""
    at = {"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_hash": F.xxhash64(F.coalesce("text", F.lit("")))}
    rows = rows.withColumns(at)
    # numbers rise with the partitions of the sort, and are read back as written
    keys = written(rows.where(F.lit(nulls) | ~F.col("_null")).select(*at).distinct().orderBy(*at)
                   .withColumn("_number", F.monotonically_increasing_id()), "lines-keys")
    out = written(rows.join(keys, [*at], "left").drop(*at).withColumn("doc_id", F.col("_number")).drop("_number"), "lines-numbered")
    forget(keys)
    return out


def dedup(docs: DataFrame, num: int = 4, den: int = 5, least: int = 1, nulls: bool = False) -> DataFrame:
    """The documents with their columns, text without the removed lines, and n_lines, n_removed.

    Where few documents lose a line, only those that may do so meet the table of removed lines."""
    own = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in own], F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
    if odd_ids(inner, nulls):
        inner = _numbered(inner, nulls)
    gone = removed(inner.select("doc_id", "text"), num, den, least)
    lists = gone.groupBy("doc_id").agg(F.collect_list("line_no").alias("out"))      # at most the lines of one document
    none, count = F.array().cast("array<int>"), gone.select("doc_id").distinct().count()
    if _few(count, inner.count()):
        inner = _maybe(inner, gone, count, "doc_id")
        some = inner.where("maybe").join(lists, "doc_id", "left").withColumn("out", F.coalesce("out", none))
        rows = inner.where("not maybe").withColumn("out", none).unionByName(some)
    else:
        rows = inner.join(lists, "doc_id", "left").withColumn("out", F.coalesce("out", none))
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = rows.withColumn("n_removed", F.size("out").cast("long")).withColumn("n_lines", F.size(split).cast("long"))
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("out", i)), "\n")
    text = F.when(F.col("n_removed") > 0, kept).otherwise(F.col("in_text"))
    return rows.select(*[(text if c == "text" else F.col(f"`in_{c}`")).alias(c) for c in own],
                       *[c for c in ("n_lines", "n_removed") if c not in own])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every document."""
    return (dedup(docs.select("doc_id", "text"), least=1, nulls=True)
            .select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")))
