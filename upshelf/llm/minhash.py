"""Operator 13: near duplicates by MinHash bands and sequential Bayesian verification.

Documents of equal shingle sets are one class; only class representatives
(smallest doc_id) are compared.

1. *Bands.* Minima of linear permutations of 32-bit shingle hashes, ``ROWS`` a
   band. Two sets are candidates if one of the bands agrees whole. There are so
   many bands that a pair at the threshold shares none with a chance below
   ``BAND_MISS`` (25 at a similarity of 0.85).
2. *Batches.* The verifying signature is a one-permutation MinHash: a byte of
   the smallest hash in each of ``BINS`` bins, 0 for an empty bin. The bins that
   either set fills are a sample without replacement of their union, a bin
   agrees if its member is common. Bins are compared batch by batch. A pair can
   reach the threshold only with ``o`` common of at most ``u`` members (known
   from the sizes); after ``m`` of ``n`` bins agree, the common ones among the
   ``u - n`` unseen members are beta-binomial under a uniform prior. A pair goes
   if it needs more than there are, or if its posterior chance to reach the
   threshold is below ``MISS``.
3. *Exact check.* Survivors are confirmed on their full sets.

Work stays linear in a group of near copies: first every representative meets
one pivot of its buckets. Then, in buckets that still hold several components,
the members outside the bucket's largest component meet the others: directly in
buckets of at most ``LIGHT`` members, by blocks of signatures in larger ones, so
that no task holds a whole bucket. Pairs inside a component could not change
the result. Nothing is capped.

Rules: null or wordless text has no set, links with nothing and is its own
component; rows with null doc_id link with nothing, have a null component and
are kept; rows that repeat a doc_id are one document, linked by any of their
texts (a task that compares it holds its different sets). Every input row gives
one row. Empty table: no rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.llm import shingles
from upshelf.llm.common import components, forget, pick, pieces, release, written

#: Minima of a band, and the chance that a pair at the threshold shares no band.
ROWS, BAND_MISS = 4, 1e-8

#: Bins of the verifying signature, those compared up to each look at the posterior, and the chance below which a pair goes.
BINS, LOOKS, MISS = 512, (64, 192, 512), 1e-9

#: Largest bucket whose pairs are joined directly; rows of a block on either side of a larger one; pairs of one
#: document that are confirmed together.
LIGHT, LEFT, RIGHT, SHARE = 32, 1024, 4096, 2048

#: Shingle hashes permuted at a time (they stay in a core's cache), pairs of signatures compared at a time.
CHUNK, BLOCK = 1 << 15, 1 << 14

U = np.uint64


def bands(num: int, den: int) -> int:
    return math.ceil(math.log(BAND_MISS) / math.log1p(-(num / den) ** ROWS))


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) smallest values under as many permutations; sets are not empty."""
    seed = shingles.mix(np.arange(1, 2 * count + 1, dtype=U)) >> U(32)
    mul, add = seed[:count].astype(np.uint32) | np.uint32(1), seed[count:].astype(np.uint32)
    out = np.empty((len(sets), count), dtype=np.uint32)
    a = 0
    while a < len(sets):
        b, n = a + 1, len(sets[a])
        while b < len(sets) and n + len(sets[b]) <= CHUNK:
            n += len(sets[b])
            b += 1
        x = (np.concatenate(sets[a:b]) >> U(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[a:b - 1])])
        for i in range(count):
            out[a:b, i] = np.minimum.reduceat(x * mul[i] + add[i], at)
        a = b
    return out


def tokens(sets: list[np.ndarray], count: int) -> np.ndarray:
    """(len(sets), count) 64-bit band tokens."""
    low = minima(sets, count * ROWS).reshape(len(sets), count, ROWS).astype(U)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=U), (len(sets), count))
    for i in range(ROWS):
        out = shingles.mix(out * U(0x9E3779B97F4A7C15) + low[:, :, i])
    return out.view(np.int64)


def signature(x: np.ndarray) -> bytes:
    """A byte of the smallest hash of every bin of a sorted set; 0: the bin is empty."""
    out = np.zeros(BINS, dtype=np.uint8)
    at = (x >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(x) else at
    out[at[first]] = (x[first] >> U(16)) % U(255) + U(1)
    return out.tobytes()


def _log_factorial(k: np.ndarray) -> np.ndarray:
    small = np.cumsum(np.log(np.maximum(np.arange(32), 1)))
    z = np.maximum(k, 31).astype(np.float64)
    return np.where(k < 32, small[np.minimum(k, 31)], z * np.log(z) - z + 0.5 * np.log(2 * np.pi * z) + 1 / (12 * z) - 1 / (360 * z ** 3))


def may_reach(m: np.ndarray, n: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int, miss: float = MISS) -> np.ndarray:
    """Whether sets of ``na`` and ``nb`` members may reach the threshold after ``m`` of ``n`` seen members are common.

    The tail of the beta-binomial is bounded from above by a geometric series
    from its first term, as its ratios of neighbouring terms fall."""
    o = -(-num * (na + nb) // (num + den))              # least number of common members
    u = na + nb - o                                     # then largest union
    left, want = u - n, o - m
    possible = want <= left
    left, x = np.maximum(left, 0), np.clip(want, 0, np.maximum(left, 0))
    lf = _log_factorial
    log = (lf(left) - lf(x) - lf(left - x) + lf(x + m) + lf(left - x + n - m) - lf(left + n + 1) - lf(m) - lf(n - m) + lf(n + 1))
    ratio = (left - x) * (m + 1 + x) / ((x + 1.0) * np.maximum(n - m + left - x, 1))
    rare = (want > 0) & (ratio < 1) & (log - np.log1p(-np.minimum(ratio, 1 - 1e-12)) < math.log(miss))
    return possible & ~rare


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the paired signatures may reach the threshold; later batches are read for earlier survivors only."""
    alive, done = np.arange(len(a)), 0
    m = n = np.zeros(len(a), dtype=np.int64)
    for look in LOOKS:
        x, y = a[alive, done:look], b[alive, done:look]
        m, n = m + ((x == y) & (x > 0)).sum(axis=1), n + ((x | y) > 0).sum(axis=1)
        stay = may_reach(m, n, na[alive], nb[alive], num, den)
        alive, m, n, done = alive[stay], m[stay], n[stay], look
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), BINS)


def cards(docs: DataFrame, k: int, count: int) -> DataFrame:
    """(doc_id, n, key, bands, sig) of every row: set size, class key, band tokens and verifying signature."""
    def run(batches):
        for b in pieces(batches):
            sets = shingles.sets(b.column(1), k)
            some = [i for i, x in enumerate(sets) if len(x)]
            key, sig, band = ([None] * len(sets) for _ in range(3))
            for i, t in zip(some, tokens([sets[i] for i in some], count)):
                key[i], sig[i], band[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), signature(sets[i]), t
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(key, pa.binary()),
                                              pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "n", "key", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, sig binary")


def _sizes(a: str, b: str, num: int, den: int):
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def survivors(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that the batches of bins leave."""
    sig = reps.select("rep", "n", "sig")
    both = (pairs.select("a", "b").join(sig.toDF("b", "nb", "sb"), "b").join(sig.toDF("a", "na", "sa"), "a")
            .select("a", "b", "na", "nb", "sa", "sb"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                c = b.slice(at, BLOCK)
                ok = plausible(_matrix(c.column(4)), _matrix(c.column(5)), np.asarray(c.column(2)), np.asarray(c.column(3)), num, den)
                yield c.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that link, by the exact overlap of their full sets.

    Pairs meet at their first document. Its set is sent once to each of its
    shares of at most about SHARE pairs, every second document's set once a pair."""
    pairs = written(pairs, "minhash-pairs")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    seats = (pairs.join(shares, "a").select(F.col("b").alias("id"), F.col("a").alias("home"), F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
             .union(shares.select(F.col("a").alias("id"), F.col("a").alias("home"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))))
    # written, so that Spark knows the size before it decides whether the texts have to be shuffled to it
    own = written(seats.groupBy("id").agg(F.collect_list(F.struct("home", "share")).alias("seats")), "minhash-seats")

    def load(batches):
        for b in pieces(batches, 2):
            sets = [x.tobytes() for x in shingles.sets(b.column(2), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.large_binary())], ["id", "seats", "x"])

    held = (docs.join(own, F.col("doc_id") == F.col("id")).select("id", "seats", "text")
            .mapInArrow(load, "id long, seats array<struct<home:long,share:int>>, x binary")
            .select(F.explode("seats").alias("s"), "id", "x").select("s.home", "s.share", "id", "x"))
    met = held.repartition("home", "share").sortWithinPartitions("home", "share", F.col("id") != F.col("home"))

    def exact(batches):
        at, first = None, []
        for batch in batches:
            home, share, ids = (batch.column(i).to_pylist() for i in range(3))
            a, b = [], []
            for h, s, i, x in zip(home, share, ids, batch.column(3)):
                x = np.frombuffer(x.as_buffer(), U)
                if (h, s) != at:
                    at, first = (h, s), []
                if i == h:
                    if not any(np.array_equal(x, y) for y in first):
                        first.append(x)
                    continue
                for y in first:
                    o = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                    if o and den * o >= num * (len(x) + len(y) - o):
                        a.append(h)
                        b.append(i)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = written(met.mapInArrow(exact, "a long, b long").distinct(), "minhash-links")
    forget(pairs, own)
    release(docs.sparkSession)
    return links


def _across(posts: DataFrame, reps: DataFrame, met: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that may link across components of a bucket, the written table they come from)."""
    mixed = (posts.groupBy("token").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("token", "k"))
    shared = written(posts.join(mixed, "token"), "minhash-mixed")
    main = (shared.groupBy("token", "root").agg(F.count("*").alias("c"))
            .groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("k"), F.max("c").alias("c"))
            .select("token", "main", (F.col("k") - F.col("c")).alias("minors")))
    rows = shared.join(main, "token").withColumn("minor", F.col("root") != F.col("main"))

    light = rows.where(F.col("k") <= LIGHT)
    x = light.where("minor").select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    y = light.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    few = (x.join(y, "token").where("ra <> rb").where(_sizes("na", "nb", num, den))
           .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(met, ["a", "b"], "left_anti"))

    heavy = (rows.where(F.col("k") > LIGHT).withColumn("ml", F.ceil(F.col("minors") / LEFT).cast("int"))
             .withColumn("mr", F.ceil(F.col("k") / RIGHT).cast("int")))
    place = lambda m: F.pmod(F.xxhash64("rep"), F.col(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = heavy.where("minor").select("token", place("ml").alias("i"), spread("mr").alias("j"), "rep", "n", "root", F.lit(True).alias("left"))
    right = heavy.select("token", spread("ml").alias("i"), place("mr").alias("j"), "rep", "n", "root", F.lit(False).alias("left"))
    blocks = left.union(right).join(reps.select("rep", "sig"), "rep").groupBy("token", "i", "j")

    def tile(t: pa.Table) -> pa.Table:
        rep, n, root, side = (t.column(c).to_numpy() for c in ("rep", "n", "root", "left"))
        sig, side = _matrix(t.column("sig")), side.astype(bool)
        l, r = np.flatnonzero(side), np.flatnonzero(~side)
        nl, nr = n[l][:, None], n[r][None, :]
        first = sig[:, :LOOKS[0]]
        void = (first == 0).astype(np.float32)
        both = (void[l] @ void[r].T).astype(np.int16)          # bins that neither fills
        same = np.zeros((len(l), len(r)), dtype=np.int16)
        for i in range(LOOKS[0]):
            same += first[l, i][:, None] == first[r, i][None, :]
        x, y = np.nonzero((root[l][:, None] != root[r][None, :]) & (nl * den >= nr * num) & (nr * den >= nl * num))
        seen, ok = (LOOKS[0] - both)[x, y].astype(np.int64), []
        for at in range(0, len(x), BLOCK):
            p, q = x[at:at + BLOCK], y[at:at + BLOCK]
            m = (same[p, q] - both[p, q]).astype(np.int64)
            p, q = (v[may_reach(m, seen[at:at + BLOCK], n[l[p]], n[r[q]], num, den)] for v in (p, q))
            stay = plausible(sig[l[p]], sig[r[q]], n[l[p]], n[r[q]], num, den)
            ok.append((l[p[stay]], r[q[stay]]))
        a, b = (rep[np.concatenate([o[i] for o in ok])] if ok else rep[:0] for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    many = blocks.applyInArrow(tile, "a long, b long")
    return survivors(few, reps, num, den).union(many).where("a < b").distinct(), shared


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked when den * intersection >= num * union."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string")
    full = written(cards(docs, k, bands(num, den)), "minhash-full")
    card = written(full.select("doc_id", "n", "key"), "minhash-cards")
    reps = written(full.where("doc_id is not null and n > 0").groupBy("key")
                   .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "minhash-reps")
    forget(full)
    release(spark)

    # texts of one doc_id are one document
    known = card.where("doc_id is not null and n > 0")
    several = known.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    own = (known.join(several, "doc_id", "left_semi").select("doc_id", "key").distinct().join(reps.select("key", "rep"), "key")
           .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    own = written(own, "minhash-own")

    posts = reps.select("rep", "n", F.explode("bands").alias("token"))
    pivot = (posts.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
             .select("token", F.col("p.rep").alias("a"), F.col("p.n").alias("na")))
    shared = written(posts.join(pivot, "token"), "minhash-shared")
    star = (shared.where("rep <> a").where(_sizes("n", "na", num, den))
            .groupBy("rep", "a").agg(F.count("*").alias("c"))
            .groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("p"))
            .select((-F.col("p.a")).alias("a"), "b"))
    star = written(star, "minhash-star")
    release(spark)
    links = confirmed(survivors(star, reps, num, den), docs, k, num, den)
    first = components(links.union(own), "minhash-cc1")
    rooted = (shared.select("token", "rep", "n").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select("token", "rep", "n", F.coalesce("component", "rep").alias("root")))
    across, mixed = _across(rooted, reps, star, num, den)
    more = confirmed(across, docs, k, num, den)
    forget(shared, star, mixed)

    # links across components join whole components
    root = first.select(F.col("node"), F.col("component"))
    over = (more.join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    second = components(over, "minhash-cc2").toDF("root", "over")
    named = (reps.select("key", "rep").join(first, F.col("rep") == F.col("node"), "left")
             .select("key", F.coalesce("component", "rep").alias("root")).join(second, "root", "left")
             .select("key", F.coalesce("over", "root").alias("component")))
    out = written(card.join(named, "key", "left")
                  .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
                  .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "minhash-out")
    forget(card, reps, links, more, own)
    return out
