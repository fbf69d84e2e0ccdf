"""Operator 9: exact Jaccard join of word-shingle sets.

Documents of equal sets are one class, and only class representatives
(smallest doc_id) are compared. A representative lies in *tiles*: one per size
band (powers of two, and the next band where a partner may lie in it) and per
shingle of its prefix. In its own band the prefix holds the ``n - ceil(t*n) + 1`` rarest
shingles, by a corpus count in a fixed number of hash buckets. In the next band ``m`` is the
smallest size of a partner, a link takes ``o = ceil((n + m) * t / (1 + t))`` shared shingles, and
the ``n - o + 1`` rarest do. So two linked sets always share a tile. In a tile pairs pass

1. the size bound ``t * larger <= smaller``,
2. the bitmap bound: each set is hashed to a bitmap of its band's length; a bit
   only one side has is a shingle the other lacks, so bit counts bound the
   overlap from above,
3. the exact intersection of the sorted arrays.

Work stays linear in a group of near copies: first every member meets one
pivot of its tiles; then only pairs in different components so far are
compared. Pairs inside one component could not change the result.

Rules: null or wordless text has no set, links with nothing and is its own
component; rows with null doc_id link with nothing and have a null component;
rows that repeat a doc_id are one document, linked by any of their texts.
Every input row gives one row. Empty table: no rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm import shingles
from upshelf.llm.common import components, forget, pick, release, small_batches, written

#: Buckets of the corpus count and bits of the candidate filter: fixed, so what is sent to all tasks has a fixed size.
BUCKETS, FILTER_BITS = 1 << 16, 1 << 22

#: Members of a block of a tile; tiles up to LIGHT members give their few pairs straight away.
BLOCK, LIGHT = 1024, 32
U = np.uint64


def bucket_counts(docs: DataFrame, k: int) -> np.ndarray:
    """In how many documents the shingles of each hash bucket occur, over all documents."""
    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for x in shingles.sets(b.column(0), k):
                total += np.bincount((x & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS) if len(x) > 4096 else 0
                if 0 < len(x) <= 4096:
                    np.add.at(total, (x & U(BUCKETS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = (docs.select("text").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())    # at most BUCKETS rows
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r.bucket] = r.n
    del rows
    release(docs.sparkSession)
    return out


def _bits(n: int) -> int:
    return 1 << max(6, int(2 * n - 1).bit_length())


def bitmap(x: np.ndarray) -> bytes:
    out = np.zeros(_bits(len(x)), dtype=bool)
    out[(mix_low(x) & U(len(out) - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def mix_low(x: np.ndarray) -> np.ndarray:
    return x >> U(20)           # bits the bucket count does not use


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """Upper bound of the overlap from two bitmaps; the longer one is folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def cards(docs: DataFrame, k: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, key, sig, prefix): size, class key, bitmap and rarest shingles, rarest first, of every row."""
    low = np.minimum(counts, (1 << 24) - 1).astype(U) << U(40)

    def run(batches):
        for b in batches:
            n, key, sig, pre = [], [], [], []
            for x in shingles.sets(b.column(1), k):
                m = len(x)
                n.append(m)
                key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if m else None)
                sig.append(bitmap(x) if m else None)
                order = low[(x & U(BUCKETS - 1)).astype(np.int64)] | (x >> U(24))
                p = m - (num * m + den - 1) // den + 1 if m else 0
                pre.append(np.sort(np.partition(order, p - 1)[:p] if 0 < p < m else order).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()),
                 pa.array(pre, pa.list_(pa.int64()))], ["doc_id", "n", "key", "sig", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, key binary, sig binary, prefix array<long>")


def _posts(reps: DataFrame, num: int, den: int, *more: str) -> DataFrame:
    """A row per tile (token, band) of a representative."""
    band = F.floor(F.log2(F.col("n"))).cast("int")
    above = F.pow(F.lit(2.0), band + 1).cast("long")
    need = F.ceil((F.col("n") + above) * num / (num + den))
    tile = lambda b, size: F.struct(b.alias("band"), F.slice("prefix", F.lit(1), size.cast("int")).alias("tokens"))
    own = tile(band, F.size("prefix"))
    tiles = F.when(F.col("n") * den >= num * above, F.array(own, tile(band + 1, F.col("n") - need + 1))).otherwise(F.array(own))
    return (reps.select("rep", "n", *more, F.explode(tiles).alias("tile"))
            .select(F.explode("tile.tokens").alias("token"), "tile.band", "rep", "n", *more))


def _sizes(a: str, b: str, num: int, den: int):
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def _filter(ids: DataFrame) -> np.ndarray:
    """A fixed-size bit set that holds every id (and some others)."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = (ids.select(F.shiftright(h, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).collect())       # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in rows:
        out[r.w] = r.b
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _crossing(post: DataFrame, reps: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a tile in different components whose bitmaps allow a link, and the written table they come from.

    A tile of k members is cut into blocks of about BLOCK; every pair of blocks
    is compared by one matrix product of bitmaps, and only pairs within the
    bound leave it. In a tile of at most LIGHT members, where a product would
    cost more than the pairs, the bitmaps are compared after the join."""
    tiles = (post.groupBy("token", "band").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo <> hi").select("token", "band", "k"))
    table = shared = written(post.join(tiles, ["token", "band"]), "jaccard-shared")
    light = shared.where(F.col("k") <= LIGHT).drop("k")
    x, y = light.toDF("token", "band", "a", "na", "ra"), light.toDF("token", "band", "b", "nb", "rb")
    few = (x.join(y, ["token", "band"]).where("a < b and ra <> rb").where(_sizes("na", "nb", num, den))
           .select("a", "b"))
    shared = shared.where(F.col("k") > LIGHT).withColumn("m", F.ceil(F.col("k") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("m")).cast("int")
    others = F.sequence(F.lit(0), F.col("m") - 1)
    blocks = (shared.withColumn("own", own).withColumn("other", F.explode(others))
              .select("token", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      "rep", "n", "root", "own"))
    met = blocks.join(reps.select("rep", "sig"), "rep").groupBy("token", "band", "i", "j")

    def tile(batch: pa.Table) -> pa.Table:
        rep, n, root, own = (batch.column(c).to_numpy() for c in ("rep", "n", "root", "own"))
        size = min(len(x) for x in batch.column("sig").to_pylist())
        bits = np.empty((len(rep), size * 8), dtype=np.float32)
        for r, x in enumerate(batch.column("sig").to_pylist()):
            y = np.frombuffer(x, np.uint8)
            while len(y) > size:
                y = y[:len(y) // 2] | y[len(y) // 2:]
            bits[r] = np.unpackbits(y)
        at = [np.flatnonzero(own == v) for v in np.unique(own)]
        left, right = at[0], at[-1]
        both = bits[left] @ bits[right].T
        pop = bits.sum(axis=1)
        na, nb = n[left][:, None], n[right][None, :]
        over = np.minimum(na - (pop[left][:, None] - both), nb - (pop[right][None, :] - both))
        ok = (den * over >= num * (na + nb - over)) & (root[left][:, None] != root[right][None, :])
        x, y = np.nonzero(ok)
        a, b = rep[left[x]], rep[right[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return met.applyInArrow(tile, "a long, b long").where("a < b").union(few).distinct(), table


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs that link: bitmap bound first, exact intersection of the rest. Pairs grow with the documents, so
    merge joins at every size: no pairs are gathered on the driver for a broadcast, and one plan serves all sizes."""
    sig = reps.select("rep", "n", "sig").hint("merge")
    both = (pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
            .select("a", "b", "na", "nb", "sa", "sb"))

    def bound(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            keep = []
            for _, _, na, nb, sa, sb in zip(*cols):
                o = overlap_bound(sa, na, sb, nb)
                keep.append(den * o >= num * (na + nb - o))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = written(both.mapInArrow(bound, "a long, b long").distinct(), "jaccard-near")
    release(docs.sparkSession)
    bits = _filter(near.select(F.col("a").alias("id")).union(near.select("b")).distinct())

    def load(batches):
        for b in batches:
            b = b.filter(pa.array(bits[b.column(2).to_numpy(zero_copy_only=False)].astype(bool)))
            if b.num_rows:
                got = [x.tobytes() for x in shingles.sets(b.column(1), k)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.large_binary())], ["id", "x"])

    held = (docs.where("doc_id is not null")
            .select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("h"))
            .mapInArrow(load, "id long, x binary").hint("merge"))
    full = near.join(held.toDF("a", "xa"), "a").join(held.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")

    def exact(batches):
        for batch in batches:
            keep = []
            for xa, xb in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(xa.as_buffer(), U), np.frombuffer(xb.as_buffer(), U)
                o = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * o >= num * (len(x) + len(y) - o))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(full.mapInArrow(exact, "a long, b long").distinct(), "jaccard-links")
    release(docs.sparkSession)
    forget(near)
    return links


def join(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked when den * intersection >= num * union."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = pick(docs, doc_id="long", text="string")
    card = written(cards(docs, k, num, den, bucket_counts(docs, k)), "jaccard-cards")
    release(spark)
    reps = written(card.where("doc_id is not null and n > 0").groupBy("key")
                   .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"),
                        F.first("prefix").alias("prefix")), "jaccard-reps")
    release(spark)
    # prefixes and bitmaps of all rows are not needed again: of the cards only sizes and keys stay
    keys = written(card.select("doc_id", "n", "key"), "jaccard-keys")
    forget(card)
    # tiles of one member hold no pair: only the others are written, for both passes. Posts are dealt out once, for
    # the tile's size and its pivot alike
    tile = Window.partitionBy("token", "band")
    tiles = written(_posts(reps, num, den).select("*", F.min("rep").over(tile).alias("a"), F.count("*").over(tile).alias("c"))
                    .where("c > 1").drop("c"), "jaccard-tiles")
    release(spark)
    star = (tiles.where("rep <> a").groupBy("rep", "n", "a").agg(F.count("*").alias("c"))
            .join(reps.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").where(_sizes("n", "na", num, den))
            .groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("p"))
            .select((-F.col("p.a")).alias("a"), "b"))
    links = verified(star, reps, docs, k, num, den)
    release(spark)
    so_far = components(links, "jaccard-cc1")
    release(spark)
    rooted = (tiles.join(so_far.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select("token", "band", "rep", "n", F.coalesce("component", "rep").alias("root")))
    across, shared = _crossing(rooted, reps, num, den)
    more = verified(across, reps, docs, k, num, den)
    forget(shared, tiles)
    release(spark)
    comp = components(links.union(more), "jaccard-cc2")
    release(spark)
    named = (reps.select("key", "rep").join(comp, F.col("rep") == F.col("node"), "left")
             .select("key", F.coalesce("component", "rep").alias("component_id")))
    out = written(keys.join(named, "key", "left")
                  .select("doc_id", F.col("n").alias("n_shingles"),
                          F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")), "jaccard-out")
    forget(keys, reps, links, more)
    release(spark)
    return out
