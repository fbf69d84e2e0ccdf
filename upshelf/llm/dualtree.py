"""Operator 12: ranked lexical search by a dual tree over items and documents.

An item's vector counts its terms; a document's vector holds, for the same
terms, whole numbers ``w * ((10^9 tf) div (1000 tf + 8 m))``. A score is their
inner product, all terms are at least 0, so for a node of items and a node of
documents the product of their coordinate maxima bounds every score of the pair
from above.

1. One pass reads the texts and writes, per document, its number of terms and
   the counts of the items' terms. Totals and document frequencies come from
   the written rows.
2. Every task holds the item tree. It takes its documents in batches, orders a
   batch by language-like likeness (heaviest coordinate, then length), builds
   the document tree and walks both from the roots: a pair of nodes whose bound
   is below the weakest k-th best score of its items is pruned whole, exactly;
   pairs left over at the leaves are scored in whole numbers and merged into the
   items' k best. The best of all tasks meet in two ranked steps.

Terms are compared by 64-bit hashes: two of a corpus's T terms and the items' V
agree by chance below ``T * V / 2^64``.

Memory: items are taken in groups of about ``GROUP`` terms (a pass over the
written rows each, usually one), inside a task in blocks of ``ITEMS``; a batch
of documents is as long as ``CELLS`` coordinates allow. Texts are never cut.

Rules: null texts and texts without terms score nothing and do not count in N.
Every row is a document, also where a doc_id repeats; rows without an id are
ranked with a null id, after equal scores with one. Rows of one item_id are one
item: the terms of its distinct texts together; a null item_id is an item too.
Items without terms have no rows. Scores must stay below 2^63. Empty tables: no
rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm import shingles
from upshelf.llm.common import forget, pick, pieces, written

#: Distinct (item, term) pairs of a group, items of a block, coordinates of a batch of documents.
GROUP, ITEMS, CELLS = 1 << 20, 256, 1 << 22

#: Children of a node, and documents or items of a leaf.
FAN, LEAF = 8, 8

#: Salts of the first ranking of the tasks' results.
SALTS = 64

U = np.uint64
# bytes that separate terms become spaces: ASCII that is neither letter nor digit
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[:128][[not chr(c).isalnum() for c in range(128)]] = 32


def terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every term, first term of each text and the end)."""
    data, off = shingles.buffers(col)
    return shingles.words(_CLEAN[data], off)


def _counts(col: pa.Array, vocab: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of terms, distinct terms, their counts) of every text; with ``vocab``, only its terms, as positions."""
    h, at = terms(col)
    if vocab is not None:
        pos = np.searchsorted(vocab, h)
        pos[pos == len(vocab)] = 0
        known = vocab[pos] == h if len(vocab) else np.zeros(len(h), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = h[a:b] if vocab is None else pos[a:b][known[a:b]]
        u, c = np.unique(own, return_counts=True)
        yield b - a, u, c


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, q): how often a term stands in an item."""
    def run(batches):
        for b in pieces(batches):
            got = list(_counts(b.column(1), None))
            who = np.repeat(np.arange(b.num_rows), [len(u) for _, u, _ in got])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(who)), pa.array(np.concatenate([u for _, u, _ in got]).view(np.int64)),
                 pa.array(np.concatenate([c for _, _, c in got]).astype(np.int64))], ["item_id", "term", "q"])

    rows = pick(items, item_id="long", text="string").distinct().mapInArrow(run, "item_id long, term long, q long")
    return rows.groupBy("item_id", "term").agg(F.sum("q").alias("q"))


def _read(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc_id, n, at, tf): terms of a document, and the places in ``vocab`` of those of the items with their counts."""
    def run(batches):
        for b in pieces(batches):
            got = list(_counts(b.column(1), vocab))
            ends = np.cumsum([0, *(len(u) for _, u, _ in got)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate([x[i] for x in got]).astype(np.int32)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.int64()), *lists], ["doc_id", "n", "at", "tf"])

    return docs.mapInArrow(run, "doc_id long, n long, at array<int>, tf array<int>").where("n > 0")


def _frequencies(rows: DataFrame, size: int) -> np.ndarray:
    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for b in batches:
            df += np.bincount(np.asarray(b.column(0).flatten()), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["at", "df"])

    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("at").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():   # at most one a term
        out[r["at"]] = r.df
    return out


class Tree:
    """Levels of coordinate maxima over rows, leaves first; children of a node lie together."""

    def __init__(self, x: np.ndarray):
        self.levels, self.starts = [], []
        step = LEAF
        while True:
            at = np.arange(0, len(x), step)
            self.levels.append(np.maximum.reduceat(x, at, axis=0))
            self.starts.append(at)
            if len(at) == 1:
                return
            x, step = self.levels[-1], FAN


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where every sum is exact there."""
    top = float(a.sum(axis=1, dtype=np.float64).max(initial=0)) * float(b.max(initial=0))
    if top < 2.0 ** 52:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def walk(items: Tree, docs: Tree, floor: np.ndarray) -> np.ndarray:
    """Which leaf pairs (items x documents) may hold a score of ``floor`` or more; ``floor`` goes by item."""
    deep = max(len(items.levels), len(docs.levels))
    weakest = [np.minimum.reduceat(floor, items.starts[0])]
    for at in items.starts[1:]:
        weakest.append(np.minimum.reduceat(weakest[-1], at))
    alive = np.ones((1, 1), dtype=bool)
    for d in range(deep - 1, -1, -1):
        i, j = min(d, len(items.levels) - 1), min(d, len(docs.levels) - 1)
        a, b = items.levels[i], docs.levels[j]
        if alive.shape != (len(a), len(b)):             # children take their parents' place
            up = np.arange(len(a)) // FAN if alive.shape[0] != len(a) else np.arange(len(a))
            to = np.arange(len(b)) // FAN if alive.shape[1] != len(b) else np.arange(len(b))
            alive = alive[np.ix_(up, to)]
        r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if len(r) == 0:
            return np.zeros((len(items.levels[0]), len(docs.levels[0])), dtype=bool)
        alive[np.ix_(r, c)] &= _products(a[r], b[c]) >= weakest[i][r][:, None]
    return alive


class Best:
    """The k best (score, id, id is null) of every item, by score, then id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.zeros((n, k), dtype=np.int64)
        self.id, self.null = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=bool)

    def floor(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], 1)         # scores of 0 never count

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, d, z = (np.concatenate([x[i], y]) for x, y in ((self.score, score), (self.id, ids), (self.null, null)))
        o = np.lexsort((d, z, s == 0, -s))[:self.k]
        self.score[i], self.id[i], self.null[i] = s[o], d[o], z[o]


class Block:
    """Some items over the terms that they hold."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray):
        self.cols = np.unique(np.concatenate([at for at, _ in rows]))
        q = np.zeros((len(rows), len(self.cols)), dtype=np.int64)
        for i, (at, count) in enumerate(rows):
            q[i, np.searchsorted(self.cols, at)] = count
        self.order = np.argsort((q * weight[self.cols]).argmax(axis=1), kind="stable")   # like items lie together
        self.q = q[self.order]
        self.tree = Tree(self.q)

    def search(self, x: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best, first: int) -> int:
        """Merge the documents ``x`` (over ``cols``) into the items' best; the number of scored pairs."""
        order = np.lexsort((x.sum(axis=1), x.argmax(axis=1)))
        x, ids, null = x[order], ids[order], null[order]
        at = first + self.order
        alive = walk(self.tree, Tree(x), best.floor()[at])
        done = 0
        for leaf in np.flatnonzero(alive.any(axis=1)):
            r = np.arange(leaf * LEAF, min(len(self.q), (leaf + 1) * LEAF))
            c = np.flatnonzero(np.repeat(alive[leaf], LEAF)[:len(x)])
            score = _products(self.q[r], x[c])
            done += score.size
            for own, s in zip(at[r], score):
                ok = np.flatnonzero(s >= max(1, best.score[own, -1]))
                if len(ok):
                    best.add(own, s[ok], ids[c[ok]], null[c[ok]])
        return done


def _scored(rows: DataFrame, items: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): every task's k best of every item, the item by its place."""
    blocks = [Block([(at, c) for _, at, c in items[a:a + ITEMS]], weight) for a in range(0, len(items), ITEMS)]

    def run(batches):
        best = Best(len(items), k)
        for b in batches:
            ids, n = b.column(0), np.asarray(b.column(1))
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            off = np.asarray(b.column(2).offsets)
            at, tf = np.asarray(b.column(2).values)[off[0]:off[-1]], np.asarray(b.column(3).values)[off[0]:off[-1]].astype(np.int64)
            who = np.repeat(np.arange(len(n)), np.diff(off))
            m = 25 + np.array([75 * int(x) * n_docs // n_terms for x in n], dtype=np.int64)
            value = weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[who]))
            for i, block in enumerate(blocks):
                col = np.searchsorted(block.cols, at)
                col[col == len(block.cols)] = 0
                own = np.flatnonzero(block.cols[col] == at)
                size = max(LEAF, CELLS // len(block.cols))
                cut = np.searchsorted(who[own], np.arange(0, len(n) + size, size))
                for j, a in enumerate(range(0, len(n), size)):
                    part = own[cut[j]:cut[j + 1]]
                    x = np.zeros((min(size, len(n) - a), len(block.cols)), dtype=np.int64)
                    x[who[part] - a, col[part]] = value[part]
                    block.search(x, ids[a:a + size], null[a:a + size], best, i * ITEMS)
        i, r = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(best.id[i, r], mask=best.null[i, r]), pa.array(best.score[i, r])],
                                         ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    docs = pick(docs, doc_id="long", text="string")
    wanted = written(_item_terms(items), "dualtree-items")
    groups = max(1, math.ceil(wanted.count() / GROUP))
    found = []
    for g in range(groups):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).orderBy("item_id", "term").toArrow()   # about GROUP rows
        if rows.num_rows == 0:
            continue
        term, q = np.asarray(rows["term"]).view(U), np.asarray(rows["q"])
        who = rows["item_id"].to_pylist()
        cut = [0, *(i for i in range(1, len(who)) if who[i] != who[i - 1]), len(who)]
        vocab = np.unique(term)
        at = np.searchsorted(vocab, term)
        read = written(_read(docs, vocab), "dualtree-docs")
        total = read.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            forget(read)
            continue
        df = _frequencies(read, len(vocab))
        weight = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
        own = [(who[a], at[a:b], q[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        tops = _scored(read, own, weight, total.n, total.l, k).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SALTS)))
        best = _ranked(_ranked(tops, ["item", "salt"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(own)], "item long, item_id long")
        found.append(written(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "dualtree-out"))
        forget(read)
    forget(wanted)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def oracle(k: int = 10) -> str:
    split = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
    return f"""
WITH t AS (SELECT doc_id, {split} AS t FROM documents),
tf AS MATERIALIZED (SELECT doc_id, t, count(*) AS tf FROM t GROUP BY doc_id, t),
n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, {split} AS t FROM benchmark) GROUP BY item_id, t),
w AS (
  SELECT tf.t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, c WHERE t IN (SELECT t FROM q) GROUP BY tf.t, docs
), m AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM n, c),
s AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {k}"""
