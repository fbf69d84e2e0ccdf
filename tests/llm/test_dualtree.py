"""Operator 12 against plain scoring of every document."""

import math
import re
from collections import Counter

import numpy as np

from upshelf.llm import dualtree

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return WORD.findall((text or "").translate(LOWER))


def _plain(docs, items, k=10):
    own = [(d, Counter(_terms(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, t in dict.fromkeys(items):
        wanted.setdefault(i, Counter()).update(_terms(t))
    out = []
    for item, q in wanted.items():
        found = []
        for d, c, n in own:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                    for t, x in q.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def test_search_ranks_as_plain_scoring(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(dualtree, "CELLS", 1 << 13)          # many small batches and trees
    monkeypatch.setattr(dualtree, "ITEMS", 7)
    monkeypatch.setattr(dualtree, "GROUP", 300)
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(docs.selectExpr("doc_id + 1000", "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    odd = spark.createDataFrame([(900, "The THE the quick fox"), (900, "owls"), (900, "owls"), (901, None), (902, " \n"), (903, "zzzznowhere"), (None, "quick élèves"),
                                 (904, "quick"), (905, "Quick")], "item_id long, text string")
    items = items.union(odd)
    want = _plain([tuple(r) for r in table.collect()], [tuple(r) for r in items.collect()])
    clash = items.selectExpr("*", "'x' as doc_id", "1 as rank", "2 as score")
    assert _got(dualtree.search(table.selectExpr("*", "'x' as item_id", "1 as n", "2 as `a.b`"), clash)) == want
    assert dualtree.search(empty, items).count() == 0 and dualtree.search(table, items.limit(0)).count() == 0
    assert dualtree.search(docs.where("text is null"), items).count() == 0


def test_walk_prunes_and_keeps_every_reachable_score():
    rng = np.random.default_rng(11)
    for n, m, d in ((3, 5, 4), (70, 600, 30), (9, 8, 1)):
        items, docs = rng.integers(0, 3, size=(n, d)), rng.integers(0, 5, size=(m, d)) ** 4
        if m == 600:                    # topics that lie together
            items *= np.arange(d) // 3 == (np.arange(n) // 8)[:, None]
            docs *= np.arange(d) // 3 == (np.arange(m) // 60)[:, None]
        score = items @ docs.T
        floor = np.sort(score, axis=1)[:, -3]
        alive = dualtree.walk(dualtree.Tree(items), dualtree.Tree(docs), floor)
        full = np.repeat(np.repeat(alive, dualtree.LEAF, axis=0)[:n], dualtree.LEAF, axis=1)[:, :m]
        assert full[score >= floor[:, None]].all()
        if m == 600:
            assert not alive.all()


def test_products_beyond_floating_point_stay_exact():
    a, b = np.array([[3, 1 << 30]]), np.array([[1 << 31, (1 << 31) + 1]])
    assert dualtree._products(a, b)[0, 0] == 3 * (1 << 31) + (1 << 30) * ((1 << 31) + 1)
