"""Operator 13 against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from upshelf.llm import minhash, shingles

SF = "/root/testdata/sf0.001"


def _shingles(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def _plain(rows, k, num, den):
    rows = [(d, _shingles(t, k)) for d, t in rows]
    best = {d: d for d, _ in rows if d is not None}
    find = lambda x: x if best[x] == x else find(best[x])
    known = [r for r in rows if r[0] is not None and r[1]]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x & y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                best[hi] = lo
    return sorted([(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in rows], key=str)


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
@pytest.mark.parametrize("light,left,right,share", [(32, 1024, 4096, 2048), (2, 2, 3, 1)])
def test_components(spark, docs, k, num, den, light, left, right, share, monkeypatch):
    for name, value in (("LIGHT", light), ("LEFT", left), ("RIGHT", right), ("SHARE", share)):      # small buckets go through the blocks too
        monkeypatch.setattr(minhash, name, value)
    chain = [f"w{i} " * 1 for i in range(400)]
    # a group in which each text is near the next few only, one row of other words under a used id, an edge of 17 of 20 shingles
    group = [(3000 + i, "".join(chain[3 * i:3 * i + 120])) for i in range(40)]
    odd = [(3001, "an entirely different text under an id that is used already today"), (2000, "An entirely  different text under an id that is used already today"),
           (2100, " ".join(f"e{i}" for i in range(19))), (2101, " ".join(f"e{i}" for i in range(22)))]
    table = (docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
             .union(spark.createDataFrame(group + odd, "doc_id long, text string")))
    want = _plain([tuple(r) for r in table.collect()], k, num, den)
    found = minhash.near_duplicates(table.withColumn("key", F.lit("clash")).withColumn("a.b", F.lit(1)), k, num, den)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()], key=str) == want


def test_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_posterior_is_the_beta_binomial_tail():
    def tail(m, n, left, want):           # uniform prior on the share of common members, seen without replacement
        return sum(math.comb(left, x) * math.exp(
            math.lgamma(x + m + 1) + math.lgamma(left - x + n - m + 1) - math.lgamma(left + n + 2)
            - math.lgamma(m + 1) - math.lgamma(n - m + 1) + math.lgamma(n + 2)) for x in range(max(want, 0), left + 1))

    rng = np.random.default_rng(4)
    for _ in range(400):
        na, nb = rng.integers(1, 400, 2)
        o = -(-85 * (na + nb) // 185)
        u = int(na + nb - o)
        n = int(rng.integers(0, min(u, 300) + 1))
        m = int(rng.integers(0, min(n, o) + 1))
        got = minhash.may_reach(*(np.array([v]) for v in (m, n, na, nb)), 85, 100, miss=1e-4)[0]
        real = tail(m, n, u - n, int(o - m)) if o - m <= u - n else 0
        assert got >= (real >= 1e-4)                     # the bound keeps all that the posterior keeps
        if real < 1e-5:
            assert not got                               # and little more
    far = np.array([50_000])
    assert not minhash.may_reach(np.array([300]), np.array([512]), far, far, 85, 100)[0] and minhash.may_reach(np.array([430]), np.array([512]), far, far, 85, 100)[0]


def test_signatures_estimate_jaccard_and_batches_keep_near_pairs():
    rng = np.random.default_rng(2)
    pool = shingles.mix(rng.integers(1, 1 << 60, 4000).astype("uint64"))
    sets = [np.sort(pool[a:a + 1000]) for a in (0, 50, 80, 500, 2500)]
    low = minhash.minima(sets, 128)
    for j, real in enumerate((950 / 1050, 920 / 1080, 500 / 1500, 0), 1):
        assert abs((low[0] == low[j]).mean() - real) < 5 * math.sqrt(max(real * (1 - real), 0.001) / 128)
    sig, n = np.array([np.frombuffer(minhash.signature(s), np.uint8) for s in sets]), np.full(5, 1000)
    assert minhash.plausible(sig[[0] * 5], sig, n, n, 85, 100).tolist() == [True, True, True, False, False]
    assert not any(minhash.signature(sets[0][:0]))
    assert minhash.bands(85, 100) == 25 and (1 - 0.85 ** minhash.ROWS) ** 25 < 1e-8


def test_long_text_beside_short_ones(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " tail"), (3, "v1 v2 v3"), (4, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]
