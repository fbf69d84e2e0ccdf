"""Operators 1, 2, 5 and 9 against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from upshelf.llm import ann, fingerprint, jaccard, linededup, shingles

SF = "/root/testdata/sf0.001"


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 7)).astype("float32")
    v[40:60] = v[10]
    rows = [(i, v[i].tolist(), "x") for i in range(300)] + [(3, v[3].tolist(), "x"), (900, None, "x"), (901, [], "x"), (902, [0.0] * 7, "x"),
            (903, [1.0, None] + [0.0] * 5, "x"), (904, [float("nan")] * 7, "x"), (905, [1.0, 2.0], "x"), (None, v[1].tolist(), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = ann.nearest(df, F.col("id") % 20 == 0, k=20, query_block=4, cand_block=32, blocks_per_slice=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = v.astype("float64")
    assert set(by) == set(range(0, 300, 20))
    for q, found in by.items():
        s = np.cumsum(w * w[q], axis=1)[:, -1]
        want = sorted((-s[i], i) for i in range(300) if i != q)[:20]
        assert [(i, -x) for x, i in want] == [(i, x) for _, i, x in sorted(found)]


def test_nearest_of_numbers_beyond_the_bounds(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e100, 0.0]), (2, [-1e200, 3.0]), (3, [0.0, 2e-200]), (4, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.query_id: [] for r in ann.nearest(df, F.col("id") == 0, k=3).collect()}
    for r in ann.nearest(df, F.col("id") == 0, k=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(got[0])] == [1, 3, 4]


def test_nearest_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, F.lit(True), k=20).orderBy("query_id").collect()] == \
        [(0, 1, 1, 0.5), (1, 1, 0, 0.5)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def _likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_follow_generalised_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.with_edited(docs).collect()}
    assert len(got) == len(rows)
    off, prints = [], {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        h = len(t) // 2
        edited = t[:len(t) - h] + nxt[:h]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, got[d].fingerprint) == got[d].fingerprint
        off += [got[d].near_edited - _likeness(t, edited), got[d].near_next - _likeness(t, nxt)]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.5 / math.sqrt(fingerprint.SAMPLES)


def test_fingerprints_of_odd_rows(spark, docs, empty):
    got = fingerprint.with_edited(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    of = {r.doc_id: r for r in got}
    assert of[0].fingerprint == of[1].fingerprint == of[None].fingerprint and of[0].near_next == 1.0
    assert of[3].fingerprint == of[4].fingerprint == of[6].fingerprint == "" and of[3].near_next == 1.0
    assert fingerprint.with_edited(empty).count() == 0
    one = fingerprint.with_edited(docs.where("doc_id = 7")).first()
    assert one.edited_sha256 == hashlib.sha256(b"one one").hexdigest()


def _shingles(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_jaccard_components(spark, docs, k, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "LIGHT", 2)        # small tiles go through the blocked product too
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    table = docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    rows = [(r.doc_id, _shingles(r.text, k)) for r in table.collect()]
    best = {d: d for d, _ in rows if d is not None}
    find = lambda x: x if best[x] == x else find(best[x])
    known = [r for r in rows if r[0] is not None and r[1]]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x & y and den * len(x & y) >= num * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                best[hi] = lo
    want = sorted(((d, len(s), find(d) if d is not None else None) for d, s in rows), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(table, k, num, den).collect()), key=str)
    assert got == want


def test_jaccard_links_across_size_bands_at_the_threshold(spark):
    """Pairs that just reach or just miss the threshold, the larger in the next band of sizes."""
    rows, want = [], {}
    for i, large in enumerate((64, 65, 70, 79, 128, 131, 256)):
        for j, small in enumerate((large * 4 // 5, -(-large * 4 // 5), large - 1)):
            a = 2 * (3 * i + j)
            words = [f"w{a}x{v}" for v in range(large)]
            rows += [(a, " ".join(words)), (a + 1, " ".join(words[:small]))]
            want |= {a: a, a + 1: a if 5 * small >= 4 * large else a + 1}
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=1, num=4, den=5).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_empty_and_bounds(empty):
    assert jaccard.join(empty).count() == 0
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (90, 100), (3000, 3300)):
        pool = shingles.mix(rng.integers(1, 1 << 60, n + m).astype("uint64"))
        a, b = np.sort(pool[:n]), np.sort(pool[n // 3:n // 3 + m])
        real = len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b)) >= real


def _removed(rows, least=1):
    tr = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz    ")
    lines = sorted((d, i, frozenset(w for w in x.translate(tr).split(" ") if w)) for d, t in rows if d is not None
                   for i, x in enumerate((t or "").split("\n")))
    out = set()
    for j, (d, i, s) in enumerate(lines):
        if len(s) >= least and any((e, k) < (d, i) and len(t) >= least and 9 * len(s & t) >= 4 * (len(s) + len(t)) for e, k, t in lines[:j]):
            out.add((d, i))
    return out


@pytest.mark.parametrize("named", [1 << 19, 3])
def test_line_dedup(spark, docs, named, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 2)
    monkeypatch.setattr(linededup, "NAMED", named)          # bit sets, and the join beyond them
    some = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text").where("doc_id < 150")
    near = spark.createDataFrame([(1000 + i, f"alpha beta gamma delta epsilon zeta eta theta iota variant{i}") for i in range(12)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(some).union(near)
    rows = [(r.doc_id, r.text) for r in table.collect()]
    gone = _removed(rows)
    got = linededup.dedup(table).collect()
    want = sorted(((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows), key=str)
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == want
    assert sum(r.n_removed for r in got) == sum((d, i) in gone for d, t in rows for i, _ in enumerate((t or "").split("\n")))


def test_line_dedup_empty_and_columns(docs, empty):
    assert linededup.digests(empty).count() == 0
    assert linededup.dedup(docs).columns[:6] == docs.columns


def test_line_dedup_of_short_lines_and_lines_without_blanks(spark):
    texts = ["Menu\nHome\n床前明月光疑是地上霜举头望明月低头思故乡\na b c\nw x y z\n\nthe only line that is long enough here",
             "home\nb  c a\na b d\nv w x y z\n床前明月光疑是地上霜举头望明月低头思故乡\n", "menu home\nMENU\nx\nz y x w", "a b c\nmenu"]
    rows = list(enumerate(texts))
    gone = _removed(rows, least=1)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}
    assert want[1] == "a b d\n" and want[3] == ""
    assert {r.doc_id: r.text for r in linededup.dedup(table, least=1).collect()} == want
    assert {r.doc_id: r.kept_sha256 for r in linededup.digests(table).collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_line_dedup_of_repeated_and_null_ids(spark):
    a, b = "shared words stand in this line\nonly in text a here we go", "clean words of quite another kind\nsecond clean line of the text b"
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a + "\nsomething that no other row has"), (None, b), (None, b), (None, None)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=1, nulls=True).collect()
    want = [(3, a), (5, ""), (5, b), (5, b), (None, "something that no other row has"), (None, ""), (None, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    # by default rows without an id are left alone
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want[4:] = rows[4:]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_folded_lines_have_the_words_of_plain_python(spark):
    texts = ["Foo BAR\nfoo", "a\tB\x0bC\x0cD\rE", "É Ünd ÀB cD", "İ K \u2028X", "", None, " x  Y "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.w for r in linededup._lines(df).select("doc_id", "line_no", linededup._words("line").alias("w")).collect()}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert got == {(d, i): [w for w in re.split("[\x20\x09-\x0d]+", x.translate(fold)) if w] for d, t in enumerate(texts) for i, x in enumerate((t or "").split("\n"))}


def test_bit_sets_name_a_small_share_only():
    # whatever the size of the table: most of its rows are met by a join
    assert linededup._few(100, 800) and not linededup._few(101, 800) and not linededup._few(linededup.NAMED + 1, 1 << 40)


def test_links_are_confirmed_by_merge_joins_at_every_size(spark, monkeypatch):
    plans, write = {}, jaccard.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)
    monkeypatch.setattr(jaccard, "written", seen)
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["z"])), (3, "q r s")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.join(df, 3, 4, 5).collect()} == {1: 1, 2: 1, 3: 3}
    assert all(plans[name].count("SortMergeJoin") >= 2 for name in ("jaccard-near", "jaccard-links"))
    assert "BroadcastHashJoin" not in plans["jaccard-links"]


def test_jaccard_posts_are_dealt_out_once_and_cards_go_before(spark, monkeypatch):
    plans, there, write = {}, {}, jaccard.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        there[name] = write(df, name)
        if name == "jaccard-tiles":
            path = spark._jvm.org.apache.hadoop.fs.Path(there["jaccard-cards"].written_to)
            assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return there[name]
    monkeypatch.setattr(jaccard, "written", seen)
    words = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join(words + ["z"])), (2, "q r s"), (4, "q r s"), (None, "q r s"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, 3, 4, 5).collect()), key=str)
    assert got == sorted([(1, 28, 1), (2, 29, 1), (2, 1, 1), (4, 1, 1), (None, 1, None), (5, 0, 5)], key=str)
    assert plans["jaccard-tiles"].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("named", [1 << 19, 0])
def test_joins_of_candidate_lines_hold_no_classes(spark, docs, named, monkeypatch):
    """The classes of all word buckets stand in plans without joins of candidates only: those are kept and shown anew after each stage."""
    plans, write = {}, linededup.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)
    monkeypatch.setattr(linededup, "written", seen)
    monkeypatch.setattr(linededup, "NAMED", named)
    linededup.dedup(docs.select("doc_id", "text")).collect()
    assert all("xxhash64" not in p and len(p) < 1 << 14 for p in plans["lines-hit"])
    # each candidate's set is made once, whether it stands on one side or on both
    assert len(plans["lines-held"]) == len(plans["lines-hit"]) == 2
