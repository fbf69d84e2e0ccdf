"""Operator 4: secrets by fixed patterns and a linear-chain conditional random field.

Base spans come from three fixed patterns. The field tags every token (a run
without white space) as secret *begin*, *inside* or *outside* from its shape,
the words beside it and features of its file, and is decoded by Viterbi; spans
it finds where no base span is are added as kind ``crf``.

Training: the field is fitted by its likelihood (forward-backward in numpy) on
windows of at most ``SAMPLE`` documents, with the base spans as labels; patterns
are no feature, so the field learns how secrets look and where they stand. At
most half of the sample are documents with a base span, looked for in all whole
texts, and at most half are others, either those of smallest id hash. Windows lie
around the spans wherever they stand, ``WINDOWS`` a document, evenly taken if it
has more, and anywhere in the others: ``RATIO`` for each document with a span (of
``LEAST_HITS`` at least), at most ``CLEAN`` a document. Without a base span in the whole table the field
adds nothing.

Decoding is exact though only few tokens are visited: every transition weight
is finite, so a token whose *outside* emission leads by more than twice the
span of the transitions is outside on every best path, and such tokens cut a
text into short independent stretches.

Rules: null text is empty and has no spans; every row gives one row; offsets
are code points, end exclusive; spans sort by start, then kind as listed."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upshelf.llm.common import forget, pick, small_batches, written
from upshelf.llm.shingles import buffers, words

# Fixed values of the contract: patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")       # AKIA[A-Z0-9]+ of 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")              # the longest run is the match, so the bound may stand in the pattern
KINDS = ("assign", "access", "hex", "crf")
CUE_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "key", "bearer", "credentials")

SAMPLE, WINDOWS, RATIO, LEAST_HITS, CLEAN, BESIDE, ROUNDS, RATE, DECAY = 2000, 16, 25, 20, 8, 12, 120, 0.15, 1e-3

#: Every text with a base span matches, and few others: a match of ASSIGN may swallow the name that starts one here.
MAYBE = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]{12})|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""

_CLASS = np.full(256, 4, dtype=np.uint8)        # 0 digit, 1 upper, 2 lower, 3 space, 4 symbol, 5 beyond ASCII
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[32, *range(9, 14)]] = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _cues() -> np.ndarray:
    """Hashes of the cue words, bare and with the marks that follow them."""
    forms = [w + tail for w in CUE_WORDS for tail in ("", ":", "=", '":', "':")]
    raw = "\n".join(forms).encode()
    return np.sort(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


_CUES = _cues()

#: Number of values of each feature; the first is a constant.
SIZES = (1, 8, 6, 6, 6, 6, 6, 6, 6, 3, 3, 2, 2, 2, 6, 6, 4, 4)
FIRST = np.cumsum((0,) + SIZES[:-1])
WIDTH = int(sum(SIZES))


def _share(part, whole, top=5):
    return np.minimum(top, np.ceil(part * top / np.maximum(whole, 1))).astype(np.int64)


def features(data: np.ndarray, off: np.ndarray):
    """(starts, ends, first token of each document and the end, feature columns (tokens, features))."""
    n = len(data)
    cls = _CLASS[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    space = cls == 3
    begin, last = ~space, ~space
    begin[1:] &= space[:-1] | first[1:n]
    last[:-1] &= space[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    at = np.searchsorted(s, off)
    size = e - s

    def counted(mask):
        run = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(mask, out=run[1:], dtype=np.int32)
        return run, run[e] - run[s]

    runs, parts = zip(*(counted(cls == c) for c in (0, 1, 2, 4, 5)))
    turn = np.zeros(n, dtype=bool)
    turn[1:] = cls[1:] != cls[:-1]
    _, turns = counted(turn)
    turns = np.maximum(turns - 1, 0)                       # the first byte follows white space
    h, _ = words(data, off)
    cue = np.zeros(len(s), dtype=np.int64)
    if len(s):
        cue = (_CUES[np.minimum(np.searchsorted(_CUES, h), len(_CUES) - 1)] == h).astype(np.int64)
    mark = np.isin(data[e - 1], np.frombuffer(b":=", np.uint8)).astype(np.int64) if len(s) else cue
    holds = (counted((data == 61) | (data == 58))[1] > 0).astype(np.int64)
    length = np.minimum(7, np.floor(np.log2(np.maximum(size, 1)))).astype(np.int64)
    digits = _share(parts[0], size)
    edge = np.zeros(len(s) + 2, dtype=np.int64)

    def beside(x, step):
        """The neighbour's value within the document, else 0."""
        edge[1:-1] = x
        out = edge[1 + step:len(s) + 1 + step].copy()
        stop = at[:-1] if step < 0 else at[1:] - 1
        ok = at[1:] > at[:-1]
        out[stop[ok]] = 0
        return out

    doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
    width = np.maximum(np.diff(off), 1)
    per = lambda k: _share((runs[k][off[1:]] - runs[k][off[:-1]]), width, 3)
    kinds = np.array([1, 2, 2, 0, 0, 0])                    # digit, letter, other
    cols = [np.zeros(len(s), dtype=np.int64), length, digits, _share(parts[1], size), _share(parts[2], size),
            _share(parts[3], size), _share(parts[4], size), np.minimum(5, turns), _share(turns, size),
            kinds[cls[s]], kinds[cls[e - 1]], holds, beside(cue, -1), beside(mark, -1),
            np.minimum(5, beside(length, -1)), beside(digits, -1), per(0)[doc], per(3)[doc]]
    return s, e, at, np.stack(cols, axis=1)


class Field:
    """Weights: emission (feature value, tag) and transition (tag, tag); tags outside, begin, inside."""

    def __init__(self):
        self.w = np.zeros((WIDTH, 3))
        self.t = np.zeros((3, 3))

    def emissions(self, cols: np.ndarray) -> np.ndarray:
        out = np.zeros((len(cols), 3))
        for f, first in enumerate(FIRST):
            out += self.w[first + cols[:, f]]
        return out

    def train(self, cols: np.ndarray, tags: np.ndarray, at: np.ndarray) -> None:
        """Likelihood ascent over sequences at[i]:at[i+1]."""
        size = np.diff(at)
        most, many = int(size.max()), len(size)
        spot = np.minimum(at[:-1][:, None] + np.arange(most), len(cols) - 1)
        live = np.arange(most)[None, :] < size[:, None]
        y = np.where(live, tags[spot], 0)
        pairs = live[:, 1:]
        seen_t = np.zeros((3, 3))
        np.add.at(seen_t, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        ids = FIRST + cols                                  # (tokens, features)
        gold = np.zeros((WIDTH, 3))
        for f in range(ids.shape[1]):
            np.add.at(gold, (ids[:, f], tags), 1)
        m = [np.zeros_like(self.w), np.zeros_like(self.t)]
        v = [np.zeros_like(self.w), np.zeros_like(self.t)]
        for step in range(1, ROUNDS + 1):
            e = self.emissions(cols)[spot]                  # (sequences, most, 3)
            alpha = np.empty_like(e)
            alpha[:, 0] = e[:, 0]
            for i in range(1, most):
                x = alpha[:, i - 1, :, None] + self.t
                top = x.max(axis=1)
                nxt = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + e[:, i]
                alpha[:, i] = np.where(live[:, i, None], nxt, alpha[:, i - 1])
            beta = np.zeros_like(e)
            for i in range(most - 2, -1, -1):
                x = self.t + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
                top = x.max(axis=2)
                beta[:, i] = np.where(live[:, i + 1, None], top + np.log(np.exp(x - top[..., None]).sum(axis=2)), 0)
            z = alpha[:, -1]
            z = z.max(axis=1) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1))
            p = np.exp(alpha + beta - z[:, None, None])[live]
            pair = np.exp(alpha[:, :-1, :, None] + self.t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
            tok = spot[live]
            want = np.zeros((WIDTH, 3))
            for f in range(ids.shape[1]):
                for k in range(3):
                    want[:, k] += np.bincount(ids[tok, f], weights=p[:, k], minlength=WIDTH)
            grads = ((gold - want) / many - DECAY * self.w, (seen_t - pair[pairs].sum(axis=0)) / many - DECAY * self.t)
            rate = RATE * (1 - step / (ROUNDS + 1))
            for q, g, mm, vv in zip((self.w, self.t), grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q += rate * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-8)

    def decode(self, e: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """(first token, last token) of every secret on the best paths of sequences at[i]:at[i+1]."""
        swing = 2 * (self.t.max() - self.t.min())
        loose = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= swing)
        if not len(loose):
            return []
        doc = np.searchsorted(at, loose, "right")
        cut = np.flatnonzero((np.diff(loose) > 1) | (np.diff(doc) > 0)) + 1
        out = []
        for part in np.split(loose, cut):
            lo, hi = int(part[0]), int(part[-1]) + 1
            begins = lo == at[np.searchsorted(at, lo, "right") - 1]
            ends = hi == at[np.searchsorted(at, lo, "right")]
            tags = self._path(e[lo:hi], begins, ends)
            i = 0
            while i < len(tags):
                if tags[i]:
                    j = i + 1
                    while j < len(tags) and tags[j] == 2:
                        j += 1
                    out.append((lo + i, lo + j - 1))
                    i = j
                else:
                    i += 1
        return out

    def _path(self, e: np.ndarray, begins: bool, ends: bool) -> list[int]:
        t = self.t.tolist()
        rows = e.tolist()
        score = [rows[0][k] + (0.0 if begins else t[0][k]) for k in range(3)]
        back = []
        for row in rows[1:]:
            best = [max(range(3), key=lambda a: (score[a] + t[a][k], -a)) for k in range(3)]  # noqa: B023
            back.append(best)
            score = [score[best[k]] + t[best[k]][k] + row[k] for k in range(3)]
        if not ends:
            score = [score[k] + t[k][0] for k in range(3)]
        k = max(range(3), key=lambda a: (score[a], -a))
        out = [k]
        for best in reversed(back):
            k = best[k]
            out.append(k)
        return out[::-1]


def _byte_spans(text: str) -> list[tuple[int, int]]:
    """Base spans as byte offsets."""
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return [(int(at[a]), int(at[b])) for a, _, b in base_spans(text)]


def _tags(s: np.ndarray, e: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(s), dtype=np.int64)
    for a, b in sorted(spans):
        lo, hi = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b, "left"))
        if tags[lo:hi].any():
            continue                                        # within an earlier span
        tags[lo:hi] = 2
        tags[lo:lo + 1] = 1 if hi > lo else tags[lo:lo + 1]
    return tags


def _windows(text: str, clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature columns, tags, sizes) of the windows of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    s, e, _, x = features(raw, np.array([0, len(raw)]))
    y = _tags(s, e, _byte_spans(text))
    found, done = [], 0
    spots = np.flatnonzero(y) if y.any() or not len(s) else np.sort(np.random.default_rng(len(raw)).integers(0, len(s), clean))
    for mid in spots.tolist():                              # windows around secrets, or anywhere in a clean text
        a, b = max(done, mid - BESIDE), min(len(s), mid + BESIDE + 1)
        if b > a and mid >= done:
            found.append((a, b))
            done = b
    if len(found) > WINDOWS:
        found = [found[i] for i in np.linspace(0, len(found) - 1, WINDOWS).astype(int)]
    take = np.concatenate([np.arange(a, b) for a, b in found]) if found else np.zeros(0, dtype=np.int64)
    return x[take].astype(np.uint8), y[take].astype(np.uint8), np.array([b - a for a, b in found], dtype=np.uint8)


def _sample(docs: DataFrame) -> tuple[list[int], int]:
    """Keys of the documents to learn from, with a base span and without, and the windows of one without."""
    marked = docs.select("key", "at", F.when(F.col("text").rlike(MAYBE), F.col("text")).alias("text"))

    def exact(batches):
        for b in batches:
            hit = [bool(t and base_spans(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hit, pa.bool_())], ["key", "at", "hit"])

    flags = written(marked.mapInArrow(exact, "key long, at long, hit boolean").distinct(), "secrets-flags")
    first = lambda hit, n: [r.key for r in flags.where(F.col("hit") == hit).orderBy("at", "key").limit(n).collect()]
    hits = first(True, SAMPLE // 2)
    want = RATIO * max(LEAST_HITS, len(hits))           # few clean windows would find secrets in plain words
    others = first(False, min(SAMPLE // 2, want)) if hits else []
    forget(flags)
    return hits + others, min(CLEAN, max(1, want // max(1, len(others))))


def train(docs: DataFrame) -> Field | None:
    """A field from a bounded sample of documents; None where no document has a base span."""
    small_batches(docs.sparkSession)
    d = (pick(docs, doc_id="long", text="string").where("text <> ''")
         .select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("doc_id").alias("at"), "text"))
    keys, clean = _sample(d)
    if not keys:
        return None

    def cut(batches):
        for b in batches:
            got = [[v.tobytes() for v in _windows(t, clean)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([g[i] for g in got], pa.binary()) for i in range(3)]], ["key", "x", "y", "sizes"])

    rows = (d.where(F.col("key").isin(keys)).select("key", "text")
            .mapInArrow(cut, "key long, x binary, y binary, sizes binary").dropDuplicates(["key"]).collect())
    rows.sort(key=lambda r: r.key)
    cols, tags, sizes = (np.frombuffer(b"".join(r[c] for r in rows), np.uint8).astype(np.int64) for c in ("x", "y", "sizes"))
    if not tags.any():
        return None
    field = Field()
    field.train(cols.reshape(len(tags), len(SIZES)), tags, np.concatenate([[0], np.cumsum(sizes)]))
    return field


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) of every whole text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [base_spans(t) for t in texts]
            data, off = buffers(b.column(1))
            if field is not None and len(data):
                s, e, at, cols = features(data, off)
                for first, last in field.decode(field.emissions(cols), at):
                    i = int(np.searchsorted(at, first, "right")) - 1
                    lo, hi = int(s[first] - off[i]), int(e[last] - off[i])
                    raw = data[off[i]:off[i + 1]].tobytes()
                    a = len(raw[:lo].decode("utf-8", "replace"))
                    z = a + len(raw[lo:hi].decode("utf-8", "replace"))
                    if not any(x < z and a < y for x, k, y in found[i] if k < 3):
                        found[i].append((a, 3, z))
            rows = [[{"kind": KINDS[k], "start": x, "end": y} for x, k, y in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start int, end int>>")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from the operator's spans."""
    got = scan(docs, train(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long")
    return got.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                      F.sha2(listed(F.filter("spans", lambda x: x.kind != "crf")).cast("binary"), 256).alias("base_sha256"),
                      listed("spans").alias("spans"))
