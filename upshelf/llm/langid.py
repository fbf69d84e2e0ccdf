"""Operator 7: language of a text by a bidirectional gated recurrent network over bytes.

The network reads a text in pieces of ``PIECE`` bytes (all of them, states
start anew in each), once forward and once backward; both states give language
probabilities at every byte. A document's probabilities are the mean over its
letter positions, the language is the largest, its score that mean.

It is trained in numpy by backpropagation through time on a bounded sample:
``PER_LANG`` documents a language (those of smallest id hash), every language that
labels one, four windows of ``WINDOW`` characters a document.
Training order and start weights are fixed, so a table always gives one model.

Rules: null text or text without a letter is ``und`` with score 0; so is every
text when there is nothing to learn from. Documents with null doc_id are
judged but not learned from and not held out. Of rows that repeat an id and
label one is learned from (smallest windows). Every row gives one row; ties go
to the alphabetically first language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm.common import pick, small_batches
from upshelf.llm.shingles import buffers

HIDDEN, PIECE, BATCH = 8, 128, 4096
PER_LANG, WINDOW, SHARES = 160, 160, 64
STEPS, TRAIN_BATCH, TRAIN_PIECE, RATE = 220, 192, 64, 0.03

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
f32 = np.float32


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One reading direction; ``w`` holds input weights by byte, ``u`` the recurrent ones (update, reset, candidate)."""

    def __init__(self, rng: np.random.Generator, langs: int):
        h = HIDDEN
        self.w = rng.normal(0, 0.3, (3 * h, 256)).astype(f32)
        self.u = rng.normal(0, 0.3, (3 * h, h)).astype(f32)
        self.o = rng.normal(0, 0.3, (langs, h)).astype(f32)

    def states(self, x: np.ndarray):
        """All steps over x (length, batch), with what the way back needs."""
        hid, kept = np.zeros((HIDDEN, x.shape[1]), f32), []
        h2 = 2 * HIDDEN
        for row in x:
            a, u = self.w[:, row], self.u @ hid
            zr = _sig(a[:h2] + u[:h2])
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = np.tanh(a[h2:] + r * u[h2:])
            kept.append((hid, z, r, n, u[h2:]))
            hid = n + z * (hid - n)
            yield hid
        self.kept = kept

    def back(self, x: np.ndarray, dh_out: list[np.ndarray]):
        """Gradients of w and u from those of the states."""
        dw, du = np.empty((len(x), 3 * HIDDEN, x.shape[1]), f32), np.zeros_like(self.u)
        dh = np.zeros((HIDDEN, x.shape[1]), f32)
        for t in range(len(x) - 1, -1, -1):
            hid, z, r, n, m = self.kept[t]
            dh = dh + dh_out[t]
            dan = dh * (1 - z) * (1 - n * n)
            daz = dh * (hid - n) * z * (1 - z)
            dar = dan * m * r * (1 - r)
            dw[t, :HIDDEN], dw[t, HIDDEN:2 * HIDDEN], dw[t, 2 * HIDDEN:] = daz, dar, dan
            g = np.concatenate([daz, dar, dan * r])
            du += g @ hid.T
            dh = dh * z + self.u.T @ g
        flat = x.ravel()
        rows = dw.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
        return np.stack([np.bincount(flat, weights=r, minlength=256) for r in rows]).astype(f32), du

    def logits(self, x: np.ndarray, out: np.ndarray) -> None:
        """Adds this direction's logits to out (length, languages, batch); no state is kept."""
        b, h, h2 = x.shape[1], HIDDEN, 2 * HIDDEN
        half = np.ones((3 * h, 1), f32)
        half[:h2] = 0.5                                  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        w, uu = self.w * half, self.u * half
        hid, u, a = np.zeros((h, b), f32), np.empty((3 * h, b), f32), np.empty((3 * h, b), f32)
        for t, row in enumerate(x):
            np.take(w, row, axis=1, out=a, mode="clip")
            np.matmul(uu, hid, out=u)
            zr = a[:h2]
            zr += u[:h2]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n, m = a[h2:], u[h2:]
            m *= zr[h:]
            n += m
            np.tanh(n, out=n)
            hid -= n
            hid *= zr[:h]
            hid += n
            out[t] += self.o @ hid


class Model:
    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(7)
        self.langs = langs
        self.ways = [Direction(rng, len(langs)), Direction(rng, len(langs))]
        self.c = np.zeros((len(langs), 1), f32)

    def train(self, x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> None:
        """x (length, n) bytes, y (n) languages, seen (length, n) positions that count."""
        rng = np.random.default_rng(11)
        params = [p for d in self.ways for p in (d.w, d.u, d.o)] + [self.c]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick_ = rng.integers(0, x.shape[1], TRAIN_BATCH)
            bx, by, bs = x[:, pick_], y[pick_], seen[:, pick_]
            fw, bw = list(self.ways[0].states(bx)), list(self.ways[1].states(bx[::-1]))[::-1]
            want = np.eye(len(self.langs), dtype=f32)[:, by]
            scale = f32(1 / max(1, bs.sum()))
            dl = []
            for t in range(len(bx)):
                s = self.ways[0].o @ fw[t] + self.ways[1].o @ bw[t] + self.c
                p = np.exp(s - s.max(axis=0))
                dl.append((p / p.sum(axis=0) - want) * (bs[t] * scale))
            grads = []
            for d, states, lt, bytes_ in ((self.ways[0], fw, dl, bx), (self.ways[1], bw[::-1], dl[::-1], bx[::-1])):
                dw, du = d.back(bytes_, [d.o.T @ g for g in lt])
                grads += [dw, du, sum(g @ s.T for g, s in zip(lt, states))]
            grads.append(sum(dl).sum(axis=1, keepdims=True))
            rate = RATE * (1 - step / (STEPS + 1))
            for p, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= (rate * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-8)).astype(f32)

    def positions(self, data: np.ndarray, off: np.ndarray):
        """Per block of pieces: (document of each piece, first byte, probabilities (length, languages, pieces))."""
        size = np.diff(off)
        many = -(-size // PIECE)
        doc = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = off[doc] + nth * PIECE
        length = np.minimum(PIECE, off[doc + 1] - start)
        order = np.argsort(-length, kind="stable")       # pieces of like length share a block
        block = max(1, BATCH * 64 // max(64, len(self.langs)))     # bounds the memory of many languages
        for a in range(0, len(order), block):
            at = order[a:a + block]
            most = int(length[at].max())
            spot = start[at][None, :] + np.arange(most)[:, None]
            inside = np.arange(most)[:, None] < length[at][None, :]
            x = np.where(inside, data[np.minimum(spot, len(data) - 1)], 32)
            out = np.empty((most, len(self.langs), len(at)), f32)
            out[:] = self.c
            self.ways[0].logits(x, out)
            # backward over each piece from its own last byte
            flip = np.maximum(length[at][None, :] - 1 - np.arange(most)[:, None], 0)
            back = np.zeros_like(out)
            self.ways[1].logits(np.take_along_axis(x, flip, axis=0), back)
            out += np.take_along_axis(back, flip[:, None, :], axis=0)
            out -= out.max(axis=1, keepdims=True)
            np.exp(out, out=out)
            out /= out.sum(axis=1, keepdims=True)
            yield doc[at], start[at], out, inside & _LETTER[x]

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, languages) over letter positions."""
        total = np.zeros((len(off) - 1, len(self.langs)))
        count = np.zeros(len(off) - 1)
        for doc, _, p, seen in self.positions(data, off):
            sums = (p * seen[:, None, :]).sum(axis=0, dtype=np.float64)
            for i in range(len(self.langs)):
                total[:, i] += np.bincount(doc, weights=sums[i], minlength=len(total))
            count += np.bincount(doc, weights=seen.sum(axis=0), minlength=len(total))
        return total / np.maximum(count, 1)[:, None]


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """A model from the labelled documents that are not held out; None if there are none."""
    d = pick(docs, doc_id="long", text="string", lang="string").where("doc_id is not null and lang is not null").where(~_held_out())
    langs = sorted(r.lang for r in d.select("lang").distinct().collect())
    if not langs:
        return None
    # ids first (no text is read): the smallest hashes of every share of a language, then those of the language
    first = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = (d.select("doc_id", "lang").distinct().withColumn("share", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(SHARES)))
           .withColumn("n", first("share")).where(F.col("n") <= PER_LANG))
    ids = [r.doc_id for r in few.withColumn("n", first()).where(F.col("n") <= PER_LANG).select("doc_id").collect()]
    cut = [F.substring("text", F.floor(F.length("text") * i / 4).cast("int") + 1, F.lit(WINDOW)) for i in range(4)]
    windows = F.struct(*[c.alias(f"w{i}") for i, c in enumerate(cut)])
    # one row an id and label, however often it repeats
    rows = [(r.lang, *r.w) for r in d.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(F.min(windows).alias("w")).collect()]
    pieces = sorted({(r[0], w) for r in rows for w in r[1:] if w and any(c.isalpha() for c in w)})
    pieces += [(lang, w.upper()) for lang, w in pieces[::10]]   # capitals are rare in the sample
    x, y = [], []
    for lang, w in pieces:
        raw = w.encode()[:2 * TRAIN_PIECE]
        for a in range(0, max(1, len(raw) - TRAIN_PIECE // 2), TRAIN_PIECE):
            x.append(np.frombuffer(raw[a:a + TRAIN_PIECE].ljust(TRAIN_PIECE), np.uint8))
            y.append(langs.index(lang))
    if not x:
        return None
    model = Model(langs)
    if len(langs) > 1:
        grid = np.stack(x, axis=1)
        model.train(grid, np.array(y), _LETTER[grid].astype(f32))
    return model


def _lettered(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are decoded."""
    plain = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
    out = plain[off[1:]] > plain[off[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[off[i]:off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """(doc_id, <keep>, lang_pred, score); only the text is an input."""
    small_batches(docs.sparkSession, 1000)
    rows = docs.select("text", *[c for c in docs.columns if c != "text"])
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "lang_pred string", "score double"])

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(0))
            pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if model is not None and len(data):
                p, known = model.documents(data, off), _lettered(data, off)
                best = p.argmax(axis=1)
                pred = [model.langs[i] if k else "und" for i, k in zip(best, known)]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)],
                                             [*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang): runs of bytes with the same most likely language."""
    small_batches(docs.sparkSession, 100)

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(1))
            best = np.zeros(len(data), dtype=np.int64)
            if len(data):
                for _, start, p, _ in model.positions(data, off):
                    top = p.argmax(axis=1)
                    spot = start[None, :] + np.arange(len(top))[:, None]
                    ok = spot < off[np.searchsorted(off, start, "right")][None, :]
                    best[spot[ok]] = top[ok]
            out = []
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                x = best[off[i]:off[i + 1]]
                cut = np.flatnonzero(np.diff(x)) + 1
                for s, e in zip([0, *cut], [*cut, len(x)]):
                    if e > s:
                        out.append((doc_id, int(s), int(e), model.langs[x[s]]))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                             ["doc_id", "start", "end", "lang"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, start long, end long, lang string")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of the same table."""
    model = train(docs)
    got = predict(pick(docs, doc_id="long", text="string"), model, "doc_id")
    return got.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
