"""A whole pipeline run against plain Python, and the network of op7 against plain loops and finite differences."""

import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.llm.test_pairs import _removed, _shingles
from upshelf.llm import langid, mixing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def _raked(cells):
    """Probabilities of cells {(source, lang, topic): tokens} by plain proportional fitting."""
    w, targets = dict(cells), []
    for i in range(3):
        own = {}
        for c, n in cells.items():
            own[c[i]] = own.get(c[i], 0) + n
        shares = {v: n ** mixing.ALPHA for v, n in own.items()}
        targets.append({v: s / sum(shares.values()) for v, s in shares.items()})
    for _ in range(200):
        for i in range(3):
            have = {}
            for c, n in w.items():
                have[c[i]] = have.get(c[i], 0) + n
            w = {c: n * targets[i][c[i]] / have[c[i]] for c, n in w.items()}
    factor = {c: w[c] / cells[c] for c in cells}
    return {c: f / max(factor.values()) for c, f in factor.items()}


def _topic(text, n):
    share = lambda chars: sum(c in chars for c in text) / len(text)
    return ("short" if n < 40 else "table" if share("|") > 0.02 else "numbers" if share("0123456789") > 0.1
            else "noise" if share("!$%&*#") > 0.05 else "prose")


def _plain_run(rows):
    docs = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    gone = _removed([(d, t) for d, t, _, _ in docs])
    cut = []
    for d, t, lang, source in docs:
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone]
        if len(kept) == len(t.split("\n")) or "\n".join(kept).strip(" \t\r\n"):
            cut.append((d, "\n".join(kept), lang, source))
    sets, root = {d: _shingles(t, 5) for d, t, _, _ in cut}, {d: d for d, *_ in cut}
    moved = True
    while moved:
        moved = False
        for a, x in sets.items():
            for b, y in sets.items():
                if root[b] < root[a] and x and y and 5 * len(x & y) >= 4 * len(x | y):
                    root[a], moved = root[b], True
    token = re.compile("[%s]|[^%s\\x20\\x09-\\x0D]+" % (2 * (re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), mixing.UNSPACED),)))
    single = [(d, t, g, s, len(token.findall(t))) for d, t, g, s in cut if root[d] == d]
    cells = {}
    for d, t, g, s, n in single:
        cells[s, g, _topic(t, n)] = cells.get((s, g, _topic(t, n)), 0) + n
    prob = _raked(cells)
    u = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2 ** 32
    left = [(d, t) for d, t, g, s, n in single if u(d) < prob[s, g, _topic(t, n)]]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {d: np.array(enc.encode_ordinary(t), "<u4") for d, t in left}
    return sorted((d, len(ids[d]), hashlib.sha256(ids[d].tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in left)


def test_pipeline_as_plain_python(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("do", "fe", "gi", "hu", "ja", "st")]
    say = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for i in range(60):
        text = "\n".join(say(int(rng.integers(3, 40))) for _ in range(int(rng.integers(1, 4))))
        rows.append((i, text, "en fr de".split()[i % 3], "web books code".split()[(i // 4) % 3]))
    base = rows[3][1].replace("\n", " ") + " " + say(60)
    rows += [(60, base, "en", "web"), (61, base + " more", "en", "web"), (62, "new " + base, "fr", "books"), (63, rows[5][1], "de", "code"),
             (64, rows[7][1] + "\nMenu\n" + say(20), "fr", "web"), (65, "Menu\n" + say(9), "fr", "web"), (66, "12 34 !", "en", "web"), (67, "", "en", "web"),
             (68, None, "en", "web"), (69, "床前明月光 " * 30, "en", "web"), (70, "a|b|c " * 60, "de", "code"), (71, "1 22 333 " * 40 + "x", "de", "code")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = _plain_run(rows)
    assert 20 < len(want) < 66 and got == want


def _plain_states(w, u, x):
    """States of the gated unit, a position and a sequence at a time."""
    h, sig = langid.HIDDEN, lambda a: 1 / (1 + np.exp(-a))
    out = np.zeros((*x.shape, h))
    for j in range(x.shape[1]):
        s = np.zeros(h)
        for t in range(len(x)):
            a, b = w[:, x[t, j]], u @ s
            z, r = sig(a[:h] + b[:h]), sig(a[h:2 * h] + b[h:2 * h])
            n = np.tanh(a[2 * h:] + r * b[2 * h:])
            s = n + z * (s - n)
            out[t, j] = s
    return out


def test_network_states_logits_and_gradients():
    rng = np.random.default_rng(4)
    way = langid.Direction(np.random.default_rng(1), 3)
    x = rng.integers(97, 103, (7, 4))
    w, u = way.w.astype(float), way.u.astype(float)
    plain = _plain_states(w, u, x)
    states = list(way.states(x))
    np.testing.assert_allclose([s.T for s in states], plain, atol=1e-5)
    out = np.zeros((7, 3, 4), np.float32)
    way.logits(x, out)
    np.testing.assert_allclose(out, np.einsum("lh,tjh->tlj", way.o.astype(float), plain), atol=1e-4)
    pull = rng.normal(size=(7, langid.HIDDEN, 4))
    dw, du = way.back(x, [p.astype(np.float32) for p in pull])
    loss = lambda: float((_plain_states(w, u, x) * pull.transpose(0, 2, 1)).sum())
    for table, grad in ((w, dw), (u, du)):
        for _ in range(25):
            at = int(rng.integers(0, table.shape[0])), int(rng.choice(x.ravel())) if table is w else int(rng.integers(0, table.shape[1]))
            old = table[at]
            table[at] = old + 1e-5
            up = loss()
            table[at] = old - 1e-5
            down = loss()
            table[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-3 * (1 + abs(grad[at]))
