"""Byte-level BPE shared by operators 6 and 8: pieces, byte table, model.

A text is cut into the pieces of the public pattern; each distinct piece goes
once through the tokenizers library's BPE model and is then kept, up to a
bounded number of pieces a worker (pieces beyond it are encoded each time)."""

from __future__ import annotations

import base64
import functools
import re
import struct
import unicodedata

import numpy as np

#: Pieces kept by a worker.
KEEP = 400_000

#: White space as Unicode defines it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The public byte-to-character table: printable bytes are themselves, the rest follow from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@functools.cache
def splitter() -> re.Pattern:
    """The public pattern with its Unicode classes written out, for the standard ``re``."""
    def runs(major: str) -> str:
        out, start = [], None
        for i in range(0x110001):
            inside = i < 0x110000 and unicodedata.category(chr(i))[0] == major
            if inside and start is None:
                start = i
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
                start = None
        return "".join(out)
    letters, numbers = runs("L"), runs("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+"
                      f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


#: A blank between white space (or the end): there a run of white space crosses the cut at blanks.
CROSSING = re.compile(f" (?:[{SPACES}]|\\Z)")


@functools.cache
def unassigned() -> re.Pattern:
    """A character that the interpreter's Unicode tables do not know; newer tables may call it a letter or number."""
    out, start = [], None
    for i in range(0x110001):
        inside = i < 0x110000 and unicodedata.category(chr(i)) == "Cn"
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return re.compile(f"[{''.join(out)}]")


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    """The tokenizers library's byte-level BPE with these ranks.

    A rank file names the result of each merge; every cut of a token into two
    known tokens is a merge of that rank, which is how rank encoders read it.
    A piece that is itself a token stays whole."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers
    import public_tokenizers
    chars = byte_chars()
    shown = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1
              for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok


class Pieces:
    """Encodes texts piece by piece with one tokenizer, as little-endian uint32 bytes."""

    def __init__(self, tok, keep: int = KEEP):
        chars = byte_chars()
        self.table = {b: chars[b] for b in range(256)}
        self.back = {c: b for b, c in enumerate(chars)}
        self.tokenize, self.keep, self.find = tok.model.tokenize, keep, splitter().findall
        self.tok = tok
        self.known = _Known(self)
        self.special = [] if tok.encode_special_tokens else [t.content for t in tok.get_added_tokens_decoder().values()]
        self.words = _Words(self)

    def piece(self, p: str) -> bytes:
        if p.isascii() and p.isprintable():             # of these the byte table moves the blank alone
            shown = p.replace(" ", self.table[32])
        else:
            shown = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
        found = [t.id for t in self.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def ids(self, text: str) -> bytes:
        """Ids of a whole text. A blank before other text always starts a piece, so
        texts without white space crossing such a cut are looked up word by word."""
        if not self.own(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if CROSSING.search(text):
            return self.cut(text)
        first, *rest = text.split(" ")
        return self.cut(first) + b"".join(map(self.words.__getitem__, rest))

    def own(self, text: str) -> bool:
        """Whether the pattern above cuts the text as the library does: it holds no special token of the file and no
        character newer than the interpreter's tables."""
        if any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")                  # most texts; these characters are all known
            return True
        except UnicodeEncodeError:
            return unassigned().search(text) is None

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id: the byte table read backwards."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            out[i] = bytes(self.back[c] for c in shown) if all(c in self.back for c in shown) else shown.encode()
        return out


class _Known(dict):
    """Piece -> its ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, p: str) -> bytes:
        got = self.pieces.piece(p)
        if len(self) < self.pieces.keep:
            self[p] = got
        return got


class _Words(dict):
    """Word -> ids of the word with the blank before it. Two words with a line break between them seldom come again and
    are not kept."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        got = self.pieces.cut(" " + word)
        if len(self) < self.pieces.keep and "\n" not in word:
            self[word] = got
        return got


def offsets(ids: np.ndarray, lengths: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end of every token; a token that holds part of a character covers all of it."""
    end = np.cumsum(lengths[ids], dtype=np.int64)
    start = end - lengths[ids]
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    nth = np.cumsum(lead, dtype=np.int64)              # characters begun up to and with this byte
    return nth[start] - 1 if len(ids) else start, nth[end - 1] if len(ids) else end
