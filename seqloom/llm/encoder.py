"""Exact fast encoding with a byte-level BPE file of the tokenizers library.

The GPT-2 style pre-tokeniser scans left to right without looking back, and between a blank and
the non-blank character after it a word always begins, as it does at a line feed and after it. So
a text is cut there, each piece (a blank or a line feed and what follows it) is encoded by the
library's model when it is first met, and the ids of the pieces are joined. Texts where that
argument could fail (runs of blanks or line feeds, unusual characters, strings of special
tokens) go to the library whole. Other kinds of files always do.

Defined cases: no texts give no ids, an empty text gives none, and a text that is not valid
Unicode (a lone surrogate) is the library's affair, which refuses it.
"""

from __future__ import annotations

import json
import os
from codecs import charmap_decode
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with characters other than these are not cut: line feed, ASCII from the blank on, and a
#: range of letters and signs.
_LEAST, _MOST = "¡", "ɏ"
#: Marks that are one word of the pre-tokeniser after letters; an apostrophe is not, since it may
#: begin a word of letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SAFE = bytes([10, *range(32, 127)])
#: What stands for a frequent mark that closes a word, once it is cut off. No text that is cut has it.
_CLOSING = {",": "\x01", ".": "\x02"}
#: What stands before the first word of a text, in texts that are cut; no such text has it either.
_FIRST = "\x03"
#: Bytes of UTF-8 as blanks, letters and digits (all beyond ASCII too), marks, and 0 for others.
_KINDS = bytes(32 if b in b"\n " else 97 if b > 127 or chr(b).isalnum() else 33 if b in _SAFE else 0 for b in range(256))
#: Pieces kept in each of two generations, about 160 bytes each.
_CACHE = 300_000
#: Runs of marks that close a word, kept at once.
_RUNS = 10_000


class _Pieces(dict):
    """Ids of pieces, learnt when first looked up: of letters by one call of the model, of letters
    and closing marks from both, of others by words of the pre-tokeniser. Two generations: when
    the newer is full it becomes the older, from which pieces in use come back and the rest
    are dropped."""

    def __init__(self, tok, before: str, first: _Pieces | None = None):
        super().__init__()
        self.older, self.before, self.first = {}, before, first
        self.tokenize, self.split = tok.model.tokenize, tok.pre_tokenizer.pre_tokenize_str
        # what the pre-tokeniser writes for a blank, and for each byte of letters
        self.blank = before and self.split(f"a{before}b")[1][0][0]
        written = {b: chr(b) for b in range(128)}
        for c in map(chr, range(ord(_LEAST), ord(_MOST) + 1)):
            written |= zip(c.encode(), self.split(c)[0][0], strict=True)
        self.written = "".join(written.get(b, "\ufffe") for b in range(256))
        self.bytes_of = first.bytes_of if first else [i.to_bytes(4, "little") for i in range(1 + max(tok.get_vocab().values()))]
        self.runs: dict[str, bytes] = {}
        self.marks = {stand_in: self._words(mark) for mark, stand_in in _CLOSING.items()}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            if piece.isalpha():
                word = self.blank + (piece if piece.isascii() else charmap_decode(piece.encode(), "strict", self.written)[0])
                found = b"".join([self.bytes_of[t.id] for t in self.tokenize(word)])
            else:
                found = self._mixed(piece)
        if len(self) >= _CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def _mixed(self, piece: str) -> bytes:
        if piece in self.marks:
            return self.marks[piece]
        if piece[:1] == _FIRST:
            return self.first[piece[1:]]
        if piece[:1] == "\n" and self.first is not None:
            return self.first["\n"] + self.first[piece[1:]] if piece[1:] else self.first["\n"]
        body = piece.rstrip(_MARKS)
        if body.isalpha():
            return self[body] + self._run(piece[len(body) :])
        return self._words(self.before + piece)

    def _run(self, marks: str) -> bytes:
        found = self.runs.get(marks)
        if found is None:
            if len(self.runs) >= _RUNS:
                self.runs.clear()
            found = self.runs[marks] = self._words(marks)
        return found

    def _words(self, text: str) -> bytes:
        return b"".join([self.bytes_of[t.id] for w, _ in self.split(text) for t in self.tokenize(w)])


class Encoder:
    """encode(texts) -> little-endian uint32 ids of each text, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
            return
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.path, self.library = path, lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        pre = conf.get("pre_tokenizer") or {}
        self.pieces = (pre.get("type"), pre.get("use_regex", True), pre.get("add_prefix_space")) == ("ByteLevel", True, False) and not conf.get("normalizer")
        self.special = [t["content"].encode() for t in conf.get("added_tokens", [])]
        if self.pieces:
            # a piece is looked up before the model is called, so the model's own cache only costs
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            plain.model._resize_cache(0)
            self.first = _Pieces(plain, "")
            self.rest = _Pieces(plain, " ", self.first)

    @cached_property
    def tokenizer(self):
        """The library's, for whole texts; where all texts can be cut it is never loaded."""
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.no_truncation()
        tok.no_padding()
        return tok

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(ids, dtype="<u4").tobytes() for ids in self.library(texts[i : i + 64])]
        return out

    def _can_cut(self, raw: bytes, kinds: bytes) -> bool:
        if b"\0" in kinds:
            return False
        if not raw.isascii():
            try:
                left = raw.translate(None, _SAFE).decode("utf-8")
            except UnicodeDecodeError:
                return False
            if min(left) < _LEAST or max(left) > _MOST:
                return False
        # two blank characters that a third or the end follows are one word with it
        if b"  " in kinds and (any(r in raw for r in (b"  ", b" \n", b"\n\n\n", b"\n\n ")) or raw[-2:].isspace()):
            return False
        return raw not in (b" ", b"\n") and not any(s in raw for s in self.special)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The first word, and pieces: what follows a blank, or a line feed and what follows it."""
        return text.replace("\n", " \n").split(" ")

    @staticmethod
    def _spaced(raw: bytes, kinds: bytes) -> bytes:
        """A text that can be cut, with a blank between any two pieces of _cut(); commas and full
        stops before a blank or a line feed are pieces of their own. They are words of the
        pre-tokeniser if each follows a letter or digit, so not in texts where one may not."""
        beyond = b"" if raw.isascii() else raw.translate(None, _SAFE)
        alone = not (b"!! " in kinds or b" ! " in kinds or beyond and not beyond.decode("utf-8").isalpha())
        raw = raw.replace(b"\n", b" \n")
        for mark, stand_in in _CLOSING.items() if alone else ():
            raw = raw.replace(f"{mark} ".encode(), f" {stand_in} ".encode())
        return _FIRST.encode() + raw

    def _joined(self, spaced: list[bytes]) -> list[bytes]:
        """Ids of texts of _spaced(). A piece is looked up once for all of them."""
        cut = pc.split_pattern(pa.array(spaced, pa.large_binary()).cast(pa.large_string()), " ")
        flat = cut.values.dictionary_encode()
        found = list(map(self.rest.__getitem__, flat.dictionary.to_numpy(zero_copy_only=False).tolist()))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, code = np.frombuffer(b"".join(found), "<u4"), flat.indices.to_numpy()
        n = size[code]
        end = np.cumsum(n)
        # the k-th id of a piece in the texts is the k-th after the place where the piece is learnt
        at = np.repeat((np.cumsum(size) - size)[code] - (end - n), n)
        at += np.arange(len(at))
        body = ids[at].tobytes()
        ends = (4 * end[cut.offsets.to_numpy()[1:] - 1]).tolist()
        return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.pieces:
            return self.whole(texts)
        out: list[bytes] = [b""] * len(texts)
        cut, odd = {}, []
        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            kinds = raw.translate(_KINDS)
            if self._can_cut(raw, kinds):
                cut[i] = self._spaced(raw, kinds)
            else:
                odd.append(i)
        if cut:
            for i, ids in zip(cut, self._joined(list(cut.values())), strict=True):
                out[i] = ids
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where words of the pre-tokeniser begin, without a leading blank, the number of tokens
        before each, and of all. Where a text can be cut, words at blanks and line feeds only."""
        raw = text.encode("utf-8", "surrogatepass")
        if self._can_cut(raw, raw.translate(_KINDS)):
            cut = self._cut(text)
            sizes = np.array([len(self.first[cut[0]]), *map(len, map(self.rest.__getitem__, cut[1:]))], dtype=np.int64) // 4
            blank = np.array([0, *[p[:1] != "\n" for p in cut[1:]]], dtype=np.int64)
            ends = np.cumsum(np.array(list(map(len, cut))) + blank)
            return np.concatenate([[0], ends[:-1]]) + blank, np.cumsum(sizes) - sizes, int(sizes.sum())
        (e,) = self.tokenizer.encode_batch([text], add_special_tokens=False)
        # tokens of special strings have a word id of their own or none
        word = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], dtype=np.int64)
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        return np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[at, 0], at, len(word)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return Encoder(path)


def batches_of(texts: list[str], limit: int = 1_000_000):
    """Ranges of texts with at most `limit` characters each, but one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)
