"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

The bytes of each piece of the vocabulary's splitting pattern are mapped to Latin-1, so that an Aho-Corasick
automaton over the tokens can read them. One pass of the automaton gives the longest token at every position;
the encoder takes longest matches from left to right and steps back to the next shorter token, or over the last
token, where two adjacent tokens would not have been merged that way. Whether two tokens may stand side by side is
memoised. The result is the one that the merges in order of rank give, in time linear in the text.

Defined results: null and empty text give an empty list, blank text is encoded like any other; strings of special
tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.session import spread

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: how text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts in ASCII, for the faster standard matcher.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Pieces kept in a worker's memory. This bounds memory only; other pieces are encoded again.
KEPT_PIECES, KEPT_LENGTH = 200_000, 24
KEPT_LINES, KEPT_LINE = 60_000, 160


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe(dict):
    """The encoder; as a dictionary it holds the ids, packed as int32, of the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        import re

        import ahocorasick
        import regex

        super().__init__()
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.rank = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.text = {v: k for k, v in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.lines: dict[str, bytes] = {}
        self.size = [0] * (max(self.text) + 1)
        for token, rank in self.rank.items():
            self.size[rank] = len(token)
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            parts = self._parts(token, rank)
            self.halves[rank] = parts
            if parts[0] != parts[1] or len(token) > 1:
                self.pairs[parts] = rank

    def _parts(self, token: str, rank: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; a single byte is its own halves."""
        if len(token) == 1:
            return rank, rank
        ids = [self.rank[c] for c in token]
        while len(ids) > 2:
            best = min((r, i) for i in range(len(ids) - 1) if (r := self.pairs.get((ids[i], ids[i + 1]), rank)) < rank)
            ids[best[1] : best[1] + 2] = [best[0]]
        return ids[0], ids[1]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens side by side."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        pairs, halves, limit = self.pairs, self.halves, 1 << 60
        while True:
            # a merge over the border that comes before those inside the tokens would have been made first
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, (_, left) = left, halves[left]
                if left == limit:
                    limit, (right, _) = right + 1, halves[right]
                    if right + 1 == limit:
                        return True
            else:
                limit, (right, _) = right + 1, halves[right]
                if right + 1 == limit:
                    limit, (_, left) = left, halves[left]
                    if left == limit:
                        return True

    def _next(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text = self.text[token]
            found = next((r for n in range(len(text) - 1, 0, -1) if (r := self.rank.get(text[:n])) is not None), -1)
            self.shorter[token] = found
        return found

    def encode_piece(self, piece: str) -> list[int]:
        data = piece if piece.isascii() else piece.encode("utf-8", "replace").decode("latin-1")
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        for end, (length, rank) in self.automaton.iter(data):
            longest[end - length + 1] = rank  # later ends are longer
        fits, size = self.fits, self.size
        token = longest[0]
        out, at = [token], size[token]
        while at < n:  # without a step back, as for most pieces
            left, token = token, longest[at]
            fit = fits.get(left << 20 | token)
            if not (self.adjacent(left, token) if fit is None else fit):
                return self._backtrack(longest, out, at, token)
            out.append(token)
            at += size[token]
        return out

    def _backtrack(self, longest: list[int], out: list[int], at: int, token: int) -> list[int]:
        n, size, adjacent = len(longest), self.size, self.adjacent
        possible = bytearray(b"\1") * (n + 1)
        while True:
            end = at + size[token]
            if possible[end] and (not out or adjacent(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = self._next(token)
            if token < 0:
                possible[at] = 0
                token = out.pop()
                at -= size[token]

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.encode_piece(piece)).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def _line(self, line: str) -> bytes:
        """The ids of a part of a text that ends in no white space, or of the last part."""
        packed = b"".join(map(self.__getitem__, self.split_ascii(line) if line.isascii() else self.split(line)))
        if len(line) <= KEPT_LINE:
            if len(self.lines) >= KEPT_LINES:
                self.lines.clear()
            self.lines[line] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as int32. A line break after other than white space always ends a piece."""
        if not text:
            return b""
        get, out = self.lines.get, []
        lines = text.split("\n")
        part, blank = lines[0], []
        for line in lines[1:]:
            if part and not part[-1].isspace():
                if blank:
                    blank.append(part)
                    part, blank = "\n".join(blank), []
                out.append(get(part) or self._line(part))
                part = "\n" + line
            else:
                blank.append(part)
                part = line
        if blank:
            blank.append(part)
            part = "\n".join(blank)
        if part:
            out.append(get(part) or self._line(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<i4").tolist()


_LOADED: dict[tuple[str, str], Bpe] = {}


def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY) -> Bpe:
    """The encoder of this worker process, made once."""
    if (folder, name) not in _LOADED:
        _LOADED[folder, name] = Bpe(read_ranks(folder, name))
    return _LOADED[folder, name]


#: Bytes of ids in a batch that goes back to the JVM, so that long texts don't add up in memory.
_BATCH = 8 << 20


def _each_text(make: Callable, schema: pa.Schema, folder: str, name: str, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, name)
        for batch in batches:
            texts, size, start, packed = batch.column(text_at), 0, 0, []
            for i in range(len(texts)):
                packed.append(bpe.packed(texts[i].as_py()))
                size += len(packed[-1])
                if size > _BATCH or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(packed)) for k, c in enumerate(batch.columns) if k != text_at), make(packed)], schema=schema)
                    size, start, packed = 0, i + 1, []

    return run


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return spread(documents.select("doc_id", "text")).mapInArrow(_each_text(_lists, schema, folder, name, 1), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``: the length of every text in tokens; 0 for null and empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    count = lambda packed: pa.array([len(p) // 4 for p in packed], pa.int64())
    return spread(documents.select("doc_id", "text")).mapInArrow(_each_text(count, schema, folder, name, 1), "doc_id bigint, n_tokens bigint")
