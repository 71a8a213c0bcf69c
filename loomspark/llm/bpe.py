"""Byte-level BPE encoding and decoding with forced boundaries.

A merge makes a token of the vocabulary out of two neighbours, and the two
bytes at the seam stand next to each other in it. So where two bytes never
stand next to each other in any token, no merge ever crosses: a certain cut.
Each pre-token is cut there, the fragments are encoded independently (and
remembered), and their ids are put one after the other.

Pre-tokens are those of the vocabulary file's own splitter: texts of
characters up to U+024F by a pattern with the same character classes, others
by the library's splitter. Strings of added tokens inside a text become these
tokens, as the library has it.

Null and empty texts have no ids and decode to an empty text. Every row gets
its own result; whole texts are encoded, a text's ids are one row.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm._common import packed, ship, with_row

#: Up to here the pattern's classes are spelt out.
_KNOWN = 0x250


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_KNOWN) if unicodedata.category(chr(c))[0] == kind)


def splitter() -> re.Pattern:
    letter, number, space = _class("L"), _class("N"), r"\t-\r \x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class Encoder(dict):
    """Maps a pre-token to its ids, packed as little-endian 32-bit numbers.

    Holds at most ``most`` of them in two generations: when the younger is full, the older goes and what is still in use comes back from it.
    """

    def __init__(self, path: str, most: int = 160_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.most, self.older = most, {}
        names = byte_names()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: bytes(names[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.byte_id = {b: vocab[c] for c, b in names.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        #: pairs of bytes inside tokens, as one number
        self.joined = {256 * t[i - 1] + t[i] for t in self.token.values() for i in range(1, len(t))}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.split = splitter().findall
        self.unknown = re.compile(f"[^\\x00-{chr(_KNOWN - 1)}]").search
        self.fragments: dict[bytes, bytes] = {}
        self.path, self._library, self._names = path, None, names
        self.shown = [self.token[i] for i in range(max(self.token) + 1)]

    def pre_tokens(self, text: str) -> list[str]:
        if not self.unknown(text):
            return self.split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:z] for _, (a, z) in self._library.pre_tokenize_str(text)]

    def cuts(self, data: bytes) -> list[bytes]:
        """Fragments between forced boundaries."""
        if len(data) < 2:
            return [data]
        joined, out, at = self.joined, [], 0
        for i in range(1, len(data)):
            if 256 * data[i - 1] + data[i] not in joined:
                out.append(data[at:i])
                at = i
        return [*out, data[at:]]

    def merged(self, fragment: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap of pairs keeps long fragments fast."""
        ids = [self.byte_id[b] for b in fragment]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := merge.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def fragment(self, data: bytes) -> bytes:
        """Ids of a part of a pre-token; such parts recur in other pre-tokens."""
        ids = self.fragments.get(data)
        if ids is None:
            ids = np.array(self.merged(data), "<u4").tobytes()
            if len(data) <= 64:
                if len(self.fragments) >= self.most // 4:
                    self.fragments.clear()
                self.fragments[data] = ids
        return ids

    def __missing__(self, pre_token: str) -> bytes:
        packed = self.older.get(pre_token)
        if packed is None:
            parts = self.cuts(pre_token.encode("utf-8", "replace"))
            packed = b"".join(map(self.fragment, parts)) if len(parts) > 1 else np.array(self.merged(parts[0]), "<u4").tobytes()
        if len(pre_token) <= 64:
            if len(self) >= self.most // 2:
                self.older = dict(self)
                self.clear()
            self[pre_token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if self.specials is None:
            return b"".join(map(self.__getitem__, self.pre_tokens(text)))
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts.append(b"".join(map(self.__getitem__, self.pre_tokens(text[at : m.start()]))))
            parts.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        parts.append(b"".join(map(self.__getitem__, self.pre_tokens(text[at:] if at else text))))
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.shown.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """The ``keep`` columns (default doc_id), n_tokens, ids (binary, little-endian 32-bit) and decoded (the text that the ids give).

    ``path``: a byte-level BPE vocabulary file that every executor has there.
    """
    ship(docs.sparkSession)
    rows = packed(docs, keep or ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomspark.llm import bpe

        enc = bpe.encoder(path)
        for b in batches:
            for part in range(0, b.num_rows, 1024):
                few = b.slice(part, 1024)
                ids = [enc.encode(x or "") for x in few.column("body").to_pylist()]
                shown = [enc.decode(x) if decode else None for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [few.column("row"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(shown, pa.string())],
                    ["row", "n_tokens", "ids", "decoded"],
                )

    out = rows.mapInArrow(run, with_row(rows, "n_tokens long, ids binary, decoded string"))
    return out.select("row.*", "n_tokens", "ids", "decoded")
