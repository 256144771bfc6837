"""Byte-pair encoding by backtracking, decoding by an offset table.

Encoding a pre-token: an Aho-Corasick automaton over all tokens' bytes finds the longest token that
starts at each byte; a token may follow another only if the pair table says that the merges would
not have joined across their border; otherwise the next shorter token is tried, then the one before
is taken back.  Each byte position is given up at most once, so the work is linear, and the result
is the one that applying the merges in order gives.  Decoding copies slices of one flat byte buffer.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents

CACHE_WORDS = 900_000
# Unicode White_Space, stated because re's \s holds more.
_WS = "\t-\r \x85\xa0  -     　"
# Fixed value: the byte-level pre-tokenizer's pattern.
_PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_CODECS: dict[str, "BacktrackingBpe"] = {}


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BacktrackingBpe:
    """A byte-level BPE whose merges are numbered in order by their ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = _byte_of_char(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        # rank orders merges; halves undoes a merge; joined is what two tokens merge to
        self.rank, self.halves, self.joined = [-1] * size, [(i, i) for i in range(size)], {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.rank[whole], self.halves[whole] = rank, (vocab[left], vocab[right])
            self.joined[vocab[left], vocab[right]] = whole
        words = {self.tokens[i]: i for token, i in vocab.items() if token not in self.special}
        self.automaton = ahocorasick.Automaton()
        for token, i in words.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * size  # the longest token that begins this one
        for token, i in words.items():
            self.shorter[i] = next((words[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in words), -1)
        # the offset table
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.names = [str(i) for i in range(size)]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right side by side; kept in the pair table."""
        key = (left, right)
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        """Undo the later of the two tokens' merges step by step; no merge across the border may come before."""
        limit = len(self.rank)  # merges from here on would have come too late
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and self.rank[whole] < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the one on the left is done first
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 1, self.halves[right][0]

    def encode_pretoken(self, data: bytes) -> list[int]:
        n = len(data)
        longest = [-1] * n
        tokens = self.tokens
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end - len(tokens[token]) + 1] = token
        if len(tokens[longest[0]]) == n:
            return [longest[0]]
        out: list[int] = []
        open_at = bytearray(b"\x01") * (n + 1)  # positions not yet given up
        at, token = 0, longest[0]
        while at < n:
            end = at + len(tokens[token])
            if open_at[end] and (not out or self.follows(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(tokens[token])
                # resume with the next shorter choice at the earlier position
                # (its full length now ends at a position given up)
        return out

    def _word(self, pretoken: str) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        found = self.words[pretoken] = array("I", self.encode_pretoken(pretoken.encode())).tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        out, get = [], self.words.get
        for part in parts:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out += [get(p) or self._word(p) for p in _PRETOKEN.findall(part)]
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        take = np.repeat(self.starts[ids] - before, lengths) + np.arange(int(lengths.sum()))
        return self.flat[take].tobytes()


def codec(path: str) -> BacktrackingBpe:
    """One codec a Python worker."""
    if path not in _CODECS:
        _CODECS[path] = BacktrackingBpe(path)
    return _CODECS[path]


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded).

    Null is the empty text: no tokens.  Repeated rows are encoded each.  Narrow: no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = bpe.encode(text)
                    listed = ids.tolist()
                    decoded = bpe.decode(ids).decode("utf-8", "replace")
                    shas = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(bpe.names.__getitem__, listed)), decoded)]
                    rows.append((doc_id, len(listed), *shas) + ((listed, decoded) if with_ids else ()))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return documents(docs).mapInArrow(run, schema)
