"""Packing by power-of-two decomposition: every document becomes binary-length pieces, equal lengths share a bucket.

A piece is a training sequence of its own, so no sequence crosses documents and none is padded.
Tokenizing and cutting are narrow: the job has no shuffle, whatever the skew of the sources.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, turn_to, worker_cache

SEQUENCE = 4096
CACHE_WORDS, CACHE_CHARS = 900_000, 64  # the words kept between batches, and the longest of these
# What str.split() takes for white space and the tokenizer does not.
_NO_GAP = "\x1c\x1d\x1e\x1f"
_GAP = re.compile("[ \t\n\r]+")
# Letters up to U+024F, then ASCII signs: NFC leaves them, lower() is the tokenizer's lower case, and each part is one token run.  (U+0130 becomes two characters.)
_PLAIN = re.compile(r"([A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+)([!-/:-@\[-`{-~]*)")
_ENCODERS: dict[str, "_WordIds"] = worker_cache("packing", {})


def _stays_letter(c: str) -> bool:
    """Whether the tokenizer's lower case and NFC make no letter and mark of it: the mark and a sign after it would be one run."""
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c.lower()).isalpha() and unicodedata.normalize("NFC", c).isalpha())


class _WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes, from the tokenizers library.

    The tokenizer drops white space and never joins words across it, so a text's ids are its words'
    ids in turn.  Signs after plain letters, and a full stop or comma after any letter, are a token run
    of their own.  Words of letters are encoded a hundred at a time; each ends with the one id that
    closes a word.  Plain ones need none of the tokenizer's normalizers and patterns, only its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # Spark runs the tasks side by side; a pool of threads in each worker would only hold memory a thread
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model_only = Tokenizer(self.tokenizer.model)
        self.model_only.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.long: list[str] = []  # words of the last batch that don't stay
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _encode(self, tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, words: set[str]) -> None:
        ended, plain, letters, others, seen = [], [], [], [], set()
        for word in words:
            root, tail, to = word, "", letters if word.isalpha() else others
            if match := _PLAIN.fullmatch(word):
                (root, tail), to = match.groups(), plain
            elif len(word) > 1 and word[-1] in ".," and _stays_letter(word[-2]):
                root, tail = word[:-1], word[-1]
                to = letters if root.isalpha() else others
            if tail:
                ended.append((word, root, tail))
                if tail not in self and tail not in seen:
                    seen.add(tail)
                    others.append(tail)
            if root not in self and root not in seen:
                seen.add(root)
                to.append(root)
        for tokenizer, own in ((self.model_only, plain), (self.tokenizer, letters)):
            lines = [own[i : i + 100] for i in range(0, len(own), 100)]
            texts = [" ".join(x) for x in lines]
            for line, ids in zip(lines, self._encode(tokenizer, [x.lower() for x in texts] if own is plain else texts), strict=True):
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) == len(line):  # each has one at least, so each has one
                    data, end = ids.tobytes(), (4 * ends).tolist()
                    for word, i, j in zip(line, [0, *end], end, strict=False):
                        self[word] = data[i:j]
                else:
                    others += line
        for word, ids in zip(others, self._encode(self.tokenizer, others), strict=True):
            self[word] = ids.tobytes()
        for word, root, tail in ended:
            self[word] = self[root] + self[tail]
        self.long = [w for w in {*words, *seen} if len(w) > CACHE_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_GAP.split(text) if any(c in text for c in _NO_GAP) else text.split() for text in texts]
        words = set().union(*split)
        if missing := set(filterfalse(self.__contains__, words)):
            if len(self) + 3 * len(missing) > CACHE_WORDS:
                self.clear()
                missing = words
            self.add(missing)
        joined = [b"".join(map(self.__getitem__, words)) for words in split]
        for w in self.long:
            self.pop(w, None)
        self.long = []
        return joined


def encoder(path: str) -> _WordIds:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _WordIds(path)
    return _ENCODERS[path]


def binary_pieces(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of whole sequences, then of the binary digits of the rest, longest first."""
    pieces = [(i * longest, longest) for i in range(n // longest)]
    start, rest, bit = n - n % longest, n % longest, longest // 2
    while rest:
        if rest & bit:
            pieces.append((start, bit))
            start, rest = start + bit, rest - bit
        bit //= 2
    return pieces


def power_of_two_pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, longest: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset (and ids).

    ``bucket`` is log2 of the length: write with ``partitionBy("bucket")`` to batch equal lengths.
    A null or empty text is the end id alone.  Repeated rows are packed each.  sequence_id numbers
    pieces in the order of the input's partitions; it is stable under task retries.
    """
    assert longest & (longest - 1) == 0, "sequences are powers of two"
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("packing")
        words, end = encoder(tokenizer_path), array("I", [end_id]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[] for _ in range(6 + with_ids)]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start, length in binary_pieces(n, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, start, length, zlib.crc32(piece), n, length.bit_length() - 1)
                        for column, value in zip(out, row + ((array("i", piece).tolist(),) if with_ids else ()), strict=True):
                            column.append(value)
                types = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return documents(docs).mapInArrow(cut, schema).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
