"""Token counts by the whole-token shortcut.

Most pre-tokens of a text are themselves strings of the vocabulary, but a string of the vocabulary need
not encode alone as one token: the merges may take another way through it.  So every string is proved
once, offline, by running the merges on it; what comes out as itself counts one wherever it stands as a
pre-token.  Only the other pre-tokens are merged.  The table of proved strings is bounded by the
vocabulary and goes to the executors as a broadcast; counting is narrow, without a shuffle.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import filterfalse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _PRETOKEN, _byte_of_char
from .common import documents

LIMIT = 512
CACHE_WORDS, CACHE_BYTES = 500_000, 64  # the cache's words, and the longest of these
_COUNTERS: dict[str, "TokenCounter"] = {}


class TokenCounter:
    """Counts of a byte-level BPE; ``whole`` holds the strings proved to be one token, or none of them."""

    def __init__(self, path: str, whole: frozenset[str] = frozenset()):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.char = {b: c for c, b in _byte_of_char().items()}
        special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = [t for t in spec["model"]["vocab"] if t not in special]
        # the library takes such strings out of a text first, the longest at each place
        self.special = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(left, right): i for i, (left, right) in enumerate(merges)}
        self.whole, self.more = whole, {}

    def merged(self, word: str) -> int:
        """How many tokens the merges leave of ``word``, in the vocabulary's letters: the earliest merge first, of equal ones the leftmost."""
        part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        rank, end, left = self.rank, len(word), len(word)
        todo = [(r, i) for i in range(end - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if j >= end or not part[i] or rank.get((part[i], part[j])) != r:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], ""
            left, after[i] = left - 1, after[j]
            if after[j] < end:
                before[after[j]] = i
                if (new := rank.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(todo, (new, i))
            if (k := before[i]) >= 0 and (new := rank.get((part[k], part[i]))) is not None:
                heapq.heappush(todo, (new, k))
        return left

    def prove(self) -> frozenset[str]:
        """The strings of the vocabulary that encode alone as one token; those that are no UTF-8 are no pre-tokens."""
        to_byte, out = _byte_of_char(), []
        for token in self.vocab:
            if self.merged(token) == 1:
                try:
                    out.append(bytes(to_byte[c] for c in token).decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(out)

    def _more(self, pretoken: str) -> int:
        """The tokens of a pre-token beyond the first."""
        if (n := self.more.get(pretoken)) is None:
            data = pretoken.encode()
            n = self.merged("".join(map(self.char.__getitem__, data))) - 1
            if len(data) <= CACHE_BYTES:
                if len(self.more) >= CACHE_WORDS:
                    self.more.clear()
                self.more[pretoken] = n
        return n

    def count(self, text: str) -> int:
        n, parts = 0, [text]
        if self.special:
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            pretokens = _PRETOKEN.findall(part)
            n += len(pretokens) + sum(map(self._more, filterfalse(self.whole.__contains__, pretokens)))
        return n


def whole_tokens(tokenizer_path: str) -> frozenset[str]:
    """The offline proof: some seconds, once for a vocabulary."""
    return TokenCounter(tokenizer_path).prove()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, whole: frozenset[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    The counts are those of the tokenizers library without added tokens, truncation and padding; special strings within texts are
    special tokens, as its default has it.  Null is the empty text: no bytes, no tokens.  Repeated rows are counted each, a null
    doc_id stays.  A text of one very long word is merged as a whole, in n log n.  ``whole`` is an earlier proof, to be used again.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(whole if whole is not None else whole_tokens(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _COUNTERS:  # one a Python worker
            _COUNTERS[tokenizer_path] = TokenCounter(tokenizer_path, proved.value)
        counter = _COUNTERS[tokenizer_path]
        for batch in batches:
            texts = batch.column("text")
            counts = [counter.count(t.as_py()) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pc.binary_length(texts.cast(pa.large_binary())).cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
