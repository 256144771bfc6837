"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-case words, their first letters and how many words share these, hashed into ``2**bits`` slots, present or not.  Beside a weight per slot the
model has a short factor vector per slot, so it learns pairs of terms, which a sum of term weights
misses.  It is fitted with AdaGrad on a bounded sample of labelled rows; scoring is a narrow pass.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_by_arrow, documents, turn_to, worker_cache

#: The most labelled rows that are fitted on; with more, those of the smallest id hashes are taken.
FIT_ROWS = 10_000
BITS, FACTORS = 18, 4
#: Beginnings of words, in letters, that are terms too, so that inflected forms share weights.
STEMS = (4, 5, 6, 7, 8)
#: That so many different words of a text share a beginning is a term too: one may be chance, a family isn't.
SHARED = (2, 3, 4)
#: Terms met in fewer fitted rows keep weight 0, whatever the number of rows; decay holds down those hardly more frequent.
LEAST_ROWS = 3
#: Bounds of a worker's cache of words: entries, and letters of each.
CACHE_WORDS, CACHE_LETTERS = 200_000, 40
#: A toxic row counts as so many clean ones, as these are many.
TOXIC_WEIGHT = 3
#: Rows that fitting sees in all, within 8 and 16 epochs.
SEEN_ROWS = 50_000
#: Of the fitted rows, those whose crc32(id) modulo 5 is this set where 0.5 lies; the held-out ones, of 0, never do.
INNER = 1
#: Where 0.5 lies, a share of clean rows above it weighs so many times as the same share of toxic rows below.
FALSE_ALARM = 2
_WORD = re.compile(r"[^\W\d_]+")


class FactorizationMachine(NamedTuple):
    bias: float
    weights: np.ndarray  # per slot
    factors: np.ndarray  # per slot and factor

    def raw(self, slots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log odds of documents whose slots are concatenated; ends has each one's end.

        With x = 1 for present terms: sum of weights + half of (sum of factors squared - sum of squares)."""
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        out = np.full(len(ends), self.bias)
        full = sizes > 0
        if full.any():
            at, scale = starts[full], _scale(sizes[full])
            v = self.factors[slots]
            total = np.add.reduceat(v, at, axis=0)
            square = np.add.reduceat((v * v).sum(1), at)
            out[full] += np.add.reduceat(self.weights[slots], at) * scale[:, 0] + 0.5 * ((total * total).sum(1) - square) * scale[:, 0] ** 2
        return out

    def raw_each(self, texts: list[np.ndarray]) -> np.ndarray:
        """``raw`` of one array of slots a document, some hundred at a time."""
        parts = [texts[at : at + 256] for at in range(0, len(texts), 256)]
        return np.concatenate([np.zeros(0), *(self.raw(np.concatenate(x), np.cumsum([len(t) for t in x])) for x in parts)])


def _scale(sizes: np.ndarray) -> np.ndarray:
    """Longer texts hold more terms of no account: each counts a little less."""
    return (np.maximum(sizes, 1) ** -0.25)[:, None]


class _WordTerms(dict):
    """word -> the hashes of it and of its beginnings (0: it has none so long), 4 bytes each; a bounded cache of a worker's."""

    def __missing__(self, word: str) -> bytes:
        terms = [crc32(word.encode()), *(crc32(f"{word[:n]}-".encode()) if len(word) > n else 0 for n in STEMS)]
        raw = struct.pack(f"<{len(terms)}I", *terms)
        if len(word) <= CACHE_LETTERS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = raw
        return raw


_TERMS = worker_cache("toxicity_fm", _WordTerms())


def slots_of(text: str) -> np.ndarray:
    """The distinct slots of a text's terms, in order."""
    words = set(_WORD.findall(text.lower()))
    if not words:
        return np.zeros(0, np.int32)
    hashes = np.frombuffer(b"".join(map(_TERMS.__getitem__, words)), np.uint32).reshape(len(words), -1)
    stems, many = np.unique(hashes[:, 1:][hashes[:, 1:] > 0], return_counts=True)
    shared = [stems[many >= k] * np.uint32(0x9E3779B1) + np.uint32(k) for k in SHARED]
    terms = np.concatenate([hashes[:, 0], stems, *shared])
    return np.unique((terms ^ terms >> np.uint32(BITS)) & np.uint32((1 << BITS) - 1)).astype(np.int32)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int | None = None, rate: float = 0.7, decay: float = 0.02, batch: int = 128, seed: int = 7) -> FactorizationMachine:
    """AdaGrad on the logistic loss.  One class or no rows: the bias alone."""
    rng = np.random.default_rng(seed)
    n = len(texts)
    share = (labels.sum() + 1) / (n + 2) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    w = np.zeros(1 << BITS)
    v = rng.normal(0, 0.02, (1 << BITS, FACTORS))
    if n == 0 or labels.min() == labels.max():
        return FactorizationMachine(bias, w, np.zeros_like(v))
    met = np.zeros(1 << BITS, np.int32)
    for t in texts:
        met[t] += 1  # its slots are distinct
    kept = met >= LEAST_ROWS
    v[~kept] = 0
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    sizes = np.array([np.count_nonzero(kept[t]) for t in texts])
    for _ in range(epochs or min(max(SEEN_ROWS // n, 8), 16)):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            rows = order[k : k + batch]
            rows = rows[sizes[rows] > 0]
            if not len(rows):
                continue
            idx = np.concatenate([texts[r] for r in rows])
            idx = idx[kept[idx]]  # batch by batch: no second copy of all texts
            m = sizes[rows]
            at = np.cumsum(m) - m
            scale = _scale(m)
            vi = v[idx]
            total = np.add.reduceat(vi, at, axis=0)
            square = np.add.reduceat((vi * vi).sum(1), at)
            z = bias + np.add.reduceat(w[idx], at) * scale[:, 0] + 0.5 * ((total * total).sum(1) - square) * scale[:, 0] ** 2
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * np.where(labels[rows] > 0, TOXIC_WEIGHT, 1)
            each = np.repeat(e * scale[:, 0], m)
            slots, inverse = np.unique(idx, return_inverse=True)
            dw = np.bincount(inverse, each) + decay * w[slots]
            pair = (np.repeat(total, m, axis=0) - vi) * np.repeat(e * scale[:, 0] ** 2, m)[:, None]
            dv = np.stack([np.bincount(inverse, pair[:, f]) for f in range(FACTORS)], 1) + decay * v[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            gb += e.sum() ** 2
            w[slots] -= rate * dw / np.sqrt(gw[slots])
            v[slots] -= 0.1 * rate * dv / np.sqrt(gv[slots])
            bias -= rate * e.sum() / np.sqrt(gb)
    return FactorizationMachine(float(bias), w.astype(np.float32), v.astype(np.float32))


def best_cut(raw: np.ndarray, labels: np.ndarray) -> float:
    """The log odds at which the share of toxic rows at or above, less FALSE_ALARM times that of clean rows, is largest."""
    order = np.argsort(-raw, kind="stable")
    toxic = labels[order] > 0
    if toxic.all() or not toxic.any():
        return 0.0
    gain = np.cumsum(toxic) / toxic.sum() - FALSE_ALARM * np.cumsum(~toxic) / (~toxic).sum()
    ends = np.append(np.diff(raw[order]) < 0, True)  # equal scores stay together
    at = int(np.argmax(np.where(ends, gain, -np.inf)))
    below = raw[order][at + 1] if at + 1 < len(raw) else raw[order][at] - 1
    return float((raw[order][at] + below) / 2)


def calibrated_fit(texts: list[np.ndarray], labels: np.ndarray, inner: np.ndarray) -> FactorizationMachine:
    """``fit`` on all rows, its bias moved by the best cut of a fit on the rows that aren't ``inner``, as the inner ones show it.

    Toxic rows are few, so an uncalibrated fit lets the doubtful ones pass."""
    model = fit(texts, labels)
    if not inner.any() or inner.all():
        return model
    outer = fit([t for t, i in zip(texts, inner, strict=True) if not i], labels[~inner])
    own = [t for t, i in zip(texts, inner, strict=True) if i]
    return model._replace(bias=model.bias - best_cut(outer.raw_each(own), labels[inner]))


def held_out(doc_id: str = "doc_id"):
    """Whether labels of a row are kept from fitting: crc32 of the id as text, modulo 5, is 0 (null: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic, slots of at most ``fit_rows`` labelled ids that aren't held out, one row an id.

    Of several labels of one id the largest counts; null labels and ids have no part in it.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = marked.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # fit_rows ids: bounded
    rows = documents(docs).join(F.broadcast(chosen), "doc_id")

    def featurize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("toxicity_fm")
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "slots": [slots_of(t).tobytes() for t in frame["text"]]})

    sample = rows.select("doc_id", "toxic", "text").mapInPandas(featurize, "doc_id long, toxic int, slots binary")
    return sample.groupBy("doc_id", "toxic").agg(F.min("slots").alias("slots"))  # however many rows an id has


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on ``fit_sample``; only its slots reach the driver."""
    sample = collect_by_arrow(fit_sample(docs, labels, fit_rows)).sort_values("doc_id")
    inner = np.array([crc32(str(i).encode()) % 5 == INNER for i in sample["doc_id"]], bool)
    return calibrated_fit([np.frombuffer(s, np.int32) for s in sample["slots"]], sample["toxic"].to_numpy(float), inner)


def scorer(spark: SparkSession, model: FactorizationMachine) -> Callable[[Column], Column]:
    """A column function: text -> score within 0 and 1; null and empty texts get the bias's score."""
    shared = spark.sparkContext.broadcast(model)  # a fixed size: 2**BITS slots

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        turn_to("toxicity_fm")
        out = []
        for at in range(0, len(texts), 256):
            slots = [slots_of(t or "") for t in texts[at : at + 256]]
            raw = shared.value.raw(np.concatenate(slots), np.cumsum([len(s) for s in slots]))
            out.append(1 / (1 + np.exp(-np.clip(raw, -30, 30))))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, score, predicted per row, from the text alone."""
    score = scorer(docs.sparkSession, model)
    scored = documents(docs).select("doc_id", score("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under one half; null and empty texts have the bias's score."""
    return docs.where(scorer(docs.sparkSession, model)(F.col(text_col)) < 0.5)
