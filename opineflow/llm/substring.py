"""Substring dedup: MinHash banding of paragraphs, exact Jaccard, components, spans to remove.

A paragraph is a line with words.  Equal paragraphs, short ones too, are found by a digest of their text.
Of different ones those of five words and more that agree in a band (two coordinates; recall 99.4 % at
similarity 0.8) are joined, verified by the exact Jaccard of their five-word shingles, and linked into
components; the first paragraph of a component stays, the others are to be removed.

Repeated passages also begin and end within paragraphs.  So paragraphs are cut into pieces as well, at
places that the words nearby choose: where the hash of a word pair is least among its neighbours.  A
passage is cut alike wherever it stands, and one of over 50 words all but surely holds whole pieces.
Pieces are compared by digest alone: a changed word in some 13 leaves no Jaccard of 0.8, while the
pieces beside it still are equal.

The texts are read twice, and no table holds them: the first pass keeps digests and band keys, the
second cuts the shingles of paragraphs that share a band.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, join_groups, materialize, release
from .dart_minhash import text_roots
from .shingles import SHINGLE, mix, shingle_hashes, words_of

REACH = 6  # word pairs on either side that a border is compared with
LEAST_WORDS = 6  # of a piece; paragraphs have no least length
BANDS, ROWS = 5, 2
SIMILARITY = 0.8
_M = np.uint64(0xA0761D6478BD642F)
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _M)
_TOP = np.iinfo(np.uint64).max
_UNITS = "doc_id long, text_key long, paragraph boolean, start int, end int, id binary, keys array<long>"


def piece_borders(words: np.ndarray, first: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) word indexes of all pieces; ``first`` has each paragraph's first word and the end."""
    counts = np.diff(first)
    pair = np.full(len(words), _TOP, np.uint64)
    pair[1:] = mix(words[:-1] * _M + words[1:])
    pair[first[:-1][counts > 0]] = _TOP
    # paragraphs lie ``reach`` apart, so that none sees its neighbour
    at = np.arange(len(words)) + np.repeat(np.arange(len(counts)) + 1, counts) * reach
    line = np.full(len(words) + (len(counts) + 2) * reach, _TOP, np.uint64)
    line[at] = pair
    cut = pair < _TOP
    for k in range(1, reach + 1):
        cut &= (pair < line[at - k]) & (pair <= line[at + k])
    starts = np.union1d(np.flatnonzero(cut), first[:-1][counts > 0])
    return starts, np.append(starts[1:], len(words))


def band_keys(runs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys of the paragraphs from word ``start`` to ``end``, of SHINGLE words at least."""
    n = end - start - SHINGLE + 1
    begins = np.cumsum(n) - n
    each = runs[np.repeat(start - begins, n) + np.arange(n.sum())]
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _M, (len(start), BANDS)).copy()
    for k, seed in enumerate(SEEDS):
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * _M + np.minimum.reduceat(mix(each ^ seed), begins))
    return keys.view(np.int64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs, and the pieces of those that have several, with a digest of their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = part.column("text").to_pylist()
            w = words_of(texts)
            if not len(w.hashes):
                continue
            first = np.append(w.paragraphs, len(w.hashes))
            start, end = piece_borders(w.hashes, first)
            inner = (end - start >= LEAST_WORDS) & ~(np.isin(start, first) & np.isin(end, first))
            n = len(first) - 1
            start, end = np.concatenate([first[:-1], start[inner]]), np.concatenate([first[1:], end[inner]])
            of = np.searchsorted(w.first, start, side="right") - 1
            a, z = w.starts[start] - w.offset[of], w.ends[end - 1] - w.offset[of]
            ids = [blake2b(texts[t][i:j].encode("utf-8", "surrogatepass"), digest_size=16).digest() for t, i, j in zip(of.tolist(), a.tolist(), z.tolist(), strict=True)]
            banded = np.flatnonzero(end[:n] - start[:n] >= SHINGLE)
            sizes = np.zeros(len(start), np.int32)
            sizes[banded] = BANDS
            keys = band_keys(shingle_hashes(w.hashes), start[banded], end[banded]).reshape(-1) if len(banded) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys))
            rows, whole = pa.array(of), pa.array(np.arange(len(start)) < n)
            yield pa.record_batch([part.column("doc_id").take(rows), part.column("text_key").take(rows), whole, pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(ids, pa.binary()), lists], names=["doc_id", "text_key", "paragraph", "start", "end", "id", "keys"])


def _cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the wanted paragraphs of each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, wanted = batch.column("text")[row].as_py(), batch.column("wanted")[row].as_py()
            for at in range(0, len(wanted), 128):
                some = wanted[at : at + 128]
                w = words_of([text[x["start"] : x["end"]] for x in some])
                runs = shingle_hashes(w.hashes)
                sets = [np.unique(runs[a : z - SHINGLE + 1]).tobytes() for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.record_batch([pa.array([x["id"] for x in some], pa.binary()), pa.array(sets, pa.binary())], names=["id", "items"])


def _place(*more: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "start", "uid", *more)


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per paragraph, and per piece of one, that others repeat: doc_id, start, end (code points), paragraph
    (or piece), keep_doc_id, keep_start, removed.

    keep_* is the one of the class that stays, of the smallest doc_id (null last), then text hash, then start; its own row
    has removed false.  Null, empty and blank texts have no paragraphs.  Repeats within a document and in repeated rows
    count.  Paragraphs of under five words are alike only if they are equal, letters' cases included.
    """
    docs = documents(docs).withColumn("text_key", F.xxhash64("text"))
    units = materialize(docs.mapInArrow(_units, _UNITS).withColumn("uid", F.monotonically_increasing_id()), "units")
    # what shares a digest, first by 64 bits of it: two short passes instead of all rows in one group
    short = F.xxhash64("id")
    shared = materialize(units.groupBy(short.alias("short")).agg(F.count("*").alias("n")).where("n > 1"), "shared-units")
    hits = materialize(join_groups(units.drop("keys").withColumn("of", short), shared, "of", "short").drop("of", "short", "n"), "hits")
    # one row a different paragraph, with the place of its first one; equal ones are summed up before the shuffle
    first = F.min(_place("end", "keys")).alias("first")
    paragraphs = materialize(units.where("size(keys) > 0").groupBy("id").agg(first).select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "first.start", "first.uid", "first.end", "first.keys"), "paragraphs")
    release(units, shared)

    def sets_of(needed: DataFrame) -> DataFrame:
        wanted = paragraphs.join(needed, "id").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("id", "start", "end")).alias("wanted"))
        wanted = materialize(wanted.select(F.col("doc_id").alias("in_id"), F.col("text_key").alias("in_key"), "wanted"), "wanted")
        once = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("text_key") == F.col("in_key")))
        return once.select("text", "wanted").mapInArrow(_cut_sets, "id binary, items binary").dropDuplicates(["id"])

    roots = materialize(text_roots(paragraphs.select(F.explode("keys").alias("key"), "id"), sets_of, similarity), "paragraph-roots")
    # classes: a text and what its component says
    groups = hits.groupBy("id").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    linked = roots.select(F.col("node").alias("id")).unionByName(roots.select(F.col("root").alias("id"))).distinct()
    single = materialize(paragraphs.drop("keys").join(linked, "id", "left_semi").join(groups.select("id"), "id", "left_anti").withColumn("paragraph", F.lit(True)), "linked-paragraphs")
    texts = groups.unionByName(single.select("id", _place().alias("first"), F.lit(1).cast("long").alias("n")))
    texts = materialize(texts.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "first", "n"), "unit-roots")
    classes = materialize(texts.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("keep"), F.sum("n").alias("size")).where("size > 1"), "unit-classes")
    members = materialize(join_groups(texts.select("id", "root", "n"), classes, "root", "of", "size").select(F.col("id").alias("member"), "keep", "n"), "unit-members")
    release(paragraphs, texts, classes)
    rows = join_groups(hits.unionByName(single.select(hits.columns)), members, "id", "member")
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "paragraph", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").cast("long").alias("keep_start"), (F.col("uid") != F.col("keep.uid")).alias("removed"))
