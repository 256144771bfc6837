"""Near-duplicate documents by DartMinHash: hashed darts, sparse weighted signatures, banded joining.

A text is the multiset of its five-word shingles.  Over each shingle's half line of weights and all
ranks darts are thrown at random, but determined by hashes alone, in cells of doubling size.  A dart
counts if it falls below the shingle's weight; of those that hash to one of the signature's coordinates
the earliest is kept.  Two texts agree in a coordinate with the probability of their weighted Jaccard.
Ranks are swept upward only until all coordinates of a text are filled, so a text takes about k log k
darts, however long it is.

Exact copies are put under one representative first.  Texts that agree in a band are candidates:
all pairs of a small bucket; in a large one each text is first held against two pivots, one of which most
others agree with, so work is linear in a group's size.  Candidates are verified by the exact weighted
Jaccard; classes are connected components.  Large buckets that still hold several components go through
an exact prefix-filter join between the components, so that no link there is lost to the pivots.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, join_groups, key128, materialize, release, turn_to
from .components import components
from .shingles import jaccard, mix, occurrence_sets, shingle_sets, weighted

BANDS, ROWS = 25, 5
SIMILARITY = 0.8
SMALL_BUCKET = 8
BIT_WORDS, SHORT_PREFIX = 16, 32
#: Shared items met more often than 1 / OFTEN of all go last in a prefix, by how often; the others go by their hash.
OFTEN = 1 << 19
#: Rank cells: [0, 2^-10), coarse up to 2^-4, then doubling.
_RANKS = [0.0, 2.0**-10, 2.0**-7, *(2.0**k for k in range(-4, 24))]
_M = np.uint64(0xD6E8FEB86659FD93)


def _poisson(mean: float) -> np.ndarray:
    """Cumulative chances of 0, 1, 2 ... darts in a cell."""
    n = np.arange(int(mean + 12 * mean**0.5 + 20))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.maximum(n[1:], 1)))])
    return np.cumsum(np.exp(logs))


_CDF: dict[float, np.ndarray] = {}


def signatures(hashes: np.ndarray, of: np.ndarray, weights: np.ndarray, texts: int, k: int) -> np.ndarray:
    """(texts, k) 32-bit values; texts without elements have zeros.  ``of`` is the element's text."""
    best = np.full((texts, k), np.iinfo(np.uint64).max, np.uint64)
    open_ = np.zeros(texts, bool)
    open_[of] = True
    top = int(weights.max()) if len(weights) else 0
    levels = [(0, 1)]
    while levels[-1][1] < top:
        levels.append((levels[-1][1], 2 * levels[-1][1]))
    reach = [np.flatnonzero(weights > low) for low, _ in levels]
    for band, (r0, r1) in enumerate(zip(_RANKS, _RANKS[1:], strict=False)):
        if not open_.any():
            break
        for level, (w0, w1) in enumerate(levels):
            at = reach[level][open_[of[reach[level]]]]
            if not len(at):
                continue
            mean = (r1 - r0) * (w1 - w0)
            cdf = _CDF.setdefault(mean, _poisson(mean))
            cell = mix(hashes[at] + np.uint64((band * 64 + level + 1) * int(_M) & (2**64 - 1)))
            chance = (cell >> np.uint64(11)).astype(np.float64) * 2.0**-53
            some = np.flatnonzero(chance >= cdf[0])
            n = np.searchsorted(cdf, chance[some], side="right")
            number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who = np.repeat(at[some], n)
            dart = mix(np.repeat(cell[some], n) + (number.astype(np.uint64) + np.uint64(1)) * _M)
            place = mix(dart)
            if w1 > 1:  # the height within the cell
                height = w0 + (w1 - w0) * ((place & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24)
                below = height < weights[who]
                who, dart, place = who[below], dart[below], place[below]
            # earliest rank first, then the dart's own 32 bits
            rank = np.uint64(band) << np.uint64(58) | (place >> np.uint64(38) << np.uint64(32))
            where = of[who] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best.reshape(-1), where, rank | (dart & np.uint64(0xFFFFFFFF)))
        open_ &= (best == np.iinfo(np.uint64).max).any(1)
    return np.where(best == np.iinfo(np.uint64).max, 0, best & np.uint64(0xFFFFFFFF)).astype(np.uint64)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys of ``rows`` coordinates each."""
    bands = values.shape[1] // rows
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M, (len(values), bands)).copy()
    for r in range(rows):
        keys = mix(keys * _M + values[:, r : bands * rows : rows])
    return keys.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("dart_minhash")
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            texts = [t.lower() for t in part.column("text").to_pylist()]
            h, of, c = weighted(*shingle_sets(texts), len(texts))
            keys = band_keys(signatures(h, of, c, len(texts), BANDS * ROWS), ROWS)
            some = np.flatnonzero(np.bincount(of, minlength=len(texts)) > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys[some].reshape(-1)))
            yield pa.record_batch([part.column("id").take(pa.array(some)), lists], names=["id", "keys"])


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The (key, id) rows whose key several texts have, with n, their number."""
    shared = materialize(bands.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1"), "shared-keys")
    rows = materialize(join_groups(bands, shared, "key", "k").select("key", "id", "n"), "buckets")
    release(shared)
    return rows


def bucket_pairs(rows: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """Pairs (a < b) to compare first: all of small buckets, each text with two pivots in large ones."""
    few = rows.where(F.col("n") <= small).select("key", "id")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    many = rows.where(F.col("n") > small)
    # a text that shares large buckets with many others is close to the middle of its group
    liked = many.groupBy(F.col("id").alias("i")).agg(F.sum("n").alias("liked"))
    many = materialize(many.join(liked, F.col("id") == F.col("i")).select("key", "id", "liked"), "large-buckets")
    pivots = many.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("liked", "id"))["id"].alias("p1"), F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id"))["id"].alias("p2"), F.count("*").alias("n"))
    held = join_groups(many, materialize(pivots, "pivots"), "key", "k").select("id", F.explode(F.array("p1", "p2")).alias("p")).where("id != p")
    return pairs.unionByName(held.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))).distinct()


def open_texts(rows: DataFrame, roots: DataFrame, small: int = SMALL_BUCKET) -> DataFrame:
    """(id, root) of the texts in large buckets whose texts are still of several components."""
    many = rows.where(F.col("n") > small).join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    many = materialize(many, "large-rooted")
    several = many.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("k", "n")
    found = materialize(join_groups(many, materialize(several, "open-keys"), "key", "k").select("id", "root").distinct(), "open")
    release(many)
    return found


def prefix_pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a < b) of different roots that may be similar; texts are (id, root, items), items as of ``_sets``.

    Prefix filter: with all items in one order, two sets of this similarity share an item among the first
    size - ceil(similarity * size) + 1 of each.  Frequent ones go last; as these are few, each text finds its own
    prefix, and only prefixes are shuffled.  Sizes and the items behind the shared one bound the rest, and so do
    bit maps of the items: each bit that the other text lacks is at least one item it lacks.
    """

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("dart_minhash")
        for batch in batches:
            for i in range(batch.num_rows):
                values = np.frombuffer(batch.column("items")[i].as_py(), np.int64)
                root = batch.column("root").slice(i, 1)
                for at in range(0, len(values), 1 << 16):
                    part = values[at : at + (1 << 16)]
                    yield pa.record_batch([root.take(pa.array(np.zeros(len(part), np.int32))), pa.array(part)], names=["root", "item"])

    met = texts.select("root", "items").mapInArrow(items, "root binary, item long").groupBy("item")
    met = materialize(met.agg(F.count("*").alias("met"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("item", "met"), "shared-items")
    # fewer than OFTEN items, whatever the data; what is met in one root only makes no pair, so it counts as rare
    least = (met.agg(F.sum("met")).first()[0] or 0) // OFTEN
    often = met.where(F.col("met") > least).orderBy("item").toArrow()
    often = texts.sparkSession.sparkContext.broadcast([often.column(c).to_numpy() for c in ("item", "met")])
    release(met)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("dart_minhash")
        names, counts = often.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = np.frombuffer(row.column("items")[0].as_py(), np.int64)
                left, right = np.searchsorted(names, values), np.searchsorted(names, values, "right")
                rank = np.zeros(len(values), np.int64)
                rank[left < right] = counts[left[left < right]]
                first = values[np.lexsort((values, rank))][: len(values) - math.ceil(len(values) * similarity - 1e-6) + 1]
                bit = np.zeros(64 * BIT_WORDS, np.uint8)
                bit[values.view(np.uint64) % np.uint64(len(bit))] = 1
                bits = pa.array(np.packbits(bit).view(np.int64)[None].tolist(), pa.list_(pa.int64()))
                for at in range(0, len(first), 1 << 16):
                    part = first[at : at + (1 << 16)]
                    same = pa.array(np.zeros(len(part), np.int32))
                    columns = [row.column("id").take(same), row.column("root").take(same), pa.array(np.full(len(part), len(values))), pa.array(part), pa.array(np.arange(at + 1, at + 1 + len(part))), bits.take(same)]
                    yield pa.record_batch(columns, names=["id", "root", "size", "item", "at", "bits"])

    each = texts.select("id", "root", "items").mapInArrow(prefixes, "id binary, root binary, size long, item long, at long, bits array<long>")
    each = materialize(each.select("id", "root", "size", "item", "at", *[F.col("bits")[k].alias(f"b{k}") for k in range(BIT_WORDS)]), "all-prefixes")
    # only what stands in prefixes of several roots makes a pair
    shared = each.groupBy(F.col("item").alias("i")).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("i", "n")
    first = join_groups(each, materialize(shared, "prefix-items"), "item", "i").select(*each.columns)
    # similar sets are of one size class or of neighbouring ones
    grade = F.floor(F.log("size") / (1.0001 * -math.log(similarity)))
    # where both prefixes are short, a pair is only met at the first item that they share
    whole = Window.partitionBy("id")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "item")).over(whole)), lambda x: x["item"])
    prefix = F.when(F.count("*").over(whole) <= SHORT_PREFIX, in_order)
    first = materialize(first.withColumns({"grade": grade, "prefix": prefix}), "prefixes")
    x, y = first.withColumn("grade", F.explode(F.array("grade", F.col("grade") + 1))).alias("x"), first.alias("y")
    common = F.ceil((F.col("x.size") + F.col("y.size")) * (similarity / (1 + similarity)) - 1e-6)
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) + 1
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id")))
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.b{k}")))) for k in range(BIT_WORDS)), F.lit(0))
    enough = (F.col("x.size") - only("x", "y") >= common) & (F.col("y.size") - only("y", "x") >= common)
    near = (F.col("x.item") == F.col("y.item")) & (F.col("x.grade") == F.col("y.grade")) & smaller & (F.col("x.root") != F.col("y.root")) & (left >= common) & enough
    near = near & F.coalesce(F.get(F.array_intersect("x.prefix", "y.prefix"), F.lit(0)) == F.col("x.item"), F.lit(True))
    return x.join(y, near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("dart_minhash")
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            sets = occurrence_sets([t.lower() for t in part.column("text").to_pylist()])
            yield pa.record_batch([part.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])


def verified_links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard is ``similarity`` or more; sets are (id, items) of their texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("dart_minhash")
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [jaccard(np.frombuffer(x[i].as_py(), np.uint64), np.frombuffer(y[i].as_py(), np.uint64)) >= similarity for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def text_roots(bands: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the components of similar texts; bands are (key, id) of different texts, from a written table.

    ``sets_of`` gives (id, items), whose Jaccard is the similarity, of a table of wanted ids.
    """
    rows = shared_buckets(bands)
    pairs = materialize(bucket_pairs(rows), "pairs")
    sets = materialize(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    links = materialize(verified_links(pairs, sets, similarity), "links")
    roots = materialize(components(links), "roots")
    rest = materialize(prefix_pairs(open_texts(rows, roots).join(sets, "id"), similarity).join(pairs, ["a", "b"], "left_anti"), "rest-pairs")
    links = materialize(links.unionByName(verified_links(rest, sets, similarity)), "all-links")
    release(rows, pairs, sets, roots, rest)
    return components(links)


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    A class is a connected component of texts linked by similarity; class_id is its smallest doc_id (null
    last), and that row is kept (of fully repeated rows, one).  Words are lower case, split at white space.
    Texts of under five words are one shingle; texts without words are alike only if they are equal.
    """
    docs = documents(docs).withColumn("id", key128(F.col("text")))
    rows = materialize(docs.select("doc_id", "id").withColumn("rid", F.monotonically_increasing_id()), "rows")
    rows = join_groups(rows, _classes(docs, rows, similarity), "id", "t")
    return rows.select("doc_id", F.col("keep.doc_id").alias("class_id"), F.col("size").alias("class_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicate_classes`` keeps; of rows that repeat id and text, any one.

    The row travels as one column, so its other columns may have any names."""
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), key128(F.coalesce(F.col(text_col), F.lit(""))).alias("id"))
    plain = documents(docs, id_col, text_col).withColumn("id", key128(F.col("text")))
    rows = materialize(plain.select("doc_id", "id").withColumn("rid", F.monotonically_increasing_id()), "rows")
    keepers = _classes(plain, rows, similarity).where(F.col("t") == F.col("keep.id")).select("t", F.col("keep.doc_id").alias("keep_id"))
    kept = whole.join(keepers, (F.col("id") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")
    return kept.dropDuplicates(["id"]).select("row.*")


def _classes(docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """t (a text's id), keep (its class's first row), size and n, the text's rows; docs have text and id, rows (written) doc_id, id and rid."""
    distinct = docs.select("id", "text").dropDuplicates(["id"])
    # keys of every row, then one row a text: less to shuffle than the texts
    keys = materialize(docs.select("id", "text").mapInArrow(_keys, "id binary, keys array<long>").dropDuplicates(["id"]), "band-keys")
    roots = text_roots(keys.select(F.explode("keys").alias("key"), "id"), lambda needed: distinct.join(needed, "id").select("id", "text").mapInArrow(_sets, "id binary, items binary"), similarity)
    # classes are summed up per text, then per class; only sizes and ids meet the rows again
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "id")).alias("first")
    texts = rows.groupBy("id").agg(first, F.count("*").alias("n"))
    texts = materialize(texts.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"), "first", "n"), "text-roots")
    classes = materialize(texts.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("keep"), F.sum("n").alias("size")), "classes")
    found = materialize(join_groups(texts, classes, "root", "r", "size").select(F.col("id").alias("t"), "keep", "size", "n"), "text-classes")
    release(keys, texts, classes)
    return found
