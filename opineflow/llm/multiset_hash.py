"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text's elements are its paragraphs, those of several sentences cut at sentence ends.  Each element
is hashed to a wide vector, and a fingerprint is the sum of its elements' vectors modulo powers of
two.  The order of elements does not matter, and adding or taking away an element adds or subtracts
its vector.  Two kinds of lanes are summed:

* exact lanes, 8 of 32 bits modulo 2^32: two texts agree in all of them only if their elements do;
* sign lanes, 128 counts of hash bits modulo 2^31: with n elements, 2 * count - n is a sum of random
  signs, whose inner product over the lanes estimates how many elements two texts share.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

ELEMENT_ENDS = r"\n+|(?<=[.!?])\s+"
SIGN_HASHES, EXACT_HASHES = 2, 4
_PAIRS = 32 * SIGN_HASHES  # sums that hold two sign lanes each, 31 bits apart
_LOW = (1 << 31) - 1


def elements(text: Column) -> Column:
    return F.filter(F.split(text, ELEMENT_ENDS, -1), lambda x: F.char_length(x) > 0)


def _lane_sums() -> list[Column]:
    """Sums over the elements in ``unit``: pairs of bit counts, then 32-bit words."""
    sums = [F.count("unit").alias("n")]
    for h in range(SIGN_HASHES):
        hashed = F.col(f"h{h}")
        sums += [F.sum(F.shiftrightunsigned(hashed, j).bitwiseAND(F.lit(1)) + F.shiftleft(F.shiftrightunsigned(hashed, j + 32).bitwiseAND(F.lit(1)), 31)).alias(f"s{32 * h + j}") for j in range(32)]
    for h in range(EXACT_HASHES):
        hashed = F.col(f"h{SIGN_HASHES + h}")
        sums += [F.sum(hashed.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"e{2 * h}"), F.sum(F.shiftrightunsigned(hashed, 32)).alias(f"e{2 * h + 1}")]
    return sums


def fingerprint_sums(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lane sums of each row's text: keys, n, s0.. (sign pairs), e0.. (exact words).  Keys tell rows apart."""
    units = texts.select(*keys, F.explode_outer(elements(F.col(text))).alias("unit"))
    hashes = [F.when(F.col("unit").isNotNull(), F.xxhash64(F.lit(h).cast("long"), "unit")).alias(f"h{h}") for h in range(SIGN_HASHES + EXACT_HASHES)]
    sums = units.select(*keys, "unit", *hashes).groupBy(*keys).agg(*_lane_sums())
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums.columns if c not in keys]
    return sums.select(*keys, *zero)


def updated_sums(sums: DataFrame, keys: list[str], inserted: DataFrame | None = None, deleted: DataFrame | None = None, text: str = "text") -> DataFrame:
    """The lane sums of edited texts without hashing them anew: those of ``sums`` plus the inserted texts' elements, less the deleted ones'.

    ``inserted`` and ``deleted`` have the keys and a text; several a key, and keys that ``sums`` lacks, are allowed.
    Only what was there may be deleted: counts are never below 0."""
    changes = [sums]
    for more, sign in ((inserted, 1), (deleted, -1)):
        if more is not None:
            own = fingerprint_sums(more.select(*keys, text), keys, text)
            changes.append(own.select(*keys, *[(sign * F.col(c)).alias(c) for c in own.columns if c not in keys]))
    both = changes[0]
    for c in changes[1:]:
        both = both.unionByName(c)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.columns if c not in keys])


def fingerprint_text(prefix: str = "") -> Column:
    """The fingerprint as hex: element count, exact words modulo 2^32, sign counts modulo 2^31."""
    name = lambda c: F.col(prefix + c)
    words = [F.lpad(F.lower(F.hex(name(f"e{j}").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for j in range(2 * EXACT_HASHES)]
    pairs = [F.lpad(F.lower(F.hex(name(f"s{j}"))), 16, "0") for j in range(_PAIRS)]
    return F.concat(F.lpad(F.lower(F.hex(name("n"))), 8, "0"), *words, *pairs)


def sign_lanes(prefix: str = "") -> Column:
    """The 128 sums of signs as an array of doubles."""
    name = lambda c: F.col(prefix + c)
    low = [(2 * name(f"s{j}").bitwiseAND(F.lit(_LOW)) - name("n")).cast("double") for j in range(_PAIRS)]
    high = [(2 * F.shiftrightunsigned(name(f"s{j}"), 31) - name("n")).cast("double") for j in range(_PAIRS)]
    return F.array(*low, *high)


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two arrays of sign sums, within 0 and 1; two empty texts are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


_SLOTS = 1 << 20  # numbers of slices within a range of ids


def _ranges(docs: DataFrame, parts: int) -> tuple[Column, DataFrame]:
    """Ranges of (descending doc_id, text hash): the column that numbers them, and (head_id, head_hash, before): each range's
    first row and the range before it, around the end.  Some two rows at most a range, whatever the data.

    An id that several cuts name holds several ranges' rows; these are sliced by their hash, as are the rows without id."""
    quantiles = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")
    found = docs.select("doc_id").agg(quantiles, F.count("*").alias("n"), F.count("doc_id").alias("with_id")).first()
    repeats = Counter(found["q"] or []) if parts > 1 else Counter()
    cuts = sorted(repeats, reverse=True)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    part = F.lit(0)
    if groups:  # two short searches rather than one long one
        below = lambda values: F.aggregate(values, F.lit(0), lambda n, q: n + F.when(F.col("doc_id") < q, 1).otherwise(0))
        coarse = below(F.array(*[F.lit(g[0]) for g in groups]))
        rest = F.array(*[F.array(*[F.lit(q) for q in g[1:]]).cast("array<bigint>") for g in groups])
        inner = F.when(coarse > 0, below(F.element_at(rest, coarse))).otherwise(0)
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.when(coarse > 0, (coarse - 1) * width + 1 + inner).otherwise(0))
    # a named id is the smallest of its range, and rows without id come last: slice 0 is all that stands before them
    hot = [q for q in cuts if repeats[q] > 1]
    slices = F.lit(0)
    if hot:
        slices = F.coalesce(F.try_element_at(F.map_from_arrays(F.array(*[F.lit(q) for q in hot]).cast("array<bigint>"), F.array(*[F.lit(repeats[q] + 1) for q in hot])), F.col("doc_id")), F.lit(0))
    bare = -(-(found["n"] - found["with_id"]) * parts // found["n"]) if found["n"] else 0
    slices = F.when(F.col("doc_id").isNull(), F.lit(min(bare, _SLOTS - 2))).otherwise(slices)
    place = (F.xxhash64("text") / F.lit(2.0**64) + 0.5) * slices  # rises with the hash
    part = part.cast("long") * _SLOTS + F.when(slices > 0, 1 + F.least(F.floor(place), slices - 1)).otherwise(0)
    heads = docs.select("doc_id", part.alias("part"), F.bitwise_not(F.xxhash64("text")).alias("late")).groupBy("part").agg(F.max(F.struct("doc_id", "late")).alias("head"))
    around = Window.orderBy("part")  # a row a range
    before = F.coalesce(F.lag("part").over(around), F.max("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return part, heads.select(F.col("head.doc_id").alias("head_id"), F.bitwise_not("head.late").alias("head_hash"), before.alias("before"))


def with_next_text(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, part, row (numbers rows within a part) and next_text, that of the next row in descending
    doc_id (null last, ties by text hash); after the last the first.  One shuffle of the texts.

    No id holds more than its ranges' rows in one task; only rows that repeat both id and text stay together."""
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, heads = _ranges(docs, parts)
    # each range also gets the row that comes next after it
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), part.alias("part"))
    rows = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct("part", F.lit(0).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))))
    rows = rows.select("doc_id", "text", "hash", F.explode(places).alias("place")).select("doc_id", "text", "hash", "place.part", "place.guest")
    order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), "hash", "text")
    rows = rows.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next_text"))
    return rows.where("guest = 0").drop("guest", "hash")


def document_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty; a text without elements has the zero fingerprint.  The only document of a
    table is its own next.  Repeated rows are neighbours and get a row each.
    """
    rows = with_next_text(documents(docs), parts).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars - n_chars div 2))"), F.expr("left(next_text, int(n_chars div 2))")))
    texts = F.array(*[F.struct(F.lit(i).alias("which"), F.col(c).alias("body")) for i, c in enumerate(("text", "edited", "next_text"))])
    rows = rows.select("part", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(texts).alias("t"))
    keys = ["part", "row", "doc_id", "n_chars", "edited_sha256", "which"]
    # rows stay where the window put them: both aggregations run without another shuffle
    sums = fingerprint_sums(rows.select(*keys[:-1], "t.which", "t.body"), keys, "body")
    one = sums.select(*keys, fingerprint_text().alias("print"), sign_lanes().alias("lanes"))
    of = lambda c, i: F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{c}{i}")
    each = one.groupBy(*keys[:-1]).agg(of("print", 0), of("print", 1), of("lanes", 0), of("lanes", 1), of("lanes", 2))
    return each.select(
        "doc_id", "n_chars", "edited_sha256", F.col("print0").alias("fingerprint"), F.col("print1").alias("edited_fingerprint"),
        likeness(F.col("lanes0"), F.col("lanes1")).alias("near_edited"), likeness(F.col("lanes0"), F.col("lanes2")).alias("near_next"),
    )
