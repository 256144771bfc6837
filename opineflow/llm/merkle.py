"""Merkle manifest of a dataset: a radix-ranked trie of the documents of each group.

A document's rank in its group comes from histograms of the digits of its id, from the highest digit
down: the rows with smaller digits are counted, and only buckets with many rows are counted again by
their next digits.  So no table is ever sorted as a whole, and no task holds more than a small bucket.
The rank, written in the base of the fanout, is the place in the trie.  Nodes are reduced by their
longest prefixes: a block of ``fanout ** k`` neighbours becomes one node at a time, so that a trie of
``N`` leaves takes ``log(N) / k`` shuffles.  On the way back every block hands its path to its members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, release

FANOUT = 2
BUCKET_ROWS = 128  # a bucket of more rows is split by its next digits
RADIX_BITS = 6  # the histograms' digits; sums run over 2 ** RADIX_BITS siblings
BLOCK_LEAVES = 64
_SIGN = 1 << 63
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields in turn, each ``-`` if null, else its bytes in UTF-8, a colon and itself."""
    parts = []
    for c in (f.cast("string") for f in fields):
        parts.append(F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*parts), 256)


def _prefix_sums(counts: DataFrame, bits: int) -> DataFrame:
    """(g, base, d, n) to the same with ``start``, the rows of the bucket's siblings with smaller d; digit by digit."""
    shifts = [0, *range(RADIX_BITS, bits, RADIX_BITS)]
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = None
    for shift in reversed(shifts):
        level = counts if shift == 0 else counts.groupBy("g", "base", F.shiftright("d", shift).alias("d")).agg(F.sum("n").alias("n"))
        if sums is None:
            sums = level.withColumn("start", before("g", "base"))
            continue
        level = level.withColumn("up", F.shiftright("d", RADIX_BITS)).withColumn("within", before("g", "base", "up"))
        above = sums.select("g", "base", F.col("d").alias("up"), F.col("start").alias("above"))
        sums = level.join(above, ["g", "base", "up"]).select("g", "base", "d", "n", (F.col("above") + F.col("within")).alias("start"))
    return sums


def radix_ranks(rows: DataFrame, words: list[str], order: list[Column], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """``rows``, a written table, with ``rank``: from 0 within ``g`` by the ``words`` in turn, then ``order``; and the tables to release.

    ``words`` are long columns without nulls, the last one different in every row, so that any group of
    equal rows is split in the end.  Ranks are exact and without gaps, however the words are spread.
    """
    scratch: list[DataFrame] = []
    done: list[DataFrame] = []
    sort = [F.col(w) for w in words[:-1]] + order + [F.col(words[-1])]

    def ranked(part: DataFrame, *by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*sort))
        return part.withColumn("rank", (F.col("start") + place - 1).cast("long")).select(*rows.columns, "rank")

    most = rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    rest = rows.withColumn("base", F.lit(0).cast("long"))
    if most <= bucket_rows:
        return ranked(rest.withColumn("start", F.col("base")), "g"), scratch
    for word in words:
        low, high = rest.agg(F.min(word), F.max(word)).first()
        bits = ((low + _SIGN) ^ (high + _SIGN)).bit_length()  # the digits above are the same in all rows
        while bits and most > bucket_rows:
            width = min(bits, (most // bucket_rows).bit_length() + 1)
            bits -= width
            digit = F.shiftrightunsigned(F.col(word).bitwiseXOR(F.lit(-_SIGN)), bits).bitwiseAND(F.lit((1 << width) - 1))
            here = rest.withColumn("d", digit)
            counts = materialize(here.groupBy("g", "base", "d").agg(F.count("*").alias("n")), "digit-counts")
            starts = _prefix_sums(counts, width).select(F.struct("g", "base", "d").alias("bucket"), (F.col("base") + F.col("start")).alias("start"), "n")
            starts = materialize(starts, "digit-starts")
            scratch += [counts, starts]
            most = starts.agg(F.max("n")).first()[0]
            met = join_groups(here.withColumn("of", F.struct("g", "base", "d")), starts, "of", "bucket")
            if most <= bucket_rows:
                done.append(ranked(met, "of"))
                break
            met = materialize(met.drop("bucket"), "digit-buckets")
            scratch.append(met)
            done.append(ranked(met.where(F.col("n") <= bucket_rows), "of"))
            rest = met.where(F.col("n") > bucket_rows).select(*rows.columns, F.col("start").alias("base"))
        if most <= bucket_rows:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, scratch


def _levels(fanout: int, depth: int) -> str:
    """How many levels a block of a group of ``m`` nodes goes up: to the one node that remains, or through the whole block."""
    return " + ".join(f"cast(m > {fanout**i} as int)" for i in range(depth))


@dataclass
class Trie:
    """``stages``: written tables of (g, m, block, members, levels), lowest first; ``top``: (g, digest)."""

    stages: list[DataFrame]
    top: DataFrame
    fanout: int
    depth: int


def build(leaves: DataFrame, fanout: int, depth: int) -> Trie:
    """The trie over (g, m, rank, leaf, ...), m being the rows of g: blocks of ``fanout ** depth`` neighbours, stage by stage."""
    run, stages, nodes = fanout**depth, [], leaves
    most = nodes.agg(F.max("m")).first()[0] or 0
    up = f"transform(sequence(0, (size(element_at(acc, -1)) + {fanout - 1}) div {fanout} - 1), i -> sha2(array_join(slice(element_at(acc, -1), cast(i * {fanout} + 1 as int), {fanout}), ''), 256))"
    levels = f"aggregate(if(up = 0, cast(array() as array<int>), sequence(1, up)), array(transform(members, x -> x.leaf)), (acc, l) -> concat(acc, array({up})))"
    while True:
        extra = [c for c in nodes.columns if c not in ("g", "m", "rank")]
        members = F.sort_array(F.collect_list(F.struct("rank", *extra))).alias("members")
        blocks = nodes.groupBy("g", "m", F.expr(f"rank div {run}").alias("block")).agg(members)
        blocks = blocks.withColumn("up", F.expr(_levels(fanout, depth))).withColumn("levels", F.expr(levels)).drop("up")
        stages.append(materialize(blocks, f"trie-{len(stages)}"))
        top = stages[-1].select("g", F.expr(f"(m + {run - 1}) div {run}").alias("m"), F.col("block").alias("rank"), F.expr("element_at(levels, -1)[0]").alias("leaf"))
        if most <= run:
            return Trie(stages, top.select("g", F.col("leaf").alias("digest")), fanout, depth)
        most, nodes = (most + run - 1) // run, top


def paths(trie: Trie, above: DataFrame, carry: list[str]) -> DataFrame:
    """The leaves with ``path``; ``above`` holds (g, path) of each group and the columns ``carry``, handed down.

    A path is one entry a level, from the leaf up: ``at``, its place in its run, and the run's other digests."""
    f = trie.fanout
    index = f"(cast(j as int) div cast(pow({f}, l) as int))"
    at = f"cast({index} % {f} as int)"
    others = f"concat(slice(levels[l], cast({index} - {at} + 1 as int), {at}), slice(levels[l], cast({index} + 2 as int), {f - 1} - {at}))"
    own = f"if(size(levels) = 1, cast(array() as array<struct<at: int, siblings: array<string>>>), transform(sequence(0, size(levels) - 2), l -> struct({at} as at, {others} as siblings)))"
    above = above.withColumn("block", F.lit(0).cast("long"))
    for stage in reversed(trie.stages):
        met = stage.join(above.select("g", "block", F.col("path").alias("upper"), *carry), ["g", "block"])
        found = f"transform(members, (x, j) -> struct(x as x, concat({own}, upper) as path))"
        met = met.select("g", "m", *carry, F.explode(F.expr(found)).alias("found")).select("g", "m", *carry, "found.x.*", "found.path")
        above = met.withColumnRenamed("rank", "block")
    return above.withColumnRenamed("block", "rank")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf's up."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda p: p.siblings)), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give: the verifier's side, no tables needed."""

    def up(acc: Column, p: Column) -> Column:
        n = F.size(p.siblings)
        left, right = F.slice(p.siblings, F.lit(1), p["at"]), F.slice(p.siblings, p["at"] + 1, n - p["at"])
        return F.sha2(F.concat(F.array_join(left, ""), acc, F.array_join(right, "")), 256)

    return F.aggregate(path, leaf, up)


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, also: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS, block_leaves: int = BLOCK_LEAVES
) -> DataFrame:
    """One row per input row: doc_id, grp, leaf, rank, size, subroot, root, path (and ``also``, over the columns of ``docs``).

    Leaves ascend by id within their group, nulls last; rows that share an id ascend by their leaf.  Rows that are the same in all
    fields have the same leaf, each its own place.  Groups ascend by UTF-8 bytes, the null group first; an empty group value is not
    the null one.  Null and empty fields differ in the leaf.  Other columns of ``docs``, whatever their names, have no part in it.
    An empty table has no root and gives no rows.
    """
    spark, also = docs.sparkSession, also or {}
    depth = 1
    while fanout ** (depth + 1) <= block_leaves:
        depth += 1
    chosen = [F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).cast("string").alias("grp"), leaf_digest([F.col(c) for c in fields]).alias("leaf"), F.monotonically_increasing_id().alias("rid")]
    leaves = materialize(docs.select(*chosen, *(c.alias(f"__{name}") for name, c in also.items())), "leaves")
    # groups, ranked by their bytes, seven a word
    sizes = materialize(leaves.groupBy("grp").agg(F.count("*").alias("m")).withColumn("uid", F.monotonically_increasing_id()), "groups")
    groups, longest = sizes.agg(F.count("*"), F.max(F.octet_length("grp"))).first()
    hexed = F.hex(F.col("grp").cast("binary"))
    words = {"named": F.col("grp").isNotNull().cast("long")}
    for i in range(((longest or 0) + 6) // 7):
        words[f"bytes{i}"] = F.coalesce(F.conv(F.rpad(F.substring(hexed, 14 * i + 1, 14), 14, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))
    ordered = materialize(sizes.withColumns(words).withColumn("g", F.lit(0).cast("long")), "group-words")
    ranked, scratch = radix_ranks(ordered, [*words, "uid"], [F.col("grp").cast("binary")], bucket_rows)
    ranked = materialize(ranked.select(F.col("grp").alias("of"), F.col("rank").alias("g"), "m"), "group-ranks")
    # documents, ranked within their groups
    placed = leaves.join(ranked, F.col("grp").eqNullSafe(F.col("of"))).drop("of")
    words = {"no_id": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long")), "leading": F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")}
    placed = materialize(placed.withColumns(words), "placed")
    place, more = radix_ranks(placed, [*words, "rid"], [F.col("leaf")], bucket_rows)
    trie = build(place.select("g", "m", "rank", "leaf", "doc_id", "grp", *(f"__{name}" for name in also)), fanout, depth)
    over = build(trie.top.select(F.lit(0).cast("long").alias("g"), F.lit(groups).cast("long").alias("m"), F.col("g").alias("rank"), F.col("digest").alias("leaf")), fanout, depth)
    root = (over.top.first() or [None, None])[1]
    release(leaves, sizes, ordered, ranked, placed, *scratch, *more)
    none = F.expr("cast(array() as array<struct<at: int, siblings: array<string>>>)")
    subroots = paths(over, spark.range(1).select(F.col("id").alias("g"), none.alias("path")), [])
    subroots = subroots.select(F.col("rank").alias("g"), F.col("leaf").alias("subroot"), "path")
    out = paths(trie, subroots, ["subroot"])
    return out.select("doc_id", "grp", "leaf", "rank", F.col("m").alias("size"), "subroot", F.lit(root).cast("string").alias("root"), "path", *(F.col(f"__{name}").alias(name) for name in also))


def tampered_proofs(docs: DataFrame, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 7 divides the CRC-32 of the decimal doc_id, the leaf that is folded has 1 added to n_chars; a null n_chars and the rows
    without an id stay as they are, so these verify.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = merkle_manifest(docs, fanout=fanout, also={"changed": F.when(hit, changed)}, bucket_rows=bucket_rows, block_leaves=block_leaves)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _reduced(name: str, first: str, by: str) -> str:
    """A recursive table that halves the nodes of each ``by`` level by level."""
    return f"""{name} as ({first} union all
        select {by}, l + 1, i // {FANOUT}, (m + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' order by i)) from {name} where m > 1 group by {by}, l, i // {FANOUT}, m)"""


def _path(leaves: str, nodes: str, join: str) -> str:
    """For each of ``leaves`` its siblings, level by level, with their place in the run."""
    return f"""select a.k, b.l, b.i % {FANOUT} as side, b.i, (a.i // cast(pow({FANOUT}, b.l) as bigint)) % {FANOUT} as own, b.h from {leaves} a join {nodes} b on {join}
        and b.m > 1 and b.i // {FANOUT} = a.i // cast(pow({FANOUT}, b.l + 1) as bigint) and b.i <> a.i // cast(pow({FANOUT}, b.l) as bigint)"""


_FIELD = "case when {0} is null then '-' else octet_length(encode(cast({0} as varchar))) || ':' || {0} end"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
#: crc32 is not a function of DuckDB: eight steps a byte of the id's digits, as shifts of an unsigned number.
_CRC = """list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ord(c)::ubigint)),
        lambda a, b: list_reduce([xor(a, b), 1::ubigint, 1::ubigint, 1::ubigint, 1::ubigint, 1::ubigint, 1::ubigint, 1::ubigint, 1::ubigint], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end))"""
ORACLE_SQL = f"""with recursive d as materialized (select row_number() over () as k, doc_id, lang, {_LEAF} as leaf,
        case when xor({_CRC}, 4294967295::ubigint) % 7 = 0 then {_LEAF.replace("n_chars", "(n_chars + 1)")} end as changed from documents),
    r as materialized (select *, row_number() over (partition by lang order by doc_id nulls last, leaf, k) - 1 as i, count(*) over (partition by lang) as m from d),
    g as materialized (select lang, row_number() over (order by lang is not null, encode(lang)) - 1 as g, count(*) over () as n from (select distinct lang from d)),
    x as materialized (select r.k, r.i, r.m, r.leaf, g.g from r join g on r.lang is not distinct from g.lang),
    {_reduced("t", "select g, 0 as l, i, m, leaf as h from x", "g")},
    s as materialized (select t.g as k, t.g as i, g.n as m, t.h from t join g using (g) where t.m = 1),
    {_reduced("u", "select 0 as z, 0 as l, i, m, h from s", "z")},
    levels as (select max(l) as top from t),
    own as ({_path("x", "t", "a.g = b.g")}),
    upper as ({_path("s", "u", "true")}),
    steps as (select k, l, side, i, own, h from own union all select x.k, upper.l + levels.top, upper.side, upper.i, upper.own, upper.h from x join upper on x.g = upper.k, levels),
    depths as (select x.k, coalesce(max(t.l), 0) as low from x join t on x.g = t.g group by x.k),
    high as (select max(l) as high from u),
    proof as materialized (select k, string_agg(h, '' order by l, i) as sides from steps group by k),
    per as materialized (select k, l, coalesce(string_agg(h, '' order by i) filter (side < own), '') as lft, coalesce(string_agg(h, '' order by i) filter (side > own), '') as rgt from steps group by k, l),
    f as (select d.k, 0 as l, coalesce(d.changed, d.leaf) as h from d
        union all select f.k, f.l + 1, case when f.l < depths.low or f.l >= levels.top and f.l < levels.top + high.high then sha256(coalesce(per.lft, '') || f.h || coalesce(per.rgt, '')) else f.h end
        from f join depths using (k) left join per on per.k = f.k and per.l = f.l, levels, high where f.l < levels.top + high.high),
    folded as (select f.k, f.h from f, levels, high where f.l = levels.top + high.high)
    select d.doc_id, d.leaf, s.h as subroot, u.h as root, sha256(coalesce(proof.sides, '')) as proof_sha256, folded.h as folded_root, folded.h = u.h as verified
    from d join x using (k) join s on s.i = x.g join folded using (k) left join proof using (k), (select h from u where m = 1) u"""
