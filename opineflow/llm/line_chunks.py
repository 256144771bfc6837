"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of ``window`` neighbouring lines ends a chunk wherever it is 0 modulo
``every``; borders depend on nearby lines alone, so a passage that is shifted by inserted lines is cut
the same way.  Chunks of two lines or more that occur more than once in the corpus are removed from
all documents but the first (smallest doc_id, then text hash, then place).

Chunks alone leave the ends of a shared passage, and all of a short one.  With ``passages``, as in the
query and the pipeline, every run of whole lines of over ``PASSAGE_WORDS`` words that stands in the
corpus before goes in full as well.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, join_groups, key128, materialize, turn_to

WINDOW, EVERY = 2, 4
PASSAGE_WORDS = 50  # a passage has more
_BASE, _MOD = 1_000_003, 2_147_483_647


def _line_hash(line):
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunks(docs: DataFrame, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """Per chunk: doc_id, text_key, nth, first_line, n_lines, chunk (its lines joined by line feeds).

    A text without line feeds is one line; an empty text is one empty line.
    """
    rows = docs.select("doc_id", key128(F.col("text")).alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    rows = rows.withColumn("hashes", F.transform("lines", _line_hash))
    rolling = f"""transform(sequence(0, size(hashes) - 1), i ->
        aggregate(slice(hashes, greatest(i - {window - 1}, 0) + 1, least(i + 1, {window})), 0L, (s, h) -> (s * {_BASE}L + h) % {_MOD}L))"""
    rows = rows.withColumn("ends", F.expr(f"filter(transform({rolling}, (r, i) -> if(r % {every} = 0 or i = size(lines) - 1, i + 1, null)), e -> e is not null)"))
    # lines and ends are named twice, so that the optimizer doesn't move their making into the loop
    first = "if(k = 0 or size(ends) = 1, 0, ends[k - 1])"
    spans = f"transform(ends, (e, k) -> struct(k as nth, {first} as first_line, e - {first} as n_lines, if(size(lines) = 1, lines[0], array_join(slice(lines, {first} + 1, e - {first}), '\n')) as chunk))"
    return rows.select("doc_id", "text_key", F.explode(F.expr(spans)).alias("c")).select("doc_id", "text_key", "c.*")


def repeated_chunks(docs: DataFrame, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """The chunks to remove: doc_id, text_key, first_line, n_lines.

    Chunks are grouped by their whole text, so equality is byte for byte; what leaves the grouping is a
    digest and the first occurrence.  Copies are counted before the shuffle, however many there are.
    """
    pieces = chunks(docs, window, every).where("n_lines >= 2")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "nth")
    groups = pieces.groupBy("chunk").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    groups = materialize(groups.select(key128(F.col("chunk")).alias("common"), "first", "n"), "common-chunks")
    found = pieces.select("doc_id", "text_key", "nth", "first_line", "n_lines", key128(F.col("chunk")).alias("chunk_key"), place.alias("place"))
    found = join_groups(found, groups, "chunk_key", "common")
    return found.where(F.col("place") != F.col("first")).select("doc_id", "text_key", "first_line", "n_lines")


def passage_spans(lines: list[bytes]) -> set[tuple[int, int]]:
    """(start, end) of the shortest run of over PASSAGE_WORDS words from each line on, and up to each line.

    A passage that two texts share holds, for each of its lines, the run up to that line or the run from its own
    first line on, so the runs that repeat make up exactly the passages that repeat.  Runs begin and end with words,
    so blank lines beside a run stay, and a run has few lines but blank ones.
    """
    before = [0, *accumulate(len(x.split()) for x in lines)]
    spans = set()
    for i in range(len(lines)):
        if before[i] == before[i + 1]:
            continue
        end = bisect_right(before, before[i] + PASSAGE_WORDS)
        if end <= len(lines):
            spans.add((i, end))
        start = bisect_left(before, before[i + 1] - PASSAGE_WORDS) - 1
        if start >= 0:
            spans.add((start, i + 1))
    return spans


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn_to("line_chunks")
    names = ["doc_id", "text_key", "first_line", "n_lines", "passage"]
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            of, first, count, keys = [], [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                lines = text.split(b"\n")
                begins = [0, *accumulate(len(x) + 1 for x in lines)]
                for a, z in passage_spans(lines):
                    of.append(k)
                    first.append(a)
                    count.append(z - a)
                    keys.append(sha256(text[begins[a] : begins[z] - 1]).digest()[:16])
            of = pa.array(of, pa.int32())
            yield pa.record_batch([part.column("doc_id").take(of), part.column("text_key").take(of), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(keys, pa.binary())], names=names)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """The runs of over PASSAGE_WORDS words to remove: doc_id, text_key, first_line, n_lines; they overlap.

    A line's first occurrence never goes, as no run that holds it stands before.
    """
    rows = docs.select("doc_id", key128(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    spans = rows.mapInArrow(_passages, "doc_id long, text_key binary, first_line int, n_lines int, passage binary")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "first_line")
    groups = spans.groupBy("passage").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    groups = materialize(groups.select(F.col("passage").alias("common"), "first", "n"), "common-passages")
    return join_groups(spans, groups, "passage", "common").where(place != F.col("first")).select("doc_id", "text_key", "first_line", "n_lines")


def _without_chunks(docs: DataFrame, id_col: str, text_col: str, window: int, every: int, passages: bool) -> DataFrame:
    """row (the whole one), clean (its text without the repeats), n_lines (before), chunks and lines (how many went)."""
    plain = documents(docs, id_col, text_col)
    # text_key differs within a group of copies, so at most one group of lines a document is gathered
    spans = repeated_chunks(plain, window, every)
    if passages:
        spans = spans.unionByName(repeated_passages(plain))
    cut = spans.distinct().groupBy(F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key")).agg(F.collect_list(F.struct("first_line", "n_lines")).alias("cut"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), key128(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"))
    rows = rows.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    gone = "array_distinct(flatten(transform(cut, c -> sequence(c.first_line, c.first_line + c.n_lines - 1))))"
    rows = rows.withColumn("gone", F.expr(f"if(cut is null, null, {gone})")).withColumn("split", F.split("text", "\n", -1))
    # split is named twice, so that the optimizer doesn't move its making into the loop
    kept = F.expr("array_join(transform(array_except(sequence(0, size(split) - 1), gone), i -> if(size(split) = 1, split[0], split[i])), '\n')")
    return rows.select("row", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("clean"), F.size("split").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).alias("chunks"), F.coalesce(F.size("gone"), F.lit(0)).alias("lines"))


def remove_line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, every: int = EVERY, passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of its texts; with ``passages`` repeated passages go too, in full.

    Every row stays, as its text may still be wanted when empty; null texts stay null.  Repeated rows are one
    document: both keep its first occurrences.  All other columns are left alone, whatever their names.
    """
    out = _without_chunks(docs, id_col, text_col, window, every, passages)
    return out.select([F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_chunk_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines (before), removed_chunks (chunks and runs that went), removed_lines, clean_sha256 (of the text that is left)."""
    out = _without_chunks(documents(docs), "doc_id", "text", WINDOW, EVERY, True)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("chunks").cast("long").alias("removed_chunks"),
        F.col("lines").cast("long").alias("removed_lines"), F.sha2("clean", 256).alias("clean_sha256"),
    )


ORACLE_SQL = rf"""with d as materialized (select doc_id, coalesce(text, '') as text, sha256(coalesce(text, ''))[1:32] as tk, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    l as (select doc_id, tk, unnest(lines) as line, unnest(range(0, length(lines))) as i, length(lines) as n_lines from d),
    h as (select *, ('0x' || md5(line)[1:7])::bigint as h, len(regexp_extract_all(line, '[^ 	-
]+')) as words from l),
    r as materialized (select *, (coalesce(lag(h) over w, 0) * {_BASE} + h) % {_MOD} as roll, sum(words) over w as after, sum(length(line) + 1) over w - 1 as stop from h window w as (partition by doc_id, tk order by i)),
    e as (select *, coalesce(sum(case when i + 1 = n_lines or roll % {EVERY} = 0 then 1 else 0 end) over (partition by doc_id, tk order by i rows between unbounded preceding and 1 preceding), 0) as nth from r),
    c as (select doc_id, tk, nth, min(i) as first_line, count(*) as n, string_agg(line, chr(10) order by i) as chunk from e group by doc_id, tk, nth),
    m as (select *, count(*) over (partition by chunk) as copies, row_number() over (partition by chunk order by doc_id, tk, nth) as k from c where n >= 2),
    w as materialized (select doc_id, tk, i, cast(after as bigint) as after, cast(after - words as bigint) as before, stop, stop - length(line) as start from r where words > 0),
    ps as (select a.doc_id, a.tk, a.i, z.i - a.i + 1 as n, a.start, z.stop from w a asof join w z on a.doc_id = z.doc_id and a.tk = z.tk and a.before + {PASSAGE_WORDS} < z.after
        union select z.doc_id, z.tk, a.i, z.i - a.i + 1, a.start, z.stop from w z asof join w a on a.doc_id = z.doc_id and a.tk = z.tk and z.after - {PASSAGE_WORDS} > a.before),
    pk as (select ps.*, sha256(substr(text, cast(start + 1 as bigint), cast(stop - start as bigint))) as passage from ps join d using (doc_id, tk)),
    pm as (select *, count(*) over (partition by passage) as copies, row_number() over (partition by passage order by doc_id, tk, i) as k from pk),
    x as (select doc_id, tk, first_line, n from m where copies > 1 and k > 1 union select doc_id, tk, i, n from pm where copies > 1 and k > 1),
    gone as (select distinct doc_id, tk, unnest(range(first_line, first_line + n)) as i from x),
    k as (select r.doc_id, r.tk, string_agg(r.line, chr(10) order by r.i) as rest from r anti join gone using (doc_id, tk, i) group by r.doc_id, r.tk),
    s as (select doc_id, tk, count(*) as chunks from x group by doc_id, tk), t as (select doc_id, tk, count(*) as gone from gone group by doc_id, tk)
    select d.doc_id, cast(length(d.lines) as bigint) as n_lines, cast(coalesce(s.chunks, 0) as bigint) as removed_chunks, cast(coalesce(t.gone, 0) as bigint) as removed_lines, sha256(coalesce(k.rest, '')) as clean_sha256
    from d left join k using (doc_id, tk) left join s using (doc_id, tk) left join t using (doc_id, tk)"""
