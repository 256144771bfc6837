"""Anchors in texts with their offsets: registered aliases and dates, explicit or relative to the time of publication."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The forms of dates and the terms that count from the day of publication.
FULL_DATE = r"(?<!\d)(20\d{2})(?:年\s*|[-/.])(0?[1-9]|1[0-2])(?:月\s*|[-/.])(0?[1-9]|[12]\d|3[01])日?(?!\d)"
MONTH_DAY = r"(?<![\d年月])(0?[1-9]|1[0-2])月(0?[1-9]|[12]\d|3[01])日(?!\d)"
EVENT_DAY = r"(?<![\d./-])(0?[1-9]|1[0-2])[./](0?[1-9]|[12]\d|3[01])(?![\d./-])"
EVENT_CUES = ("非农", "CPI", "PPI", "FOMC", "议息", "财报", "业绩", "会议")
CUE_REACH = 10
DAYS = {"今天": 0, "今日": 0, "明天": 1, "明日": 1, "昨天": -1, "昨日": -1}
WEEKS = {"上周": -1, "本周": 0, "这周": 0, "下周": 1}
MONTHS = {"上月": -1, "本月": 0, "这个月": 0, "下月": 1}
WEEKDAYS = {"一": 0, "二": 1, "三": 2, "四": 3, "五": 4, "六": 5, "日": 6, "天": 6}
# What a task holds of an Arrow batch as Python objects at a time.
SLICE_ROWS, SLICE_HITS = 64, 10_000


def _any(terms) -> str:
    return "|".join(map(re.escape, terms))


def _day(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _week(published: date, offset: int) -> date:
    return published + timedelta(days=7 * offset - published.weekday())


def _month(published: date, offset: int) -> date:
    years, month = divmod(published.month - 1 + offset, 12)
    return date(published.year + years, month + 1, 1)


def _full(m, text, published):
    return _day(int(m[1]), int(m[2]), int(m[3])), None


def _month_day(m, text, published):
    return _day(published.year, int(m[1]), int(m[2])), None


def _weekday(m, text, published):
    return _week(published, WEEKS[m[1]]) + timedelta(days=WEEKDAYS[m[2]]), None


def _near_day(m, text, published):
    return published + timedelta(days=DAYS[m[0]]), None


def _whole_week(m, text, published):
    return _week(published, WEEKS[m[0]]), _week(published, WEEKS[m[0]] + 1)


def _whole_month(m, text, published):
    return _month(published, MONTHS[m[0]]), _month(published, MONTHS[m[0]] + 1)


def _event_day(m, text, published):
    cued = any(cue in text[m.end() : m.end() + CUE_REACH] for cue in EVENT_CUES)
    return (_day(published.year, int(m[1]), int(m[2])) if cued else None), None


#: (rule, pattern, resolver, confidence) in the order of precedence; all but full dates need a day of publication.
EXPLICIT = (("full_date", re.compile(FULL_DATE), _full, 1.0), ("month_day_from_published_year", re.compile(MONTH_DAY), _month_day, 0.9))
RELATIVE = (
    ("relative_weekday_from_published_at", re.compile(f"({_any(WEEKS)})({_any(WEEKDAYS)})"), _weekday, 0.85),
    ("relative_day_from_published_at", re.compile(_any(DAYS)), _near_day, 0.85),
    ("relative_week_from_published_at", re.compile(_any(WEEKS)), _whole_week, 0.8),
    ("relative_month_from_published_at", re.compile(_any(MONTHS)), _whole_month, 0.8),
    ("numeric_month_day_with_event_cue", re.compile(EVENT_DAY), _event_day, 0.75),
)


def _free(start: int, end: int, taken: list[tuple]) -> bool:
    return not any(start < t[1] and t[0] < end for t in taken)


def _hits(text: str, published: date | None, rules) -> list[tuple]:
    """(start, end, raw, day, end_day, confidence, rule); an earlier rule's span keeps later ones away."""
    out: list[tuple] = []
    for rule, pattern, resolve, confidence in rules:
        if published is None and resolve is not _full:
            continue
        for m in pattern.finditer(text):
            if _free(m.start(), m.end(), out):
                day, until = resolve(m, text, published)
                if day is not None:
                    out.append((m.start(), m.end(), m[0], day, until, confidence, rule))
    return out


def dates_in(text: str | None, published: date | None) -> list[tuple]:
    """Explicit dates, then the relative ones that overlap none of them, by their place."""
    found = _hits(text or "", published, EXPLICIT)
    found += [h for h in _hits(text or "", published, RELATIVE) if _free(h[0], h[1], found)]
    return sorted(found)


def temporal_spans(docs: DataFrame, id_col: str, text_col: str, published_col: str) -> DataFrame:
    """A row a date met in a text: id, start, end (code points), raw, day, end_day (exclusive, of weeks and months), confidence, rule.

    Null texts count as empty; without a day of publication only full dates are found.  The work is within a row, so nothing is shuffled."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *h) for i, t, p in zip(batch["id"], batch["text"], batch["published"]) for h in dates_in(t, None if pd.isna(p) else p)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "raw", "day", "end_day", "confidence", "rule"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(published_col).cast("date").alias("published"))
    return rows.mapInPandas(scan, f"id {kind}, start int, end int, raw string, day date, end_day date, confidence double, rule string").withColumnRenamed("id", id_col)


def _beside(border: str) -> Callable[[str], bool]:
    """Whether a character beside a word keeps it from standing alone: an ASCII letter, or a digit too."""
    return (lambda c: c.isascii() and c.isalpha()) if border == "letters" else (lambda c: c.isascii() and c.isalnum())


def hits_of(keys: Sequence[str], wanted: Sequence[str], alone: set[str], border: str, fold: bool, context: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes the rows of ``alias_hits`` from batches of the keys and ``__text``; no batch it gives is over SLICE_HITS rows."""
    beside, names = _beside(border), [*keys, "alias", "start", "end", *(["before", "after"] if context else [])]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()][: len(names) - len(keys)]
    slice_rows, slice_hits = SLICE_ROWS, SLICE_HITS

    def rows_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*found, strict=True)
        kept = [batch.column(k).take(pa.array(of, pa.int64())) for k in keys]
        return pa.record_batch([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias in wanted:
            automaton.add_word(alias, alias)
        automaton.make_automaton()
        for batch in batches:
            found: list[tuple] = []
            for at in range(0, batch.num_rows, slice_rows):
                for row, text in enumerate(batch.column("__text").slice(at, slice_rows).to_pylist(), at):
                    text = (text or "").lower() if fold else text or ""
                    for last, alias in automaton.iter(text):
                        end = last + 1
                        start = end - len(alias)
                        if alias in alone and (start and beside(text[start - 1]) or end < len(text) and beside(text[end])):
                            continue
                        found.append((row, alias, start, end, text[max(0, start - context) : start], text[end : end + context]))
                        if len(found) == slice_hits:
                            yield rows_of(batch, found)
                            found = []
            if found:
                yield rows_of(batch, found)

    return scan


def alias_hits(docs: DataFrame, keys: Sequence[str], text_col: str, aliases: Sequence[str], border: str = "words", fold: bool = False, context: int = 0) -> DataFrame:
    """A row an occurrence of an alias: the ``keys`` of its text, alias, start, end (code points); overlapping ones too.

    Aliases without a Chinese character stand alone: no ASCII letter or digit beside them (``words``), no letter (``letters``), or
    anywhere (``none``).  ``fold`` compares in lower case, so offsets are those of the text in lower case.  With ``context`` the
    characters before and after come along.  Null texts have no hits; aliases are a curated list without empty ones, and each task
    makes one automaton of it, so a text is read once however many there are.  A task holds the texts of SLICE_ROWS rows and SLICE_HITS
    hits at a time besides its Arrow batch."""
    wanted = sorted({a.lower() if fold else a for a in aliases})
    if "" in wanted:
        raise ValueError("an alias is empty")
    around = ["before", "after"] if context else []
    schema = StructType([docs.schema[k] for k in keys]).add("alias", "string").add("start", "integer").add("end", "integer")
    for c in around:
        schema = schema.add(c, "string")
    if not wanted:
        return docs.sparkSession.createDataFrame([], schema)
    alone = {a for a in wanted if border != "none" and not any("一" <= c <= "鿿" for c in a)}
    scan = hits_of(keys, wanted, alone, border, fold, context)
    return docs.select(*keys, F.col(text_col).alias("__text")).mapInArrow(scan, schema)


def entity_spans(docs: DataFrame, id_col: str, text_col: str, aliases: Sequence[tuple[str, str]]) -> DataFrame:
    """A row an occurrence of an alias and each ticker it stands for: id, alias, ticker, start, end (code points).

    Aliases of ASCII characters stand between word borders (no ASCII letter or digit beside them), Chinese ones anywhere, overlapping ones too."""
    tickers: dict[str, list[str]] = {}
    for alias, ticker in aliases:
        if ticker not in tickers.setdefault(alias, []):
            tickers[alias].append(ticker)
    hits = alias_hits(docs, [id_col], text_col, list(tickers))
    if not tickers:
        return hits.select(id_col, "alias", F.lit("").alias("ticker"), "start", "end")
    known = F.create_map(*[c for alias, of in tickers.items() for c in (F.lit(alias), F.array(*map(F.lit, of)))])
    return hits.select(id_col, "alias", F.explode(known[F.col("alias")]).alias("ticker"), "start", "end")
