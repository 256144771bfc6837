"""Context gates of aliases: numbers and common words are securities only where what stands around them says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opineflow.operators.anchoring import alias_hits

# What makes a number part of a telephone number.
PHONE_BEFORE = r"[0-9][\s\-–—.]$"
PHONE_PLUS = r"[+＋]\(?[0-9]{1,4}\)?[\s\-–—.]"
PHONE_AFTER = r"^[\s\-–—.][0-9]{4}"
PHONE_WORDS = ("tel", "fax", "phone", "电话", "传真", "转分机")
PHONE_REACH, PLUS_REACH, TITLE_REACH, TERM_REACH, LEAD_REACH = 24, 16, 40, 12, 12
# What makes a number or a word a security.
OPEN, CLOSE = "（([【", "）)]】"
EXCHANGE = r"(?i)^\.(HK|SH|SZ|SS|TW|T|US|N|O|OQ)([^A-Za-z0-9]|$)"
TERMINAL = r"^ (HK|CH|US|TT|JP|KS)([^A-Za-z0-9]|$)"
TERMS = ("代码", "股", "证券", "收盘", "开盘", "涨", "跌", "买入", "卖出", "增持", "减持", "持有", "评级", "目标价", "上市", "公司")
LEAD = r"(?i)(ticker|symbol|股票代码|代码)\s*[:：]?\s*$"
BRACKETED = r"^\s+(US|UN|UW|HK|CH|TT|JP|GR|LN|SS|SZ)\s*[）)\]】]"
EQUITY = r"^ (US|UN|UW|HK|CH|TT|JP|GR|LN) Equity([^A-Za-z0-9]|$)"


def _any(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def _last(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.substring(text, -n, n)).otherwise(text)


def _first(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def _like(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?U)" + pattern))


def _edge(text: Column, chars: str, last: bool) -> Column:
    """The neighbouring character is one of ``chars``; an empty context has none."""
    edge = _last(text, 1) if last else _first(text, 1)
    return edge.isin(*chars)


def number_gate(before: Column, after: Column, titles: Sequence[str] = ()) -> Column:
    """A bare number stands for a security: no telephone number and no title of a newsletter, but a bracket, a venue or a term of trade nearby.

    ``before`` and ``after`` are 40 characters of its context."""
    near = F.lower(F.concat(_last(before, PHONE_REACH), _first(after, PHONE_REACH)))
    phone = _like(_last(before, PHONE_REACH), PHONE_BEFORE) | _like(_last(before, PLUS_REACH), PHONE_PLUS) | _like(after, PHONE_AFTER) | _any(near, PHONE_WORDS)
    title = _any(F.concat(_last(before, TITLE_REACH), _first(after, TITLE_REACH)), titles)
    venue = _like(_first(after, 6), EXCHANGE) | _like(_first(after, 8), TERMINAL)
    traded = _any(F.concat(_last(before, TERM_REACH), _first(after, TERM_REACH)), TERMS)
    return ~phone & ~title & (_edge(before, OPEN, True) | _edge(after, CLOSE, False) | venue | traded)


def word_gate(before: Column, after: Column) -> Column:
    """A common word stands for a security: in brackets of its own, with a venue, or announced as a code."""
    near = _first(after, 16)
    bracketed = _edge(before, OPEN, True) & (_edge(after, CLOSE, False) | _like(near, BRACKETED))
    return bracketed | _like(_first(after, 6), EXCHANGE) | _like(_last(before, LEAD_REACH), LEAD) | _like(near, EQUITY)


def gated_spans(docs: DataFrame, id_col: str, text_col: str, registry: Sequence[tuple[str, str, bool]], titles: Sequence[str] = (), rejected: bool = False) -> DataFrame:
    """A row an occurrence of a registered alias that its context lets through: id, alias, ticker, start, end, gate.

    ``registry`` holds (alias, ticker, ambiguous).  Aliases of digits alone go through the gate of numbers, ambiguous ones through that
    of words, those that are both through both; the others pass.  ``rejected`` gives the occurrences kept out instead.  Null texts
    count as empty.  An alias of several tickers gives a row each.  The gates are expressions over the context that the automaton cuts
    out, so a text is read once and never shuffled."""
    tickers: dict[str, list[str]] = {}
    for alias, ticker, _ in registry:
        if ticker not in tickers.setdefault(alias, []):
            tickers[alias].append(ticker)
    unsure = [alias for alias, _, ambiguous in registry if ambiguous]
    hits = alias_hits(docs, [id_col], text_col, list(tickers), context=TITLE_REACH)
    number, word = F.rlike("alias", F.lit("^[0-9]+$")), F.col("alias").isin(unsure)
    passes = (~number | number_gate(F.col("before"), F.col("after"), titles)) & (~word | word_gate(F.col("before"), F.col("after")))
    gate = F.when(number & word, "both").when(number, "number").when(word, "word").otherwise("open")
    known = F.create_map(*[c for alias, of in tickers.items() for c in (F.lit(alias), F.array(*map(F.lit, of)))])
    return hits.where(~passes if rejected else passes).select(id_col, "alias", F.explode(known[F.col("alias")]).alias("ticker"), "start", "end", gate.alias("gate"))
