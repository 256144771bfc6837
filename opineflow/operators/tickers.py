"""Ticker dialects, rating words, numbers in texts and ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix -> (canonical suffix, market) of the venues with rules of their own; "" means the bare code.
SUFFIXES = {"US": ("", "US"), "N": ("", "US"), "NYSE": ("", "US"), "O": ("", "US"), "OQ": ("", "US"), "NSDQ": ("", "US"), "SS": ("SH", "CN"), "SH": ("SH", "CN"), "SZ": ("SZ", "CN"), "HK": ("HK", "HK"), "TW": ("TW", "TW"), "T": ("T", "JP")}
# Other venues whose codes are letters, and those whose codes are letters or digits.
LETTER_VENUES = {"L": ("L", "UK"), "LN": ("L", "UK"), "PA": ("PA", "FR"), "FP": ("PA", "FR"), "AS": ("AS", "NL"), "DE": ("DE", "DE"), "SW": ("SW", "CH"), "MI": ("MI", "IT"), "MC": ("MC", "ES"), "ST": ("ST", "SE"), "HE": ("HE", "FI"), "AX": ("AX", "AU"), "TO": ("TO", "CA")}
MIXED_VENUES = {"KS": ("KS", "KR"), "KQ": ("KQ", "KR"), "SI": ("SI", "SG"), "KL": ("KL", "MY"), "NS": ("NS", "IN"), "BO": ("BO", "IN")}
# First two digits of a bare six-digit code -> its suffix.
SEGMENTS = {"60": "SH", "68": "SH", "00": "SZ", "30": "SZ"}
# Shapes of a code before each canonical suffix.
SHAPES = {"": "[A-Z]{1,5}", "HK": "[0-9]{1,5}", "SH": "[0-9]{6}", "SZ": "[0-9]{6}", "TW": "[0-9]{4,6}", "T": "[0-9]{4}"}
# Rating words.
BULLISH = ("buy", "overweight", "outperform", "ow", "add", "positive", "accumulate", "surperformance", "买入", "增持")
NEUTRAL = ("neutral", "hold", "equal weight", "ew", "market perform", "sector perform", "in line", "持有", "中性")
BEARISH = ("sell", "underweight", "underperform", "reduce", "卖出", "减持")
STRONG = ("buy", "sell", "outperform", "underperform", "surperformance", "买入", "卖出")
TILT = ("overweight", "underweight", "ow", "add", "reduce", "positive", "accumulate", "增持", "减持")


def normalized(raw: Column) -> Column:
    """struct(symbol, market) of one stock code in a broker's or vendor's dialect; null where it can't be told for sure."""
    code = F.upper(F.trim(raw))
    base, suffix = F.regexp_extract(code, r"^(.+)\.([^.]+)$", 1), F.regexp_extract(code, r"^(.+)\.([^.]+)$", 2)
    out = lambda symbol, market: F.struct(symbol.alias("symbol"), F.lit(market).alias("market"))
    rule = None
    for given, (canonical, market) in SUFFIXES.items():
        symbol = base if not canonical else F.concat(F.when(F.length(base) < 4, F.lpad(base, 4, "0")).otherwise(base), F.lit(".HK")) if canonical == "HK" else F.concat(base, F.lit(f".{canonical}"))
        hit = (suffix == given) & base.rlike(f"^{SHAPES[canonical]}$")
        rule = F.when(hit, out(symbol, market)) if rule is None else rule.when(hit, out(symbol, market))
    for venues, shape in ((LETTER_VENUES, "^[A-Z]{1,8}$"), (MIXED_VENUES, "^[A-Z0-9]{1,8}$")):
        for given, (canonical, market) in venues.items():
            rule = rule.when((suffix == given) & base.rlike(shape), out(F.concat(base, F.lit(f".{canonical}")), market))
    for digits, canonical in SEGMENTS.items():
        rule = rule.when(code.rlike(f"^{digits}[0-9]{{4}}$"), out(F.concat(code, F.lit(f".{canonical}")), "CN"))
    return rule.when(code.rlike("^[A-Z]{1,5}$"), out(code, "US"))


def split_ticker(ticker: Column) -> Column:
    """struct(head, suffix): digits without leading zeros; a leading dollar sign goes."""
    t = F.ltrim(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lit("$"))
    head, suffix = F.trim(F.substring_index(t, ".", 1)), F.when(F.instr(t, ".") > 0, F.trim(F.regexp_extract(t, r"^[^.]*\.(.*)$", 1))).otherwise("")
    bare = F.when(head.rlike("^0+$"), F.lit("0")).when(head.rlike("^[0-9]+$"), F.ltrim(head, F.lit("0"))).otherwise(head)
    return F.struct(bare.alias("head"), suffix.alias("suffix"))


def tickers_match(a: Column, b: Column) -> Column:
    """The same security: equal codes, and no two different venues."""
    x, y = split_ticker(a), split_ticker(b)
    return (x["head"] != "") & (x["head"] == y["head"]) & ((x["suffix"] == "") | (y["suffix"] == "") | (x["suffix"] == y["suffix"]))


def ticker_in_text(ticker: Column, text: Column) -> Column:
    """The ticker, or its code of two signs and more, stands in the text; a leading dollar sign doesn't count, an empty ticker never does."""
    raw, big = F.ltrim(F.upper(F.trim(F.coalesce(ticker, F.lit("")))), F.lit("$")), F.upper(F.coalesce(text, F.lit("")))
    base = F.substring_index(raw, ".", 1)
    return (raw != "") & (F.contains(big, raw) | ((F.length(base) >= 2) & F.contains(big, base)))


def number_in_text(number: Column, text: Column) -> Column:
    """A number stands in the text in one of its usual spellings."""
    whole = F.when(number == F.floor(number), number.cast("long").cast("string"))
    short = F.regexp_replace(F.format_string("%.2f", number), r"\.?0+$", "")
    return F.exists(F.array(whole, F.concat(whole, F.lit(".0")), F.when(number.cast("string").rlike(r"^[0-9.\-]+$"), number.cast("string")), short), lambda s: F.coalesce(F.contains(text, s), F.lit(False)))


def rating_token(raw: Column) -> Column:
    """Lower case, hyphens and underscores as blanks, single blanks; empty is null."""
    token = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), "[-_]", " "), r"\s+", " "))
    return F.when(token != "", token)


def rating_direction(raw: Column) -> Column:
    token = rating_token(raw)
    return F.when(token.isin(*BULLISH), "bullish").when(token.isin(*NEUTRAL), "neutral").when(token.isin(*BEARISH), "bearish")


def rating_conviction(raw: Column) -> Column:
    token = rating_token(raw)
    return F.when(token.isin(*STRONG), 0.7).when(token.isin(*TILT), 0.6).when(token.isin(*NEUTRAL), 0.4)


def horizon_of_months(months: Column) -> Column:
    return F.when(months <= 2, "short_term").when(months <= 6, "medium_term").otherwise("long_term")


def market_of(symbol: Column) -> Column:
    """Market by suffix; six digits are mainland shares, anything else is American; no symbol, no market."""
    up = F.upper(symbol)
    return F.when(up.isNull() | (up == ""), None).when(up.endswith(".HK"), "HK").when(up.rlike(r"\.(SZ|SS)$|^[0-9]{6}$"), "CN").otherwise("US")


def currency_of(symbol: Column) -> Column:
    return F.when(market_of(symbol) == "HK", "HKD").when(market_of(symbol) == "CN", "CNY").otherwise("USD")


def stable_id(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """prefix and the first digits of the SHA-256 of the parts, joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, digits))


def window_suffix(period: Column) -> Column:
    """struct(days, truncated) of ``[window=Nd]`` or ``[window=Nd truncated]`` at the end; null without one."""
    days = F.regexp_extract(period, r"\[window=([0-9]+)d( truncated)?\]\s*$", 1)
    return F.when(days != "", F.struct(days.cast("int").alias("days"), (F.regexp_extract(period, r"\[window=([0-9]+)d( truncated)?\]\s*$", 2) != "").alias("truncated")))


def is_json_object(text: Column) -> Column:
    """The text is one JSON object and nothing else.

    Spark's parser leaves what follows a value unread, so the text is parsed as the first of two elements of a list: what follows the
    object would stand between it and the closing mark, which then isn't the second and last."""
    mark = "end of the text, 7c1e5b"
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{mark}"]')))
    at = lambda path, kind: F.try_variant_get(parsed, path, kind)
    whole = (at("$[1]", "string") == mark) & at("$[2]", "variant").isNull() & F.schema_of_variant(at("$[0]", "variant")).startswith("OBJECT")
    return F.coalesce(whole, F.lit(False))


def unfenced_json(raw: Column) -> Column:
    """The JSON object of a model's answer, without a code fence around it; null if it doesn't parse or more than an object stands there."""
    body = F.trim(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    return F.when(is_json_object(body), body)
