"""A registry of aliases built from pairs of company names and stock codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opineflow.operators.tickers import normalized

# Codes that are no tickers, marks of Korean names, words that make a name a title.
NO_CODES = ("PRC", "CHINA", "CN", "HK", "US", "USA", "EU", "UK", "GLOBAL", "ASIA", "APAC", "NA", "N/A")
KOREAN = ("三星", "海力士", "Samsung", "Hynix", "现代", "Hyundai", "起亚", "Kia", "LG")
CJK_NOISE = ("指数", "设备", "市场", "板块", "概念", "行业", "消费者", "运价", "中小盘", "基准", "会议", "要点", "展望", "解读", "重申", "预计", "结合", "优化", "打造", "发布", "如何", "追踪", "学会", "协会", "渗透率", "出货量", "研报", "策略", "晨报", "周报")
ASCII_NOISE = ("weekly", "monthly", "daily", "tracker", "benchmark", "rates", "rate", "strategy", "morning", "notes", "note", "update", "preview", "review", "outlook", "transcript", "summit", "index", "attribution", "attributions", "movers", "pulse", "spot")
# Endings of company names, their limits, and what no name holds.
ASCII_SUFFIX = r"[\s,]+(Inc|Inc\.|Corp|Corp\.|Corporation|Co|Co\.|Ltd|Ltd\.|Limited|PLC|Plc|Holdings?|Group)\.?$"
CJK_SUFFIX = "(股份有限公司|有限公司|控股有限|股份|控股|集团|公司)$"
MOST_CHARS, MOST_WORDS = 40, 6
NEVER = "[％%；;。！？!?|:]"
CJK = "[一-鿿]"


def _bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def clean_company_name(name: Column, prefixes: Sequence[str] = (), generic: Sequence[str] = (), themes: Sequence[str] = ()) -> Column:
    """The name as an alias, or null where it is none: null, too short or long, a title, a theme, a phrase.

    Blanks are joined, the first of the ``prefixes`` that leads it and a share class at its end go.  Names with CJK characters must hold
    no noise or ``generic`` term, be none of the ``themes`` and have no hyphen; others are up to six ASCII words, none of them noise."""
    c = F.trim(F.regexp_replace(F.regexp_replace(name, "[_~]", " "), r"[\s\p{Z}]+", " "))
    c = F.trim(F.regexp_replace(c, "^[-&—·. ]+", ""))

    def without_prefix(c: Column) -> Column:
        cut = F.coalesce(*[F.when(F.startswith(c, F.lit(f"{p} ")), F.trim(F.substr(c, F.lit(len(p) + 2)))) for p in prefixes], c)
        return F.trim(F.regexp_replace(cut, r"[\s\-–—]+[AH]$", ""))

    def judged(c: Column) -> Column:
        fits = F.char_length(c).between(2, MOST_CHARS) & ~c.rlike(r"^\p{Nd}") & ~c.rlike(NEVER)
        cjk = ~c.rlike("|".join([*CJK_NOISE, *generic, "-", "—"])) & ~c.isin(list(themes) or [""])
        words = F.split(c, " ")
        plain = c.rlike(r"^[A-Za-z][A-Za-z0-9&.,'()\- ]*$") & (F.size(words) <= MOST_WORDS)
        plain &= ~F.arrays_overlap(F.transform(words, lambda w: F.regexp_replace(F.lower(w), "^[.,]+|[.,]+$", "")), F.array(*[F.lit(w) for w in ASCII_NOISE]))
        return F.when(fits & F.when(c.rlike(CJK), cjk).otherwise(plain), c)

    return _bound(_bound(c, without_prefix), judged)


def without_suffix(name: Column) -> Column:
    """The name without its corporate ending; null where it has none or too little stays."""
    cjk = name.rlike(CJK)
    short = F.when(cjk, F.regexp_replace(name, CJK_SUFFIX, "")).otherwise(F.trim(F.regexp_replace(name, ASCII_SUFFIX, "")))
    return F.when((short != name) & (F.char_length(short) >= F.when(cjk, 2).otherwise(3)), short)


def judged_pairs(pairs: DataFrame, rejected: Sequence[str] = (), **lists: Sequence[str]) -> DataFrame:
    """Distinct (name, code) pairs with symbol, market, clean (the alias or null) and status: code_rejected, korean, bare_alpha or kept.

    Bare letters are kept only where their symbol also has a code of another shape or two clean names.  Null and empty names and codes do not count."""
    p = pairs.where("name <> '' and code <> ''").select("name", "code").distinct().withColumn("code", F.trim("code"))
    raw, code = F.upper("code"), F.col("code")
    bare = code.rlike("^[A-Za-z]+$")
    out = raw.isin(*NO_CODES, *[r.upper() for r in rejected]) | (code == "") | (bare & (F.char_length(code) < 2))
    p = p.select("name", raw.alias("code"), F.when(~out, _bound(code, normalized)).alias("t"), bare.alias("bare"), clean_company_name(F.col("name"), **lists).alias("clean"))
    korean = F.col("code").rlike("^[0-9]{6}$") & F.col("name").rlike("|".join(KOREAN))
    p = p.select("name", "code", "bare", "clean", "t.symbol", "t.market", F.when(F.col("t").isNull(), "code_rejected").when(korean, "korean").alias("why"))
    each = p.where("why is null").groupBy(F.col("symbol").alias("of")).agg(F.bool_and("bare").alias("letters"), F.coalesce(F.min("clean") != F.max("clean"), F.lit(False)).alias("several"))
    p = p.join(each, F.when(F.col("why").isNull(), F.col("symbol")) == F.col("of"), "left")
    return p.select("name", "code", "symbol", "market", "clean", F.coalesce("why", F.when(F.col("letters") & ~F.col("several"), "bare_alpha"), F.lit("kept")).alias("status"))


def company_registry(judged: DataFrame, known: DataFrame, rejected: Sequence[str] = (), ambiguous: Sequence[str] = ()) -> DataFrame:
    """Aliases of the kept pairs: alias, symbol, market, status (kept, conflict or known) and requires_context.

    Aliases are the symbol, its codes, the digits of its code, its clean names with and without their endings.  One that several symbols
    share is a conflict (its symbol null); those in ``known`` (alias) stand there already; ``ambiguous`` ones need the gates of context."""
    base = F.regexp_extract("symbol", r"^([0-9]+)\.[^.]+$", 1)
    forms = F.array("symbol", "code", F.nullif(base, F.lit("")), "clean", without_suffix(F.col("clean")))
    a = judged.where("status = 'kept'").select("symbol", "market", F.explode(F.array_distinct(forms)).alias("alias")).withColumn("alias", F.trim("alias"))
    alias, ascii_only = F.col("alias"), F.col("alias").rlike(r"^[\x00-\x7F]*$")
    barred = F.upper(alias).isin(*NO_CODES, *[r.upper() for r in rejected]) | alias.rlike("^[0-9]{1,3}$") | alias.rlike("^(19|20)[0-9]{2}$")
    a = a.where((F.char_length(alias) >= 2) & ~(ascii_only & barred))
    a = a.groupBy("alias").agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("other"), F.min_by("market", "symbol").alias("market"))
    k = known.select(F.col("alias").alias("there")).distinct()
    one = F.col("symbol") == F.col("other")
    status = F.when(~one, "conflict").when(F.col("there").isNotNull(), "known").otherwise("kept")
    a = a.join(k, F.col("alias") == F.col("there"), "left")
    return a.select("alias", F.when(one, F.col("symbol")).alias("symbol"), F.when(one, F.col("market")).alias("market"), status.alias("status"), ((status == "kept") & alias.isin(*ambiguous)).alias("requires_context"))
