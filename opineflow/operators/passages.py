"""Markup, rhythm, lexicon scores, signals and search over texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (pattern, replacement) in order; groups are written \1 and the patterns are common to Java and RE2.
MARKDOWN_STEPS = (
    (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)<br[^>]*>", "\n"),
    (r"(?is)<h1[^>]*>(.*?)</h1>", "\n# \\1\n"),
    (r"(?is)<h2[^>]*>(.*?)</h2>", "\n## \\1\n"),
    (r"(?is)<h3[^>]*>(.*?)</h3>", "\n### \\1\n"),
    (r"(?is)<(?:strong|b)>(.*?)</(?:strong|b)>", "**\\1**"),
    (r"(?is)<(?:em|i)>(.*?)</(?:em|i)>", "*\\1*"),
    (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "[\\2](\\1)"),
    (r'(?is)<img [^>]*src="([^"]*)"[^>]*>', "![](\\1)"),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)</?(?:p|div|ul|ol|tr|table)(?: [^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n\n\n+", "\n\n"),
    (r"^[ \t\r\n]+|[ \t\r\n]+$", ""),
)
PLAIN_STEPS = (
    (r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "),
    (r"<[^>]*>", " "),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
    (r"[ \t\r\n]+", " "),
    ("^ | $", ""),
)


def rewrite(text: Column, steps: Sequence[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to.replace("\\", "$"))
    return text


def text_rhythm(docs: DataFrame) -> DataFrame:
    """Sentences, their mean length and its population variance, the share of neighbours that differ by over 30 %, pauses per character."""
    lengths = F.filter(F.transform(F.split("text", "[.!?]", -1), lambda s: F.char_length(F.trim(s))), lambda n: n > 0)
    d = docs.select("doc_id", F.char_length("text").alias("chars"), (F.char_length("text") - F.char_length(F.regexp_replace("text", "[,;:]", ""))).alias("pauses"), lengths.alias("l"))
    d = d.withColumn("n", F.size("l")).withColumn("s", F.expr("aggregate(l, 0L, (a, x) -> a + x)")).withColumn("q", F.expr("aggregate(l, 0L, (a, x) -> a + cast(x as bigint) * x)"))
    turns = F.expr("size(filter(sequence(1, greatest(n - 1, 1)), i -> n > 1 and (l[i] < 0.7D * l[i - 1] or l[i] > 1.3D * l[i - 1])))")
    mean = F.try_divide("s", "n")
    return d.select(
        "doc_id", F.col("n").alias("sentences"), F.round(mean, 3).alias("mean_chars"), F.round(F.try_divide("q", "n") - mean * mean, 2).alias("variance"),
        F.round(F.try_divide(turns, F.col("n") - 1), 4).alias("alternation"), F.round(F.try_divide("pauses", "chars"), 4).alias("pause_density"),
    )


def lexicon_score(text: Column, positive: Sequence[str], negative: Sequence[str], negator: str) -> Column:
    """(for - against) / all lexicon words present; a word after the negator counts for the other side; null without any."""
    low = F.lower(text)

    def present(words: Sequence[str], negated: bool) -> Column:
        hits = [(F.contains(low, F.lit(f"{negator} {w}")) == negated) & F.contains(low, F.lit(w)) for w in words]
        return sum((h.cast("int") for h in hits), F.lit(0))

    plus, minus = present(positive, False) + present(negative, True), present(negative, False) + present(positive, True)
    return F.round(F.try_divide(plus - minus, plus + minus), 4)


def sentiment_rules(docs: DataFrame, positive: Sequence[str], negative: Sequence[str], negator: str) -> DataFrame:
    s = docs.select("doc_id", lexicon_score(F.col("text"), positive, negative, negator).alias("score"))
    return s.withColumn("class", F.when(F.col("score") > 0.15, "bullish").when(F.col("score") < -0.15, "bearish").otherwise("neutral"))


def passage_signals(docs: DataFrame, words: Sequence[str], short: int, long: int) -> DataFrame:
    """Occurrences of signal words, numbers, and the class: noise (too short or long), signal or plain."""
    low = F.lower("text")
    hits = sum((F.floor((F.char_length("text") - F.char_length(F.replace(low, F.lit(w), F.lit("")))) / len(w)) for w in words), F.lit(0)).cast("int")
    d = docs.select("doc_id", F.char_length("text").alias("n"), hits.alias("signals"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"))
    kind = F.when((F.col("n") < short) | (F.col("n") > long), "noise").when(F.col("signals") >= 5, "signal").otherwise("plain")
    return d.select("doc_id", "signals", "numbers", kind.alias("kind"))


def emotion_arcs(scores: DataFrame) -> DataFrame:
    """Of (id, pos, score): local peaks with ends, sign changes, rhythm = 1 - variance of absolute steps, within 0 and 1."""
    order = Window.partitionBy("id").orderBy("pos")
    s = scores.select("id", "score", F.lag("score").over(order).alias("b"), F.lead("score").over(order).alias("a"))
    peak = (F.col("b").isNotNull() | F.col("a").isNotNull()) & (F.col("score") > F.coalesce("b", F.lit(-9.0))) & (F.col("score") > F.coalesce("a", F.lit(-9.0)))
    step = F.abs(F.col("score") - F.col("b"))
    rhythm = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.var_pop(step), F.lit(0.0)))), 4)
    return s.groupBy("id").agg(F.count("*").alias("n"), F.count_if(peak).alias("peaks"), F.count_if(F.signum("score") * F.signum("b") < 0).alias("sign_changes"), rhythm.alias("rhythm"))


def search(docs: DataFrame, terms: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best texts by BM25.  Postings hold the searched terms alone; corpus size and mean length are scalars of one pass."""
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("w"))
    corpus = words.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("w")).alias("mean"))
    hits = words.select("doc_id", F.size("w").alias("len"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), (F.size("w") - F.size(F.array_remove("w", t))).alias("tf")) for t in terms])).alias("h"))
    hits = hits.select("doc_id", "len", "h.term", "h.tf").where("tf > 0")
    spread = hits.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("df"))
    idf = F.log(1 + (corpus.select("n").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / corpus.select("mean").scalar()))
    ranked = hits.join(spread, F.col("term") == F.col("t")).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    return ranked.orderBy(F.desc("score"), "doc_id").limit(k)


def related_content(mentions: DataFrame, doc_id: int) -> DataFrame:
    """Other texts that mention what this one does, with the number of shared tickers."""
    own = mentions.where(F.col("doc_id") == doc_id).select(F.col("ticker").alias("__t")).distinct()
    return mentions.join(own, F.col("ticker") == F.col("__t")).where(F.col("doc_id") != doc_id).groupBy("doc_id").agg(F.count("*").alias("shared"))


def coverage(blocks: DataFrame, mentions: DataFrame, by: str, worst: int) -> DataFrame:
    """Per group: blocks, those with a mention, the rate; ``worst`` marks the groups of the lowest rates."""
    hit = mentions.select(F.col("doc_id").alias("__d")).distinct().withColumn("__hit", F.lit(1))
    g = blocks.join(hit, F.col("doc_id") == F.col("__d"), "left").groupBy(by).agg(F.count("*").alias("blocks"), F.count("__hit").alias("hits"))
    g = g.withColumn("rate", F.round(F.col("hits") / F.col("blocks"), 4))
    return g.withColumn("worst", F.row_number().over(Window.orderBy("rate", by)) <= worst)  # a row a group


def overlap(items: DataFrame, training: DataFrame) -> DataFrame:
    """Evaluation items (item_id, text) with ``leaked``: whether a training text is the same but for blanks at its ends; null texts never are."""
    seen = training.select(F.trim("text").alias("__t")).where("__t is not null").distinct().withColumn("__seen", F.lit(True))
    return items.join(seen, F.trim("text") == F.col("__t"), "left").select(*items.columns, F.coalesce("__seen", F.lit(False)).alias("leaked"))
