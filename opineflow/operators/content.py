"""Content operators: cleaning, hashing, blocks, passages, mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BORDER_KEYS = 32  # keys a slice from which a stratum's borders are taken


def content_hash(text: str = "text"):
    """16 hex digits of SHA-1 over the text without white space."""
    return F.substring(F.sha1(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "").cast("binary")), 1, 16)


def hash_dedupe(docs: DataFrame) -> DataFrame:
    """The first document of each content hash and how many share it; minima are taken before the shuffle."""
    return docs.groupBy(content_hash().alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def split_blocks(docs: DataFrame, short: int = 40) -> DataFrame:
    """Non-blank lines with their order and type: heading (short, no full stop), list item, paragraph."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw")).withColumn("body", F.trim("raw")).where("body != ''")
    kind = F.when(F.rlike("body", F.lit(r"^([-*]|[0-9]+[.)]) ")), "list").when((F.char_length("body") < short) & ~F.endswith("body", F.lit(".")), "heading").otherwise("paragraph")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.select("doc_id", (F.row_number().over(order) - 1).alias("order_index"), kind.alias("block_type"), F.char_length("body").alias("n_chars"))


def topic_runs(messages: DataFrame) -> DataFrame:
    """Consecutive messages of one speaker merged: run number, speaker, turns, characters."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("turned", F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1))
    m = m.withColumn("run", F.sum("turned").over(order).cast("int"))
    return m.groupBy("conv_id", "run").agg(F.min_by("role", "turn").alias("role"), F.min("turn").alias("first_turn"), F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))


def text_style(docs: DataFrame) -> DataFrame:
    """Per text: words, distinct words, redundancy, questions, exclamations, digits."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", words.alias("words"))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    count = lambda p: F.regexp_count("text", F.lit(p))
    return d.select("doc_id", n.alias("words"), distinct.alias("distinct_words"), F.round(1 - F.try_divide(distinct, n), 4).alias("redundancy"), count(r"\?").alias("questions"), count("!").alias("exclamations"), count("[0-9]").alias("digits"))


def entity_mentions(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Mentions of registered aliases (alias, ticker) among a text's words: counts per text and ticker.

    The registry is a curated list and is broadcast, so that words never move: a frequent one would be one task's.  Mentions are counted
    by alias first, without a sort; only these counts are shuffled."""
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("alias")).where("alias != ''")
    each = words.join(F.broadcast(registry), "alias").groupBy("doc_id", "ticker", "alias").agg(F.count("*").alias("n"))
    return each.groupBy("doc_id", "ticker").agg(F.sum("n").alias("mentions"), F.max(F.struct(F.char_length("alias").alias("chars"), "alias"))["alias"].alias("longest_alias"))


def entity_index(mentions: DataFrame) -> DataFrame:
    """Ticker to the number of texts and mentions, and its first text."""
    return mentions.groupBy("ticker").agg(F.count("*").alias("texts"), F.sum("mentions").alias("mentions"), F.min("doc_id").alias("first_doc"))


def stratified_select(rows: DataFrame, strata: str, score: str, key: str, quota: int) -> DataFrame:
    """The best ``quota`` rows of each stratum, ties by key."""
    best = Window.partitionBy(strata).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= quota)


def key_borders(rows: DataFrame, strata: str, key: str, size: str, slices: int) -> DataFrame:
    """Per stratum of ``size`` rows ``__cuts``, slices - 1 of its keys in order, the same ones however the rows are dealt.

    They stand at even steps among the keys whose hash is small, some BORDER_KEYS a slice.  A stratum none of whose keys is chosen has no row."""
    few = F.pmod(F.xxhash64(key), F.lit(1 << 31)) / (1 << 31) < BORDER_KEYS * slices / F.col(size)
    keys = rows.where(few).groupBy(strata).agg(F.sort_array(F.collect_set(key)).alias("__keys"))
    step = lambda i: F.get("__keys", F.floor(i * F.size("__keys") / slices).cast("int"))
    return keys.select(strata, F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), step).alias("__cuts"))


def stratified_sample(rows: DataFrame, strata: str, key: str, rate: float, least: int, slices: int = 64) -> DataFrame:
    """min(n, max(least, ceil(n * rate))) rows of each stratum, first by its numeric key.

    Borders cut a stratum by key into slices and the slices are counted, so that rows are put in order within a slice, never within
    a whole stratum; slices beyond the quota are not put in order at all.  The borders are some of the keys, chosen by their hash: they
    are worked out more than once and must be the same each time, which approximate percentiles are not."""
    sizes = rows.groupBy(F.col(strata).alias("__of")).agg(F.count("*").alias("n"))
    sized = rows.join(sizes, F.col(strata).eqNullSafe(F.col("__of")))
    cuts = key_borders(sized, "__of", key, "n", slices).withColumnRenamed("__of", "__at")
    cut = sized.join(cuts, F.col("__of").eqNullSafe(F.col("__at")), "left").drop("__at")
    cut = cut.withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(key))), F.lit(0))).drop("__cuts")
    counts = cut.groupBy(F.col("__of").alias("__in"), F.col("__slice").alias("__nth")).agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__in").orderBy("__nth")) - F.col("__n"))
    quota = F.least("n", F.greatest(F.lit(least), F.ceil(F.col("n") * rate)))
    near = cut.join(counts, F.col("__of").eqNullSafe(F.col("__in")) & (F.col("__slice") == F.col("__nth"))).where(F.col("__before") < quota)
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__of", "__slice").orderBy(key))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= quota).select(*rows.columns, "n", "rank")
