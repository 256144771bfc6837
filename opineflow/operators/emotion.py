"""Emotions of paragraphs by a lexicon: what stands shortly before a word turns or weighs it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opineflow.operators.anchoring import alias_hits

# Words that turn an emotion and phrases that only look like them, words that weigh it (the first that stands there counts).
NEGATIONS = ("不", "没", "无", "非", "别", "莫", "未", "勿", "not", "no", "never", "neither", "nor")
NOT_NEGATIONS = {"非": ("非常",), "未": ("未来",), "无": ("无数", "无论", "无所谓")}
WEIGHTS = {
    "非常": 1.5, "极其": 1.8, "特别": 1.5, "相当": 1.3, "很": 1.2, "真的": 1.3, "绝对": 1.8, "肯定": 1.5, "强烈": 1.6, "大幅": 1.5, "超级": 1.7, "very": 1.5, "extremely": 1.8, "highly": 1.6, "strongly": 1.6, "absolutely": 1.8,
    "稍微": 0.7, "有点": 0.7, "可能": 0.8, "或许": 0.6, "大概": 0.7, "似乎": 0.6, "slightly": 0.7, "somewhat": 0.7, "maybe": 0.7,
}
# What a turned emotion becomes (else neutral), and which count for and against.
OPPOSITES = {"joy": "sadness", "sadness": "joy", "trust": "disgust", "disgust": "trust", "fear": "anticipation", "anticipation": "fear", "anger": "trust", "bullish": "bearish", "bearish": "bullish"}
FOR, AGAINST = ("joy", "trust", "bullish", "anticipation", "surprise"), ("fear", "sadness", "disgust", "anger", "bearish")
NEGATION_REACH, WEIGHT_REACH = 10, 15


def _last(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.substring(text, -n, n)).otherwise(text)


def negated(before: Column) -> Column:
    """A word of negation stands in the ten characters before, and no phrase that only looks like it."""
    near, out = _last(before, NEGATION_REACH), F.lit(False)
    for word in NEGATIONS:
        hit = F.contains(near, F.lit(word))
        for phrase in NOT_NEGATIONS.get(word, ()):
            hit = hit & ~F.contains(near, F.lit(phrase))
        out = out | hit
    return out


def weight(before: Column) -> Column:
    """The weight by the fifteen characters before; 1 without a word for it."""
    near, out = _last(before, WEIGHT_REACH), None
    for word, value in WEIGHTS.items():
        hit = F.contains(near, F.lit(word))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(1.0)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, text): the lines with words, in order from 0; null and blank texts have none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select(F.col(id_col).alias("id"), F.posexplode(lines).alias("pos", "text"))


def paragraph_emotions(rows: DataFrame, lexicon: Sequence[tuple[str, str]]) -> DataFrame:
    """Per paragraph (id, pos, text): emotion, score (-1 to 1), intensity, confidence (both up to 1) and words, how many were met.

    ``lexicon`` holds (word, emotion) in order of precedence; a word given twice has its last emotion.  Latin words compare in lower
    case.  A word counts once a paragraph, at its first place: negated it adds 1 to the opposite emotion, else its weight to its own.
    The emotion of the highest sum is the paragraph's, of equal ones the one whose word comes first in the lexicon.  Without a word it
    is neutral.  All words go through one automaton a script; what is gathered is a paragraph's words."""
    order = {w: i for i, w in enumerate(dict(lexicon))}
    latin = {w.lower(): e for w, e in lexicon if w.isascii()}
    place = {w.lower() if w.isascii() else w: i for w, i in order.items()}
    hits = []
    for words, fold in (([w for w in order if not w.isascii()], False), (list(latin), True)):
        if words:
            hits.append(alias_hits(rows, ["id", "pos"], "text", words, border="none", fold=fold, context=WEIGHT_REACH))
    empty = rows.select("id", "pos", F.lit("neutral").alias("emotion"), F.lit(0.0).alias("score"), F.lit(0.0).alias("intensity"), F.lit(0.3).alias("confidence"), F.lit(0).alias("words"))
    if not hits:
        return empty
    each = hits[0].unionByName(hits[1]) if len(hits) > 1 else hits[0]
    first = each.groupBy("id", "pos", "alias").agg(F.min_by("before", "start").alias("before"))
    known = {**dict(lexicon), **latin}
    table = F.create_map(*[F.lit(x) for w in place for x in (w, known[w])])
    ranks = F.create_map(*[F.lit(x) for w, i in place.items() for x in (w, i)])
    opposite = F.coalesce(F.create_map(*[F.lit(x) for kv in OPPOSITES.items() for x in kv])[table[F.col("alias")]], F.lit("neutral"))
    turned = first.select("id", "pos", ranks[F.col("alias")].alias("place"), F.when(negated(F.col("before")), opposite).otherwise(table[F.col("alias")]).alias("emotion"), F.when(negated(F.col("before")), 1.0).otherwise(weight(F.col("before"))).alias("w"))
    sums = turned.groupBy("id", "pos", "emotion").agg(F.round(F.sum("w"), 9).alias("w"), F.count("*").alias("n"), F.min("place").alias("place"))
    total = F.sum("w")
    plus, minus = F.sum(F.when(F.col("emotion").isin(*FOR), F.col("w")).otherwise(0.0)), F.sum(F.when(F.col("emotion").isin(*AGAINST), F.col("w")).otherwise(0.0))
    found = sums.groupBy(F.col("id").alias("__id"), F.col("pos").alias("__pos")).agg(
        F.max_by("emotion", F.struct(F.col("w"), -F.col("place"))).alias("e"), F.round((plus - minus) / total, 6).alias("s"), F.round(F.least(F.lit(1.0), total / 5), 6).alias("i"), F.round(F.least(F.lit(1.0), total / 3), 6).alias("c"), F.sum("n").cast("int").alias("k")
    )
    out = rows.join(found, F.col("id").eqNullSafe(F.col("__id")) & (F.col("pos") == F.col("__pos")), "left")
    filled = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return out.select("id", "pos", filled("e", "neutral").alias("emotion"), filled("s", 0.0).alias("score"), filled("i", 0.0).alias("intensity"), filled("c", 0.3).alias("confidence"), filled("k", 0).alias("words"))
