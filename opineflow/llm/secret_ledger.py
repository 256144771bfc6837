r"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a path is content-addressed; a blob that several paths or versions share
is scanned once per rule version, and a ledger of (blob, rule, rule version) makes later runs scan only
unseen pairs: a changed rule is run over all blobs, the others over new blobs.  A rule's version is a
digest of the rule itself.  Findings hang on blobs and are joined back to all paths.

Spans are found without offsets from the regex engine: matches and the pieces between them alternate,
so a match starts where the lengths of all pieces and matches before it add up to (code points).
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, key128


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # its least length; shorter matches are dropped after matching

    @property
    def version(self) -> str:
        return sha256(f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}".encode()).hexdigest()[:16]


#: Base rules, leftmost and non-overlapping per kind; their order breaks ties of start.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),  # a shorter match leaves nothing longer in its run
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Formats that public services document for their credentials.
ADDED_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def _bound(value: Column, f) -> Column:
    """f(value), the value worked out once however often f's own lambdas name it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chunks(values: Column) -> Column:
    """An array as an array of about as many arrays as each has elements.

    A list that grows in a fold is copied at each step.  Folding within chunks and then over chunks copies but the square root."""
    n = F.size(values)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    last = F.greatest(F.lit(0), F.floor((n - 1) / width).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * width + 1, width))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in ``text``, in order."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    # lengths of piece, match, piece, match ...; their running sums are the borders
    sizes = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda p, m: F.struct(F.char_length(p).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size")))
    run = lambda at, of: F.struct(at.alias("at"), F.array().cast(of).alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(rule.kind).alias("kind")))).alias("out"),
    )
    within = lambda acc, chunk: _bound(
        F.aggregate(chunk, run(acc["at"], f"array<{_SPAN}>"), step), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))
    )
    spans = _bound(sizes, lambda s: F.flatten(F.aggregate(_chunks(s), run(F.lit(0).cast("long"), f"array<array<{_SPAN}>>"), within, lambda acc: acc["out"])))
    enough = F.zip_with(spans, values, lambda s, v: F.when(F.char_length(v) >= rule.least, s))
    found = F.filter(enough, lambda s: s.isNotNull())
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _asked(rules: Sequence[Rule]) -> Column:
    """Whether a row of the ledger or the findings is of one of these rules, as it is now."""
    return F.concat_ws(":", "rule", "rule_version").isin([f"{r.kind}:{r.version}" for r in rules])


def scan_incremental(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of these rules (blob_id, rule, rule_version, spans), earlier ones included, and new ledger rows (blob_id, rule, rule_version).

    ``versions`` has a ``text`` per path and version.  Pairs of a blob and a rule's version that the ledger
    has are not scanned.  Append new ledger rows and findings to the tables kept; repeats of both do no harm.
    Findings of other rules and of older versions stay out.
    """
    blobs = versions.select(key128(F.col("text")).alias("blob_id"), "text").dropDuplicates(["blob_id"])
    seen = F.array().cast("array<string>")
    if ledger is not None:
        known = ledger.where(_asked(rules)).groupBy(F.col("blob_id").alias("known")).agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        blobs = blobs.join(known, F.col("blob_id") == F.col("known"), "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        seen = F.coalesce("seen", seen)
    scans = [F.when(~F.array_contains(seen, rule.kind), F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("rule_version"), _spans(F.col("text"), rule, rank).alias("spans"))) for rank, rule in enumerate(rules)]
    scanned = blobs.select("blob_id", F.filter(F.array(*scans), lambda x: x.isNotNull()).alias("scans"))
    hits = scanned.select("blob_id", F.explode(F.filter("scans", lambda x: F.size(x["spans"]) > 0)).alias("s")).select("blob_id", "s.*")
    if findings is not None:
        hits = findings.where(_asked(rules)).unionByName(hits).dropDuplicates(["blob_id", "rule"])
    return hits, scanned.select("blob_id", F.explode("scans").alias("s")).select("blob_id", "s.rule", "s.rule_version")


def spans_of_blobs(findings: DataFrame, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """blob_id and all its spans, by start and then in the order of ``rules``."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)])
    ranked = findings.select("blob_id", F.transform("spans", lambda s: s.withField("rank", rank[F.col("rule")])).alias("spans"))
    return ranked.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a row a rule


def findings_by_path(paths: DataFrame, blob: Column, found: DataFrame, salts: int = 16) -> DataFrame:
    """``row`` (each one of ``paths``, whole) and ``found``, the columns of its blob's row in the table ``found``.

    ``blob`` makes a row's blob_id.  Salted, as one blob may be a third of all paths."""
    spread = found.select(F.col("blob_id").alias("found_id"), F.struct([c for c in found.columns if c != "blob_id"]).alias("found"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("nth"))
    rows = paths.select(F.struct("*").alias("row"), blob.alias("blob_id"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    return rows.join(spread, (F.col("blob_id") == F.col("found_id")) & (F.col("salt") == F.col("nth")), "left").select("row", "found")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """``docs``, all rows and columns, with each found span (overlapping ones as one) replaced by ``[kind]``; null texts stay null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    findings, _ = scan_incremental(docs.select(text.alias("text")), rules=rules)
    rows = findings_by_path(docs, key128(text), spans_of_blobs(findings, rules)).select("row", F.col("found.spans").alias("spans"), F.col("row").getField(text_col).alias("body"))
    body = F.col("body")

    def redacted(acc: Column, chunk: Column) -> Column:
        """The text up to the chunk's last span: its spans are cut out of that piece alone."""
        end = F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda s: s["end"])))
        piece = F.substring(body, acc["at"].cast("int") + 1, (end - acc["at"]).cast("int"))
        step = lambda p, a, s: F.when(
            s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(p, (a["at"] - acc["at"]).cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
        done = _bound(piece, lambda p: F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), lambda a, s: step(p, a, s)))
        return _bound(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(_chunks(F.col("spans")), none, redacted, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"].cast("int") + 1, F.char_length(body))))
    return rows.select([F.when(F.col("spans").isNull(), F.col("body")).otherwise(clean).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def document_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> DataFrame:
    """Per row: doc_id, n_<kind> of the base rules, base_sha256, spans (kind:start:end, comma-joined).

    Null texts count as empty and have no spans.  Repeated rows are reported each.
    """
    docs = documents(docs)
    findings, _ = scan_incremental(docs.select("text"), rules=rules)
    base = len(BASE_RULES)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {k})) as bigint)").alias(f"n_{rule.kind}") for k, rule in enumerate(BASE_RULES)]
    found = spans_of_blobs(findings, rules).select("blob_id", *counts, listed(F.filter("spans", lambda s: s["rank"] < base)).alias("base"), listed(F.col("spans")).alias("spans"))
    out = findings_by_path(docs.select("doc_id", "text"), key128(F.col("text")), found)
    return out.select(
        "row.doc_id", *[F.coalesce(F.col(f"found.n_{r.kind}"), F.lit(0)).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(F.coalesce("found.base", F.lit("")), 256).alias("base_sha256"), F.coalesce("found.spans", F.lit("")).alias("spans"),
    )


#: DuckDB; the letters' cases are spelt out, as its (?i) also folds letters outside ASCII.
def _sql(kinds: Sequence[Rule] = BASE_RULES + ADDED_RULES) -> str:
    def pattern(rule: Rule) -> str:
        out = rule.pattern
        if "(?i:" in out:
            inner = out[out.index("(?i:") + 4 : out.index("))")]
            out = out.replace(f"(?i:{inner})", "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in inner))
        return out.replace("'", "''")

    parts = []
    for rank, rule in enumerate(kinds):
        p = pattern(rule)
        parts.append(f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, i as nth,
            coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start, length(m[i]) as size
            from (select doc_id, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', {rule.group}) as v, regexp_split_to_array(text, '{p}') as b, unnest(range(1, length(m) + 1)) as i from d)
            where length(v[i]) >= {rule.least}""")
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents), s as ({' union all '.join(parts)}),
        g as (select doc_id, cast(count(*) filter (rank = 0) as bigint) as n_assign, cast(count(*) filter (rank = 1) as bigint) as n_access, cast(count(*) filter (rank = 2) as bigint) as n_hex,
            coalesce(string_agg(kind || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(start + size as bigint) as varchar), ',' order by start, rank) filter (rank < {len(BASE_RULES)}), '') as base,
            string_agg(kind || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(start + size as bigint) as varchar), ',' order by start, rank) as spans from s group by doc_id)
        select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (doc_id)"""


ORACLE_SQL = _sql()
