"""The corpus operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import read
from .dart_minhash import near_duplicate_classes
from .exact_sort import content_sort_dedup
from .line_chunks import ORACLE_SQL as LINE_SQL
from .line_chunks import line_chunk_digest
from .merkle import ORACLE_SQL as MERKLE_SQL
from .merkle import tampered_proofs
from .multiset_hash import document_fingerprints
from .packing import power_of_two_pack
from .secret_ledger import ORACLE_SQL as SECRET_SQL
from .secret_ledger import document_secrets
from .substring import repeated_paragraphs
from .token_counts import token_counts
from .toxicity_fm import fit_toxicity, held_out, score_toxicity
from .warc import warc_round_trip
from .whitening import whitened_embeddings


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(read(spark, sf_dir, "documents"))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_secrets(read(spark, sf_dir, "documents"))


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return power_of_two_pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(read(spark, sf_dir, "documents"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read(spark, sf_dir, "documents"))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read(spark, sf_dir, "documents"))


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunk_digest(read(spark, sf_dir, "documents"))


def op11_radix_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_proofs(read(spark, sf_dir, "documents"))


def op12_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(read(spark, sf_dir, "embeddings"))


def op13_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()]
    return {f.__name__: f for f in own}


_WARC_SQL = """with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
    f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
    select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
        case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
        case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from f"""

_SORT_SQL = r"""with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
    from d window w as (partition by norm order by n desc, doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_ledger": SECRET_SQL, "op4_warc_segments": _WARC_SQL, "op5_content_sort_dedup": _SORT_SQL, "op10_line_chunk_dedup": LINE_SQL, "op11_radix_merkle": MERKLE_SQL}
