"""WARC: write pages as archives with revisits, read archives back with segment reassembly.

Writing goes through Spark's text sink: one row per record, CRLF as the line separator, so the
files are WARC/1.1 under gzip, made by committed tasks.  HTTP payloads are chunk-framed, and chunk borders
are placed so that the reader's record separator never occurs in a block; the reader can then
split archives anywhere.  Records over ``segment_bytes`` continue in segments of their own.

Reading groups continuation records by origin identifier, orders them by segment number, checks the
total length and decodes the chunked framing.  A group is the segments of one record, never more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_path

VERSION = "WARC/1.1"
_SEPARATOR = f"{VERSION}\r\n"  # no part of it begins it again, so readers can resume anywhere
_EPOCH = "1970-01-01T00:00:00Z"
_RECORD = "value string"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _whole_characters(block: bytes, at: int) -> int:
    """The last border of a character up to ``at``: the sink takes strings."""
    while 0 < at < len(block) and block[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunk_frame(payload: bytes, chunk_bytes: int) -> bytes:
    """HTTP chunked framing; a chunk ends inside each occurrence of the record separator, and never within a character."""
    mark, out, at = _SEPARATOR.encode(), [], 0
    while at < len(payload):
        end = min(at + chunk_bytes, len(payload))
        if (found := payload.find(mark, at, min(end + len(mark), len(payload)))) >= 0:
            end = min(end, found + 5)
        end = _whole_characters(payload, end)
        out.append(b"%x\r\n%b\r\n" % (end - at, payload[at:end]))
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def unchunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = line + 2 + size
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[line + 2 : at])
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return f"{VERSION}\r\n{head}\r\n{block.decode('utf-8')}\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 100, segment_bytes: int = 16384, chunk_bytes: int = 8192, salts: int = 16) -> None:
    """Write one logical record per row; null html is an empty payload.

    Of equal payloads of ``least_revisit`` bytes or more, the row with the smallest id (null last) is
    the response, as are rows that repeat its id; all others are revisits that refer to it.
    """
    url = F.col(url_col) if url_col in pages.columns else F.lit(None)
    columns = [F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x20\x7F]", ""), F.lit(VERSION), F.lit(VERSION.replace("/", "%2F"))).alias("url")]
    rows = pages.select(*columns, F.monotonically_increasing_id().alias("row_id"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id")).alias("first")
    copied = rows.where(F.octet_length("html") >= least_revisit).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1")
    # salted on both sides, as one payload may be a third of all pages
    copied = copied.select(F.col("digest").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("same_salt"))
    rows = rows.join(copied, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("same_salt")), "left")
    rows = rows.select("page_id", "row_id", "url", "html", "digest", F.col("first.page_id").alias("ref_page"), F.col("same").isNotNull().alias("copied"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    name = lambda page, r=r: f"urn:page:{'' if page is None else page}:{r['digest'][:32]}"
                    me, payload = f"<{name(r['page_id'])}:{r['row_id']}>", r["html"].encode()
                    head = [("WARC-Record-ID", me), ("WARC-Date", _EPOCH), ("WARC-Target-URI", r["url"] or "urn:none"), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http;msgtype=response")]
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                    if r["copied"] and r["ref_page"] != r["page_id"]:
                        out.append(_record([("WARC-Type", "revisit"), *head, ("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<{name(r['ref_page'])}>")], http))
                        continue
                    block = http + chunk_frame(payload, chunk_bytes)
                    cuts = [0]
                    while len(block) - cuts[-1] > segment_bytes:
                        cuts.append(_whole_characters(block, cuts[-1] + segment_bytes))
                    parts = [block[a:b] for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True)]
                    for i, part in enumerate(parts):
                        if len(parts) == 1:
                            segment = [("WARC-Type", "response"), *head]
                        elif i == 0:
                            segment = [("WARC-Type", "response"), *head, ("WARC-Segment-Number", 1)]
                        else:
                            segment = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{i + 1}>"), ("WARC-Date", _EPOCH), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", i + 1)]
                            segment += [("WARC-Segment-Total-Length", len(block))] * (i == len(parts) - 1)
                        out.append(_record(segment, part))
                yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    rows.mapInArrow(records, _RECORD).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_records(spark, path: str) -> DataFrame:
    """The archives' records: type, record_id, origin_id, segment, total, refers_to, digest, length, block.

    A block whose length differs from its Content-Length fails the read rather than losing bytes.
    """
    raw = spark.read.option("lineSep", _SEPARATOR).text(path).where("value != ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    raw = raw.select(head.alias("head"), F.expr("substring(value, char_length(substring_index(value, '\r\n\r\n', 1)) + 5)").alias("block"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)\r?$", 1), F.lit(""))
    rows = raw.select(
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Segment-Origin-ID").alias("origin_id"),
        field("WARC-Segment-Number").cast("int").alias("segment"), field("WARC-Segment-Total-Length").cast("long").alias("total"),
        field("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("digest"), field("Content-Length").cast("long").alias("length"), "block",
    )
    # two line ends close a record
    whole = (F.octet_length("block") == F.col("length") + 4) & F.endswith("block", F.lit("\r\n\r\n"))
    return rows.withColumn("block", F.when(whole, F.expr("left(block, char_length(block) - 4)")).otherwise(F.raise_error(F.concat(F.lit("record "), F.col("record_id"), F.lit(" is not as long as its Content-Length")))))


def reassemble(records: DataFrame) -> DataFrame:
    """Whole response and revisit records: segments grouped by origin, in order, with their total length checked."""
    origin = F.coalesce("origin_id", "record_id")
    parts = records.where(F.col("segment").isNotNull()).groupBy(origin.alias("record_id")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"), F.max(F.when(F.col("segment") == 1, F.col("type"))).alias("type"),
        F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"),
    )
    block = F.concat_ws("", F.col("parts.block"))
    numbered = F.expr("forall(sequence(1, size(parts)), i -> parts[i - 1].segment = i)")
    good = numbered & (F.octet_length("block") == F.col("total"))
    parts = parts.withColumn("block", block).withColumn("block", F.when(good, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("record_id")))))
    names = ["record_id", "type", "refers_to", "digest", "block"]
    return records.where(F.col("segment").isNull()).select(names).unionByName(parts.select(names))


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Per page: page_id, record_id, type, refers_to, digest, payload_bytes, payload_digest (and payload), as the archives hold them.

    For a revisit the payload columns are null here; its digest header and its response tell.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            sizes, shas, payloads = [], [], []
            for kind, block in zip(batch.column("type").to_pylist(), blocks, strict=True):
                if kind != "response":
                    payload = None
                else:
                    head, _, body = block.encode().partition(b"\r\n\r\n")
                    payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
                sizes.append(None if payload is None else len(payload))
                shas.append(None if payload is None else hashlib.sha256(payload).hexdigest())
                payloads.append(payload if with_payload else None)
            columns = [batch.column(c) for c in ("record_id", "type", "refers_to", "digest")] + [pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(payloads, pa.binary())]
            yield pa.record_batch(columns, names=["record_id", "type", "refers_to", "digest", "payload_bytes", "payload_digest", "payload"])

    out = reassemble(read_records(spark, path)).mapInArrow(decode, "record_id string, type string, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary")
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*):', 1), '') as long)")
    out = out.select(page("record_id").alias("page_id"), "*", page("refers_to").alias("refers_to_page"))
    return out if with_payload else out.drop("payload")


def warc_round_trip(pages: DataFrame, path: str | None = None, salts: int = 16, **options) -> DataFrame:
    """Write, then read back: page_id, payload_bytes, payload_digest, record_type, refers_to per row of ``pages``.

    A revisit's payload is that of the response it refers to, taken from the archive by page and payload digest.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, salts=salts, **options)
    found = materialize(read_warc(spark, path, with_payload=False), "warc-index")
    salt = F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int")
    cited = found.where("type = 'revisit'").select(F.col("digest").alias("cited")).distinct()
    target = found.where("type = 'response'").join(cited, F.col("digest") == F.col("cited"), "left_semi")
    target = target.groupBy(F.col("page_id").alias("target_page"), F.col("digest").alias("target_header")).agg(F.max("payload_bytes").alias("target_bytes"), F.max("payload_digest").alias("target_digest"))
    target = target.withColumn("target_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    refers = (F.col("type") == "revisit") & (F.col("digest") == F.col("target_header")) & F.col("refers_to_page").eqNullSafe(F.col("target_page"))
    found = found.withColumn("salt", salt).join(target, refers & (F.col("salt") == F.col("target_salt")), "left")
    return found.select(
        "page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "target_digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("refers_to_page")).alias("refers_to"),
    )
