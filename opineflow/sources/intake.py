"""Intake of raw files and of brokers' lists: facts from paths, content ids, what is new, known, a duplicate or wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of files, folders and words that tell a source, folders that are no creators.
IMAGES, PDFS = ("png", "jpg", "jpeg", "webp", "bmp"), ("pdf",)
FOLDER_TYPES = ("daily_post", "daily_pre", "weekly_strategy", "research_report", "chat_export")
WORD_TYPES = (("内部直播", "livestream_audio"), ("直播", "livestream_audio"), ("周度策略", "weekly_strategy"), ("课代表", "weekly_strategy"), ("研报", "research_report"), ("深度分析", "research_report"))
PLATFORMS = ("feishu", "bilibili", "wechat")
NO_CREATORS = ("_inbox", "_research", "upload", "local", *PLATFORMS)
ZONE = "+08:00"


def raw_files(spark: SparkSession, root: str, suffixes: Sequence[str] = (*IMAGES, *PDFS)) -> DataFrame:
    """All files of these kinds below a folder: rel_path, content_hash (SHA-256 of the bytes), modified, length.

    A file is read whole by one task, as its digest needs; Spark reads no file of 2 GB and more this way.  Spark passes over folders
    whose names begin with an underscore: those right below ``root`` are named to it one by one, deeper ones stay unread."""
    kinds = ",".join(f"*.{v}" for s in suffixes for v in dict.fromkeys((s.lower(), s.upper(), s.capitalize())))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    passed = [f.getPath().toString() for f in fs.listStatus(base) if f.isDirectory() and f.getPath().getName().startswith("_")]
    base = fs.makeQualified(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{kinds}}}").load([root, *passed])
    # file:/x and file:///x name the same
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    rel = F.substring(plain(F.col("path")), F.char_length(plain(F.lit(base))) + 1, F.char_length("path"))
    return files.select(rel.alias("rel_path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"), "length")


def _time(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    whole = lambda c: F.expr("null").cast("int") if c is None else c.try_cast("int")
    return F.try_make_timestamp(whole(year), whole(month), whole(day), whole(hour), whole(minute), F.lit(0).cast("decimal(16,6)"), F.lit(ZONE))


def published_at(name: Column, modified: Column) -> Column:
    """struct(at, source): the time in a file's name, the date in it, dotted or not, else the time of its last change; Beijing's clock.

    The first place of each form counts; one that is no date leaves the turn to the next form."""
    part = lambda pattern, i: F.regexp_extract(name, pattern, i)
    both, plain, dotted = r"([0-9]{4})([0-9]{2})([0-9]{2})[_-]([0-9]{2})([0-9]{2})(?:[^0-9]|$)", r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", r"(?<![0-9])([0-9]{4})[.\-]([0-9]{1,2})[.\-]([0-9]{1,2})(?![0-9])"
    zero = F.lit("0")
    forms = [(_time(*(part(both, i) for i in range(1, 6))), "filename_datetime"), (_time(*(part(plain, i) for i in (1, 2, 3)), zero, zero), "filename_date"), (_time(*(part(dotted, i) for i in (1, 2, 3)), zero, zero), "filename_dotted_date")]
    out = None
    for at, source in forms:
        value = F.struct(at.alias("at"), F.lit(source).alias("source"))
        out = F.when(at.isNotNull(), value) if out is None else out.when(at.isNotNull(), value)
    return out.otherwise(F.struct(modified.cast("timestamp").alias("at"), F.when(modified.isNotNull(), "file_mtime").otherwise("unknown").alias("source")))


def plan_intake(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (rel_path, content_hash, modified), known (grp, content_id) -> one row a file with what its path tells and its ``status``.

    Of files of equal content the first by path counts, the others are duplicates; it exists already if ``known`` has its group and id,
    else it is new.  First files are found by an aggregate before any shuffle of rows, so a content that a third of the files share
    gathers nowhere.  The path's segments decide the order, as folders sort before what their names begin."""
    segments = F.split("rel_path", "/")
    rows = files.withColumn("segments", segments)
    first = F.get("segments", F.lit(0))
    creator = F.when(~first.isin(*NO_CREATORS), first)
    inner = F.filter("segments", lambda s: s.isin(*FOLDER_TYPES))
    kind = F.when(F.size(inner) > 0, F.get(inner, F.lit(0))).when(F.array_contains("segments", "upload"), "manual_upload")
    for word, name in WORD_TYPES:
        kind = kind.when(F.contains("rel_path", F.lit(word)), name)
    told = published_at(F.element_at("segments", -1), F.col("modified"))
    suffix = F.lower(F.substring_index("rel_path", ".", -1))
    rows = rows.select(
        "rel_path", "segments", "content_hash", F.concat(F.lit("local_"), F.substring("content_hash", 1, 24)).alias("content_id"), creator.alias("creator_id"), F.coalesce(creator, first).alias("grp"), kind.otherwise("unclassified").alias("source_type"),
        F.when(first.isin(*PLATFORMS), first).otherwise("local").alias("platform"), F.when(suffix.isin(*PDFS), "pdf").otherwise("image").alias("file_type"), told.alias("told"),
    )
    firsts = rows.groupBy(F.col("content_hash").alias("__h")).agg(F.min("segments").alias("__first"))
    have = known.select(F.col("grp").alias("__g"), F.col("content_id").alias("__id"), F.lit(True).alias("__known")).distinct()
    rows = rows.join(firsts, F.col("content_hash") == F.col("__h")).join(have, (F.col("grp") == F.col("__g")) & (F.col("content_id") == F.col("__id")), "left")
    status = F.when(F.col("segments") != F.col("__first"), "duplicate").when(F.col("__known"), "exists").otherwise("new")
    return rows.select("rel_path", "content_hash", "content_id", "creator_id", "grp", "source_type", "platform", "file_type", F.col("told.at").alias("published_at"), F.col("told.source").alias("published_source"), status.alias("status"))


def plan_broker_intake(meta: DataFrame, files: DataFrame, known: DataFrame, volumes: Sequence[str]) -> DataFrame:
    """One row a line of a broker's list: line_no, content_id, published_at, status (new, exists, duplicate, failed), error_code, retryable.

    meta (line_no, filepath, date), files (path, content_hash) that can be read, known (content_id), volumes that are mounted.  The first
    fault counts: no path, no date, no date that is one (YYYY-MM-DD; the file's own time never stands in), a volume that isn't mounted,
    no file.  Of lines with equal content the first counts.  Only failures that a mount would mend are to be tried again."""
    path, day = F.trim(F.coalesce("filepath", F.lit(""))), F.trim(F.coalesce("date", F.lit("")))
    given = lambda i: F.regexp_extract(day, r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", i)
    at = _time(given(1), given(2), given(3), F.lit("0"), F.lit("0"))
    found = files.select(F.col("path").alias("__p"), "content_hash").dropDuplicates(["__p"])
    volume = F.regexp_extract("filepath", "^/Volumes/([^/]+)/", 1)
    code = (
        F.when(path == "", "F0_BROKER_META_INVALID").when(day == "", "F0_BROKER_DATE_MISSING").when(at.isNull(), "F0_BROKER_DATE_INVALID")
        .when(F.col("content_hash").isNull() & (volume != "") & ~volume.isin(*volumes), "F0_BROKER_VOLUME_MISSING").when(F.col("content_hash").isNull(), "F0_BROKER_FILE_MISSING")
    )
    rows = meta.join(found, F.col("filepath") == F.col("__p"), "left").withColumns({"published_at": at, "error_code": code})
    good = F.col("error_code").isNull()
    rows = rows.withColumn("content_id", F.when(good, F.concat(F.lit("broker_"), F.substring("content_hash", 1, 24))))
    firsts = rows.where(good).groupBy(F.col("content_hash").alias("__h")).agg(F.min("line_no").alias("__first"))
    have = known.select(F.col("content_id").alias("__id"), F.lit(True).alias("__known")).distinct()
    rows = rows.join(firsts, good & (F.col("content_hash") == F.col("__h")), "left").join(have, F.col("content_id") == F.col("__id"), "left")
    status = F.when(~good, "failed").when(F.col("line_no") != F.col("__first"), "duplicate").when(F.col("__known"), "exists").otherwise("new")
    return rows.select("line_no", "content_id", F.when(good, F.col("published_at")).alias("published_at"), status.alias("status"), "error_code", F.when(~good, F.col("error_code") == "F0_BROKER_VOLUME_MISSING").alias("retryable"))
