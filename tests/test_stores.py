"""Versioned tables through crashes, patches and deletes; objects by digest; snapshots by day; intake twice; chats late, repeated and restarted."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from opineflow.operators.tickers import is_json_object, ticker_in_text
from opineflow.operators.records import merged_spans
from opineflow.sources import intake
from opineflow.sources.versioned import VersionedTable, get_objects, object_store, put_objects, snapshot_strictly_before, write_snapshot
from opineflow.streaming import live

SCHEMA = "id int, status string, day date"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def day(n):
    return dt.date(2026, 1, n)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "day")
    assert t.read().count() == 0 and t.current() == {}
    a, b, c = (1, "new", day(1)), (2, "new", day(1)), (3, "new", day(2))
    t.replace(frame(spark, [a, b, c]))
    for _ in range(2):  # the same again
        t.replace(frame(spark, [a, b]))
        assert rows_of(t.read()) == [a, b, c]
    before = t.current()
    assert t.patch(spark.createDataFrame([(2, "done"), (9, "x")], "id int, status string"), "id") == ["2026-01-01"]
    assert rows_of(t.read()) == [a, (2, "done", day(1)), c] and t.current()["2026-01-02"] == before["2026-01-02"]
    t.patch(spark.createDataFrame([(1, None)], "id int, status string"), "id")  # null is a value
    assert rows_of(t.read(["2026-01-01"]).select("id", F.coalesce("status", F.lit("none")))) == [(1, "none"), (2, "done")]
    assert t.patch(spark.createDataFrame([(9, "x")], "id int, status string"), "id") == []
    assert t.delete(spark.createDataFrame([(3,)], "id int"), "id") == ["2026-01-02"] and list(t.current()) == ["2026-01-01"]
    t.append(frame(spark, [c, (4, "new", day(1))]))
    assert [r[0] for r in rows_of(t.read().select("id"))] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        t.patch(spark.createDataFrame([(1, day(2))], "id int, day date"), "id")


def test_a_crash_between_files_and_list_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "day")
    t.replace(frame(spark, [(1, "old", day(1)), (2, "old", day(2))]))

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(t, "_publish", crash)
    for act in (lambda: t.replace(frame(spark, [(1, "new", day(1)), (2, "new", day(2))])), lambda: t.patch(spark.createDataFrame([(1, "new")], "id int, status string"), "id"), lambda: t.delete(spark.createDataFrame([(1,)], "id int"), "id")):
        with pytest.raises(OSError):
            act()
    again = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, "day")
    assert rows_of(again.read()) == [(1, "old", day(1)), (2, "old", day(2))]
    again.replace(frame(spark, [(1, "new", day(1))]))
    assert rows_of(again.read()) == [(1, "new", day(1)), (2, "old", day(2))]


def test_partition_names(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string, v int", "k")
    rows = [("a/b", 1), ("c=d e", 2), ("日本:", 3), ("", 4)]
    t.replace(spark.createDataFrame(rows[:3], "k string, v int"))
    assert rows_of(t.read()) == sorted(rows[:3]) and rows_of(t.read(["a/b"])) == [("a/b", 1)]


def test_objects(spark, tmp_path):
    store = object_store(spark, str(tmp_path / "o"))
    put = lambda *texts: put_objects(store, spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert put("a", "b", "a", None, "") == 3 and put("a", "c") == 1 and put("a") == 0
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = spark.createDataFrame([(sha(t),) for t in ("a", "", "zzz")], "d string")
    assert {(r.digest, r.content and bytes(r.content), r.state) for r in get_objects(store, wanted, "d").collect()} == {(sha("a"), b"a", "ok"), (sha(""), b"", "ok"), (sha("zzz"), None, "missing")}
    store.append(spark.createDataFrame([(sha("x"), b"y", sha("x")[:2])], "digest string, content binary, bucket string"))
    (bad,) = get_objects(store, spark.createDataFrame([(sha("x"),)], "d string"), "d").collect()
    assert bad.state == "corrupt" and bad.content is None


def test_snapshots(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "s"), "kol string, stance string, snapshot_date date", "snapshot_date")
    rows = lambda *r: spark.createDataFrame(list(r), "kol string, stance string")
    write_snapshot(t, rows(("a", "bullish"), ("b", "bearish")), "2026-01-05")
    write_snapshot(t, rows(("a", "neutral")), "2026-01-07")
    write_snapshot(t, rows(("a", "bearish")), "2026-01-05")  # the day's later one
    assert rows_of(snapshot_strictly_before(t, "2026-01-07")) == [("a", "bearish", day(5))]
    assert rows_of(snapshot_strictly_before(t, "2026-01-08")) == [("a", "neutral", day(7))] and snapshot_strictly_before(t, "2026-01-05").count() == 0
    write_snapshot(t, rows(("a", "x")).limit(0), "2026-01-07")
    assert rows_of(snapshot_strictly_before(t, "2026-02-01")) == [("a", "bearish", day(5))]


def test_local_intake(spark, tmp_path):
    files = {
        "kol/weekly_strategy/20260105_0930.png": b"1", "kol/研报 2026.1.7.pdf": b"2", "kol/x/copy 20260199.PDF": b"1", "feishu/20261301.jpg": b"3", "upload/a.png": b"4", "_inbox/直播/20260230_1200_20260102.webp": b"5",
        "kol-b/a.png": b"6", "kol/z.png": b"6", "kol/notes.txt": b"7", "top.png": b"8",
    }
    for name, content in files.items():
        path = tmp_path / "raw" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, (1_700_000_000, 1_700_000_000))
    none = spark.createDataFrame([], "grp string, content_id string")
    scan = lambda: intake.raw_files(spark, str(tmp_path / "raw"))
    first = {r.rel_path: r for r in intake.plan_intake(scan(), none).collect()}
    assert set(first) == set(files) - {"kol/notes.txt"}
    assert {n: (r.status, r.creator_id, r.source_type, r.platform, r.file_type, r.published_source) for n, r in first.items()} == {
        "kol/weekly_strategy/20260105_0930.png": ("new", "kol", "weekly_strategy", "local", "image", "filename_datetime"), "kol/研报 2026.1.7.pdf": ("new", "kol", "research_report", "local", "pdf", "filename_dotted_date"),
        "kol/x/copy 20260199.PDF": ("duplicate", "kol", "unclassified", "local", "pdf", "file_mtime"), "feishu/20261301.jpg": ("new", None, "unclassified", "feishu", "image", "file_mtime"), "upload/a.png": ("new", None, "manual_upload", "local", "image", "file_mtime"),
        "_inbox/直播/20260230_1200_20260102.webp": ("new", None, "livestream_audio", "local", "image", "file_mtime"), "kol-b/a.png": ("duplicate", "kol-b", "unclassified", "local", "image", "file_mtime"), "kol/z.png": ("new", "kol", "unclassified", "local", "image", "file_mtime"), "top.png": ("new", "top.png", "unclassified", "local", "image", "file_mtime"),
    }
    at = first["kol/weekly_strategy/20260105_0930.png"]
    assert at.published_at == dt.datetime(2026, 1, 5, 1, 30) or at.published_at.astimezone(dt.timezone.utc).hour == 1
    assert at.content_hash == hashlib.sha256(b"1").hexdigest() and at.content_id == "local_" + at.content_hash[:24]
    known = spark.createDataFrame([(r.grp, r.content_id) for r in first.values() if r.status == "new"], "grp string, content_id string")
    again = intake.plan_intake(scan(), known).collect()
    assert {r.status for r in again} == {"exists", "duplicate"} and {r.rel_path for r in again if r.status == "duplicate"} == {n for n, r in first.items() if r.status == "duplicate"}


def test_broker_intake(spark):
    meta = [(1, "/a.pdf", "2026-01-05"), (2, None, "2026-01-05"), (3, "/a.pdf", " "), (4, "/a.pdf", "2026-02-30"), (5, "/Volumes/X/b.pdf", "2026-01-05"), (6, "/Volumes/Y/b.pdf", "2026-01-05"), (7, "/copy.pdf", "2026-01-06"), (8, "/known.pdf", "2026-1-6"), (9, "/a.pdf", "05/01/2026"), (10, "/known.pdf", None)]
    files = spark.createDataFrame([("/a.pdf", "a" * 64), ("/copy.pdf", "a" * 64), ("/known.pdf", "b" * 64)], "path string, content_hash string")
    known = spark.createDataFrame([("broker_" + "b" * 24,)], "content_id string")
    got = {r.line_no: (r.status, (r.error_code or "").removeprefix("F0_BROKER_"), r.retryable) for r in intake.plan_broker_intake(spark.createDataFrame(meta, "line_no int, filepath string, date string"), files, known, ["Y"]).collect()}
    assert got == {
        1: ("new", "", None), 2: ("failed", "META_INVALID", False), 3: ("failed", "DATE_MISSING", False), 4: ("failed", "DATE_INVALID", False), 5: ("failed", "VOLUME_MISSING", True), 6: ("failed", "FILE_MISSING", False),
        7: ("duplicate", "", None), 8: ("exists", "", None), 9: ("failed", "DATE_INVALID", False), 10: ("failed", "DATE_MISSING", False),
    }


def test_chats(spark, tmp_path):
    def send(name, *rows):
        data = spark.createDataFrame([(c, i, dt.datetime(2026, 1, 1, 0, t), "x") for c, i, t in rows], "chat string, id string, at timestamp, text string")
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema("chat string, id string, at timestamp, text string").parquet(str(tmp_path / "in"))
        out = live.drain_appended(live.chat_sync(stream), str(tmp_path / "out"), str(tmp_path / "state"))
        got = sorted((r.chat, r.id, r["at"].minute, r.status) for r in out.collect())
        return got

    send("one", ("a", "1", 5), ("a", "2", 6), ("a", "2", 6), ("b", "1", 9), (None, "1", 1))
    first = drain()
    assert first == [("a", "1", 5, "new"), ("a", "2", 6, "new"), ("a", "2", 6, "repeated"), ("b", "1", 9, "new")]
    send("two", ("a", "0", 4), ("a", "2", 6), ("a", "3", 6), ("a", "4", 7), ("c", "1", 0))  # a restart with late, repeated and new ones
    second = drain()
    assert sorted(set(second) - set(first)) == [("a", "0", 4, "late"), ("a", "3", 6, "new"), ("a", "4", 7, "new"), ("c", "1", 0, "new")] and len(second) == 9
    assert drain() == second


def test_strict_json_and_cashtags_and_spans(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} trailing', '{"a":1}{"a":2}', '{"a":1},{"a":2}', '{"a":1}] x', '[{"a":1}]', "1", '"x"', "", None, "{", '{"a":"} x"}', "{}"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(is_json_object(F.col("t"))).collect()]
    assert [t for t, g in zip(texts, got, strict=True) if g] == ['{"a":1}', ' {"a":1} ', '{"a":"} x"}', "{}"]
    pairs = [("$TSLA", "buy TSLA now", True), ("$tsla.us", "tsla", True), ("$", "$", False), ("$A", "A", True), ("A.B", "A", False), (None, "x", False), ("TSLA", None, False)]
    found = [r[0] for r in spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i").select(ticker_in_text(F.col("a"), F.col("b"))).collect()]
    assert found == [p[2] for p in pairs]
    spans = spark.createDataFrame([("k", 1, 3), ("k", None, 5), ("k", 2, None), ("k", 9, None), ("k", 8, 7), ("k", 3, 4)], "k string, start int, end int")
    assert rows_of(merged_spans(spans, "k").select("start", "end", "spans")) == [(1, 4, 3), (9, 9, 1)]
