"""Dates and aliases by hand, creator bands, action files in both layouts."""

import datetime as dt
import json

import pyarrow as pa

from opineflow.operators import anchoring as an
from opineflow.operators.anchoring import dates_in, entity_spans, temporal_spans
from opineflow.operators.content import entity_mentions, key_borders, stratified_sample
from opineflow.operators.creators import creator_bands
from opineflow.sources.tables import action_files

DAY = dt.date(2024, 5, 15)  # a Wednesday


def found(text, day=DAY):
    return [(h[2], str(h[3]), h[6].split("_")[0]) for h in dates_in(text, day)]


def test_dates():
    assert found("2024/1/5, 2023年12月31日") == [("2024/1/5", "2024-01-05", "full"), ("2023年12月31日", "2023-12-31", "full")]
    assert found("3月1日和2月30日") == [("3月1日", "2024-03-01", "month")]
    assert found("下周一看今天") == [("下周一", "2024-05-20", "relative"), ("今天", "2024-05-15", "relative")]
    assert found("6.12非农, 6.13 12345678901CPI") == [("6.12", "2024-06-12", "numeric")]
    assert found("上月", dt.date(2024, 1, 31)) == [("上月", "2023-12-01", "relative")]
    assert found("今天 2024-01-02", None) == [("2024-01-02", "2024-01-02", "full")]
    assert found("") == found(None) == []


def test_temporal_rows(spark):
    rows = spark.createDataFrame([(1, "本周CPI", DAY), (2, None, DAY), (3, "本周", None)], "n long, body string, at date")
    got = temporal_spans(rows, "n", "body", "at").collect()
    assert [(r.n, r.start, r.end, r.day, r.end_day) for r in got] == [(1, 0, 2, dt.date(2024, 5, 13), dt.date(2024, 5, 20))]
    assert temporal_spans(rows.limit(0), "n", "body", "at").count() == 0


def test_entity_spans(spark):
    docs = spark.createDataFrame([(1, "AAPL, AAPLX 腾腾腾讯AAPL"), (2, None), (3, ""), (4, "xAAPL AAPL2")], "doc_id long, text string")
    got = entity_spans(docs, "doc_id", "text", [("AAPL", "AAPL.US"), ("腾腾", "T"), ("腾讯", "0700.HK")]).collect()
    assert sorted((r.doc_id, r.start, r.end, r.ticker) for r in got) == [(1, 0, 4, "AAPL.US"), (1, 12, 14, "T"), (1, 13, 15, "T"), (1, 14, 16, "0700.HK"), (1, 16, 20, "AAPL.US")]
    assert entity_spans(docs, "doc_id", "text", []).count() == 0


def test_creator_bands(spark):
    schema = "creator_id string, ticker string, direction string, clock int, action_id int, return_pct double, holding_days int"
    steady = [("a", "T", "bullish", i, i, 0.4, 2) for i in range(4)]
    wild = [("b", "T", d, i, i, r, None) for i, (d, r) in enumerate([("bullish", -0.1), ("bearish", None), ("bullish", -0.2)])]
    got = {r.creator_id: r for r in creator_bands(spark.createDataFrame(steady + wild + [("c", "T", None, 0, 0, None, None)], schema)).collect()}
    assert [got["a"][c] for c in ("accuracy", "timeliness", "return_score", "consistency", "overall")] == [5, 5, 5, 5, 5]
    assert [got["b"][c] for c in ("accuracy", "timeliness", "return_score", "consistency", "overall")] == [1, 1, 1, 1, 1]
    assert got["c"].consistency == 3 and got["c"].n == 1


def test_action_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "one.action.json").write_text(json.dumps({"id": "1", "ticker": "A"}, indent=2))
    (tmp_path / "deep" / "x_actions.json").write_text(json.dumps({"actions": [{"id": "2", "ticker": "B"}, {"ticker": "none"}]}, indent=2))
    (tmp_path / "deep" / "torn.action.json").write_text('{"id": "3", "tick')
    (tmp_path / "other.json").write_text(json.dumps({"id": "4"}))
    assert sorted(tuple(r) for r in action_files(spark, str(tmp_path), "id string, ticker string", "id").collect()) == [("1", "A"), ("2", "B")]


def test_stratified_sample_by_slices(spark):
    rows = [("hot" if i % 4 else None, i * 7919 % 5003) for i in range(5000)]
    got = stratified_sample(spark.createDataFrame(rows, "s string, k long"), "s", "k", 0.1, 3).collect()
    for of in ("hot", None):
        keys = sorted(k for s, k in rows if s == of)
        want = keys[: -(-len(keys) // 10)]
        assert sorted((r["rank"], r.k, r.n) for r in got if r.s == of) == [(i + 1, k, len(keys)) for i, k in enumerate(want)]


def test_borders_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, null, 'hot') as s", "pmod(xxhash64(id), 1000003) as k", "if(id % 3 = 0, 20000, 40000) as n")
    dealt = [rows.coalesce(1), rows.repartition(40).orderBy("k"), rows.repartition(7)]
    first, *others = [sorted((str(r.s), r["__cuts"]) for r in key_borders(d, "s", "k", "n", 64).collect()) for d in dealt]
    assert all(o == first for o in others) and [len(c) for _, c in first] == [63, 63] and all(c == sorted(c) for _, c in first)
    hot = stratified_sample(rows.select("s", "k"), "s", "k", 0.05, 2).where("s = 'hot'")
    assert sorted(r["rank"] for r in hot.collect()) == list(range(1, 2001))
    assert "percentile_approx" not in hot._jdf.queryExecution().toString()
    same = stratified_sample(spark.createDataFrame([("a", 7)] * 5000, "s string, k long"), "s", "k", 0.5, 2)
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 2501))


def test_mentions_are_counted_where_the_texts_are(spark):
    docs = spark.createDataFrame([(1, "The the and x"), (1, "AND THE"), (2, None), (3, "zz"), (None, "the")], "doc_id long, text string")
    registry = spark.createDataFrame([("the", "A"), ("and", "A"), ("the", "B"), ("x", "C")], "alias string, ticker string")
    got = entity_mentions(docs, registry)
    assert sorted((str(r.doc_id), r.ticker, r.mentions, r.longest_alias) for r in got.collect()) == [("1", "A", 5, "the"), ("1", "B", 3, "the"), ("1", "C", 1, "x"), ("None", "A", 1, "the"), ("None", "B", 1, "the")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_hits_come_in_small_batches():
    texts = ["ab " * 9000, None, "", *["ab"] * 5000, "ab " * 12000]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "__text"])
    for context in (0, 4):
        out = list(an.hits_of(["id"], ["ab"], {"ab"}, "words", False, context)(iter([batch, batch])))
        assert max(b.num_rows for b in out) == an.SLICE_HITS and all(b.num_rows for b in out)
        ids, starts = ([v for b in out for v in b.column(c).to_pylist()] for c in ("id", "start"))
        one = [(i, m) for i, t in enumerate(texts) for m in range(0, len(t or ""), 3)]
        assert list(zip(ids, starts, strict=True)) == one * 2
