"""Gates of numeric and ambiguous aliases on the contexts that they are there for."""

import pytest

from opineflow.operators.anchoring import entity_spans
from opineflow.operators.gates import gated_spans

REGISTRY = [("2498", "2498.HK", False), ("700", "0700.HK", False), ("KEY", "KEY", True), ("SE", "SE", True), ("ET", "ET", True), ("Block", "SQ", True), ("腾讯", "0700.HK", False), ("Apple", "AAPL", False), ("Apple", "APLE", False)]
CASES = [
    ("+61-2-9324 2498", []), ("电话 2498", []), ("Fax: 2498", []), ("2498 4455", []), ("共 2498 人", []), ("在 2498 楼", []),
    ("速腾聚创（2498）", ["2498"]), ("2498.HK 今天", ["2498"]), ("700 HK Equity", ["700"]), ("股票代码 700", ["700"]), ("700 大涨", ["700"]), ("7000 大涨", []), ("A700 大涨", []),
    ("Morning Notes (700)", []), ("700.HKX 号", []), ("a (700", ["700"]), ("700) b", ["700"]),
    ("KEY DEFINITIONS", []), ("UBS Europe SE", []), ("4:00 PM ET", []), ("Block B-6", []), ("KeyCorp (KEY)", ["KEY"]), ("Sea Ltd (SE US)", ["SE"]), ("KEY.N up", ["KEY"]), ("SE.OQ", ["SE"]),
    ("Ticker: KEY", ["KEY"]), ("股票代码 KEY", ["KEY"]), ("KEY US Equity", ["KEY"]), ("KEY US Equityx", []), ("(KEY words", []), ("KEY) words", []),
    ("腾讯腾讯", ["腾讯", "腾讯"]), ("Apple", ["Apple", "Apple"]), ("", []), (None, []),
]


def test_gates(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, (t, _) in enumerate(CASES)], "id int, text string, alias string, before int")
    got = gated_spans(docs, "id", "text", REGISTRY, ["Morning Notes"]).collect()
    out = gated_spans(docs, "id", "text", REGISTRY, ["Morning Notes"], rejected=True).collect()
    for i, (text, want) in enumerate(CASES):
        mine = sorted((r.start, r.alias) for r in got if r.id == i)
        assert [a for _, a in mine] == want, text
        assert all(text[r.start : r.end] == r.alias for r in [*got, *out] if r.id == i)
    assert {r.ticker for r in got if r.alias == "Apple"} == {"AAPL", "APLE"}
    assert not {(r.id, r.start) for r in got} & {(r.id, r.start) for r in out}


def test_context_is_of_its_own_reach(spark):
    """A dialling code, a term and a title further away than their windows have no say."""
    docs = spark.createDataFrame([(1, "+61 " + "x" * 20 + " (700)"), (2, "股" + "x" * 20 + " 700 x"), (3, "Morning Notes" + "x" * 41 + "(700)"), (4, "(700)" + "x" * 27 + "Morning Notes")], "id int, text string")
    assert sorted(r.id for r in gated_spans(docs, "id", "text", REGISTRY, ["Morning Notes"]).collect()) == [1, 3, 4]


def test_aliases(spark):
    docs = spark.createDataFrame([(1, "AB x"), (None, "AB")], "id int, text string")
    assert sorted((r.id or 0, r.ticker) for r in entity_spans(docs, "id", "text", [("AB", "X"), ("AB", "Y"), ("AB", "X")]).collect()) == [(0, "X"), (0, "Y"), (1, "X"), (1, "Y")]
    assert entity_spans(docs, "id", "text", []).count() == 0
    with pytest.raises(ValueError):
        entity_spans(docs, "id", "text", [("", "X")])
