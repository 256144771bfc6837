"""Names, endings, judged pairs and aliases of a registry on hand-made pairs."""

from pyspark.sql import functions as F

from opineflow.operators import registry as rg


def test_names(spark):
    want = {
        "BYD_A": "BYD", "  Foo~Bar  Inc ": "Foo Bar Inc", "&- —Acme": "Acme", "GS Acme": "Acme", "GS GS Acme": "GS Acme", "GSAcme": "GSAcme", "比亚迪 -H": "比亚迪", "新华保险": "新华保险", "保险": None, "电子设备": None,
        "腾讯-港股": None, "Weekly Notes": None, "Acme, Update.": None, "a b c d e f": "a b c d e f", "a b c d e f g": None, "9Lives": None, "A": None, "x" * 41: None, "x" * 40: "x" * 40, "Acme?": None, "Ünal": None, "": None, None: None, "AT&T (US)": "AT&T (US)",
    }
    df = spark.createDataFrame([(n,) for n in want], "name string")
    got = {r.name_: r.c for r in df.select(F.col("name").alias("name_"), rg.clean_company_name(F.col("name"), prefixes=("GS",), themes=("保险",)).alias("c")).collect()}
    assert got == want
    want = {"Acme Inc.": "Acme", "Acme, Ltd": "Acme", "AB Co": None, "Acme": None, "宁德时代股份有限公司": "宁德时代", "A公司": None, "Acme Holding": "Acme", None: None}
    df = spark.createDataFrame([(n,) for n in want], "name string")
    assert {r[0]: r[1] for r in df.select("name", rg.without_suffix(F.col("name")).alias("c")).collect()} == want


PAIRS = [
    ("Acme Inc", "ACM", "s"), ("Acme", "ACM.N", "s"), ("Lone", "LON", "s"), ("Twin One", "TWN", "s"), ("Twin Two", "TWN", "s"), ("Weekly", "TWX", "s"), ("三星电子", "000660", "s"), ("平安银行", "000001", "s"), ("腾讯控股", "700.HK", "s"), ("腾讯控股", " 0700.HK ", "s"),
    ("Acme Inc", "0005.HK", "s"), ("Year", "2020.HK", "s"), ("Any", "PRC", "s"), ("Any", "bad", "s"), ("Any", "X", "s"), ("Any", "12", "s"), (None, "AAPL", "s"), ("Any", None, "s"), ("", "AAPL", "s"), ("Acme Inc", "ACM", "s"), ("Key", "KEY.N", "s"),
]


def test_registry(spark):
    pairs = spark.createDataFrame(PAIRS, "name string, code string, symbol string")
    judged = rg.judged_pairs(pairs, ("bad",))
    status = {(r.name, r.code): r.status for r in judged.collect()}
    assert len(status) == 17 and status["Lone", "LON"] == status["Weekly", "TWX"] == "bare_alpha" and status["Twin One", "TWN"] == status["Acme Inc", "ACM"] == "kept"
    assert status["三星电子", "000660"] == "korean" and {status["Any", c] for c in ("PRC", "BAD", "X", "12")} == {"code_rejected"}
    known = spark.createDataFrame([("平安银行", "x"), ("平安银行", "y"), (None, "z")], "alias string, symbol string")
    got = {r.alias: (r.symbol, r.market, r.status, r.requires_context) for r in rg.company_registry(judged, known, ("bad",), ("KEY", "Acme")).collect()}
    assert got["Acme"][:3] == (None, None, "conflict") and got["Acme Inc"][2] == "conflict" and not got["Acme"][3]
    assert got["平安银行"] == ("000001.SZ", "CN", "known", False) and got["000001"] == got["000001.SZ"] == ("000001.SZ", "CN", "kept", False)
    assert {a for a in got if got[a][0] == "0700.HK"} == {"0700.HK", "700.HK", "0700", "腾讯控股", "腾讯"}
    assert got["KEY"] == ("KEY", "US", "kept", True) and "2020" not in got and got["2020.HK"][0] == "2020.HK" and "Lone" not in got and got["ACM.N"][0] == "ACM"
    assert rg.company_registry(rg.judged_pairs(pairs.limit(0)), known).count() == 0
