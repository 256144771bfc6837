"""Rows, tables, titles and text of pages: hand-made pages, and row numbers against a plain loop on crowded ones."""

import random
import statistics

from opineflow.operators import layout as ly

CELLS = "page_id string, place int, text string, x0 double, y0 double, x1 double, y1 double, region string, rows int"


def frame(spark, cells):
    return spark.createDataFrame([(*c, "clash", 0) for c in cells], CELLS)


def test_regions(spark):
    cells = [
        ("a", 0, "Title", 0.0, 0.0, 50.0, 20.0), ("a", 1, "first line", 0.0, 30.0, 90.0, 40.0), ("a", 2, "second", 0.0, 45.0, 40.0, 55.0), ("a", 3, "after a gap", -5.0, 80.0, 40.0, 90.0),
        ("a", 4, "y", 60.0, 101.0, 70.0, 111.0), ("a", 5, "x", 0.0, 100.0, 10.0, 110.0), ("a", 6, "1", 0.0, 130.0, 10.0, 140.0), ("a", 7, "2", 30.0, 131.0, 40.0, 141.0), ("a", 8, "3", 60.0, 129.0, 70.0, 139.0),
        ("a", 9, "below", 0.0, 145.0, 40.0, 155.0), ("a", 10, None, 0.0, 0.0, 1.0, 1.0), ("a", 11, "", 0.0, 0.0, 1.0, 1.0), ("a", 12, "no box", None, 0.0, 1.0, 1.0),
        ("b", 0, "lone", 0.0, 0.0, 10.0, 10.0), ("b", 1, "pair", 20.0, 0.0, 30.0, 10.0), (None, 0, "w" * 100_000, 0.0, 0.0, 1.0, 1.0),
    ]
    got = {(r.page_id, r.region): r for r in ly.layout_regions(frame(spark, cells)).collect()}
    assert [(k, r.type) for k, r in sorted(got.items(), key=str)] == [(("a", 1), "title"), (("a", 2), "text"), (("a", 3), "text"), (("a", 4), "table"), (("a", 5), "text"), (("b", 1), "text"), ((None, 1), "text")]
    assert got["a", 2].text == "first line\nsecond" and got["a", 3].x0 == 0.0 and got["b", 1].text == "lone pair"
    assert got["a", 4].text == "| x | y |  |\n| --- | --- | --- |\n| 1 | 2 | 3 |" and (got["a", 4].rows, got["a", 4].cells, got["a", 4].y1) == (2, 5, 141.0)
    assert len(got[None, 1].text) == 100_000 and ly.layout_regions(frame(spark, cells).limit(0)).count() == 0


def test_rows_against_a_loop(spark):
    rng, cells = random.Random(5), []
    for page in "pqr":
        for i in range(120):
            y, h = rng.randrange(400), rng.choice([4, 8, 20])
            cells.append((page, i, f"t{i}", float(rng.randrange(9)), float(y), 10.0, float(y + h)))
    got = {(r.page_id, r.place): r.row_no for r in ly.cell_rows(frame(spark, cells)).collect()}
    for page in "pqr":
        rows = []
        for c in sorted((c for c in cells if c[0] == page), key=lambda c: ((c[4] + c[6]) / 2, c[1])):
            middle, tall = (c[4] + c[6]) / 2, c[6] - c[4]
            fits = [n for n, r in enumerate(rows) if abs(middle - statistics.fmean(m for m, _ in r)) <= 0.6 * max(tall, statistics.fmean(t for _, t in r)) + 1e-9]
            if fits:
                rows[fits[0]].append((middle, tall))
            else:
                rows.append([(middle, tall)])
            assert got[page, c[1]] == (fits[0] if fits else len(rows) - 1)
