import random

from rowscribe.operators.linearize import linearize
from pyspark.sql import functions as F

GRID = "array<array<struct<column_span:int,is_header:boolean,row_span:int,value:string>>>"


def expected(table, highlighted, page, section):
    """Headers of a cell, found with half-open column intervals."""
    placed = []
    for row in table:
        at, cells = 0, []
        for span, header, value in row:
            cells.append((at, at + span, header, value))
            at += span
        placed.append(cells)
    out = "<s>"
    out += f"<page_title> {page} </page_title> " if page else ""
    out += f"<section_title> {section} </section_title> " if section else ""
    out += "<table> "
    for r, row in enumerate(placed):
        out += "<row> "
        for c, (a, b, _, value) in enumerate(row):
            tag = "highlighted_cell" if [r, c] in highlighted else "c"
            out += f"<{tag}> {value} "
            for above in placed[:r]:
                out += "".join(f"<col_header> {v} </col_header> " for x, y, h, v in above if h and x < b and y > a)
            out += "".join(f"<row_header> {v} </row_header> " for _, _, h, v in row[:c] if h)
            out += f"</{tag}> "
        out += "</row> "
    return out + "</table>\n\n"


def test_random_grids(spark):
    rng = random.Random(4)
    cases = []
    for i in range(60):
        table = [
            [(rng.randint(1, 3), rng.random() < 0.4, f"v{r}{c}") for c in range(rng.randint(1, 4))]
            for r in range(rng.randint(1, 4))
        ]
        marks = [[rng.randint(0, 3), rng.randint(0, 3)] for _ in range(2)]
        cases.append((i, table, marks, rng.choice(["", "Page"]), rng.choice(["", "Part"])))
    rows = [
        (i, [[(s, h, 1, v) for s, h, v in row] for row in table], marks, page, section)
        for i, table, marks, page, section in cases
    ]
    df = spark.createDataFrame(rows, f"i int, g {GRID}, m array<array<int>>, p string, s string")
    got = df.select("i", linearize(F.col("g"), F.col("m"), F.col("p"), F.col("s")).alias("o")).orderBy("i")
    assert [r["o"] for r in got.collect()] == [expected(t, m, p, s) for _, t, m, p, s in cases]
