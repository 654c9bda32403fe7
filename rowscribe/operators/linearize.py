"""Cell grids as tagged text.

A grid is ARRAY<ARRAY<STRUCT<column_span, is_header, row_span, value>>>. A cell that
spans columns shifts the cells after it, and headers above a cell are found by overlap
of the spanned columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowscribe.functions.arrays import computed_once

# The tags of the text form.
START, END = "<s>", "\n\n"
PAGE_TITLE = ("<page_title> ", " </page_title> ")
SECTION_TITLE = ("<section_title> ", " </section_title> ")
TABLE = ("<table> ", "</table>")
ROW = ("<row> ", "</row> ")
CELL = ("<c> ", "</c> ")
HIGHLIGHTED = ("<highlighted_cell> ", "</highlighted_cell> ")
COL_HEADER = ("<col_header> ", " </col_header> ")
ROW_HEADER = ("<row_header> ", " </row_header> ")


def _wrap(tags: tuple[str, str], text: Column) -> Column:
    return F.concat(F.lit(tags[0]), text, F.lit(tags[1]))


def feature_grid(name: Column, value: Column) -> Column:
    """A header cell over a value cell."""

    def row(text: Column, header: bool) -> Column:
        return F.array(
            F.struct(
                F.lit(1).alias("column_span"),
                F.lit(header).alias("is_header"),
                F.lit(1).alias("row_span"),
                text.alias("value"),
            )
        )

    return F.array(row(name, True), row(value, False))


def with_offsets(grid: Column) -> Column:
    """Add the first column and the column after the last one to every cell."""

    def place(row: Column) -> Column:
        empty = F.array().cast(
            "array<struct<first:int,after:int,is_header:boolean,value:string>>"
        )
        return F.aggregate(
            row,
            empty,
            lambda done, cell: F.concat(
                done,
                F.array(
                    F.struct(
                        _reach(done).alias("first"),
                        (_reach(done) + cell["column_span"].cast("int")).alias("after"),
                        cell["is_header"].cast("boolean").alias("is_header"),
                        cell["value"].cast("string").alias("value"),
                    )
                ),
            ),
        )

    return F.transform(grid, place)


def _reach(done: Column) -> Column:
    return F.when(F.size(done) > 0, F.element_at(done, -1)["after"]).otherwise(F.lit(0))


def linearize(
    grid: Column, highlighted: Column, page_title: Column, section_title: Column
) -> Column:
    """The grid as tagged text. ``highlighted`` is ARRAY<ARRAY<INT>> of (row, column)."""

    def cell_text(placed: Column, row: Column, row_no: Column, cell: Column, cell_no: Column) -> Column:
        above = F.filter(
            F.flatten(F.slice(placed, F.lit(1), row_no)),
            lambda h: h["is_header"] & (h["first"] < cell["after"]) & (h["after"] > cell["first"]),
        )
        left = F.filter(F.slice(row, F.lit(1), cell_no), lambda h: h["is_header"])
        marked = F.array_contains(highlighted, F.array(row_no.cast("int"), cell_no.cast("int")))
        return F.concat(
            F.when(marked, F.lit(HIGHLIGHTED[0])).otherwise(F.lit(CELL[0])),
            cell["value"],
            F.lit(" "),
            F.array_join(F.transform(above, lambda h: _wrap(COL_HEADER, h["value"])), ""),
            F.array_join(F.transform(left, lambda h: _wrap(ROW_HEADER, h["value"])), ""),
            F.when(marked, F.lit(HIGHLIGHTED[1])).otherwise(F.lit(CELL[1])),
        )

    def row_text(placed: Column, row: Column, row_no: Column) -> Column:
        return _wrap(
            ROW,
            F.array_join(
                F.transform(row, lambda cell, cell_no: cell_text(placed, row, row_no, cell, cell_no)), ""
            ),
        )

    def rows_text(placed: Column) -> Column:
        return F.array_join(F.transform(placed, lambda row, row_no: row_text(placed, row, row_no)), "")

    def title(tags: tuple[str, str], text: Column) -> Column:
        return F.when(F.length(text) > 0, _wrap(tags, text)).otherwise(F.lit(""))

    return F.concat(
        F.lit(START),
        title(PAGE_TITLE, page_title),
        title(SECTION_TITLE, section_title),
        _wrap(TABLE, computed_once(with_offsets(grid), rows_text)),
        F.lit(END),
    )
