"""HTML tables as rectangular grids, and grids as row texts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Cells(HTMLParser):
    """The cells of the outermost table, row by row: (text, columns, rows)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth = 0
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.depth == 1:
            if not self.rows:
                self.rows.append([])
            known = dict(attrs)
            self.cell = ["", _span(known.get("colspan")), _span(known.get("rowspan"))]
            self.rows[-1].append(self.cell)
        elif tag in ("br", "p", "li", "div") and self.cell is not None:
            self.cell[0] += " "

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th") and self.depth == 1:
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def _span(value: str | None) -> int:
    return max(1, min(int(value), 1000)) if value and value.strip().isdigit() else 1


def grid(html: str | None) -> list[list[str]]:
    """Every cell repeated over the columns and rows it spans; rows padded on the right.
    Null and tableless text give no rows."""
    parser = _Cells()
    parser.feed(html or "")
    out: list[list[str]] = []
    held: dict[int, tuple[int, str]] = {}  # column: rows still to fill, text
    for cells in parser.rows:
        row: dict[int, str] = {}
        for column, (left, text) in list(held.items()):
            row[column] = text
            held[column] = (left - 1, text)
            if left == 1:
                del held[column]
        at = 0
        for text, columns, rows in cells:
            text = " ".join(text.split())
            while at in row:
                at += 1
            for column in range(at, at + columns):
                row.setdefault(column, text)
                if rows > 1:
                    held[column] = (rows - 1, text)
            at += columns
        out.append([row.get(i, "") for i in range(max(row, default=-1) + 1)])
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _grid(html: pd.Series) -> pd.Series:
    return html.map(grid)


def html_grid(html: Column) -> Column:
    return _grid(html)


def grid_rows(df: DataFrame, key: str, cells: str) -> DataFrame:
    """``key, row_no, content``: rows after the header (the first row that isn't blank) as
    "header: cell" pairs joined by bars; blank rows and contents under three characters are left out."""
    blank = lambda r: F.forall(r, lambda c: F.trim(c) == "")
    solid = F.filter(cells, lambda r: ~blank(r))
    rows = df.select(key, F.get(solid, F.lit(0)).alias("_head"), F.posexplode(F.slice(solid, 2, F.greatest(F.size(solid), F.lit(1)))).alias("row_no", "_row"))
    part = F.transform("_row", lambda c, i: F.when(F.trim(c) == "", None).when(F.coalesce(F.trim(F.get("_head", i)), F.lit("")) == "", c).otherwise(F.concat(F.get("_head", i), F.lit(": "), c)))
    return rows.select(key, (F.col("row_no") + 1).alias("row_no"), F.array_join(F.array_compact(part), " | ").alias("content")).where(F.length("content") >= 3)
