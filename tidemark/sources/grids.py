"""HTML grids as rows: tables of pages with spans, chosen and named by their heads."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans beyond these count as these, as the HTML standard has it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class _Table:
    def __init__(self) -> None:
        #: rows of [in a head section, cells], cells of [text, columns, rows, is th]
        self.rows: list[tuple[bool, list[list]]] = []
        self.head, self.cell = False, None


class _Tables(HTMLParser):
    """The tables of a page in the order of their start tags; text of a nested one is its own."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[_Table] = []
        self.open: list[_Table] = []

    @staticmethod
    def _span(value: str | None, most: int) -> int:
        """0 spans what is left, anything else that is no number one."""
        digits = (value or "1").strip()
        return min(int(digits), most) if digits.isdigit() else 1

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append(_Table())
            self.open.append(self.tables[-1])
        elif self.open:
            table = self.open[-1]
            if tag in ("thead", "tbody", "tfoot"):
                table.head = tag == "thead"
            elif tag == "tr":
                table.rows.append((table.head, []))
                table.cell = None
            elif tag in ("td", "th") and table.rows:
                told = dict(attrs)
                columns, rows = max(1, self._span(told.get("colspan"), MOST_COLUMNS)), self._span(told.get("rowspan"), MOST_ROWS) or MOST_ROWS
                table.cell = [[], columns, rows, tag == "th"]
                table.rows[-1][1].append(table.cell)

    def handle_endtag(self, tag):
        if self.open:
            if tag in ("td", "th", "tr"):
                self.open[-1].cell = None
            elif tag == "thead":
                self.open[-1].head = False
            elif tag == "table":
                self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1].cell is not None:
            self.open[-1].cell[0].append(data)


def occupied(rows: list[tuple[bool, list[list]]]) -> Iterator[tuple[bool, list[str]]]:
    """(is head, texts by column) of each row, with cells that span columns or rows in each of their places.

    Head rows are those of a head section, else the first ones of header cells alone, else the first.
    """
    waiting: dict[int, list] = {}
    heads = sum(1 for head, _ in rows if head)
    if not heads:
        heads = next((i for i, (_, cells) in enumerate(rows) if not cells or not all(c[3] for c in cells)), len(rows)) or 1
        rows = [(i < heads, cells) for i, (_, cells) in enumerate(rows)]
    for is_head, cells in rows:
        texts, column, fresh = [], 0, iter(cells)
        while True:
            if column in waiting:
                left = waiting[column]
                texts.append(left[0])
                left[1] -= 1
                if not left[1]:
                    del waiting[column]
                column += 1
                continue
            cell = next(fresh, None)
            if cell is None:
                if not waiting or column > max(waiting):
                    break
                texts.append("")
                column += 1
                continue
            text = " ".join("".join(cell[0]).split())
            for _ in range(cell[1]):
                # a place that is taken from above ends the cell's width
                if column in waiting:
                    break
                texts.append(text)
                if cell[2] > 1:
                    waiting[column] = [text, cell[2] - 1]
                column += 1
        yield is_head, texts


#: Rows and cells of a page at which a part of its lines ends.
PART_ROWS, PART_CELLS = 4096, 1 << 16

_GRIDS = pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("n", pa.int64())]))
_LINE = {"grid": pa.int32(), "row": pa.int64(), "head": pa.bool_(), "cells": pa.list_(pa.string())}

_Line = tuple[int, int, bool, list[str]]


def _parts(lines: list[_Line]) -> Iterator[list[_Line]]:
    part, cells = [], 0
    for line in lines:
        part.append(line)
        cells += len(line[3])
        if len(part) == PART_ROWS or cells >= PART_CELLS:
            yield part
            part, cells = [], 0
    if part:
        yield part


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, html in enumerate(batch.column(1).to_pylist()):
            if not html:
                continue
            parser = _Tables()
            parser.feed(html)
            parser.close()
            found = [[(k, n, head, cells) for n, (head, cells) in enumerate(occupied(table.rows))] for k, table in enumerate(parser.tables)]
            told = pa.array([[{"headers": next((x[3] for x in lines if x[2]), None), "n": sum(not x[2] for x in lines)} for lines in found]], _GRIDS)
            for part in _parts([x for lines in found for x in lines]):
                lines = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _LINE.values(), strict=True)], names=list(_LINE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), told, pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), lines)], names=["page", "grids", "lines"])


def grid_lines(pages: DataFrame, page_col: str, html_col: str) -> DataFrame:
    """(page, grids, lines) of every page with tables, in parts of a bounded size.

    ``lines`` (grid, row, head, cells) are rows with spans filled in, and grids are numbered from
    0 as they begin. Each part has ``grids`` (headers, n), the first head row and the number
    of data rows of all the page's grids. Each row of ``pages`` is a page of its own.
    """
    kind = pages.schema[page_col].dataType.simpleString()
    made = "grids array<struct<headers: array<string>, n: bigint>>, lines array<struct<grid: int, row: bigint, head: boolean, cells: array<string>>>"
    return pages.select(F.col(page_col).alias("page"), F.col(html_col).alias("html")).mapInArrow(_parsed, f"page {kind}, {made}")


def header_name(c: Column) -> Column:
    """Lower case, with white space as underscores."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", "_"))


def chosen_grid(grids: Column, match: str | None = None) -> Column:
    """(grid, headers): of a page's grids of which a header matches the pattern the one with most rows, of equal ones the first; null without any.

    Headers are the cells of the first head row; further head rows, with widgets for example,
    are no data. Grids without data rows are left out.
    """
    ranked = F.transform(grids, lambda g, i: F.struct(g["n"].alias("n"), (-i).alias("first"), g["headers"].alias("headers")))
    fit = F.filter(ranked, lambda g: (g["n"] > 0) & (F.lit(True) if match is None else F.exists(g["headers"], lambda h: h.rlike(match))))
    best = F.array_max(fit)
    return F.when(best.isNotNull(), F.struct((-best["first"]).alias("grid"), best["headers"].alias("headers")))


def grid_maps(lines: DataFrame, match: str | None = None) -> DataFrame:
    """(page, row, cells) of the chosen grid of each page, from ``grid_lines``: a map of header names to texts.

    Columns without a header are left out, of columns of one name the last counts, and cells
    that a row lacks are empty. A page is parsed once and nothing is shuffled.
    """
    one = lines.withColumn("best", chosen_grid(F.col("grids"), match)).where("best is not null").withColumn("names", F.transform("best.headers", header_name))
    at = F.transform("names", lambda n, i: F.struct(n.alias("n"), i.alias("i"), F.array_contains(F.slice("names", i + 2, F.size("names")), n).alias("again")))
    own = F.filter("lines", lambda x: ~x["head"] & (x["grid"] == F.col("best.grid")))
    each = one.select("page", F.filter(at, lambda x: (x["n"] != "") & ~x["again"]).alias("kept"), F.explode(own).alias("line"))
    return each.select("page", "line.row", F.map_from_entries(F.transform("kept", lambda x: F.struct(x["n"], F.coalesce(F.get("line.cells", x["i"]), F.lit(""))))).alias("cells"))


def key_order(rows: DataFrame, cells: str, *order: Column, most: int = 10_000) -> list[str]:
    """Keys of a map column in the order in which rows, by ``order``, first have them; more than ``most`` is an error.

    Each task keeps one place for each key, and only the keys reach the driver.
    """
    keys = rows.select(*(c.alias(f"_o{i}") for i, c in enumerate(order)), F.posexplode(F.map_keys(cells)).alias("_i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(*(f"_o{i}" for i in range(len(order))), "_i")).alias("at"))
    found = [r["key"] for r in first.orderBy("at").limit(most + 1).select("key").collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different keys")
    return found


def united(rows: DataFrame, cells: str, *order: Column) -> DataFrame:
    """One text column for each key of a map column, in first-seen order; missing ones are empty."""
    return rows.select(*(F.coalesce(F.try_element_at(cells, F.lit(k)), F.lit("")).alias(k) for k in key_order(rows, cells, *order)))
