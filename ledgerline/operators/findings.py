"""Findings of pages: each page's lines, in order, through the page's automaton."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.findings import Page
from ledgerline.functions.variants import Grid
from ledgerline.operators.joins import each_group

_FIELDS = "page string, number int, key string, entity string, value map<string,string>, line long, start int, end int, raw string, role string, specimen int, assay int, marker int, limits array<string>"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]


def _page(numbers: list, lines: list) -> list:
    """The columns of a page's findings, from its lines in order."""
    rows = [(k, f.key, f.entity, sorted(f.value.items()), numbers[f.line], f.start, f.end, f.raw, f.role, f.specimen, f.assay, f.marker, f.limits) for k, f in enumerate(Page(lines).found)]
    return list(zip(*rows, strict=True)) if rows else [()] * (len(_KINDS) - 1)


def pathology(lines: DataFrame) -> DataFrame:
    """The findings of each page of ``lines`` (page, line, text): number within the page, key, entity, value, place, links and limits.

    ``start`` and ``end`` are places of the line's own text (end exclusive), and ``raw`` is what stands
    there.  specimen, assay and marker are the numbers of the findings that one is bound to; what could be
    bound to several, or to none, is unbound and says so in ``limits``.  A null text is an empty line;
    lines that tie come in the order of their text; pages without a finding, and no lines, give no rows;
    lines of a null page are one page.  A page is held in a task; other columns take no part.
    """
    rows = lines.select(F.col("page").cast("string").alias("page"), F.col("line").cast("long").alias("line"), F.col("text"))
    return each_group(rows, _page, _KINDS, _FIELDS, ("line", "text"))


_VARIANT = "page string, row long, role string, scope string, status string, assertion string, gene string, coding string, protein string, transcript string, exon string, fusion string, fraction string, copies string, parts array<struct<name:string,value:string,row:long,x:double,start:int,end:int>>"
_NAMES = ("gene", "coding", "protein", "transcript", "exon", "fusion", "fraction", "copies")
_PART = pa.struct([("name", pa.string()), ("value", pa.string()), ("row", pa.int64()), ("x", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
_PARTS = [pa.string(), pa.int64(), *[pa.string()] * 12, pa.list_(_PART)]


def _grid(cell_rows: list, xs: list, texts: list) -> list:
    """The columns of the variants of a page's grid, from its cells in order."""
    cells: dict = {}
    for row, x, text in zip(cell_rows, xs, texts, strict=True):
        cells.setdefault(row, []).append((x, text))
    numbers, out = list(cells), []
    for r in Grid(list(cells.values())).records:
        one = lambda name, r=r: " | ".join(r.values(name)) or None
        parts = [{"name": p.name, "value": p.value, "row": numbers[p.row], "x": p.x, "start": p.start, "end": p.end} for p in r.parts]
        out.append((numbers[r.row], r.role, r.scope, r.status, r.assertion, *map(one, _NAMES), parts))
    return list(zip(*out, strict=True)) if out else [()] * (len(_PARTS) - 1)


def molecular(cells: DataFrame) -> DataFrame:
    """The variants of each page's grid of ``cells`` (page, row, x, text), one row each, with the places of all their parts.

    ``status`` is COMPLETE, INCOMPLETE (no gene, or no change) or UNRESOLVED (two values of one component, both
    given).  Cells without a row, a place or a text are left out; cells of one row at one place come in the order of
    their text; pages without a variant give no rows; cells of a null page are one page.  A page is held in a task.
    """
    rows = cells.select(F.col("page").cast("string").alias("page"), F.col("row").cast("long").alias("row"), F.col("x").cast("double").alias("x"), F.col("text")).dropna(subset=["row", "x", "text"])
    return each_group(rows, _grid, _PARTS, _VARIANT, ("row", "x", "text"))
