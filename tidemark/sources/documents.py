"""Rows out of documents: JSON, XML feeds, HTML tables and links, parallel arrays."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship


def first_matching(items: Column, condition) -> Column:
    """The first element of an array that meets a condition, null if none does."""
    return F.try_element_at(F.filter(items, condition), F.lit(1))


def stat_columns(values: Column, names: Mapping[str, str]) -> list[Column]:
    """Columns of a map by its keys' names, null where it lacks one."""
    return [F.try_element_at(values, F.lit(k)).cast("double").alias(n) for k, n in names.items()]


def json_rows(df: DataFrame, column: str, schema: str, path: str | None = None) -> DataFrame:
    """One row for each element of a JSON array (at a field of the document); unreadable documents give none."""
    parsed = F.from_json(column, schema)
    return df.select(*[c for c in df.columns if c != column], F.inline(parsed[path] if path else parsed))


def json_map_rows(df: DataFrame, column: str, value_schema: str, key: str = "id") -> DataFrame:
    """One row for each entry of a JSON object."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.from_json(column, f"map<string,{value_schema}>")).alias(key, "__value")).select(*rest, key, "__value.*")


def feed_entries(df: DataFrame, column: str = "xml") -> DataFrame:
    """Items of an RSS document: title, link, guid (the link where it lacks one), published. Untitled ones are left out."""
    schema = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string>>>"
    rest = [c for c in df.columns if c != column]
    items = df.select(*rest, F.inline(F.from_xml(column, schema)["channel"]["item"]))
    return items.select(*rest, F.trim("title").alias("title"), "link", F.coalesce("guid", "link").alias("guid"), F.col("pubDate").alias("published")).filter(F.col("title") != "")


def value_at(keys: Column, values: Column, key: Column) -> Column:
    """The value of a parallel array at a key's place, null where the key is missing."""
    place = F.array_position(keys, key)
    return F.when(place > 0, F.try_element_at(values, F.when(place > 0, place).cast("int")))


class _Cells(HTMLParser):
    """Rows of the cells of each table (or list), nesting ignored."""

    def __init__(self, row: str, cell: Sequence[str]):
        super().__init__(convert_charrefs=True)
        self.row, self.cell = row, cell
        self.rows: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == self.row:
            self.rows.append([])
        if tag in self.cell:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag):
        if tag in self.cell:
            self.open = False

    def handle_data(self, data):
        if self.open and self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def html_rows(df: DataFrame, key: str, column: str = "html", row: str = "tr", cell: Sequence[str] = ("td", "th")) -> DataFrame:
    """key, row_number (from 1, in document order), cells of every row of cells in an HTML document."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, numbers, cells = [], [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser = _Cells(row, cell)
                parser.feed(text or "")
                parser.close()
                for n, found in enumerate((r for r in parser.rows if r), 1):
                    keys.append(k)
                    numbers.append(n)
                    cells.append([c.strip() for c in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(cells, pa.list_(pa.string()))], names=[key, "row_number", "cells"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {kind.simpleString()}, row_number int, cells array<string>")


def checked_width(rows: DataFrame, width: int, cells: str = "cells") -> DataFrame:
    """The rows; fails on one that has another number of cells."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {width} cells, found "), F.size(cells).cast("string"))).cast("boolean")
    return rows.filter(F.when(F.size(cells) == width, F.lit(True)).otherwise(wrong))


def largest_table(rows: DataFrame, document: str, table: str) -> DataFrame:
    """Of each document the rows of its table with the most rows, the first of equals."""
    from tidemark.operators.relational import top_n

    best = top_n(rows.groupBy(document, table).agg(F.count(F.lit(1)).alias("__n")), [document], [F.desc("__n"), table], 1, "__rank")
    return rows.join(best.select(document, table), [document, table], "left_semi")


def flipped_name(name: Column) -> Column:
    """"Last, First" as "First Last"."""
    parts = F.split(name, ",\\s*", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(name)
