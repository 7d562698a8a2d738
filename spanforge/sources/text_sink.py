"""Ordered text of any size: lines dealt by ranges, sorted within them and written as text files.

The files of a folder, in the order of their names, are the text. No line passes through the
driver, and no task orders all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, order: list[str | Column], path: str, line: str = "line") -> None:
    """Writes the column ``line`` in ``order``."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines in their order, one file at a time."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    for r in rows.orderBy("file", "block", "id").toLocalIterator():
        yield r["value"]


def markdown_lines(rows: DataFrame, title: str, order: list[str]) -> tuple[DataFrame, list[str]]:
    """(part, order..., line) of a table as Markdown, and the columns that order it: the title and head first, then a line a row."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.format_string("%.6g", c.cast("double")) if kind in ("double", "float") else c.cast("string")
        return F.coalesce(F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\n", " "), F.lit(""))

    body = rows.select(F.lit(1).alias("part"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)], F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(*c) for c in rows.dtypes]), F.lit(" |")).alias("line"))
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    spark = rows.sparkSession
    top = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "part int, line string")
    places = ["part", *[f"_{i}" for i in range(len(order))]]
    return top.unionByName(body, allowMissingColumns=True), places


def write_report(sections: list[tuple[str, DataFrame, list[str]]], path: str) -> None:
    """A report of tables (title, rows, their order), each in a numbered folder of its own, with all its rows."""
    for k, (title, rows, order) in enumerate(sections):
        lines, places = markdown_lines(rows, title, order)
        write_lines(lines, places, f"{path}/{k:04d}")
