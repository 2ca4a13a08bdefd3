"""Reading inspection CSV files."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.session import stage

REQUIRED = {"INSP_DATE", "INSP_TIME"}
MEASURE_PREFIXES = ("A_L_", "A_R_", "X_L_", "X_R_")


def _lines(spark: SparkSession, patterns: str | Sequence[str]) -> DataFrame:
    """``(value, file_path, at_start)``: every line of the files matching one glob or several, each file once."""
    globs = [patterns] if isinstance(patterns, str) else list(dict.fromkeys(patterns))
    parts = []
    for number, glob in enumerate(globs):
        try:
            lines = spark.read.text(glob)
        except AnalysisException as err:  # a glob without a match
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        at_start = F.col("_metadata.file_block_start") == 0
        parts.append(lines.select("value", F.col("_metadata.file_path").alias("file_path"), at_start.alias("at_start"), F.lit(number).alias("glob")))
    if not parts:
        raise FileNotFoundError(f"no inspection file matches {patterns!r}")
    return reduce(DataFrame.unionByName, parts)


def file_headers(lines: DataFrame) -> DataFrame:
    """``(file_path, glob, line)``: each file's first line, and the first glob that matches it.

    Tasks reduce each file to one row. Files without any line have no header.
    """
    # Ids rise within a split, and only the split at the start of a file holds its first line.
    first = lines.filter("at_start").withColumn("at", F.monotonically_increasing_id())
    return first.groupBy("file_path").agg(F.min_by("value", F.struct("glob", "at")).alias("line"), F.min("glob").alias("glob"))


def columns_of(header: str | None) -> tuple[str, ...]:
    return tuple(next(csv.reader([header or ""]), ()))


def inspection_scan(spark: SparkSession, patterns: str | Sequence[str]) -> DataFrame:
    """All inspection rows of the matching CSV files, as text columns; measures as numbers.

    Files without the date and time columns are left out. Every line is parsed in its task by its own file's header, which
    it meets in a join on the file's name; only distinct header lines reach the driver, whatever the number of files. Columns are
    matched by name, and a column that a file lacks is null. Quotes inside a cell are doubled. A file that several globs match is read once. Blank
    lines, and lines that repeat their file's header, are no rows. Of columns with one name, a file's first counts.
    """
    lines = _lines(spark, patterns)
    headers = stage(file_headers(lines), "inspection-headers")
    known = {r["line"]: columns_of(r["line"]) for r in headers.select("line").distinct().toLocalIterator()}
    known = {line: columns for line, columns in sorted(known.items()) if set(columns) >= REQUIRED}
    if not known:
        raise FileNotFoundError("no inspection file has both INSP_DATE and INSP_TIME")
    names = list(dict.fromkeys(c for columns in known.values() for c in columns))
    # A line is parsed once, by position; its header then tells which cell a name stands for.
    width = max(map(len, known.values()))
    cells = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(width)), {"escape": '"'})
    rows = (
        lines.join(headers.filter(F.col("line").isin(*known)), ["file_path", "glob"])
        .filter((F.trim("value") != "") & (F.col("value") != F.col("line")))
        .select("line", cells.alias("cells"))
    )
    return rows.select(*(_cell(name, known).alias(name) for name in names))


def _cell(name: str, known: dict[str, tuple[str, ...]]) -> Column:
    places: dict[int, list[str]] = {}
    for line, columns in known.items():
        if name in columns:
            places.setdefault(columns.index(name), []).append(line)
    cell = F.coalesce(*(F.when(F.col("line").isin(*found), F.col(f"cells.c{i}")) for i, found in places.items()))
    return cell.try_cast("double") if name.startswith(MEASURE_PREFIXES) else cell
