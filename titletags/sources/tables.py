"""Title tables and span outputs as text files."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titletags.operators.ordered import PRECEDING
from titletags.session import shared_base

TAGGED_SCHEMA = "record_number long, title string, token string, tag string"
TITLES_SCHEMA = "record_number long, title string"
SPANS_SCHEMA = "record_number long, aspect string, value string"


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Tagged titles, one row per word, with the file order as `row_idx`."""
    return _read(spark, path, TAGGED_SCHEMA)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles to score or without labels, one row per record."""
    return _read(spark, path, TITLES_SCHEMA)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose lines all fit the schema. Quotes are plain characters; only an empty
    field is missing; fields missing at the end of a line are empty. A line with too many
    fields, or with a record number that is no number, ends the job."""
    rows = (
        spark.read.schema(f"{schema}, _line string")
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("columnNameOfCorruptRecord", "_line")
        .csv(path)
    )
    first, *rest = [c for c in rows.columns if c != "_line"]
    tabs = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit("\t"), F.lit("")))
    wrong = F.col("_line").isNotNull() & (
        (tabs > len(rest)) | (F.col(first).isNull() & ~F.startswith("_line", F.lit("\t")))
    )
    message = F.concat(F.lit("malformed line: "), "_line")
    checked = F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.col(first))
    return with_row_index(rows, columns=[checked.alias(first), *rest])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text output with their 1-based number."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return with_row_index(lines, out="line_no").withColumn("line_no", F.col("line_no") + 1)


def with_row_index(rows: DataFrame, out: str = "row_idx",
                   columns: Sequence[Column | str] | None = None) -> DataFrame:
    """0-based row number of a just-read file table, in path and line order.

    The rows are written once, each with its file, the start of its split and a running
    id that is comparable within a split. The first id and the row count of each split
    are taken from that copy, so they fit it whatever the splits of another read would
    be, and the counts of the splits before it are added. No row is shuffled: the split
    table, which has one row per split, is broadcast. Files are ordered by folder, then by the number of the
    part as a number, then by name.
    """
    names = [c for c in rows.columns if c != "_line"]
    placed = materialise(rows.select(
        *(columns or names),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    ), compression="zstd")
    splits = placed.groupBy("_path", "_start").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    folder = F.regexp_replace("_path", "[^/]*$", "")
    part = F.regexp_extract("_path", "part-([0-9]+)[^/]*$", 1).try_cast("decimal(38,0)")
    before = Window.orderBy(folder, part, "_path", "_start").rowsBetween(*PRECEDING)
    shifts = splits.select(
        "_path", "_start",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return placed.join(F.broadcast(shifts), ["_path", "_start"]).select(
        *names, (F.col("_id") + F.col("_shift")).alias(out)
    )


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# What is being written with FREED, and what it was before, per session.
_writing: dict[int, tuple[int, str]] = {}
_counting = threading.Lock()


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written here goes when it has been written. Nothing
    reads it again, but else it stays on disk until the driver happens to collect its garbage."""
    session = spark._jsparkSession.hashCode()
    with _counting:
        n, before = _writing.get(session) or (0, spark.conf.get(FREED, "false"))
        spark.conf.set(FREED, "true")
        _writing[session] = (n + 1, before)
    try:
        yield
    finally:
        with _counting:
            n, before = _writing.pop(session)
            if n > 1:
                _writing[session] = (n - 1, before)
            else:
                spark.conf.set(FREED, before)


def write_spans(spans: DataFrame, path: str, mode: str = "error",
                order: tuple[str, ...] = ("record_number", "span_no"),
                compression: str = "none", dealt: bool = False) -> None:
    """Write spans as tab-separated lines without header, in record order. Where they are
    `dealt` out already, so that partitions follow each other in this order, none is shuffled."""
    ordered = spans.sortWithinPartitions(*order) if dealt else spans.orderBy(*order)
    with shuffles_freed(spans.sparkSession):
        (
            ordered.select("record_number", "aspect", "value")
            .write.mode(mode)
            .option("compression", compression)
            .option("sep", "\t")
            .option("escape", '"')
            .option("lineSep", "\r\n")
            .option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Spans as written by `write_spans`."""
    return (
        spark.read.schema(SPANS_SCHEMA)
        .option("sep", "\t")
        .option("escape", '"')
        .option("lineSep", "\r\n")
        .csv(path)
    )


def write_table(rows: DataFrame, path: str, mode: str = "error",
                compression: str = "none") -> None:
    """Write a title table in the form `read_tagged` and `read_titles` expect."""
    with shuffles_freed(rows.sparkSession):
        (
            rows.write.mode(mode)
            .option("compression", compression)
            .option("sep", "\t")
            .option("header", True)
            .option("quote", "")
            .option("emptyValue", "")
            .option("nullValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )


def head(rows: DataFrame, n: int, order: str = "row_idx") -> DataFrame:
    """The first n rows in file order."""
    return rows.orderBy(order).limit(n)


def row_count(rows: DataFrame, out: str = "n") -> DataFrame:
    return rows.agg(F.count("*").alias(out))


def records_above(titles: DataFrame, lowest: int, record: str = "record_number") -> DataFrame:
    """Records numbered above `lowest`: the part of the list kept for pseudo-labels."""
    return titles.filter(F.col(record) > lowest)


# Folders handed out so far, per application.
_folders: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder for an intermediate table below the session's shared folder."""
    path = f"{shared_base(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_intermediate(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application; returns their number.

    To be called when the results built on them have been written or collected.
    """
    paths = _folders.pop(spark.sparkContext.applicationId, [])
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in paths:
        path = hadoop.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def materialise(rows: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, which ends its lineage."""
    path = shared_folder(rows.sparkSession)
    with shuffles_freed(rows.sparkSession):
        rows.write.parquet(path, compression=compression)
    return rows.sparkSession.read.parquet(path)
