"""Delimited text in: separator, cells, missing codes and numbers."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col

#: Texts that mean "missing", in lower case.
MISSING_CODES = (
    "", "na", "n/a", "nan", "null", "nulo", ".", "-", "--", "?", "nd", "s/d", "sd", "missing", "faltante", "#n/a", "#¡div/0!", "#value!", "#valor!",
)
SEPARATORS = (",", ";", "\t", "|")
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def sniff_separator(text: str) -> str:
    """The separator that splits the first line with content most often; a comma wins ties."""
    line = next((x for x in text.splitlines() if x.strip()), "")
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def is_missing(cell: Column) -> Column:
    """True for null and for the missing codes, whatever their case and surrounding blanks."""
    return cell.isNull() | F.lower(F.trim(cell.cast("string"))).isin(*MISSING_CODES)


def to_number(cell: Column, decimal: str = "auto") -> Column:
    """A cell as a double, or null.

    Blanks and one trailing per cent sign go. ``comma``: points go and the first comma is the decimal sign. ``auto``: so
    it is too where the text ends in a comma and one to three digits and no digit follows a point; elsewhere, and in
    other modes, commas go.
    """
    s = F.regexp_replace(F.regexp_replace(cell.cast("string"), r"[\s\u00a0]", ""), "%$", "")
    as_decimal = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    plain = F.replace(s, F.lit(","), F.lit(""))
    if decimal == "comma":
        s = as_decimal
    else:
        s = F.when(s.rlike(r",\d{1,3}$") & ~s.rlike(r"\.\d"), as_decimal).otherwise(plain) if decimal == "auto" else plain
    return F.when(~is_missing(cell) & s.rlike(_NUMBER) & (F.abs(s.try_cast("double")) < float("inf")), s.try_cast("double"))


class _Quotes:
    """Whether a quoted cell is open after a line, by whether one was open before it.

    A cell is quoted if a quote is its first sign; doubled quotes are part of it; what follows its end up to the separator
    belongs to it as well.
    """

    def __init__(self, separator: str):
        s = re.escape(separator)
        self.separator = separator
        self.inside, self.behind = re.compile(r'[^"]*+(?:""[^"]*+)*+'), re.compile(rf"[^{s}]*+")

    def after(self, line: str, quoted: bool) -> bool:
        if '"' not in line:
            return quoted
        at = 0
        while True:
            if quoted or line.startswith('"', at):
                at = self.inside.match(line, at if quoted else at + 1).end()
                if at == len(line):  # no quote ends the cell
                    return True
                at, quoted = at + 1, False
            at = self.behind.match(line, at).end()
            if at >= len(line):
                return False
            at += 1


@dataclass(frozen=True)
class _Block:
    """Where a byte range of a file begins: in a quoted cell or not, the records before it in its file and in all files."""

    quoted: bool
    before: int
    before_all: int


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the byte range that holds them; Spark cuts files into ranges and gives each line to the one where it begins."""
    return spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _blocks(lines: DataFrame, separator: str) -> dict[tuple[str, int], _Block]:
    """Each byte range's beginning, by a prefix scan: a range is a function from open-or-not to open-or-not and to records.

    One row for each range reaches the driver.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, held = _Quotes(separator), {}
        for batch in batches:
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = held.setdefault((file, start), [False, True, 0, 0])
                for i in (0, 1):
                    state[2 + i] += not state[i]
                    state[i] = quotes.after(line, state[i])
        keys = list(held)
        columns = [[k[0] for k in keys], [k[1] for k in keys], *[[held[k][i] for k in keys] for i in range(4)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "open0", "open1", "n0", "n1"])

    found = lines.mapInArrow(scan, "file string, start long, open0 boolean, open1 boolean, n0 long, n1 long").collect()
    out, file, quoted, before, before_all = {}, None, False, 0, 0
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        if r.file != file:
            file, quoted, before = r.file, False, 0
        out[r.file, r.start] = _Block(quoted, before, before_all)
        n = r.n1 if quoted else r.n0
        quoted, before, before_all = (r.open1 if quoted else r.open0), before + n, before_all + n
    return out


def records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(record, in_file, nth): the records of delimited files, their number in their file and in all of them from 0.

    A quoted cell may hold line ends. Byte ranges are read in parallel: a first pass finds whether each begins inside a
    quoted cell, a second one cuts records. A record of one line stays where it was read; the lines of others meet by the
    record's number, wherever ranges cut them.
    """
    lines = _lines(spark, path)
    begins = _blocks(lines, separator)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotes, held = _Quotes(separator), {}
        for batch in batches:
            out: list[tuple] = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = begins[file, start]
                state = held.setdefault((file, start), [block.quoted, 0, 0])
                was = state[0]
                state[0] = quotes.after(line, was)
                state[1] += not was
                state[2] += 1
                n = state[1] - 1  # -1: a record of an earlier range goes on
                out.append((line, block.before + n, block.before_all + n, start, state[2], not was and not state[0]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["line", "in_file", "nth", "start", "place", "whole"])

    pieces = lines.mapInArrow(cut, "line string, in_file long, nth long, start long, place long, whole boolean")
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "line")))
    joined = pieces.where("not whole").groupBy("in_file", "nth").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("record"))
    every = pieces.where("whole").select(F.col("line").alias("record"), "in_file", "nth").unionByName(joined)
    return every.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, *, row_number: bool = True) -> DataFrame:
    """A delimited file, or a folder of them, as trimmed-header string columns and ``_row``, the record's number; blank rows are dropped.

    Files are read by byte ranges, so a large one spreads over all tasks (``records``). The first file's first record
    names the columns, and each file's first record is left out. ``_row`` counts from 0 in the order of paths; blank rows and
    later files' headers leave gaps.

    Quoted cells may hold separators, doubled quotes and line ends. Empty names become V1, V2, ...; equal names get a
    number; cells beyond the header's are dropped, missing ones null. Lines end in line feeds, with or without a carriage
    return. A file without content gives no rows.
    """
    if separator is None:
        head = spark.read.text(path).where("trim(value) != ''").limit(1).collect()
        separator = sniff_separator(head[0].value if head else "")
    every = records(spark, path, separator)
    blank = r"^[\s\ufeff]*$"
    first = every.where("in_file = 0").orderBy("nth").limit(1).collect()
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1", "maxColumns": "1000000"}
    header = next(csv.reader(io.StringIO(first[0].record.removeprefix("\ufeff"), newline=""), delimiter=separator), [""]) if first else [""]
    names: list[str] = []
    for i, name in enumerate(header, 1):
        name = name.strip() or f"V{i}"
        names.append(name if name not in names else f"{name}_{i}")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = every.where((F.col("in_file") > 0) & ~F.col("record").rlike(blank)).select(F.from_csv("record", schema, options).alias("c"), "nth")
    df = cells.select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)], *([(F.col("nth") - 1).alias("_row")] if row_number else []))
    empty = F.lit(True)
    for n in names:
        empty = empty & (F.trim(F.coalesce(col(n), F.lit(""))) == "")
    return df.where(~empty)


def read_file(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A table by its file's ending: Parquet, ORC and JSON lines by Spark, workbooks by pandas, all else as delimited text.

    Typed sources get ``_row`` by their rows' place; its values rise in input order, with gaps.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("xls", "xlsx", "ods"):
        return read_workbook(spark, path)
    if ending in ("parquet", "orc", "json"):
        return getattr(spark.read, ending)(path).withColumn("_row", F.monotonically_increasing_id())
    return read_delimited(spark, path, separator)


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The first (or named) sheet of a workbook as string columns; needs a workbook engine for pandas."""
    import pandas as pd

    found = pd.read_excel(path, sheet_name=sheet, dtype=str, header=0).dropna(how="all")
    found.insert(0, "_row", range(len(found)))
    return spark.createDataFrame(found)


def simulated_leaves(spark: SparkSession, rows: int = 120, seed: int = 20260905) -> DataFrame:
    """Leaf measures from three latent factors with noise: ID, Site and nine measures, three cells missing."""
    factor = [F.randn(seed + i) for i in range(3)]
    base = spark.range(rows).select("id", *[f.alias(f"f{i}") for i, f in enumerate(factor)])
    names = ("length", "width", "area", "thickness", "density", "dry_mass", "chlorophyll", "nitrogen", "phosphorus")
    measures = [(20 + 3 * (i // 3) + 2.0 * F.col(f"f{i // 3}") + 0.6 * F.randn(seed + 10 + i)).alias(n) for i, n in enumerate(names)]
    df = base.select(F.col("id").alias("_row"), F.concat(F.lit("L"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("ID"), F.element_at(F.array(*[F.lit(s) for s in ("Forest", "Edge", "Open")]), (F.col("id") % 3 + 1).cast("int")).alias("Site"), *measures)
    for at, name in ((rows // 4, "width"), (rows // 2, "density"), (3 * rows // 4, "nitrogen")):
        df = df.withColumn(name, F.when(F.col("_row") != at, col(name)))
    return df


__all__ = ["MISSING_CODES", "is_missing", "read_delimited", "read_file", "read_workbook", "simulated_leaves", "sniff_separator", "to_number"]
