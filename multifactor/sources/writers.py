"""Result tables out: delimited files and a package of named tables."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one table in a package at most; larger tables are written by ``write_table``.
PACKAGE_ROWS = 100_000


def write_table(df: DataFrame, path: str, *, decimals: int | None = None) -> None:
    """Write delimited text with a header, quoted where needed, one file for each task."""
    if decimals is not None:
        df = df.select(*[F.round(f.name, decimals).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8")


def escaped(value: object) -> str:
    """One cell, quoted if it holds a quote, comma, semicolon or line end."""
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if re.search(r'[",;\r\n]', text) else text


def as_csv(df: DataFrame) -> str:
    """A small table as text with byte-order mark and CRLF line ends."""
    rows = df.limit(PACKAGE_ROWS + 1).collect()
    if len(rows) > PACKAGE_ROWS:
        raise ValueError(f"a packaged table has at most {PACKAGE_ROWS} rows; use write_table")
    return "﻿" + "\r\n".join(",".join(map(escaped, r)) for r in [df.columns, *map(tuple, rows)]) + "\r\n"


def slug(name: str) -> str:
    """A name for files: ASCII letters, digits and underscores."""
    flat = unicodedata.normalize("NFD", name).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "_", flat).strip("_")


def package(tables: Mapping[str, DataFrame], texts: Mapping[str, str] | None = None) -> bytes:
    """A stored ZIP of small tables as CSV, numbered in order, and of texts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i, (name, df) in enumerate(tables.items(), 1):
            z.writestr(f"{i:02d}_{slug(name)}.csv", as_csv(df))
        for name, text in (texts or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def format_p(p: float | None) -> str:
    """A p-value for display."""
    return "" if p is None else "< 0.0001" if p < 1e-4 else f"{p:.4f}"


def format_number(x: float | None, digits: int = 3) -> str:
    """A number for display; an exponent outside [1e-4, 1e7)."""
    if x is None:
        return ""
    return f"{x:.{digits}e}" if x and not 1e-4 <= abs(x) < 1e7 else f"{x:,.{digits}f}"


def format_share(x: float | None, digits: int = 1) -> str:
    """A share as per cent."""
    return "" if x is None else f"{100 * x:.{digits}f} %"
