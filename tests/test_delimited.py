"""Delimited text by byte ranges against the serial reader, cut at every place."""

import random

import pytest

from multifactor.sources.delimited import _Quotes, read_delimited

PLAIN = 'id,"the ""text""",c\r\n1,"two\nlines, and ""quotes""",3\r\n\r\n4,5" pipe,"x\ny,"\r\n"only ""one""\n\n",,\r\n  ,\r\n"a"b,"c""",z\r\n7,8,9,10\r\n11\r\n"last\n"",",é漢,"1"\r\n'


def serial(spark, path):
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False).collect()
    return sorted([tuple(r) for r in rows if any((c or "").strip() for c in r)], key=str)


@pytest.mark.parametrize("text", [PLAIN, "﻿" + PLAIN.replace("\r\n", "\n").rstrip("\n")])
@pytest.mark.parametrize("size", [1, 2, 7, 1 << 20])
def test_rows_equal_the_serial_readers_at_every_cut(spark, tmp_path, text, size):
    (tmp_path / "x.csv").write_text(text, newline="")
    want = serial(spark, str(tmp_path / "x.csv"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        df = read_delimited(spark, str(tmp_path / "x.csv"))
        assert df.columns == ["id", 'the "text"', "c", "_row"]
        rows = df.orderBy("_row").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted([tuple(r)[:3] for r in rows], key=str) == want
    assert [r["id"] for r in rows][:2] == ["1", "4"] and rows[0]["_row"] == 0 and rows[-1]["id"] == 'last\n",'


def test_folders_leave_out_each_files_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"a;b\n{i};\"x\n{i}\"\n\n{i}0;y\n", newline="")
    rows = read_delimited(spark, str(tmp_path)).orderBy("_row").collect()
    assert [(r.a, r.b) for r in rows] == [("0", "x\n0"), ("00", "y"), ("1", "x\n1"), ("10", "y"), ("2", "x\n2"), ("20", "y")] and len({r["_row"] for r in rows}) == 6


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a,,a\n")
    assert read_delimited(spark, str(tmp_path / "none.csv")).count() == 0
    head = read_delimited(spark, str(tmp_path / "head.csv"))
    assert head.columns == ["a", "V2", "a_3", "_row"] and head.count() == 0


def test_open_cells_by_both_beginnings():
    """The function of a line, composed over cuts, is that of reading on."""
    rng, quotes = random.Random(1), _Quotes(",")

    def slow(line, quoted):
        begins = not quoted
        i = 0
        while i < len(line):
            if quoted:
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        quoted, begins = False, False
            elif line[i] == ",":
                begins = True
                i += 1
                continue
            elif line[i] == '"' and begins:
                quoted = True
            begins = False
            i += 1
        return quoted

    for _ in range(3000):
        line = "".join(rng.choice('",,ab"') for _ in range(rng.randrange(12)))
        for state in (False, True):
            assert quotes.after(line, state) == slow(line, state), (line, state)
