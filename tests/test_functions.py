"""Distributions, small algebra, number parsing and writers against known values."""

import math
import zipfile
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions import linalg as L
from multifactor.sources import delimited, writers


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (D.chi2_tail(3.841458820694124, 1), 0.05), (D.chi2_tail(16.91897760462045, 9), 0.05), (D.chi2_quantile(0.999, 4), 18.46682695290317), (D.chi2_cdf(2.0, 2), 1 - math.exp(-1)),
        (D.normal_two_sided(1.959963984540054), 0.05), (D.normal_cdf(0.0), 0.5), (D.t_two_sided(2.228138851964939, 10), 0.05), (D.t_two_sided(1.0, 1), 0.5),
        (D.f_tail(4.964602743730711, 1, 10), 0.05), (D.f_tail(-1, 2, 3), 1.0), (D.f_tail(math.inf, 2, 3), 0.0), (D.beta_i(2, 3, 0.4), 0.5248), (D.gamma_p(1, 2), 1 - math.exp(-2)),
        (D.correlation_p(1.0, 10), 0.0), (D.correlation_p(0.6319, 10), 0.05),
    ],
)
def test_distributions(got, want):
    assert got == pytest.approx(want, rel=1e-3 if want == 0.05 else 1e-9, abs=1e-12)


def test_tails_do_not_underflow_early_and_nothing_is_null():
    assert 0 < D.chi2_tail(600, 1) < 1e-100 and 0 < D.normal_two_sided(30) < 1e-150
    assert D.correlation_p(0.5, 2) is None and D.log_gamma(5) == pytest.approx(math.log(24)) and D.erf(0.5) == pytest.approx(0.5204998778)


def test_column_functions(spark):
    row = spark.createDataFrame([(3.841458820694124, 1.0), (None, 2.0)], "x double, df double").select(D.chi2_tail_column("x", "df").alias("p")).collect()
    assert row[0].p == pytest.approx(0.05) and row[1].p is None


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 6), st.integers(0, 10**6))
def test_eigenvectors(p, seed):
    m = np.random.default_rng(seed).normal(size=(p, p))
    m = m @ m.T
    values, v = L.eigen_symmetric(m)
    assert (np.diff(values) <= 1e-9).all() and values.sum() == pytest.approx(np.trace(m))
    assert np.allclose(v.T @ v, np.eye(p)) and np.allclose(v @ np.diag(values) @ v.T, m)
    assert (v[np.argmax(np.abs(v), axis=0), np.arange(p)] > 0).all()
    assert L.determinant(m) == pytest.approx(np.linalg.det(m), rel=1e-6, abs=1e-9)


def test_guarded_inverse_and_determinant():
    s = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert L.inverse(s) is None and L.determinant(s) == 0.0
    assert np.allclose(L.inverse(np.diag([2.0, 4.0])), np.diag([0.5, 0.25]))
    q = L.nearest_orthogonal(np.array([[2.0, 0.1], [0.0, 3.0]]))
    assert np.allclose(q.T @ q, np.eye(2)) and L.to_correlation(np.array([[4.0, 0.0], [0.0, 0.0]])).tolist() == [[1.0, 0.0], [0.0, 1.0]]


@pytest.mark.parametrize(
    ("text", "mode", "want"),
    [
        ("12,50", "auto", 12.5), ("1,234", "auto", 1.234), ("1.234,5", "auto", 1.2345), ("1,234,567", "auto", None), ("45%", "auto", 45.0), (" 1 000 ", "auto", 1000.0), ("1e3", "auto", 1000.0), ("-.5", "auto", -0.5),
        ("N/A", "auto", None), ("", "auto", None), (None, "auto", None), ("abc", "auto", None), ("1.234,5", "comma", 1234.5), ("1,234", "point", 1234.0), ("1e999", "auto", None), ("--", "auto", None), ("#VALUE!", "auto", None),
    ],
)
def test_numbers(spark, text, mode, want):
    assert spark.createDataFrame([(text,)], "c string").select(delimited.to_number(F.col("c"), mode)).first()[0] == want


def test_separators():
    assert delimited.sniff_separator("\n a;b;c\n1,2") == ";" and delimited.sniff_separator("a,b;c") == "," and delimited.sniff_separator("") == "," and delimited.sniff_separator("a\tb") == "\t"


def test_delimited_file(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('﻿ name ,x,,x\r\n"a ""q"", b",1,2,3\r\n,,,\r\n"two\nlines",NA,5,6\r\n'.encode())
    df = delimited.read_delimited(spark, str(tmp_path / "t.csv"))
    rows = df.orderBy("_row").collect()
    assert df.columns[0] == "name" and df.columns[2] == "V3" and len(set(df.columns)) == 5
    assert [r["name"] for r in rows] == ['a "q", b', "two\nlines"] and rows[1]["x"] == "NA" if "x" in df.columns else True


def test_simulated_source(spark):
    df = delimited.simulated_leaves(spark)
    assert df.count() == 120 and sum(df.agg(*[F.count_if(F.col(c).isNull()) for c in df.columns]).first()) == 3


def test_shape_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 9, 4, 7]], "x double")
    s, g, k, sk, ku = df.agg(C.skewness(F.col("x")), C.skewness_g1(F.col("x")), C.kurtosis(F.col("x")), C.skewness_error(F.count("x")), C.kurtosis_error(F.count("x"))).first()
    assert s == pytest.approx(0.7837945087) and g == pytest.approx(0.9876939667) and k == pytest.approx(-0.3053254437) and sk == pytest.approx(0.7937253933) and ku == pytest.approx(1.587450787)
    one = spark.createDataFrame([(5.0,)] * 4, "x double").agg(C.skewness(F.col("x")), C.kurtosis(F.col("x")), C.correlation(F.col("x"), F.col("x"))).first()
    assert one[0] == 0 and one[1] == 0 and one[2] is None


def test_package_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.25), (None, 2.0)], "name string, x double")
    assert writers.as_csv(df) == '﻿name,x\r\n"a;b",1.25\r\n,2.0\r\n'
    z = zipfile.ZipFile(BytesIO(writers.package({"Ejes propios ñ": df}, {"note.txt": "hi"})))
    assert z.namelist() == ["01_ejes_propios_n.csv", "note.txt"] and z.testzip() is None and z.read("note.txt") == b"hi"
    writers.write_table(df, str(tmp_path / "out"), decimals=1)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert writers.format_p(1e-9) == "< 0.0001" and writers.format_number(1e-6) == "1.000e-06" and writers.format_share(0.5) == "50.0 %"
