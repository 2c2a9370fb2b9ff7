"""Rows that repeat a hundred thousand times, in operators that join results back to whole rows."""

from pyspark.sql import functions as F

from multifactor.llm import lines


def test_many_equal_rows_keep_one_whole_copy(spark):
    run = "\n".join(f"line {i} of a licence that everyone copies" for i in range(12))
    many = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit(run).alias("a `text`"), F.lit("x").alias("spans"))
    one = spark.createDataFrame([(1, f"own words\n{run}", "y"), (2, None, "z"), (3, "", "z")], "doc_id int, `a ``text``` string, spans string")
    found = lines.drop_repeated_lines(many.unionByName(one), text="a `text`")
    assert found.columns == ["doc_id", "a `text`", "spans"]
    got = {(r.doc_id, r[1]): r["n"] for r in found.groupBy("doc_id", "`a ``text```").agg(F.count("*").alias("n")).collect()}
    whole = [k for k in got if k[1] is not None and run in k[1]]
    assert sum(got.values()) == 100_003 and len(whole) == 1 and got[whole[0]] == 1 and got[2, None] == 1 and got[3, ""] == 1
