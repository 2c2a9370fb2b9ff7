"""Queries of profiles, preparation, correlations and tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions import columns as C
from multifactor.functions import distributions as D
from multifactor.functions.columns import col
from multifactor.operators import adequacy, inference, layouts, prepare, profile
from multifactor.operators.quantiles import group_quantiles
from multifactor.operators.storage import new_path
from multifactor.plans.common import MEASURES, MEASURES_SQL, as_rows, measures, rounded, table
from multifactor.sources.delimited import is_missing, read_delimited, to_number

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _skew(x: str) -> str:
    return f"case when stddev_samp({x}) > 0 then skewness({x}) * power((count({x}) - 1.0) / count({x}), 1.5) else 0 end"


_PROFILE_ONE = """select '{c}' as name, cast(count({c}) as bigint) as n, cast(count(*) - count({c}) as bigint) as missing, cast(count(distinct {c}) as bigint) as "distinct",
  round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd, round(min({c}), 4) as min, round(max({c}), 4) as max, round(quantile_cont({c}, 0.5), 4) as median,
  round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.75), 4) as q3, round(100 * stddev_samp({c}) / abs(avg({c})), 4) as cv,
  round({skew}, 4) + 0.0 as skew, round(kurtosis({c}), 4) + 0.0 as kurt,
  cast(sum(case when abs({c} - m) / s > 3 then 1 else 0 end) as bigint) as outliers from {t}, (select avg({c}) as m, stddev_samp({c}) as s from {t})"""
_LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" union all ".join(_PROFILE_ONE.format(c=c, t="lineitem", skew=_skew(c)) for c in _LINE_COLUMNS))
def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of lineitem's numbers."""
    found = profile.profile(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS)
    return rounded(found.select("name", "n", "missing", "distinct", "mean", "sd", "min", "max", "median", "q1", "q3", "cv", "skew", "kurt", "outliers"), 4)


@query("""select r.name, r.role from (
  select 'p_name' as name, case when count(distinct p_name) = count(p_name) then 'id' when count(distinct p_name) > 30 then 'excluded' else 'supp-cat' end as role from part
  union all select 'p_brand', case when count(distinct p_brand) = count(p_brand) then 'id' when count(distinct p_brand) > 30 then 'excluded' else 'supp-cat' end from part
  union all select 'p_type', case when count(distinct p_type) = count(p_type) then 'id' when count(distinct p_type) > 30 then 'excluded' else 'supp-cat' end from part
  union all select 'p_size', case when stddev_samp(p_size) = 0 then 'excluded' when count(distinct p_size) <= least(8, greatest(2, floor(count(*) * 0.05 + 0.5))) then 'supp-cat' else 'active' end from part
  union all select 'p_retailprice', case when stddev_samp(p_retailprice) = 0 then 'excluded' else 'active' end from part) r""")
def suggested_roles_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role that each column of part would have."""
    return profile.profile(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).select("name", "role")


@query("""select name, flag from (
  select 'value' as name, case when abs({s}) > 2 then 'very skewed' when abs({s}) > 1 then 'skewed' else 'no alerts' end as flag from events
  union all select 'user_id', case when abs({u}) > 2 then 'very skewed' when abs({u}) > 1 then 'skewed' else 'no alerts' end from events)""".format(s=_skew("value"), u=_skew("user_id")))
def skew_flags_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness alerts of the events' numbers."""
    found = profile.flags(profile.profile(table(spark, sf_dir, "events"), ["value", "user_id"]))
    skew = F.filter("flags", lambda f: f.isin("very skewed", "skewed"))
    return found.select("name", F.when(F.size(skew) > 0, skew[0]).otherwise("no alerts").alias("flag"))


@query("select trim(event_type) as level, cast(count(*) as bigint) as n, cast(min(event_id) as bigint) as first from events where event_type is not null group by 1")
def level_counts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of event_type by first appearance."""
    return profile.levels(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""select count(*) filter (lang is not null) as lang, count(*) filter (source is not null) as source, count(*) filter (text is not null and lower(trim(text)) not in
  ('','na','n/a','nan','null','nulo','.','-','--','?','nd','s/d','sd','missing','faltante','#n/a','#¡div/0!','#value!','#valor!')) as text from documents""")
def missing_map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present cells of the documents' columns, from their presence map."""
    found = prepare.missing_map(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_row"), ["lang", "source", "text"])
    return found.agg(*[F.count_if(c).alias(c) for c in ("lang", "source", "text")])


@query("""select l_orderkey, l_linenumber, l_quantity / 10 as tenth, l_tax as share, cast(null as double) as bad from lineitem""")
def parsed_numbers_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written with decimal commas, per cent signs and thousands, read back."""
    rows = table(spark, sf_dir, "lineitem")
    comma = F.replace((F.col("l_quantity") / 10).cast("string"), F.lit("."), F.lit(","))
    return rows.select("l_orderkey", "l_linenumber", to_number(comma).alias("tenth"), to_number(F.concat(F.lit(" "), F.col("l_tax").cast("string"), F.lit("%"))).alias("share"), to_number(F.lit("1,234,567")).alias("bad"))


_SCALES = {
    "none": ("quantity", "price"), "center": ("quantity - mq", "price - mp"), "z": ("(quantity - mq) / sq", "(price - mp) / sp"),
    "pareto": ("(quantity - mq) / sqrt(sq)", "(price - mp) / sqrt(sp)"), "vast": ("(quantity - mq) / (sq * sq / mq)", "(price - mp) / (sp * sp / mp)"),
    "range": ("(quantity - lq) / (hq - lq)", "(price - lp) / (hp - lp)"), "robust": ("(quantity - dq) / (1.4826 * aq)", "(price - dp) / (1.4826 * ap)"),
}
_FIGURES = """f as (select avg(quantity) mq, avg(price) mp, stddev_samp(quantity) sq, stddev_samp(price) sp, min(quantity) lq, min(price) lp, max(quantity) hq, max(price) hp,
  quantile_cont(quantity, 0.5) dq, quantile_cont(price, 0.5) dp from li), g as (select quantile_cont(abs(quantity - dq), 0.5) aq, quantile_cont(abs(price - dp), 0.5) ap from li, f)"""


def _scaling(how: str):
    def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = prepare.prepare(measures(spark, sf_dir), prepare.Roles(["quantity", "price"]), scaling=how)
        return rounded(found.frame.select("_row", "quantity", "price"), 5)

    scaled.__name__ = f"scaling_{how}"
    scaled.__doc__ = f"Quantity and price of every line, scaled: {how}."
    q, p = _SCALES[how]
    query(f"with {MEASURES_SQL}, {_FIGURES} select _row, round({q}, 5) + 0.0 as quantity, round({p}, 5) + 0.0 as price from li, f, g")(scaled)


for _how in _SCALES:
    _scaling(_how)

_TRANSFORMS = {"log": "ln(x + case when m <= 0 then 1 - m else 0 end)", "log10": "log10(x + case when m <= 0 then 1 - m else 0 end)", "sqrt": "sqrt(x + case when m < 0 then -m else 0 end)", "inverse": "1 / (x + case when m <= 0 then 1 - m else 0 end)"}


def _transform(how: str):
    def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "_row")
        found = prepare.prepare(rows, prepare.Roles(["c_acctbal"]), transform=how, scaling="none")
        return rounded(found.frame.select("_row", "c_acctbal"), 6)

    transformed.__name__ = f"transform_{how}"
    transformed.__doc__ = f"Customers' balances (negative ones shift it) transformed: {how}."
    query(f"select c_custkey as _row, round({_TRANSFORMS[how].replace('x +', 'c_acctbal +')}, 6) + 0.0 as c_acctbal from customer, (select min(c_acctbal) m from customer)")(transformed)


for _how in _TRANSFORMS:
    _transform(_how)


@query("""select event_id as _row, round(coalesce(case when event_id % 7 = 0 then null else value end, m), 5) + 0.0 as value
  from events, (select quantile_cont(value, 0.5) m from events where event_id % 7 <> 0)""")
def imputed_median_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with every seventh event's made missing and filled with the median."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("_row"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.lit(1.0).alias("one"))
    found = prepare.prepare(rows, prepare.Roles(["value", "one"]), missing="median", scaling="none")
    return rounded(found.frame.select("_row", "value"), 5)


@query("""select event_id as _row, round(value, 5) + 0.0 as value, concat('Ind ', event_id + 1) as label from events where event_id % 7 <> 0""")
def listwise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with incomplete rows left out, and their labels."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("_row"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    found = prepare.prepare(rows, prepare.Roles(["value"]), scaling="none")
    return rounded(found.frame.select("_row", "value", F.col("_id").alias("label")), 5)


@query(f"""select l_returnflag, round({_skew('l_extendedprice')}, 6) + 0.0 as skew, round(skewness(l_extendedprice), 6) + 0.0 as skew_g1, round(kurtosis(l_extendedprice), 6) + 0.0 as kurt,
  round(sqrt(6.0 * count(*) * (count(*) - 1) / ((count(*) - 2.0) * (count(*) + 1) * (count(*) + 3))), 6) as skew_error,
  round(2 * sqrt(6.0 * count(*) * (count(*) - 1) / ((count(*) - 2.0) * (count(*) + 1) * (count(*) + 3))) * sqrt((count(*) * count(*) - 1.0) / ((count(*) - 3.0) * (count(*) + 5))), 6) as kurt_error,
  round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) as iqr from lineitem group by 1""")
def shape_by_returnflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewness, kurtosis, their errors and the interquartile range of prices by return flag."""
    x, n = col("l_extendedprice"), F.count(F.lit(1))
    lines = table(spark, sf_dir, "lineitem")
    shapes = lines.groupBy("l_returnflag").agg(*[F.round(e, 6).alias(name) for name, e in (("skew", C.skewness(x)), ("skew_g1", C.skewness_g1(x)), ("kurt", C.kurtosis(x)), ("skew_error", C.skewness_error(n)), ("kurt_error", C.kurtosis_error(n)))])
    quartiles = group_quantiles(lines, x, col("l_returnflag"), [0.25, 0.75]).select("_g", F.round(F.col("q1") - F.col("q0"), 4).alias("iqr"))
    met = shapes.join(quartiles, F.col("l_returnflag").eqNullSafe(F.col("_g")), "left")
    return met.select("l_returnflag", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("skew", "skew_g1", "kurt", "skew_error", "kurt_error", "iqr")])


def _pairs_sql(f: str) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, round({f.format(a=a, b=b)}, 6) + 0.0 as r from li" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :])


@query(f"with {MEASURES_SQL} {_pairs_sql('corr({a}, {b})')}")
def pearson_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of lineitem's measures."""
    return rounded(inference.pairwise_correlations(measures(spark, sf_dir), MEASURES))


@query("""with r as (select rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as a, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as b from part)
  select 'p_size' as a, 'p_retailprice' as b, round(corr(a, b), 6) + 0.0 as r from r""")
def spearman_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of size and price."""
    return rounded(inference.spearman(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]))


@query("select p_partkey, cast(rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as double) as size_rank from part")
def average_ranks_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank of each part's size."""
    return inference.average_ranks(table(spark, sf_dir, "part"), ["p_size"]).select("p_partkey", F.col("p_size_rank").alias("size_rank"))


@query(f"with {MEASURES_SQL} select a, b, round(v, 2) + 0.0 as v from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, covar_samp({a}, {b}) as v from li" for a in MEASURES[:3] for b in MEASURES[:3]) + ")")
def covariances_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance matrix of three measures, from the centred Gram matrix."""
    from multifactor.operators.moments import gram, moments

    df, names = measures(spark, sf_dir), MEASURES[:3]
    g, n = gram(df, [col(c) for c in names], moments(df, names).mean)
    return rounded(as_rows(spark, "a string, b string, v double", [(a, b, float(g[i, j] / (n - 1))) for i, a in enumerate(names) for j, b in enumerate(names)]), 2)


@query("""with f as (select min(o_totalprice) l, max(o_totalprice) h, least(30, greatest(5, ceil(sqrt(count(*))))) k from orders),
  c as (select cast(least(floor((o_totalprice - l) / ((h - l) / k)), k - 1) as integer) as bin, count(*) as n from orders, f group by 1)
  select cast(b.i as integer) as bin, round(l + b.i * (h - l) / k, 4) as low, round(l + (b.i + 1) * (h - l) / k, 4) as high, cast(coalesce(c.n, 0) as bigint) as n
  from f, unnest(range(cast(k as bigint))) as b(i) left join c on c.bin = b.i""")
def histogram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the orders' totals."""
    return rounded(inference.histogram(table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("""with q as (select o_orderstatus as g, quantile_cont(o_totalprice, 0.25) q1, quantile_cont(o_totalprice, 0.5) md, quantile_cont(o_totalprice, 0.75) q3 from orders group by 1)
  select g as "group", round(q1, 4) as q1, round(md, 4) as median, round(q3, 4) as q3, round(min(o_totalprice) filter (o_totalprice >= q1 - 1.5 * (q3 - q1) and o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) as whisker_low,
  round(max(o_totalprice) filter (o_totalprice >= q1 - 1.5 * (q3 - q1) and o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) as whisker_high,
  cast(count(*) filter (not (o_totalprice >= q1 - 1.5 * (q3 - q1) and o_totalprice <= q3 + 1.5 * (q3 - q1))) as bigint) as outside from orders join q on o_orderstatus = g group by g, q1, md, q3""")
def box_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-plot figures of the orders' totals by status."""
    return rounded(inference.box_summary(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus"), 4)


@query("""with g as (select o_orderpriority g, count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) v from orders group by 1), t as (select sum(n) n, sum(n * m) / sum(n) m, count(*) k, sum(n * v) w from g),
  s as (select sum(g.n * (g.m - t.m) * (g.m - t.m)) b from g, t)
  select round(b / (k - 1) / (w / (n - k)), 5) as f, cast(k - 1 as bigint) as df1, cast(n - k as bigint) as df2, round(b / (b + w), 8) as eta2,
  round(greatest(0, (b - (k - 1) * (w / (n - k))) / (b + w + w / (n - k))), 8) + 0.0 as omega2,
  round(power(w / (b + w), (n - k) / 2.0) * (1 + (n - k) / 2.0 * (b / (b + w))), 8) as p from s, t""")
def anova_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the orders' totals differ between five priorities? (The p-value has a closed form at four degrees of freedom.)"""
    f = inference.anova(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return as_rows(spark, "f double, df1 long, df2 long, eta2 double, omega2 double, p double", [(round(f["F"], 5), f["df1"], f["df2"], round(f["eta2"], 8), round(f["omega2"], 8) + 0.0, round(f["p"], 8))])


@query("""with r as (select o_orderpriority g, o_totalprice v, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as r from orders),
  s as (select g, count(*) n, sum(r) s from r group by 1), t as (select sum(n) n, sum(s * s / n) q, count(*) k from s), ties as (select sum(cast(c as double) * c * c - c) x from (select count(*) c from r group by v)),
  f as (select (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - x / (cast(n as double) * n * n - n)) h, k from t, ties)
  select round(h, 4) as h, cast(k - 1 as bigint) as df, round(exp(-h / 2) * (1 + h / 2), 6) as p from f""")
def kruskal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by ranks."""
    f = inference.kruskal(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return as_rows(spark, "h double, df long, p double", [(round(f["H"], 4), f["df"], round(f["p"], 6))])


_CELLS = """t as (select o_orderstatus a, o_orderpriority b, count(*) n from orders group by 1, 2), ra as (select a, sum(n) x from t group by 1), rb as (select b, sum(n) y from t group by 1), tn as (select sum(n) s from t),
  c as (select ra.a, rb.b, coalesce(t.n, 0) o, ra.x * rb.y / cast(s as double) e from ra cross join rb cross join tn left join t on t.a = ra.a and t.b = rb.b), d as (select *, (o - e) / sqrt(e) r from c)"""


@query(f"with {_CELLS} select a, b, cast(o as double) as observed, round(e, 6) as expected, round(r, 6) + 0.0 as residual, round(100 * r * r / (select sum(r * r) from d), 6) + 0.0 as contribution from d")
def contingency_cells_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by priority: observed, expected, residual and contribution of each cell."""
    return rounded(inference.cells(inference.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"), empty=True))


@query(f"""with {_CELLS} select round(sum(r * r), 5) as chi2, cast((count(distinct a) - 1) * (count(distinct b) - 1) as bigint) as df, round(sum(r * r) / sum(o), 8) as inertia, round(min(e), 5) as least_expected,
  cast(count(*) filter (e < 5) as bigint) as low_cells, round(sqrt(sum(r * r) / (sum(o) * (least(count(distinct a), count(distinct b)) - 1))), 7) as cramer,
  round(exp(-sum(r * r) / 2) * (1 + sum(r * r) / 2 + power(sum(r * r), 2) / 8 + power(sum(r * r), 3) / 48), 6) as p from d""")
def chi_square_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square figures and Cramer's V of that table, which has eight degrees of freedom."""
    orders = table(spark, sf_dir, "orders")
    f = inference.chi2_of(inference.contingency(orders, "o_orderstatus", "o_orderpriority"))
    v = inference.cramer(orders, ["o_orderstatus", "o_orderpriority"]).first().v
    return as_rows(spark, "chi2 double, df long, inertia double, least_expected double, low_cells long, cramer double, p double", [(round(f["chi2"], 5), f["df"], round(f["inertia"], 8), round(f["least_expected"], 5), f["low_cells"], round(v, 7), round(f["p"], 6))])


_FLAGS_SQL = "f as (select l_returnflag, l_linestatus, case when l_quantity > 25 then 'many' else 'few' end as amount, cast(l_discount as varchar) as discount from lineitem)"
_FLAGS = ["l_returnflag", "l_linestatus", "amount", "discount"]
_PAIR_SQL = """select '{a}' as a, '{b}' as b, round(sqrt(greatest(sum(n * cast(n as double) / (x * cast(y as double))) - 1, 0) / (least(count(distinct a), count(distinct b)) - 1)), 6) + 0.0 as v
  from (select *, sum(n) over (partition by a) as x, sum(n) over (partition by b) as y from (select {a} as a, {b} as b, count(*) as n from f group by 1, 2))"""


@query(f"with {_FLAGS_SQL} " + " union all ".join(_PAIR_SQL.format(a=a, b=b) for i, a in enumerate(_FLAGS) for b in _FLAGS[i + 1 :]))
def cramer_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cramer's V of all pairs of four labels, from one count of their cells."""
    amount = F.when(F.col("l_quantity") > 25, "many").otherwise("few")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", amount.alias("amount"), F.col("l_discount").alias("discount"))
    return rounded(inference.cramer(rows, _FLAGS))


@query("""with f as (select cast(l_returnflag = 'R' as integer) as flag, l_extendedprice as price, l_quantity as quantity from lineitem),
  r as (select *, rank() over (order by flag) + (count(*) over (partition by flag) - 1) / 2.0 as a, rank() over (order by price) + (count(*) over (partition by price) - 1) / 2.0 as b, rank() over (order by quantity) + (count(*) over (partition by quantity) - 1) / 2.0 as c from f)
  select 'flag' as a, 'price' as b, round(corr(a, b), 6) + 0.0 as r from r union all select 'flag', 'quantity', round(corr(a, c), 6) + 0.0 from r union all select 'price', 'quantity', round(corr(b, c), 6) + 0.0 from r""")
def spearman_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of a flag, a price and a count: few values beside many."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("flag"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return rounded(inference.spearman(rows, ["flag", "price", "quantity"]))


_R3 = f"with {MEASURES_SQL}, r as (select corr(quantity, price) a, corr(quantity, l_discount) b, corr(price, l_discount) c, count(*) n from li), d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from r)"
_THREE = ["quantity", "price", "l_discount"]


@query(f"{_R3} select round(-((n - 1) - 11.0 / 6) * ln(det), 4) as chi2, 3::bigint as df, round(det, 8) as det from d")
def bartlett_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sphericity of three measures."""
    f = adequacy.bartlett(*adequacy.correlation_of(measures(spark, sf_dir), _THREE))
    return as_rows(spark, "chi2 double, df long, det double", [(round(f["chi2"], 4), f["df"], round(f["det"], 8))])


@query(f"""{_R3}, p as (select a * a ra, b * b rb, c * c rc, power((a - b * c), 2) / ((1 - b * b) * (1 - c * c)) pa, power((b - a * c), 2) / ((1 - a * a) * (1 - c * c)) pb, power((c - a * b), 2) / ((1 - a * a) * (1 - b * b)) pc from r)
  select 'overall' as name, round((ra + rb + rc) / (ra + rb + rc + pa + pb + pc), 6) as kmo from p union all select 'quantity', round((ra + rb) / (ra + rb + pa + pb), 6) from p
  union all select 'price', round((ra + rc) / (ra + rc + pa + pc), 6) from p union all select 'l_discount', round((rb + rc) / (rb + rc + pb + pc), 6) from p""")
def kmo_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling adequacy of three measures."""
    f = adequacy.kmo(adequacy.correlation_of(measures(spark, sf_dir), _THREE)[0])
    return as_rows(spark, "name string, kmo double", [("overall", round(f["overall"], 6)), *[(n, round(float(v), 6)) for n, v in zip(_THREE, f["msa"], strict=True)]])


@query(f"""with {MEASURES_SQL}, f as (select avg(quantity) a, avg(price) b, var_samp(quantity) x, var_samp(price) y, covar_samp(quantity, price) z from li)
  select _row, round(((quantity - a) * (quantity - a) * y - 2 * (quantity - a) * (price - b) * z + (price - b) * (price - b) * x) / (x * y - z * z), 5) + 0.0 as d2 from li, f""")
def mahalanobis_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of each line to the centroid of quantity and price."""
    return rounded(adequacy.mahalanobis(measures(spark, sf_dir), ["quantity", "price"]).select("_row", "d2"), 5)


_CHECKS = f"""{_R3}, t as (select *, (a * a + b * b + c * c) / 3 q from d), h as (select *, acos(greatest(-1, least(1, a * b * c / power(q, 1.5)))) / 3 th from t),
  e as (select 1 + 2 * sqrt(q) * cos(th) l1, 1 + 2 * sqrt(q) * cos(th - 2 * pi() / 3) l2, 1 + 2 * sqrt(q) * cos(th + 2 * pi() / 3) l3 from h),
  p as (select *, power(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) pa, power(b - a * c, 2) / ((1 - a * a) * (1 - c * c)) pb, power(c - a * b, 2) / ((1 - a * a) * (1 - b * b)) pc, -((n - 1) - 11.0 / 6) * ln(det) chi2 from d),
  k as (select *, (a * a + b * b + c * c) / (a * a + b * b + c * c + pa + pb + pc) kmo, least((a * a + b * b) / (a * a + b * b + pa + pb), (a * a + c * c) / (a * a + c * c + pa + pc), (b * b + c * c) / (b * b + c * c + pb + pc)) msa,
    (abs(a) + abs(b) + abs(c)) / 3 mean_r, (abs(a) >= 0.3)::int + (abs(b) >= 0.3)::int + (abs(c) >= 0.3)::int strong, (abs(a) >= 0.9)::int + (abs(b) >= 0.9)::int + (abs(c) >= 0.9)::int redundant from p),
  f as (select avg(quantity) mq, avg(price) mp, avg(l_discount) md, stddev_samp(quantity) sq, stddev_samp(price) sp, stddev_samp(l_discount) sd,
    (abs({_skew('quantity')}) > 1)::int + (abs({_skew('price')}) > 1)::int + (abs({_skew('l_discount')}) > 1)::int skewed from li),
  z as (select (quantity - mq) / sq x, (price - mp) / sp y, (l_discount - md) / sd w from li, f),
  o as (select count(*) filter (((1 - c * c) * x * x + (1 - b * b) * y * y + (1 - a * a) * w * w + 2 * (b * c - a) * x * y + 2 * (a * c - b) * x * w + 2 * (a * b - c) * y * w) / det > 16.26623619623813) far from z, d),
  s as (select case when kmo >= 0.8 then 30 when kmo >= 0.7 then 24 when kmo >= 0.6 then 17 when kmo >= 0.5 then 9 else 0 end + case when chi2 > 7.814727903251178 then 20 else 0 end
    + case when n / 3.0 >= 10 then 20 when n / 3.0 >= 5 then 14 when n / 3.0 >= 3 then 8 else 2 end + case when n >= 100 then 10 when n >= 50 then 7 when n >= 30 then 4 else 1 end + 10
    + case when det > 1e-5 then 10 when det > 1e-9 then 5 else 0 end as score from k),
  every as (select 'sample size' as "check", case when n / 3.0 >= 10 and n >= 100 then 'ok' when n / 3.0 >= 5 then 'warn' else 'bad' end as level, n / 3.0 as figure from k
    union all select 'Bartlett', case when chi2 > 7.814727903251178 then 'ok' else 'bad' end, chi2 from k
    union all select 'KMO', case when kmo >= 0.8 then case when msa < 0.5 then 'warn' else 'ok' end when kmo >= 0.6 then 'warn' else 'bad' end, kmo from k
    union all select 'correlation structure', case when mean_r < 0.3 and strong = 0 then 'bad' else 'ok' end, mean_r from k
    union all select 'multicollinearity', case when redundant > 0 then 'warn' else 'ok' end, redundant from k
    union all select 'scales', 'ok', greatest(sq, sp, sd) / least(sq, sp, sd) from f union all select 'missing data', 'ok', 0 union all select 'outliers', case when far > 0 then 'warn' else 'ok' end, far from o
    union all select 'skewness', case when skewed > 0 then 'warn' else 'ok' end, skewed from f union all select 'dimensionality', 'info', (l1 > 1)::int + (l2 > 1)::int + (l3 > 1)::int from e
    union all select 'two axes', 'info', (l1 + l2) / 3 from e union all select 'strong pairs', 'info', strong from k)"""


@query(f"""{_CHECKS} select "check", level, round(cast(figure as double), 4) as figure, cast(score as integer) as score, case when score >= 82 then 'A' when score >= 66 then 'B' when score >= 48 then 'C' else 'D' end as grade from every, s""")
def suitability_checks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks of three complete measures with a figure each, two more figures, the score and the grade."""
    d = adequacy.diagnose(prepare.prepare(measures(spark, sf_dir), prepare.Roles(_THREE)))
    level = {name: x for name, x, _ in adequacy.advice(d)}
    figures = {
        "sample size": d.n / d.p, "Bartlett": d.bartlett["chi2"], "KMO": d.kmo["overall"], "correlation structure": d.mean_abs_r, "multicollinearity": len(d.redundant), "scales": d.scale_ratio,
        "missing data": d.missing_share, "outliers": d.outlier_count, "skewness": len(d.skewed), "dimensionality": d.above_one, "two axes": d.two_axes, "strong pairs": len(d.strong),
    }
    return rounded(as_rows(spark, "check string, level string, figure double, score int, grade string", [(k, level.get(k, "info"), float(v), d.score, d.grade) for k, v in figures.items()]), 4)


@query()
def suitability_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten checks of lineitem's measures, with the score and the grade."""
    found = prepare.prepare(measures(spark, sf_dir), prepare.Roles(MEASURES))
    d = adequacy.diagnose(found)
    return as_rows(spark, "check string, level string, figures string, score int, grade string", [(*row, d.score, d.grade) for row in adequacy.advice(d)])


@query("""with x as (select p_partkey, p_retailprice / 50 as v, p_size / 10.0 as f, (p_size - 25) / 10.0 as t from part)
  select p_partkey, round(exp(-v / 2) * (1 + v / 2), 9) as chi2_4, round(exp(-v / 2) * (1 + v / 2 + v * v / 8), 9) as chi2_6, round(power(10 / (10 + 4 * f), 5) * (1 + 5 * (1 - 10 / (10 + 4 * f))), 9) as f_4_10,
  round(1 - abs(t) / sqrt(2 + t * t), 9) as t_2, round(1 - abs(t / 4) / sqrt(2 + power(t / 4, 2)), 9) as r_4 from x""")
def distribution_tails_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of chi-square, F and Student's distributions, and a correlation's p, at every part's figures, where they have closed forms."""
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 50).alias("v"), (F.col("p_size") / 10.0).alias("f"), ((F.col("p_size") - 25) / 10.0).alias("t"))
    r = F.col("t") / 4 / F.sqrt(2 + F.pow(F.col("t") / 4, 2))
    tails = {"chi2_4": D.chi2_tail_column("v", F.lit(4.0)), "chi2_6": D.chi2_tail_column("v", F.lit(6.0)), "f_4_10": D.f_tail_column("f", F.lit(4.0), F.lit(10.0)), "t_2": D.t_two_sided_column("t", F.lit(2.0)), "r_4": D.correlation_p_column(r, F.lit(4.0))}
    return rounded(x.select("p_partkey", *[c.alias(n) for n, c in tails.items()]), 9)


@query("select s_suppkey as key, s_name as name, s_acctbal as balance, s_nationkey as nation, s_suppkey % 3 = 0 as missing from supplier")
def delimited_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers written as semicolon-separated text with decimal commas, quotes and missing codes, and read back."""
    rows = table(spark, sf_dir, "supplier")
    comma = F.replace(F.format_string("%.2f", "s_acctbal"), F.lit("."), F.lit(","))
    path = new_path(spark, "delimited")
    text = rows.select("s_suppkey", F.concat(F.lit(" "), F.col("s_name"), F.lit('; "quoted"')).alias("s_name"), comma.alias("s_acctbal"), "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, "N/A").otherwise("x").alias("note"))
    text.write.csv(path, sep=";", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_delimited(spark, path)
    number = lambda name, kind: to_number(F.col(name)).cast(kind)
    return back.select(number("s_suppkey", "long").alias("key"), F.regexp_extract(F.trim("s_name"), '^(.*); "quoted"$', 1).alias("name"), number("s_acctbal", "double").alias("balance"), number("s_nationkey", "int").alias("nation"), is_missing(F.col("note")).alias("missing"))


_SUMMARY = ["l_quantity", "l_extendedprice", "l_discount"]
_SUMMARY_ONE = """select '{c}' as variable, 'active' as role, cast(count({c}) as bigint) as n, cast(count(*) - count({c}) as bigint) as missing, cast(count(distinct {c}) as bigint) as "distinct", round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd,
  round(min({c}), 4) as min, round(max({c}), 4) as max, round(quantile_cont({c}, 0.5), 4) as median, round(100 * stddev_samp({c}) / abs(avg({c})), 4) as cv, round({skew}, 4) + 0.0 as skew, round(kurtosis({c}), 4) + 0.0 as kurt from lineitem"""
_MSA = """m as (select corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c from lineitem),
  q as (select *, power(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) pa, power(b - a * c, 2) / ((1 - a * a) * (1 - c * c)) pb, power(c - a * b, 2) / ((1 - a * a) * (1 - b * b)) pc from m),
  s as (select 'l_quantity' as variable, (a * a + b * b) / (a * a + b * b + pa + pb) as msa from q union all select 'l_extendedprice', (a * a + c * c) / (a * a + c * c + pa + pc) from q union all select 'l_discount', (b * b + c * c) / (b * b + c * c + pb + pc) from q)"""


@query(f"with {_MSA}, t as (" + " union all ".join(_SUMMARY_ONE.format(c=c, skew=_skew(c)) for c in _SUMMARY) + ") select t.*, round(s.msa, 6) as msa from t join s using (variable)")
def variable_summary_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of three measures with their sampling adequacy, in the layout in which it is handed on."""
    rows = table(spark, sf_dir, "lineitem").select(*_SUMMARY)
    r, _ = adequacy.correlation_of(rows, _SUMMARY)
    found = layouts.variable_summary(profile.profile(rows), dict.fromkeys(_SUMMARY, "active"), dict(zip(_SUMMARY, map(float, adequacy.kmo(r)["msa"]), strict=True)))
    digits = {"msa": 6, **dict.fromkeys(["mean", "sd", "min", "max", "median", "cv", "skew", "kurt"], 4)}
    return found.select(*[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else col(c) for c in found.columns])


@query("""select a.v as variable, round(a.q, 6) + 0.0 as l_quantity, round(a.p, 6) + 0.0 as l_extendedprice, round(a.d, 6) + 0.0 as l_discount from (
  select 'l_quantity' as v, 1.0 as q, corr(l_quantity, l_extendedprice) as p, corr(l_quantity, l_discount) as d from lineitem union all
  select 'l_extendedprice', corr(l_extendedprice, l_quantity), 1.0, corr(l_extendedprice, l_discount) from lineitem union all select 'l_discount', corr(l_discount, l_quantity), corr(l_discount, l_extendedprice), 1.0 from lineitem) a""")
def correlation_table_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the same measures as a matrix with a line for each."""
    r, _ = adequacy.correlation_of(table(spark, sf_dir, "lineitem").select(*_SUMMARY), _SUMMARY)
    return layouts.correlation_table(spark, r, _SUMMARY)


@query("""select 'number' as kind, 'tax' as name, cast(null as varchar) as level, cast(count(l_tax) as bigint) as n, round(corr(l_tax, l_quantity), 6) + 0.0 as quantity, round(corr(l_tax, l_extendedprice), 6) + 0.0 as price from lineitem
  union all select 'category', 'l_returnflag', l_returnflag, cast(count(*) as bigint), round(avg(l_quantity), 6), round(avg(l_extendedprice), 3) from lineitem group by l_returnflag""")
def supplementary_table_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number's correlations and flags' centroids on two measures taken as axes, in one table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.col("l_tax").alias("tax"), "l_returnflag")
    found = layouts.supplementary_table(rows, ["tax"], ["l_returnflag"], ["quantity", "price"])
    digits = F.when(F.col("kind") == "number", F.round("price", 6)).otherwise(F.round("price", 3))
    return found.select("kind", "name", "level", "n", (F.round("quantity", 6) + F.lit(0.0)).alias("quantity"), (digits + F.lit(0.0)).alias("price"))


@query("""with f as (select o_orderpriority as level, count(*) as n, min(o_orderkey) as first from orders where o_orderpriority <> '' group by 1), p as (select *, row_number() over (order by first, level) as place from f)
  select p.level, cast(p.place as integer) as place, o.o_orderkey from orders o join p on p.level = o.o_orderpriority""")
def group_rows_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's group on a map: priorities in the order in which they first come."""
    return layouts.group_rows(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")
