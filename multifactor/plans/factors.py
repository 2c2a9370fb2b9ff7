"""Queries of the factor methods, their retention, maps, description and clustering, with SQL where a closed form exists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from multifactor.functions.columns import col
from multifactor.operators import cluster, correspondence, describe, factor_maps, inference, methods, mixed, moments, profile, recommend, retention, rotation, wide
from multifactor.operators.pca import correlation_pca, pca, standardised
from multifactor.plans.common import MEASURES, MEASURES_SQL, as_rows, measures, rounded, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


# eigenvalues of three correlated variables, by the trigonometric form
_AXES3 = f"""with {MEASURES_SQL}, r as (select corr(quantity, price) a, corr(quantity, discounted) b, corr(price, discounted) c from li),
  t as (select *, (a * a + b * b + c * c) / 3 q from r), h as (select q, acos(greatest(-1, least(1, a * b * c / power(q, 1.5)))) / 3 th from t),
  e as (select k, 1 + 2 * sqrt(q) * cos(th + 2 * pi() * case k when 1 then 0 when 2 then 2 else 1 end / 3) v from h, (values (1), (2), (3)) x(k))"""
_THREE = ["quantity", "price", "discounted"]


@query(f"""{_AXES3} select cast(k as integer) as axis, round(v, 6) as eigenvalue, round(v * sqrt(2.0 / ((select count(*) from lineitem) - 1)), 8) as error, round(v / 3, 6) as share,
  round(sum(v) over (order by k) / 3, 6) as cumulative from e""")
def pca_axes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axes of three measures of lineitem."""
    axes = correlation_pca(measures(spark, sf_dir), _THREE).axes(spark)
    return axes.select("axis", *[F.round(c, 8 if c == "error" else 6).alias(c) for c in ("eigenvalue", "error", "share", "cumulative")])


@query(f"""{_AXES3}, s as (select k, v, (select sum(1.0 / i) from generate_series(e.k, 3) g(i)) b from e)
  select cast(k as integer) as axis, round(b, 6) as stick, round(v - lead(v) over (order by k), 6) as drop from s""")
def scree_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken stick and drops of those axes."""
    found = correlation_pca(measures(spark, sf_dir), _THREE)
    return rounded(retention.eigenvalue_table(spark, found, 1).select("axis", "stick", "drop"))


@query(f"""{_AXES3}, c as (select k, v, sum(v) over (order by k) / 3 s, lag(v) over (order by k) - 2 * v + lead(v) over (order by k) bend, (select sum(1.0 / i) from generate_series(e.k, 3) g(i)) stick from e)
  select 'Kaiser-Guttman' as name, cast(greatest(1, (select count(*) from e where v > 1)) as integer) as k union all select 'Jolliffe', cast(greatest(1, (select count(*) from e where v > 0.7)) as integer)
  union all select '70 % of variance', cast((select min(k) from c where s >= 0.7) as integer) union all select '80 % of variance', cast((select min(k) from c where s >= 0.8) as integer)
  union all select 'scree elbow', cast((select k from c where bend is not null order by bend desc, k limit 1) as integer)
  union all select 'broken stick', cast(greatest(1, coalesce((select min(k) - 1 from c where v <= stick), 3)) as integer)""")
def criteria_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes that the rules with a closed form keep."""
    found = correlation_pca(measures(spark, sf_dir), _THREE)
    rules = retention.criteria(found, [np.inf] * 3)
    return as_rows(spark, "name string, k int", [(r.name, r.k) for r in rules if r.name not in ("parallel analysis", "minimum average partial")])


@query()
def all_criteria_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of four measures that all eight rules keep, parallel analysis with bars from random tables, and the consensus."""
    found = correlation_pca(measures(spark, sf_dir), [*_THREE, "l_tax"])
    bars = retention.parallel_summary(retention.parallel_normal(spark, found.n, found.p)).orderBy("axis").toPandas()
    rules = retention.criteria(found, bars["p95"].tolist())
    return as_rows(spark, "name string, k int, weight int", [*[(r.name, r.k, r.weight) for r in rules], ("consensus", retention.consensus(rules), sum(r.weight for r in rules))])


_CUST = "o as (select o_custkey as _row, sum(o_totalprice) total, cast(count(*) as double) n from orders group by 1), f as (select corr(total, n) r, avg(total) mt, avg(n) mn, stddev_samp(total) st, stddev_samp(n) sn, count(*) c from o)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("_row")).agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))


@query(f"""with {_CUST}, z as (select _row, (total - mt) / st a, (n - mn) / sn b, r, c from o, f), s as (select _row, (a + b * sign(r)) / sqrt(2) x, (a - b * sign(r)) / sqrt(2) y, r, c from z)
  select _row, round(x * x, 5) as f1_squared, round(y * y, 5) as f2_squared, round(100 * x * x / (1 + abs(r)) / (c - 1), 6) as contribution_1, round(100 * y * y / (1 - abs(r)) / (c - 1), 6) as contribution_2 from s""")
def pca_individuals_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on the axes of their orders' sum and count: squared coordinates and contributions."""
    z = _customers(spark, sf_dir)
    rows = factor_maps.factor_map(z, correlation_pca(z, ["total", "n"]), 2, keep=["_row"]).individual_table()
    return rows.select("_row", F.round(F.pow("F1", F.lit(2)), 5).alias("f1_squared"), F.round(F.pow("F2", F.lit(2)), 5).alias("f2_squared"), F.round("contribution_1", 6).alias("contribution_1"), F.round("contribution_2", 6).alias("contribution_2"))


@query(f"""with {_CUST} select v as variable, cast(k as integer) as axis, round((1 + case k when 1 then abs(r) else -abs(r) end) / 2, 6) as cos2, 50.0::double as contribution from f, (values ('total'), ('n')) a(v), (values (1), (2)) b(k)""")
def pca_variables_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and contribution of the two variables."""
    z = _customers(spark, sf_dir)
    return rounded(correlation_pca(z, ["total", "n"]).loading_table(spark).select("variable", "axis", "cos2", "contribution"))


# eigenvectors are cross products of two rows of R - value I; two axes turn by the angle at which the criterion is greatest
_TURNED = f"""{_AXES3}, w as (select k, v, a * c - b * (1 - v) x1, a * b - c * (1 - v) x2, power(1 - v, 2) - a * a x3 from e, r where k <= 2),
  l as (select j, max(case when k = 1 then f end) x, max(case when k = 2 then f end) y from (select k, j, case j when 1 then x1 when 2 then x2 else x3 end * sqrt(v / (x1 * x1 + x2 * x2 + x3 * x3)) f from w, (values (1), (2), (3)) i(j)) group by 1),
  unit as (select j, sqrt(x * x + y * y) len, x / sqrt(x * x + y * y) x, y / sqrt(x * x + y * y) y from l), uv as (select x * x - y * y u, 2 * x * y t from unit),
  g as (select method, gamma, sum(u) su, sum(t) st, sum(u * u - t * t) c, 2 * sum(u * t) d from uv, (values ('varimax', 1.0), ('quartimax', 0.0), ('equamax', 1.0), ('parsimax', 1.0)) m(method, gamma) group by 1, 2),
  f as (select method, atan2(d - 2 * gamma * su * st / 3, c - gamma * (su * su - st * st) / 3) / 4 q from g),
  z as (select method, j, len * (x * cos(q) + y * sin(q)) p, len * (y * cos(q) - x * sin(q)) o from unit, f)"""


@query(f"""{_TURNED} select method, case j when 1 then 'quantity' when 2 then 'price' else 'discounted' end as variable, round(greatest(p * p, o * o), 4) as high, round(least(p * p, o * o), 4) as low from z""")
def orthogonal_rotations_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared loadings of three measures on two axes after each orthogonal rotation (parsimax's weight is 1 here, too)."""
    found, out = correlation_pca(measures(spark, sf_dir), _THREE), []
    for method in ("varimax", "quartimax", "equamax", "parsimax"):
        squared = np.sort(rotation.rotate(found.loadings[:, :2], method).pattern ** 2, axis=1)
        out += [(method, v, float(s[1]), float(s[0])) for v, s in zip(_THREE, squared, strict=True)]
    return rounded(as_rows(spark, "method string, variable string, high double, low double", out), 4)


@query()
def rotations_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the embeddings' first four axes before and after every rotation method."""
    rows, names = _embeddings(spark, sf_dir)
    found, out = correlation_pca(rows, names), None
    for method in rotation.METHODS:
        turned = rotation.rotate(found.loadings[:, :4], method)
        one = rotation.variance_table(spark, found.values[:4], turned, found.total).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query("""with f as (select var_samp(p_size) x, var_samp(p_retailprice) y, covar_samp(p_size, p_retailprice) z from part), g as (select (x + y) / 2 m, sqrt(power((x - y) / 2, 2) + z * z) d from f)
  select 1::integer as axis, round(m + d, 4) as eigenvalue, round((m + d) / (2 * m), 6) as share from g union all select 2, round(m - d, 4), round((m - d) / (2 * m), 6) from g""")
def pca_covariance_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of unscaled columns."""
    axes = pca(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).axes(spark)
    return axes.select("axis", F.round("eigenvalue", 4).alias("eigenvalue"), F.round("share", 6).alias("share"))


_CA = """t as (select l_returnflag a, l_linestatus b, cast(count(*) as double) n from lineitem group by 1, 2), ra as (select a, sum(n) x from t group by 1), rb as (select b, sum(n) y from t group by 1), tn as (select sum(n) s from t),
  c as (select ra.a, rb.b, coalesce(t.n, 0) o, ra.x / s r, rb.y / s c, s from ra cross join rb cross join tn left join t on t.a = ra.a and t.b = rb.b), w as (select sum(power(o / s - r * c, 2) / (r * c)) i from c)"""


@query(f"""with {_CA}, p as (select a, r, max(case when b = 'F' then o / s / r - c end) / sqrt(max(case when b = 'F' then c end) * (1 - max(case when b = 'F' then c end))) f from c group by 1, 2)
  select a as name, round(r, 7) as mass, round(f * f, 7) as coord_squared, round(100 * r * f * f / (select i from w), 5) as contribution, round((select i from w), 8) as eigenvalue from p""")
def ca_rows_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondence analysis of return flag by line status: the flags on its one axis."""
    found = correspondence.correspondence_of(measures(spark, sf_dir), "l_returnflag", "l_linestatus")
    points = found.points(spark).where("side = 'row' and axis = 1")
    return points.select("name", F.round("mass", 7).alias("mass"), F.round(F.col("coord") * F.col("coord"), 7).alias("coord_squared"), F.round("contribution", 5).alias("contribution"), F.lit(round(float(found.values[0]), 8)).alias("eigenvalue"))


@query(f"""with {_CA} select a as "row", b as col, o as observed, round(r * c * s, 5) as expected, round((o - r * c * s) / sqrt(r * c * s), 5) + 0.0 as residual, round(100 * power(o / s - r * c, 2) / (r * c) / (select i from w), 5) as contribution from c""")
def ca_cells_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that hold that association."""
    return rounded(correspondence.correspondence_of(measures(spark, sf_dir), "l_returnflag", "l_linestatus").cells(spark), 5)


_FLAGS = "b as (select case when l_quantity > 25 then 'many' else 'few' end q, case when l_extendedprice > 30000 then 'dear' else 'cheap' end e from lineitem), m as (select corr(case when q = 'many' then 1.0 else 0 end, case when e = 'dear' then 1.0 else 0 end) phi from b)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures(spark, sf_dir).select("_row", F.when(F.col("quantity") > 25, "many").otherwise("few").alias("q"), F.when(F.col("price") > 30000, "dear").otherwise("cheap").alias("e"), "quantity", "price", "l_discount", "l_tax", "l_returnflag")


@query(f"with {_FLAGS} select cast(k as integer) as axis, round((1 + case k when 1 then abs(phi) else -abs(phi) end) / 2, 7) as eigenvalue, round((1 + case k when 1 then abs(phi) else -abs(phi) end) / 2, 7) as share from m, (values (1), (2)) x(k)")
def mca_axes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple correspondence analysis of two flags."""
    axes = correspondence.mca(_flags(spark, sf_dir), ["q", "e"]).axes(spark)
    return axes.select("axis", F.round("eigenvalue", 7).alias("eigenvalue"), F.round("share", 7).alias("share"))


@query(f"with {_FLAGS} select 0.5::double as threshold, round(phi * phi, 6) as benzecri, 1.0::double as benzecri_share, round(phi * phi, 6) as greenacre_inertia, 1.0::double as greenacre_share from m")
def mca_adjusted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benzecri's and Greenacre's adjustment of that analysis: of two flags one axis is over the threshold."""
    a = correspondence.mca(_flags(spark, sf_dir), ["q", "e"]).adjusted
    row = (a["threshold"], a["benzecri"][0], a["benzecri_share"][0], a["greenacre_inertia"], a["greenacre_share"][0])
    return rounded(as_rows(spark, "threshold double, benzecri double, benzecri_share double, greenacre_inertia double, greenacre_share double", [tuple(float(x) for x in row)]), 6)


# a table of any number of customers by three states: the squared singular values add up to the trace less 1, their squares to the sum of squares less 1
_WIDE = """t as (select o_custkey a, o_orderstatus b, cast(count(*) as double) n from orders group by 1, 2), ra as (select a, sum(n) x from t group by 1), rb as (select b, sum(n) y from t group by 1),
  m as (select t.b, u.b as c, sum(t.n * u.n / x) / sqrt(v.y * w.y) as e, v.y, w.y as z from t join t u on t.a = u.a join ra on ra.a = t.a join rb v on v.b = t.b join rb w on w.b = u.b group by 1, 2, 4, 5),
  s as (select sum(case when b = c then e else 0 end) - 1 as s1, sum(e * e) - 1 as s2 from m), j as (select (select count(*) from ra) as rows, (select count(*) from rb) as cols, (select sum(n) from t) as n),
  mu as (select k, (s1 + case k when 1 then 1 else -1 end * sqrt(greatest(2 * s2 - s1 * s1, 0))) / 2 as mu, s1 from s, (values (1), (2)) x(k))"""


@query(f"""with {_WIDE}, v as (select k, (1 + sqrt(mu)) / 2 as v from mu union all select 3, 0.5 union all select 4, 0.5)
  select cast(k as integer) as axis, round(v, 7) as eigenvalue, round(v / ((rows + cols) / 2.0 - 1), 9) as share, cast(rows + cols as bigint) as levels, round(v, 6) as variance_of_rows from v, j""")
def mca_wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading axes of the multiple correspondence analysis of customers and states, with a level for each customer."""
    orders = table(spark, sf_dir, "orders")
    found = wide.wide_mca(orders, ["o_custkey", "o_orderstatus"], 4)
    rows = found.rows(orders, keep=["o_orderkey"]).agg(*[F.avg(F.pow(F.col(f"F{i + 1}"), F.lit(2))) for i in range(4)]).first()
    out = [(r.axis, round(r.eigenvalue, 7), round(r.share, 9), found.n_levels, round(float(v), 6)) for r, v in zip(found.axes(spark).collect(), rows, strict=True)]
    return as_rows(spark, "axis int, eigenvalue double, share double, levels long, variance_of_rows double", out)


@query(f"""with {_WIDE} select cast(k as integer) as axis, round(mu, 7) as eigenvalue, round(mu / s1, 6) as share, round(s1 * n, 3) as chi2, round(mu, 6) as variance_of_rows, round(mu, 6) as variance_of_cols from mu, j""")
def ca_wide_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondence analysis of customers by states, both in Spark: axes, and the variance of both sides' points on them."""
    found = wide.wide_correspondence(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", 2)
    points = found.points.groupBy("side").agg(*[F.sum(F.col("mass") * F.pow(F.element_at("x", i + 1), F.lit(2))).alias(f"v{i}") for i in range(2)])
    variance = {r.side: r for r in points.collect()}
    out = [(r.axis, round(r.eigenvalue, 7), round(r.share, 6), round(found.chi2, 3), *[round(float(variance[s][f"v{r.axis - 1}"]), 6) for s in ("row", "col")]) for r in found.axes(spark).collect()]
    return as_rows(spark, "axis int, eigenvalue double, share double, chi2 double, variance_of_rows double, variance_of_cols double", out)


@query("""with g as (select avg(case when l_quantity > 25 then 1.0 else 0 end) p, corr(l_extendedprice, case when l_quantity > 25 then 1.0 else 0 end) r from lineitem)
  select cast(k as integer) as axis, round(1 + case k when 1 then abs(r) else -abs(r) end, 6) as eigenvalue, round((1 + case k when 1 then abs(r) else -abs(r) end) / 2, 6) as squared from g, (values (1), (2)) x(k)""")
def famd_axes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor analysis of mixed data: price and one flag; each axis' eigenvalue and the flag's eta2."""
    found = mixed.famd(_flags(spark, sf_dir), ["price"], ["q"])
    rows = found.core.axes(spark).join(found.squared(spark).where("variable = 'q'"), "axis")
    return rows.select("axis", F.round("eigenvalue", 6).alias("eigenvalue"), F.round("squared", 6).alias("squared"))


@query("""with g as (select avg(case when l_quantity > 25 then 1.0 else 0 end) p, abs(corr(l_extendedprice, case when l_quantity > 25 then 1.0 else 0 end)) r from lineitem), s as (select *, case k when 1 then 1 else -1 end as sign from g, (values (1), (2)) x(k), (values ('many'), ('few')) y(level))
  select level, cast(k as integer) as axis, round(case level when 'many' then (1 - p) / p else p / (1 - p) end * power(r + sign, 2) / 2, 6) as coord_squared, round(power(r + sign, 2) / (2 + 2 * r * r), 6) as cos2 from s""")
def famd_levels_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag's two levels on those axes: squared barycentres and their quality."""
    found = mixed.famd(_flags(spark, sf_dir), ["price"], ["q"]).columns(spark).where("kind = 'level'")
    return rounded(found.select("level", "axis", F.pow("coord", F.lit(2)).alias("coord_squared"), "cos2"))


@query(f"""with {MEASURES_SQL}, r as (select abs(corr(quantity, price)) s, abs(corr(l_discount, l_tax)) t from li), g as (select 'size' as name, s as r from r union all select 'terms', t from r)
  select name as "group", 2::integer as variables, round(1 + r, 6) as first, round(1 / (1 + r), 6) as weight, 2.0::double as inertia, round(2 / (1 + r), 6) as on_all_axes from g""")
def mfa_groups_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two groups' own first eigenvalue, weight and inertia, and what all common axes hold of them."""
    found = mixed.mfa(measures(spark, sf_dir), {"size": ["quantity", "price"], "terms": ["l_discount", "l_tax"]}).group_table(spark)
    return rounded(found.groupBy("group", "variables", "first", "weight", "inertia").agg(F.sum("coord").alias("on_all_axes")))


@query(f"""with {MEASURES_SQL}, r as (select corr(quantity, price) qp, corr(quantity, l_discount) qd, corr(quantity, l_tax) qt, corr(price, l_discount) pd, corr(price, l_tax) pt, corr(l_discount, l_tax) dt from li),
  w as (select *, 1 / (1 + abs(qp)) w1, 1 / (1 + abs(dt)) w2 from r), l as (select w1 * w1 * (2 + 2 * qp * qp) l11, w2 * w2 * (2 + 2 * dt * dt) l22, w1 * w2 * (qd * qd + qt * qt + pd * pd + pt * pt) l12 from w)
  select 'size' as a, 'terms' as b, round(l12, 8) as lg, round(l12 / sqrt(l11 * l22), 8) as rv from l""")
def mfa_relation_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple factor analysis of two groups: how much they share."""
    found = mixed.mfa(measures(spark, sf_dir), {"size": ["quantity", "price"], "terms": ["l_discount", "l_tax"]})
    return rounded(found.relations(spark).where("a = 'size' and b = 'terms'"), 8)


@query()
def mfa_partial_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial points of every embedding, seen by four blocks of its components."""
    rows, names = _embeddings(spark, sf_dir)
    found = mixed.mfa(rows, {f"block{i}": names[16 * i : 16 * i + 16] for i in range(4)})
    return rounded(found.partial(rows, 3, keep=("_row",)), 4)


@query("""select case when bool_or(l_quantity is null) then 'x' else 'charge' end as variable, 'F1' as axis, round(power(corr(l_extendedprice * (1 - l_discount) * (1 + l_tax), a), 2), 6) as cos2, cast(count(*) as bigint) as n from
  (select l.*, (l_quantity - mq) / sq + (l_extendedprice - mp) / sp as a from lineitem l, (select avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) mp, stddev_samp(l_extendedprice) sp, corr(l_quantity, l_extendedprice) r from lineitem) f where r > 0
   union all select l.*, (l_quantity - mq) / sq - (l_extendedprice - mp) / sp as a from lineitem l, (select avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) mp, stddev_samp(l_extendedprice) sp, corr(l_quantity, l_extendedprice) r from lineitem) f where r <= 0)""")
def supplementary_charge_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplementary number's place on the first axis of quantity and price."""
    z = measures(spark, sf_dir)
    scores = correlation_pca(z, ["quantity", "price"]).scores(z, 1, keep=["_row", "charge"])
    return rounded(factor_maps.supplementary_numeric(scores, ["charge"], ["F1"]).select("variable", "axis", "cos2", "n"))


@query("""with f as (select count(*) nn, avg(l_extendedprice) m, var_pop(l_extendedprice) s from lineitem), g as (select l_returnflag level, count(*) n, avg(l_extendedprice) a from lineitem group by 1)
  select level, 'l_extendedprice' as measure, cast(n as bigint) as n, round(a, 4) as mean, round((a - m) / sqrt(s / n * (nn - n) / (nn - 1.0)), 5) + 0.0 as v from g, f""")
def test_values_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each flag's mean price lies from the overall mean."""
    found = describe.test_values(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice"])
    return found.select("level", "measure", "n", F.round("mean", 4).alias("mean"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("""select l_returnflag as level, 'l_extendedprice' as axis, cast(count(*) as bigint) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as sd,
  round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) as se, round(avg(l_extendedprice) - 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) as low,
  round(avg(l_extendedprice) + 1.96 * stddev_samp(l_extendedprice) / sqrt(count(*)), 4) as high from lineitem group by 1""")
def group_means_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by flag with its interval."""
    return rounded(describe.group_means(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice"]), 4)


@query(f"""with {MEASURES_SQL}, c as (select a, v, r from (select 'quantity' as a, 'price' as v, corr(quantity, price) r from li union all select 'quantity', 'l_discount', corr(quantity, l_discount) from li union all select 'quantity', 'l_tax', corr(quantity, l_tax) from li))
  select a as axis, v as variable, round(r, 6) + 0.0 as r, round(r * r, 6) + 0.0 as r2 from c""")
def describe_axis_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with quantity, taken as an axis."""
    return rounded(describe.describe_numeric(measures(spark, sf_dir), ["price", "l_discount", "l_tax"], ["quantity"]).select("axis", "variable", "r", "r2"))


@query("""with g as (select o_orderstatus as g, count(*) n, avg(o_totalprice / 1000) cx, avg(o_custkey) cy, var_samp(o_totalprice / 1000) xx, var_samp(o_custkey) yy, covar_samp(o_totalprice / 1000, o_custkey) xy from orders group by 1),
  h as (select *, (xx + yy) / 2 m, sqrt(power((xx - yy) / 2, 2) + xy * xy) d from g)
  select g as "group", cast(n as bigint) as n, round(cx, 4) as cx, round(cy, 4) as cy, round(sqrt((m + d) * -2 * ln(0.05)), 3) as a, round(sqrt(greatest(m - d, 0) * -2 * ln(0.05)), 3) as b, round(atan2(2 * xy, xx - yy) / 2, 5) + 0.0 as angle from h where n >= 3""")
def ellipses_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration ellipses of total and customer by status."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("x"), F.col("o_custkey").cast("double").alias("y"))
    found = factor_maps.ellipses(rows, "x", "y", "o_orderstatus")
    return found.select("group", "n", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("cx", 4), ("cy", 4), ("a", 3), ("b", 3), ("angle", 5))])


# from each corner the next is the point at the least turn, of equal turns the farthest
_HULLS = """with recursive p as (select distinct o_orderstatus as g, cast(o_totalprice as double) as x, cast(o_custkey as double) as y from orders),
  s as (select g, arg_min(x, (x, y)) as x, arg_min(y, (x, y)) as y from p group by g),
  h as (select g, x, y, -pi() / 2 as a, 0 as place, x as sx, y as sy from s
    union all select g, n.x, n.y, n.b, place + 1, sx, sy from (
      select h.g, h.place, h.sx, h.sy, arg_min({'x': p.x, 'y': p.y, 'b': atan2(p.y - h.y, p.x - h.x)},
        (atan2(p.y - h.y, p.x - h.x) - h.a + case when atan2(p.y - h.y, p.x - h.x) - h.a < -1e-9 then 2 * pi() else 0 end, -power(p.x - h.x, 2) - power(p.y - h.y, 2))) as n
      from h join p on p.g = h.g where (p.x, p.y) <> (h.x, h.y) group by h.g, h.place, h.sx, h.sy) where (n.x, n.y) <> (sx, sy))
  select g as "group", cast(place as integer) as place, x, y from h"""


@query(_HULLS)
def hulls_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls of the same clouds."""
    return factor_maps.hulls(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey")), "o_totalprice", "o_custkey", "o_orderstatus")


@query("""with r as (select l_orderkey * 10 + l_linenumber as _row, l_extendedprice as v from lineitem), x as (select *, row_number() over (order by v, _row) a, row_number() over (order by v desc, _row) d from r)
  select 'price' as axis, 'low' as "end", cast(a as integer) as place, _row, v as value from x where a <= 5 union all select 'price', 'high', cast(d as integer), _row, v from x where d <= 5""")
def extremes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cheapest and dearest lines."""
    return factor_maps.extremes(measures(spark, sf_dir).select("_row", "price"), ["price"])


def _embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"e{i}" for i in range(64)]
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) = 64")
    return rows.select(F.col("vec_id").alias("_row"), "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query()
def pca_axes_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All axes of the embeddings' 64 components (a Gram matrix by blocks)."""
    rows, names = _embeddings(spark, sf_dir)
    return rounded(correlation_pca(rows, names).axes(spark))


@query()
def rotated_loadings_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Varimax loadings of the embeddings' first three axes."""
    rows, names = _embeddings(spark, sf_dir)
    found = correlation_pca(rows, names)
    return rounded(rotation.pattern_table(spark, rotation.rotate(found.loadings[:, :3], "varimax"), names), 5)


@query()
def oblique_axes_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of lineitem's first two axes after direct oblimin."""
    found = correlation_pca(measures(spark, sf_dir), [*MEASURES, "l_discount"])
    return rounded(rotation.phi_table(spark, rotation.rotate(found.loadings[:, :2], "oblimin")), 5)


@query()
def parallel_analysis_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem's eigenvalues beside the mean and the 95 % bar of random ones for a table of its size."""
    found = correlation_pca(measures(spark, sf_dir), MEASURES)
    bars = retention.parallel_summary(retention.parallel_normal(spark, found.n, len(MEASURES)))
    return rounded(found.axes(spark).select("axis", "eigenvalue").join(bars, "axis").withColumn("kept", F.col("eigenvalue") > F.col("p95")), 5)


@query()
def parallel_permuted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by permuting each of lineitem's own columns."""
    z = standardised(measures(spark, sf_dir), _THREE)
    return rounded(retention.parallel_summary(retention.parallel_permuted(z, _THREE)), 5)


_AXES3_TERMS = _AXES3.replace("corr(quantity, discounted) b, corr(price, discounted) c", "corr(quantity, l_discount) b, corr(price, l_discount) c")


@query(f"""{_AXES3_TERMS}, w as (select k, v, a * c - b * (1 - v) x1, a * b - c * (1 - v) x2, power(1 - v, 2) - a * a x3 from e, r where k <= 2), n as (select k, v / (x1 * x1 + x2 * x2 + x3 * x3) q, x1, x2, x3 from w),
  left_over as (select m, a - coalesce(sum(q * x1 * x2), 0) r12, b - coalesce(sum(q * x1 * x3), 0) r13, c - coalesce(sum(q * x2 * x3), 0) r23, 1 - coalesce(sum(q * x1 * x1), 0) d1, 1 - coalesce(sum(q * x2 * x2), 0) d2, 1 - coalesce(sum(q * x3 * x3), 0) d3
    from r, (values (0), (1), (2)) t(m) left join n on n.k <= m group by m, a, b, c),
  partial as (select m, r12 * r12 / (d1 * d2) p, r13 * r13 / (d1 * d3) q, r23 * r23 / (d2 * d3) s from left_over)
  select cast(m as integer) as m, round((p + q + s) / 3, 4) as f, round((p * p + q * q + s * s) / 3, 4) as f4 from partial""")
def minimum_partial_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velicer's series of three measures: mean squared and fourth-power partial correlations after 0, 1 and 2 axes."""
    found = retention.velicer(correlation_pca(measures(spark, sf_dir), ["quantity", "price", "l_discount"]).correlation)
    return rounded(as_rows(spark, "m int, f double, f4 double", found["series"]), 4)


@query()
def minimum_partial_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velicer's series over the embeddings' axes."""
    rows, names = _embeddings(spark, sf_dir)
    found = retention.velicer(correlation_pca(rows, names).correlation)
    return rounded(as_rows(spark, "m int, f double, f4 double", found["series"]), 8)


@query("""with v as (select label, cast(embedding[1] as double) a, cast(embedding[2] as double) b from embeddings where embedding is not null and len(embedding) = 64), g as (select label, count(*) n, avg(a) ma, avg(b) mb, var_pop(a) va, var_pop(b) vb from v group by 1),
  t as (select count(*) n, avg(a) ma, avg(b) mb from v) select round(sum(g.n * (va + vb)) / max(t.n), 7) as within, round(sum(g.n * (power(g.ma - t.ma, 2) + power(g.mb - t.mb, 2))) / max(t.n), 7) as between from g, t""")
def cluster_inertia_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within and between inertia of the labels on two components."""
    rows, _ = _embeddings(spark, sf_dir)
    f = cluster.inertias(rows, ["e0", "e1"], "label")
    return as_rows(spark, "within double, between double", [(round(f["within"], 7), round(f["between"], 7))])


@query("""with v as (select label, cast(embedding[1] as double) a from embeddings where embedding is not null and len(embedding) = 64), f as (select count(*) nn, avg(a) m, var_pop(a) s from v), g as (select label, count(*) n, avg(a) a from v group by 1)
  select cast(label as integer) as cluster, 'e0' as measure, cast(n as bigint) as n, round(a, 6) + 0.0 as mean, round((a - m) / sqrt(s / n * (nn - n) / (nn - 1.0)), 5) + 0.0 as v from g, f""")
def cluster_test_values_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test value of a component in each label."""
    rows, _ = _embeddings(spark, sf_dir)
    found = cluster.cluster_test_values(rows, ["e0"], "label")
    return found.select("cluster", "measure", "n", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("""with n as (select count(*) n from orders), l as (select o_orderpriority level, count(*) nl from orders group by 1), c as (select o_orderstatus cluster, count(*) nc from orders group by 1), x as (select o_orderpriority level, o_orderstatus cluster, count(*) k from orders group by 1, 2)
  select l.level, c.cluster, cast(coalesce(k, 0) as bigint) as n_in, cast(nc as bigint) as n_cluster, cast(nl as bigint) as n_level,
  round((coalesce(k, 0) - nc * nl / cast(n as double)) / sqrt(nc * (nl / cast(n as double)) * (1 - nl / cast(n as double)) * (n - nc) / (n - 1.0)), 5) + 0.0 as v from l cross join c cross join n left join x on x.level = l.level and x.cluster = c.cluster""")
def category_test_values_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test value of each priority in each status."""
    found = describe.category_test_values(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return found.select("level", "cluster", "n_in", "n_cluster", "n_level", (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query()
def hcpc_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every customer on the axes of their orders."""
    z = _customers(spark, sf_dir)
    found = cluster.hcpc(correlation_pca(z, ["total", "n"]).scores(z), ["F1", "F2"])
    return rounded(found.rows, 5)


@query()
def hcpc_lineitem_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every line, the tree built on weighted prototypes."""
    z = measures(spark, sf_dir)
    return cluster.hcpc(correlation_pca(z, ["quantity", "price"]).scores(z), ["F1", "F2"], 4, exact=False).rows.select("_row", "cluster")


@query()
def cluster_paragons_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typical and peculiar customers of each cluster."""
    z = _customers(spark, sf_dir)
    found = cluster.hcpc(correlation_pca(z, ["total", "n"]).scores(z), ["F1", "F2"])
    return rounded(cluster.paragons(found.rows, ["F1", "F2"], found.centres), 5)


_RARE = "select cast({c} as varchar) as level, '{c}' as variable, cast(count(*) as bigint) as n, round(100.0 * count(*) / (select count(*) from orders), 6) as share from orders group by 1 having count(*) < 5 or count(*) < 0.02 * (select count(*) from orders)"


@query(" union all ".join(_RARE.format(c=c) for c in ("o_orderpriority", "o_custkey")))
def rare_levels_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities and customers with too few orders for a map."""
    return rounded(recommend.rare_levels(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"]).select("level", "variable", "n", "share"))


_ROLES = """select '{c}' as name, case when typeof({c}) = 'VARCHAR' then case when count(distinct {c}) = count({c}) and count({c}) > 3 then 'id' when count(distinct {c}) > 30 then 'excluded' else 'supp-cat' end
  when coalesce(stddev_samp(try_cast({c} as double)), 0) = 0 then 'excluded'
  when bool_and(try_cast({c} as double) = floor(try_cast({c} as double))) and count(distinct {c}) <= least(8, greatest(2, floor(count(*) * 0.05 + 0.5))) then 'supp-cat' else 'active' end as role from {t} group by typeof({c})"""


def _verdicts_sql(t: str, columns: list[str]) -> str:
    """Verdicts of a table whose columns' names speak for no blocks."""
    roles = " union all ".join(_ROLES.format(c=c, t=t) for c in columns)
    return f"""with r as ({roles}), k as (select count(*) filter (role = 'active') as n, count(*) filter (role = 'supp-cat') as c from r)
  select 'pca' as method, case when n >= 2 and (c = 0 or (c <= 2 and n >= 3)) then 'recommended' when n >= 2 then 'possible' else 'not applicable' end as verdict from k
  union all select 'ca', case when c = 2 and n = 0 then 'recommended' when c >= 2 then 'possible' else 'not applicable' end from k
  union all select 'mca', case when c >= 3 and n = 0 then 'recommended' when c >= 2 then 'possible' else 'not applicable' end from k
  union all select 'famd', case when n >= 1 and c >= 1 and not (c <= 2 and n >= 3) then 'recommended' when n >= 1 and c >= 1 then 'possible' else 'not applicable' end from k
  union all select 'mfa', case when n + c >= 4 then 'possible' else 'not applicable' end from k union all select 'hcpc', 'possible' from k"""


_SUITED = {"lineitem": ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], "part": ["p_size", "p_retailprice", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"]}


@query(" union all ".join(f"select '{t}' as \"table\", * from ({_verdicts_sql(t, c)})" for t, c in _SUITED.items()))
def recommended_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which methods suit the numbers and flags of three tables."""
    out = []
    for name, columns in _SUITED.items():
        rows = table(spark, sf_dir, name).select(*columns)
        out += [(name, *v) for v in sorted(recommend.recommend(rows, profile.profile(rows)).verdicts.items())]
    return as_rows(spark, "table string, method string, verdict string", out)


@query()
def method_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the recommender warns of in those tables, and the method to start with."""
    out = []
    for name, columns in _SUITED.items():
        rows = table(spark, sf_dir, name).select(*columns)
        found = recommend.recommend(rows, profile.profile(rows))
        out += [(name, found.pick, *w) for w in found.warnings]
    return as_rows(spark, "table string, pick string, level string, title string, figures string", out)


@query()
def method_runs_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five methods on lineitem: axes, inertia and the axes that their rules keep."""
    rows, out = _flags(spark, sf_dir), []
    asked = {"pca": {"numeric": ["quantity", "price", "l_tax"]}, "ca": {"categorical": ["q", "l_returnflag"]}, "mca": {"categorical": ["q", "e", "l_returnflag"]}, "famd": {"numeric": ["price"], "categorical": ["q"]},
             "mfa": {"groups": {"size": ["quantity", "price"], "terms": ["l_discount", "l_tax"]}}}
    for name, options in asked.items():
        s = methods.run(rows, name, **options)
        out.append((name, len(s.values), round(float(s.total), 6), s.k))
    return as_rows(spark, "method string, axes int, inertia double, kept int", out)


@query(f"with {MEASURES_SQL} select l_returnflag as level, cast(count(*) as bigint) as n, round(avg(quantity), 5) as quantity, round(avg(price), 4) as price from li group by 1")
def supplementary_levels_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid of each flag on two measures."""
    found = factor_maps.supplementary_levels(measures(spark, sf_dir), "l_returnflag", ["quantity", "price"])
    return found.select("level", "n", F.round("quantity", 5).alias("quantity"), F.round("price", 4).alias("price"))


@query(f"with {MEASURES_SQL} select cast(count(*) as bigint) as n, round(sum(w), 3) as weight, round(sum(w * (quantity - 25) * (quantity - 25)), 2) as xx, round(sum(w * (quantity - 25) * (price - 30000)) / 1000, 2) as xy from (select *, 1 + l_tax as w from li)")
def weighted_gram_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted Gram matrix about a given centre."""
    rows = measures(spark, sf_dir)
    g, w = moments.gram(rows, [col("quantity"), col("price")], [25.0, 30000.0], 1 + col("l_tax"))
    return as_rows(spark, "n long, weight double, xx double, xy double", [(rows.count(), round(w, 3), round(float(g[0, 0]), 2), round(float(g[0, 1]) / 1000, 2))])


@query(f"""with {MEASURES_SQL}, f as (select {', '.join(f'avg({m}) m{i}, stddev_samp({m}) s{i}' for i, m in enumerate(MEASURES))} from li)
  select l_returnflag as name, cast(count(*) as bigint) as n, round(avg({' + '.join(f'power(({m} - m{i}) / s{i}, 2)' for i, m in enumerate(MEASURES))}), 6) as distance from li, f group by 1""")
def rows_projected_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line projected on all axes of its measures: the mean squared distance from the centre by flag, which the axes keep."""
    z = measures(spark, sf_dir)
    found = correlation_pca(z, MEASURES)
    squares = [F.pow(F.col(f"F{k}"), F.lit(2)) for k in range(1, len(MEASURES) + 1)]
    rows = found.scores(z, len(MEASURES), keep=["l_returnflag"]).groupBy(F.col("l_returnflag").alias("name"))
    return rounded(rows.agg(F.count("*").alias("n"), F.avg(sum(squares[1:], squares[0])).alias("distance")))


def spearman_matrix(df: DataFrame, names: list[str]) -> np.ndarray:
    """Rank correlations as a matrix."""
    return inference.matrix_of(inference.spearman(df, names), names)
