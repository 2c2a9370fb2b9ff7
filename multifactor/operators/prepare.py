"""Preparation: roles, missing values, transforms and scaling of the active columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from multifactor.functions import columns as C
from multifactor.functions.columns import col
from multifactor.operators.profile import _missing, _number
from multifactor.operators.quantiles import quantiles

SCALINGS = ("none", "center", "z", "pareto", "vast", "range", "robust")


@dataclass(frozen=True)
class Roles:
    """Columns by role."""

    active: Sequence[str]
    supplementary_numeric: Sequence[str] = ()
    supplementary_categorical: Sequence[str] = ()
    identifier: str | None = None

    @classmethod
    def of(cls, roles: Mapping[str, str]) -> Roles:
        """From a map of column to role; only the first identifier counts."""
        names = lambda role: [n for n, r in roles.items() if r == role]
        return cls(names("active"), names("supp-num"), names("supp-cat"), next(iter(names("id")), None))


@dataclass(frozen=True)
class Prepared:
    """A prepared table.

    ``frame`` has ``_row``, ``_id``, the scaled active columns under their names, the unscaled imputed ones as
    ``raw:<name>``, and the supplementary columns.
    """

    frame: DataFrame
    active: list[str]
    n: int
    centre: dict[str, float]
    scale: dict[str, float]
    imputed: dict[str, int]
    shifted: list[str]
    missing_share: float
    supplementary_numeric: list[str] = field(default_factory=list)
    supplementary_categorical: list[str] = field(default_factory=list)

    @property
    def p(self) -> int:
        """Number of active columns."""
        return len(self.active)

    def raw(self, name: str) -> str:
        """The unscaled column of an active one."""
        return f"raw:{name}"


def missing_map(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A boolean column for each of ``names``: is the cell present?"""
    return df.select("_row", *[(~_missing(df, n)).alias(n) for n in names])


def scaled(x: Column, how: str, figures: Mapping[str, float | None]) -> Column:
    """One scaling of a column, from its figures: mean, sd, min, max, median, mad, iqr."""
    centre, scale = scaling_of(how, figures)
    if scale == 0:
        return F.when(x.isNotNull(), F.lit(0.0))
    return (x - F.lit(centre)) / F.lit(scale)


def scaling_of(how: str, f: Mapping[str, float | None]) -> tuple[float, float]:
    """Centre and divisor of a scaling; a divisor of 0 stands for a column that becomes 0 everywhere."""
    mean, sd = f["mean"] or 0.0, f["sd"] or 0.0
    if how == "none":
        return 0.0, 1.0
    if how == "center":
        return mean, 1.0
    if how == "z":
        return mean, sd
    if how == "pareto":
        return mean, sd**0.5
    if how == "vast":
        return mean, sd * sd / mean if mean else sd
    if how == "range":
        return f["min"] or 0.0, (f["max"] or 0.0) - (f["min"] or 0.0)
    if how == "robust":
        return f["median"] or 0.0, f["mad"] or f["iqr"] or 1.0
    raise ValueError(f"no such scaling: {how}")


def figures_of(df: DataFrame, columns: Mapping[str, Column], robust: bool = False) -> dict[str, dict[str, float | None]]:
    """Mean, sd, min, max of each column in one aggregation; with ``robust`` also exact median, IQR and MAD."""
    wanted = [f(x).alias(f"{i}:{k}") for i, x in enumerate(columns.values()) for k, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))]
    row = df.agg(*wanted).first().asDict()
    out = {}
    for i, name in enumerate(columns):
        out[name] = {k: row[f"{i}:{k}"] for k in ("mean", "sd", "min", "max")}
    if robust:
        for name, q in quantiles(df, columns, [0.5, 0.25, 0.75]).items():
            out[name] |= {"median": q[0] or 0.0, "iqr": (q[2] or 0.0) - (q[1] or 0.0)}
        for name, q in quantiles(df, {n: F.abs(x - F.lit(out[n]["median"])) for n, x in columns.items()}, [0.5]).items():
            out[name]["mad"] = 1.4826 * (q[0] or 0.0)
    return out


def prepare(df: DataFrame, roles: Roles, *, missing: str = "listwise", transform: str = "none", scaling: str = "z", decimal: str = "auto") -> Prepared:
    """Active columns as numbers: missing values dropped (``listwise``) or filled (``mean``, ``median``), transformed, scaled.

    Filling leaves out rows without any active value. Fewer than three rows left is an error. Medians are exact.
    """
    active = list(roles.active)
    number = {n: _number(df, n, decimal) for n in active}
    extra = [*roles.supplementary_numeric, *roles.supplementary_categorical]
    shown = [*active, *extra]
    label = F.concat(F.lit("Ind "), (F.col("_row") + 1).cast("string"))
    if roles.identifier:
        label = F.coalesce(col(roles.identifier).cast("string"), label)
    supplementary = [_number(df, n, decimal).alias(n) for n in roles.supplementary_numeric]
    supplementary += [F.when(~_missing(df, n), F.trim(col(n).cast("string"))).alias(n) for n in roles.supplementary_categorical]
    presence = sum(((~_missing(df, n)).cast("double") for n in shown), F.lit(0.0)) / max(1, len(shown))
    base = df.select("_row", label.alias("_id"), presence.alias("_present"), *[x.alias(raw_name(n)) for n, x in number.items()], *supplementary)
    raw = {n: col(raw_name(n)) for n in active}
    whole = F.lit(True)
    some = F.lit(False)
    for x in raw.values():
        whole, some = whole & x.isNotNull(), some | x.isNotNull()
    counts = base.agg(F.count_if(whole), F.count_if(some), 1 - F.avg("_present"), *[F.count_if(some & x.isNull()) for x in raw.values()],
                      *([F.avg(x) for x in raw.values()] if missing == "mean" else [])).first()
    if missing == "listwise":
        kept, n, imputed = base.where(whole), counts[0], dict.fromkeys(active, 0)
    else:
        fills = counts[3 + len(active) :] if missing == "mean" else [q[0] for q in quantiles(base, raw, [0.5]).values()]
        kept = base.where(some).withColumns({raw_name(a): F.coalesce(raw[a], F.lit(v)) for a, v in zip(active, fills, strict=True)})
        n, imputed = counts[1], dict(zip(active, counts[3 : 3 + len(active)], strict=True))
    if n < 3:
        raise ValueError("fewer than 3 complete rows are left; impute, or choose other active columns")
    values = raw
    shifted: list[str] = []
    if transform != "none":
        least = kept.agg(*[F.min(x) for x in raw.values()]).first()
        values = {a: C.transformed(x, transform, m) for (a, x), m in zip(raw.items(), least, strict=True)}
        shifted = [a for a, m in zip(active, least, strict=True) if m <= 0 and transform != "sqrt"]
    figures = figures_of(kept, values, robust=scaling == "robust")
    pairs = {a: scaling_of(scaling, figures[a]) for a in active}
    frame = kept.select("_row", "_id", *[scaled(values[a], scaling, figures[a]).alias(a) for a in active], *[raw[a] for a in active], *[col(e) for e in extra])
    return Prepared(frame, active, n, {a: c for a, (c, _) in pairs.items()}, {a: s for a, (_, s) in pairs.items()}, imputed, shifted, counts[2] or 0.0,
                    list(roles.supplementary_numeric), list(roles.supplementary_categorical))


def raw_name(name: str) -> str:
    """The unscaled column's name."""
    return f"raw:{name}"
