"""Which factor method suits a profiled table, with warnings and the figures behind them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from multifactor.functions.columns import col
from multifactor.operators.adequacy import bartlett
from multifactor.operators.inference import cramer, matrix_of, pairwise_correlations

#: The thresholds of the rules.
WEAK_R, REDUNDANT_R, ROWS_PER_VARIABLE, LEAST_ROWS = 0.30, 0.90, 5, 50
RARE_SHARE, RARE_ROWS, WEAK_V, LEAST_EXPECTED, ZEROS = 0.02, 5, 0.10, 5, 0.20
PICK_ORDER = ("mfa", "famd", "mca", "ca", "pca")


@dataclass(frozen=True)
class Advice:
    """Verdict of each method (recommended, possible, not applicable), warnings (level, title, figures) and the pick."""

    verdicts: dict[str, str]
    warnings: list[tuple[str, str, str]]
    pick: str | None
    blocks: dict[str, list[str]]


def name_blocks(names: Sequence[str]) -> dict[str, list[str]]:
    """Blocks of variables by the part of their names before _ or -; empty if the names do not speak for blocks.

    At least six variables, two blocks of two or more that hold three quarters of them, and one block of three.
    """
    found: dict[str, list[str]] = {}
    for n in names:
        parts = re.split(r"[_-]", n)
        if len(parts) > 1 and parts[0]:
            found.setdefault(parts[0].lower(), []).append(n)
    found = {k: v for k, v in found.items() if len(v) >= 2}
    held = sum(map(len, found.values()))
    fits = len(names) >= 6 and len(found) >= 2 and held >= 0.75 * len(names) and any(len(v) >= 3 for v in found.values())
    return found if fits else {}


def verdicts(numeric: int, categorical: int, blocks: bool = False) -> dict[str, str]:
    """Verdict of each method from the numbers of usable variables."""
    few = 0 < categorical <= 2 and numeric >= 3
    say = lambda best, can: "recommended" if best else "possible" if can else "not applicable"
    return {
        "pca": say(numeric >= 2 and (categorical == 0 or few), numeric >= 2),
        "ca": say(categorical == 2 and numeric == 0, categorical >= 2),
        "mca": say(categorical >= 3 and numeric == 0, categorical >= 2),
        "famd": say(numeric >= 1 and categorical >= 1 and not few, numeric >= 1 and categorical >= 1),
        "mfa": say(blocks, numeric + categorical >= 4),
        "hcpc": "possible",
    }


def looks_like_abundances(profiles: Sequence[Mapping]) -> float | None:
    """The share of zeros if three or more non-negative integer variables have many; else None."""
    if len(profiles) < 3 or not all(p["all_int"] and not p["negatives"] for p in profiles):
        return None
    share = sum(p["zeros"] for p in profiles) / max(1, sum(p["n"] for p in profiles))
    return share if share >= ZEROS else None


def rare_levels(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, level, n, share): levels with under 5 rows or 2 % of them."""
    n, out = df.count(), None
    for name in names:
        one = df.where(col(name).isNotNull()).groupBy(col(name).cast("string").alias("level")).agg(F.count("*").alias("n")).select(F.lit(name).alias("variable"), "level", "n", (100 * F.col("n") / max(1, n)).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out.where((F.col("n") < RARE_ROWS) | (F.col("share") < 100 * RARE_SHARE))


def recommend(df: DataFrame, profiled: DataFrame) -> Advice:
    """Verdicts, warnings and the method to start with, from the profile and the table.

    Correlations use the rows that both variables have; missing values are no level of their own.
    """
    rows = [r.asDict() for r in profiled.orderBy("position").collect()]
    numeric = [r for r in rows if r["role"] == "active" and r["kind"] == "numeric"]
    categorical = [r for r in rows if r["role"] == "supp-cat" and r["distinct"] >= 2]
    n = rows[0]["n"] + rows[0]["missing"] if rows else 0
    names, labels = [r["name"] for r in numeric], [r["name"] for r in categorical]
    blocks = name_blocks(names)
    found = verdicts(len(names), len(labels), bool(blocks))
    warnings: list[tuple[str, str, str]] = []
    p = len(names) + len(labels)
    if n and p and n < LEAST_ROWS:
        warnings.append(("warn", "small sample", f"{n} rows"))
    if n and p and n < ROWS_PER_VARIABLE * p:
        warnings.append(("warn", "few rows per variable", f"{n / p:.1f} each"))
    if len(names) >= 2:
        pairs = pairwise_correlations(df, names)
        r = matrix_of(pairs, names)
        sizes = [abs(x.r) for x in pairs.collect()]
        mean, strong, redundant = sum(sizes) / len(sizes), sum(s >= WEAK_R for s in sizes), sum(s >= REDUNDANT_R for s in sizes)
        test = bartlett(r, min(x["n"] for x in numeric))
        none = test["p"] >= 0.05 or (mean < 0.20 and strong <= 1)
        warnings.append(("bad", "no correlation to summarise", f"mean |r| = {mean:.3f}, p = {test['p']:.3g}") if none else ("ok", "correlation structure", f"mean |r| = {mean:.3f}, strong pairs {strong}"))
        if redundant:
            warnings.append(("warn", "nearly redundant variables", f"{redundant} pairs"))
    if (zeros := looks_like_abundances(numeric)) is not None:
        warnings.append(("warn", "looks like abundances", f"{100 * zeros:.0f} % zeros"))
    if labels and (rare := rare_levels(df, labels).count()):
        warnings.append(("warn", "rare categories", f"{rare} levels"))
    if len(labels) >= 2:
        top = cramer(df, labels).agg(F.max("v")).first()[0]
        warnings.append(("bad" if top < WEAK_V else "ok", "association of categories", f"largest V = {top:.3f}"))
    of = lambda verdict: next((m for m in PICK_ORDER if found[m] == verdict), None)
    return Advice(found, warnings, of("recommended") or of("possible"), blocks)
