"""Reports: the numbered tables of a run, its warnings, and a plain page."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from multifactor.functions.columns import col
from multifactor.operators import describe, figures, layouts, retention, rotation
from multifactor.operators.adequacy import Diagnosis, advice
from multifactor.operators.cluster import Hcpc, cluster_test_values, inertias, paragons
from multifactor.operators.factor_maps import factor_map, supplementary_levels, supplementary_numeric
from multifactor.operators.inference import matrix_of, pairwise_correlations
from multifactor.operators.pca import Pca, correlation_pca
from multifactor.operators.prepare import Prepared
from multifactor.sources.writers import format_number, package


@dataclass(frozen=True)
class Analysis:
    """A run of principal components: what was found and the numbered tables (frames, none of them collected)."""

    prepared: Prepared
    found: Pca
    k: int
    rotated: rotation.Rotation
    rules: list[retention.Criterion]
    tables: dict[str, DataFrame]


def analyse(spark: SparkSession, prepared: Prepared, diagnosis: Diagnosis | None = None, *, k: int | None = None, method: str = "varimax", replicates: int = 100) -> Analysis:
    """Components, retention, rotation, maps and description of a prepared table."""
    names = prepared.active
    found = correlation_pca(prepared.frame, names)
    horn = retention.parallel_summary(retention.parallel_normal(spark, prepared.n, prepared.p, replicates)).orderBy("axis").toPandas()
    rules = retention.criteria(found, horn["p95"].tolist())
    k = k or retention.consensus(rules)
    turned = rotation.rotate(found.loadings[:, :k], method)
    extra = [*prepared.supplementary_numeric, *prepared.supplementary_categorical]
    mapped = factor_map(prepared.frame, found, k, turned, keep=["_row", "_id", *extra])
    axes = [f"F{i + 1}" for i in range(k)]
    tables = {
        "variables": figures.scale_profile(prepared.frame.select(*[col(prepared.raw(n)).alias(n) for n in names]), names),
        "correlations": pairwise_correlations(prepared.frame, names),
        "eigenvalues": retention.eigenvalue_table(spark, found, k, horn["p95"].tolist()),
        "criteria": figures.criteria_chart(spark, rules, k),
        "loadings": found.loading_table(spark),
        "pattern": rotation.pattern_table(spark, turned, names),
        "simple structure": rotation.diagnostics(spark, turned, names),
        "component correlations": rotation.phi_table(spark, turned),
        "variable coordinates": mapped.variable_table(spark),
        "individuals": mapped.individual_table(),
        "dimension description": describe.describe_numeric(prepared.frame.select(*[col(n) for n in [*names, *prepared.supplementary_numeric]], *found.score_columns(k)), [*names, *prepared.supplementary_numeric], axes),
        "residuals": layouts.residual_matrix(spark, found.correlation, turned, names),
        "structure": layouts.structure_table(spark, turned, names),
        "correlation matrix": layouts.correlation_table(spark, found.correlation, names),
    }
    if extra:
        tables["supplementary"] = layouts.supplementary_table(mapped.individuals, list(prepared.supplementary_numeric), list(prepared.supplementary_categorical), axes)
    if prepared.supplementary_numeric:
        tables["supplementary numbers"] = supplementary_numeric(mapped.individuals, list(prepared.supplementary_numeric), axes)
    for c in prepared.supplementary_categorical:
        tables[f"categories of {c}"] = supplementary_levels(mapped.individuals, c, axes)
        tables[f"test values of {c}"] = describe.test_values(mapped.individuals, c, axes)
    return Analysis(prepared, found, k, turned, rules, tables)


def cluster_tables(clustered: Hcpc) -> dict[str, DataFrame]:
    """Assignment, description by axis, paragons and merges of a clustering."""
    return {"clusters": clustered.rows, "cluster description": cluster_test_values(clustered.rows, clustered.axes), "paragons": paragons(clustered.rows, clustered.axes, clustered.centres), "merges": clustered.merges()}


def cluster_text(clustered: Hcpc) -> str:
    """A line on each cluster: its size and what marks it."""
    rows = cluster_test_values(clustered.rows, clustered.axes).toPandas()
    out = [f"{clustered.q} clusters hold {100 * inertias(clustered.rows, clustered.axes)['ratio']:.1f} % of the inertia between them."]
    for g, part in rows.groupby("cluster"):
        marks = ", ".join(f"{r.measure} (v = {r.v:+.1f})" for r in part.sort_values("v", key=abs, ascending=False).itertuples() if abs(r.v) >= 1.96)
        out.append(f"Cluster {g + 1}: {int(part['n'].iloc[0])} rows; {marks or 'nothing marks it'}.")
    return "\n".join(out)


def warnings(analysis: Analysis, diagnosis: Diagnosis | None = None, silhouette: float | None = None) -> list[str]:
    """What limits the reading of a run."""
    out = []
    if diagnosis is not None:
        out += [f"{check}: {text}" for check, level, text in advice(diagnosis) if level in ("warn", "bad")]
    rmsr = describe.residuals(analysis.found.correlation, analysis.rotated.pattern, analysis.rotated.phi)["rmsr"]
    if rmsr >= 0.08:
        out.append(f"the axes leave correlations unexplained (root mean square {rmsr:.3f})")
    if not analysis.rotated.converged:
        out.append("the rotation did not converge")
    if silhouette is not None and silhouette < 0.25:
        out.append(f"the clusters overlap (silhouette {silhouette:.2f})")
    note = retention.retention_note(float(analysis.found.cumulative[analysis.k - 1]), analysis.k)
    return out if note == "adequate" else [*out, note]


def page(title: str, sections: Mapping[str, str | DataFrame], rows: int = 50) -> str:
    """A plain HTML page: texts as paragraphs, frames as tables of their first rows."""
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, what in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(what, str):
            out += [f"<p>{html.escape(line)}</p>" for line in what.splitlines()]
            continue
        cell = lambda v: html.escape(format_number(v, 4) if isinstance(v, float) else "" if v is None else str(v))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in what.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in what.limit(rows).collect())
        out.append(f"<table><tr>{head}</tr>{body}</table>")
    return "\n".join(out)


def diagnostic_text(d: Diagnosis) -> str:
    """The checks as plain text."""
    return "\n".join([f"Score {d.score} ({d.grade}); n = {d.n}, p = {d.p}", *[f"[{level}] {check}: {text}" for check, level, text in advice(d)]])


def packed(analysis: Analysis, texts: Mapping[str, str] | None = None, without: Sequence[str] = ("individuals",)) -> bytes:
    """The tables as a ZIP of CSV files, without those as large as the data; write these with ``writers.write_table``."""
    return package({n: t for n, t in analysis.tables.items() if n not in without}, texts)


def correlation_matrix(df: DataFrame, names: Sequence[str]):
    """Correlations of pairwise complete rows as a matrix."""
    return matrix_of(pairwise_correlations(df, names), names)
