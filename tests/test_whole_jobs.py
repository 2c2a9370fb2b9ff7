"""Registered queries run with their operators' production settings."""

import pytest

from multifactor.operators import retention
from multifactor.plans import factors


@pytest.mark.parametrize(("name", "replicates"), [("parallel_permuted_lineitem", 20), ("parallel_analysis_lineitem", 100)])
def test_parallel_analysis_draws_the_default_replicates(spark, sf_dir, monkeypatch, name, replicates):
    seen, summary = [], retention.parallel_summary
    monkeypatch.setattr(retention, "parallel_summary", lambda draws: seen.append(draws.select("replicate").distinct().count()) or summary(draws))
    factors.QUERIES[name](spark, sf_dir)
    assert seen == [replicates]
