"""Plans: scans read only what a query needs, and nothing multiplies rows."""

from __future__ import annotations

import re

import pytest

from strandline.plans import registry

from .conftest import DATA


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> set[str]:
    return {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>)?[^>]*)>", text) for c in schema.split(",")}


@pytest.mark.parametrize(
    ("name", "needed"),
    [
        ("variant_summary_by_chrom", {"record_id", "chrom", "ref_allele", "alt_allele", "qual"}),
        ("burden_by_sample", {"record_id", "sample_id"}),
        ("p3_found", {"profile_id", "gene_id", "chrom", "start_pos", "end_pos"}),
        ("p7_found", {"line_id", "fmt", "line_text"}),
    ],
)
def test_scans_are_pruned(spark, name, needed):
    got = read_columns(plan(registry.QUERIES[name](spark, str(DATA))))
    assert got
    assert got <= needed


@pytest.mark.parametrize("name", ["p3_found", "p7_found", "variant_summary_by_chrom", "peaks_in_genes", "calls_in_genes", "merged_peaks", "tumor_against_germline"])
def test_no_plan_multiplies_rows(spark, name):
    text = plan(registry.QUERIES[name](spark, str(DATA)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    text = plan(registry.QUERIES["tumor_against_germline"](spark, str(DATA)))
    assert "IsNotNull(pos)" in text and "EqualTo(panel,tumor)" in text
