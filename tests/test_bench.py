"""The pages that the benchmark serves from stored marts."""

from __future__ import annotations

import bench
from martloom.catalog.queries import all_queries
from martloom.plans.runner import run_marts
from martloom.sources.star import star_snapshot


def test_stored_pages_read_the_marts_of_a_run(spark, small_dir, tmp_path):
    snap = star_snapshot(spark, small_dir, "brand")
    run_marts(snap, str(tmp_path))
    for name, page in bench.stored_pages(spark, snap, str(tmp_path)).items():
        assert page(), name


def test_benchmarked_queries_exist():
    assert set(bench.MARTS) | set(bench.OTHERS) <= set(all_queries())
