"""Queries against their SQL on the smallest tables (tools/check_queries.py covers all of them on larger ones)."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["read_srt", "interp_asof", "baro_fuse", "cell_aggregate", "fuse_surfels", "score_confidence", "epipolar_inliers", "edge_topology", "dsm_ortho",
         "stage_durations", "mission_state_machine", "pick_sources", "detect_planes", "atlas_layout", "read_srt_files", "read_telemetry_csv_files",
         "footprints_geojson", "widest_pair", "depth_range", "make_windows", "anchors", "raster_fill"]


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not there")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import __spark_entry__ as e
    from check_queries import compare, connect
    got = e.queries()[name](spark, SF).toPandas()
    assert len(got) and compare(got, connect(SF).execute(e.oracle_sql()[name]).df()) is None


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not there")
def test_plans_hold_no_cartesian_product(spark):
    import __spark_entry__ as e
    for name in ("route_summary", "cell_aggregate", "edge_topology", "score_confidence", "radius_join"):
        plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
