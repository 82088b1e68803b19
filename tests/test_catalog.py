"""Registered queries against their SQL on the smallest tables.

A few of each section by default; SPOTFLOW_ALL=1 runs every query.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

DATA = Path("/root/testdata/sf0.001")
ALL = entry_points.oracle_sql()
SOME = [
    "parse_events", "synthetic_vehicle", "flow_rate", "site_stats", "overstay", "understay", "stalled_windows",
    "ignore_region_join", "snap_to_roads", "cameras_covering", "valid_tracks", "smooth_track", "scene_delta",
    "densify", "shortest_paths", "frame_to_frame_candidates", "cluster_output", "id_sets", "event_feed", "search",
]
NAMES = sorted(ALL) if os.environ.get("SPOTFLOW_ALL") else SOME

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return names, sorted([tuple(map(clean, r)) for r in zip(*cols)], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = _rows(entry_points.queries()[name](spark, str(DATA)).toArrow())
    want = _rows(db.sql(ALL[name]).to_arrow_table())
    assert got == want and want[1]


def test_every_sql_has_a_query_and_entry_runs(spark):
    assert set(ALL) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
