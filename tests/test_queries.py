"""A cross-section of the registered queries against their SQL."""

import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "io07_merge_bad_channels", "pr03_session_label", "fi04_crop_rezero", "fi07_debounce", "jo08_nearest_join", "jo11_overlap_join", "jo13_match_responses",
    "jo15_join_fallback", "wi02_window_panes", "wi08_conform_grid", "wi12_bad_share", "ts01_robust_z", "ts06_interpolate_max_gap", "ts15_spike_runs",
    "ts25_align_average", "sp01_welch_psd", "ag08_electrode_delta", "ev03_peaks_to_timeseries", "ev06_events_from_runs", "at04_deviation_z", "at09_sweep",
    "sp01_welch_absent", "sp02_tf_power", "sp02_tf_power_absent", "io01_read_wide", "io01_read_wide_no_index", "io04_read_many_mixed", "fi09_sample_random", "dq01_long_windows",
    "at01_deviation_l2", "st09_corr_matrix", "wi14_interval_contrast", "dq08_compare_timebases", "st06_permutation_test", "st17_isc", "st18_isc_null", "dq01_artifact_windows", "flow1_power_contrast",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    order = sorted(cols)
    assert order == sorted(got.columns)
    a = Counter(tuple(norm(r[c]) for c in order) for r in got.collect())
    b = Counter(tuple(norm(r[cols.index(c)]) for c in order) for r in cur.fetchall())
    assert a == b


def test_sweep_of_equal_means(spark, tmp_path):
    """Windows of few values have many equal means, so the quantiles fall among
    them; whether they are equal to the last digit depends on the order of the sum."""
    rng = random.Random(2)
    rows = [(100 * u + i, datetime(2024, 1, 1) + timedelta(seconds=i), u, "view", rng.choice([0.1, 0.2, 0.7])) for u in range(90) for i in range(30)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"})
    events.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    cur = con.execute(entry.oracle_sql()["at09_sweep"])
    got = entry.queries()["at09_sweep"](spark, str(tmp_path)).select([c[0] for c in cur.description]).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["region", "n", "mean", "sd", "t"] and {r["region"] for r in got.collect()} == {"other", "web"}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200
