"""Shapes of plans."""

import pytest

from catalog import analysis  # noqa: F401
from catalog.base import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sp06_psd_outliers", "sp07_aperiodic_fit", "sp08_band_readout", "sp10_local_peaks"])
def test_spectra_are_computed_once(spark, name):
    """What reads a spectrum several times reads the stored one: no Python node is left in the plan."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Scan parquet" in plan or "FileScan parquet" in plan
    assert not any(node in plan for node in ("ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups"))
