"""Formulas of the SQL counterparts against the functions they restate."""
import duckdb
import pytest

from oracles import metrics
from stillvalid.functions.pvalues import chi2_sf


@pytest.mark.parametrize("chi2", [0.5, 9.0, 30.0, 1399.0, 1401.0, 4100.0, 1e5])
def test_chi_square_tail_holds_for_large_statistics(chi2):
    got = duckdb.sql(f"SELECT {metrics._P9_LARGE} FROM (SELECT {chi2}::DOUBLE AS chi2)").fetchall()[0][0]
    assert got == pytest.approx(chi2_sf(chi2, 9), abs=1e-9)
    assert all(metrics._P9_LARGE in metrics.SQL[q] for q in ("e9_d_calibration_p", "e21_seed_summary"))
