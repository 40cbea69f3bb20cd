"""Every registered query against its own SQL statement, and the shape of its plan."""

import os

import pytest
from oracle import ROOT, compare, database

from panelforge.queries import REGISTRY

# Ingest jobs share one code path: one per grain here, all nineteen in test_sources.
SAMPLE = {"ingest_vegetation", "ingest_population", "ingest_carbon_price"}
NAMES = [n for n in REGISTRY if not n.startswith("ingest_") or n in SAMPLE]
# The smallest data hold two entities per group, too few for standard errors.
LARGER = {"panel_standard_errors", "gap_to_turning_point", "turning_points", "panel_fixed_effects", "panel_fit_quality", "panel_standard_errors_staggered"}
# Fits and scores of models that no built-in function states.
PYTHON = {"silhouette_euclidean", "ridge_forecast_fit", "changepoint_forecast", "known_changepoint_fit", "known_changepoint_forecast", "phase_classifier", "boosted_stumps"}


def shape(name):
    def check(plan):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, "product or nested loop"
        assert name in PYTHON or "Python" not in plan, "rows leave the JVM"

    return check


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, con, folder):
    if name in LARGER:
        folder = f"{ROOT}/sf0.01"
        if not os.path.isdir(folder):
            pytest.skip("no test data")
        con = database(folder)
    ok, message = compare(REGISTRY[name], spark, con, folder, shape(name))
    assert ok, message
