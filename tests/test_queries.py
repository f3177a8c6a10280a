"""Every registered query with SQL against DuckDB; the others for rows and schema."""

import oracle
import pytest

from padlens.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.differences(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["f4_pinch_features", "f7_kinematics", "f22_duration_summary"])
def test_means_equal_sql_on_more_rows(spark, name):
    """Means of terminating decimals fall on ties of the last digit where there are rows enough."""
    larger = SF.replace("0.001", "0.01")
    assert oracle.differences(registry.QUERIES[name](spark, larger), oracle.connect(larger), registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


@pytest.mark.parametrize("name", ["l2_linear_svm", "l3_forest", "l4_boosted", "l5_rff_svm", "l6_fusion"])
def test_detectors_score_val_and_test_rows_once(spark, name):
    rows = registry.QUERIES[name](spark, SF).select("event_id", "pool", "score").collect()
    assert len({r["event_id"] for r in rows}) > 0.999 * len(rows) and {r["pool"] for r in rows} == {"val", "test"}  # one id is twice in the table
    assert len({r["score"] for r in rows}) > len(rows) / 10


def test_entry_imports_without_the_training_data_part(monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith(("padlens.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("padlens.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    import padlens

    if hasattr(padlens, "llm"):
        monkeypatch.delattr(padlens, "llm")
    entry = real("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) == set(registry.ORACLES)
    sys.modules.pop("__spark_entry__", None)
