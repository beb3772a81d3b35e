import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check_oracles import connect, difference
from conftest import SF_DIR
from tachyline.workload.queries import QUERIES

QUICK = [
    "rollup_1m", "rollup_1h", "live_rollups", "first_arrival", "late_audit", "sequence_gaps", "counter_rate",
    "dropout_replay", "wire_size_audit", "dead_letter_counts", "find_rollups_1h", "live_board",
    "stepwise_rollup_1m", "stepwise_rollup_1h", "archived_twice", "record_accounting", "stored_dead_letters",
    "stream_late_rollups", "stream_dedup_rollups", "stream_dropped", "storage_report", "ingest_summary",
    "partition_skew", "find_channels",
]


def test_the_flagship_query_has_rows(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["car_id", "sensor_id", "bucket", "samples", "average", "minimum", "maximum"]
    assert not rows.isEmpty()


def test_every_query_has_its_sql(spark):
    assert not set(QUERIES) - set(entry.oracle_sql())
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    expected = connect(SF_DIR).execute(entry.oracle_sql()[name]).df()
    assert difference(got, expected) == ""


def test_the_late_rule_drops_something(spark):
    assert entry.queries()["stream_dropped"](spark, SF_DIR).first()["dropped"] > 0


def test_the_driver_contract_survives_without_the_training_queries(monkeypatch):
    """The subpackage and the pipeline may be gone; an error inside them must not pass for that."""
    import importlib

    real = importlib.import_module

    def gone(name, *rest):
        if name.startswith(("tachyline.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", gone)
    assert entry._optional("tachyline.llm.queries") is None and entry._optional("corpus_pipeline") is None

    def broken(name, *rest):
        raise ModuleNotFoundError("No module named 'numpy'", name="numpy")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("corpus_pipeline")


def test_a_copy_without_the_training_folders_imports_and_runs(tmp_path):
    """The files as they are, less the two folders, in a fresh process."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ignore = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    for pipeline in (True, False):
        copy = tmp_path / f"copy-{pipeline}"
        shutil.copytree(root, copy, ignore=ignore)
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink()
        code = (
            "import __spark_entry__ as e\n"
            "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()\n"
            "from tachyline.session import build_session\n"
            "spark = build_session('local[2]', shuffle_partitions=2)\n"
            "print('rows', e.entry(spark).count())\n"
        )
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=240)
        assert out.returncode == 0, out.stderr[-2000:]
        assert "rows" in out.stdout


def test_partition_skew_covers_all_readings(spark):
    rows = entry.queries()["partition_skew"](spark, SF_DIR).collect()
    assert sum(row["readings"] for row in rows) == 1000
    assert abs(sum(row["share"] for row in rows) - 1) < 1e-5


def test_plans_of_the_registered_queries_stay_distributed(spark):
    """No row-level window over a whole table, no cross or nested-loop join, no cached data."""
    for name in ("late_audit", "sequence_gaps", "systematic_sample", "counter_rate", "threshold_alerts", "lane_scale"):
        plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        for line in plan.splitlines():
            if "windowspecdefinition(" in line and "_block" not in line:
                raise AssertionError(f"{name}: {line.strip()[:200]}")
