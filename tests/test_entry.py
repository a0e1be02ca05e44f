from __future__ import annotations

import pytest

import __spark_entry__
from tidemark import registry

SAMPLE = [
    "audit_report", "bars_coarse_complete", "forecast_samples", "rolling_sigma", "ewma_sigma", "empirical_quantiles_by_day", "pinball_by_model_level", "transition_counts",
    "independence_lr", "seasonal_sigma", "acf_within_session", "clustered_mean_z2", "block_bootstrap", "holm_adjust", "interp_grid", "pending_cases", "year_scores",
]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(compare, name):
    compare(registry.QUERIES[name], registry.ORACLES[name])


def test_entry_imports_without_a_session_or_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pinball_by_model_level' in q and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True)
