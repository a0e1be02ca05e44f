from __future__ import annotations

import pytest

from tidemark.__main__ import main

SF = "/root/testdata/sf0.001"


def test_list_and_unknown_names(capsys):
    assert main(["list"]) == 0 and "pinball_by_model_level" in capsys.readouterr().out.split()
    assert main(["run", "nothing", "--tables", SF]) == 2
    with pytest.raises(SystemExit):
        main(["fly"])


def test_run_writes_once_and_compares(spark, tmp_path, capsys):
    out, store = f"file://{tmp_path}/out", f"file://{tmp_path}/store"
    assert main(["run", "session_label", "--tables", SF, "--compare", out]) == 0
    assert main(["run", "session_label", "--tables", SF, "--compare", out]) == 0
    assert "the same result" in capsys.readouterr().out
    assert main(["run", "audit_report", "--tables", SF, "--compare", out]) != 0
    assert main(["check", store]) == 1
