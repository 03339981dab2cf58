"""The command line builds a star and answers a question (separate JVM)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(args, timeout=600):
    out = subprocess.run([sys.executable, "-m", "almacen", *args, "--master", "local[2]"], cwd=ROOT,
                         capture_output=True, text=True, timeout=timeout, check=True)
    return out.stdout


def test_build_then_query(scratch):
    out_dir = scratch("cli-star")
    summary = json.loads(_run(["build", "--tables", "/root/testdata/sf0.001", "--out", out_dir])
                         .strip().splitlines()[-1])
    assert summary["rows"]["fact_ventas"] == 5705 and summary["summary"]["revenue"] == 86024891.6
    shown = _run(["query", "--star", out_dir, "--sql",
                  "SELECT count(*) AS n FROM fact_ventas WHERE is_cancelled = 1"])
    assert "|n|" in shown.replace(" ", "")
