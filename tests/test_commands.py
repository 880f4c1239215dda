import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.test_jobs import growth_frame
from tests.test_planning import LINE, SETTINGS, STUDY, boxes, lined
from understory.plans import commands
from understory.sources import files

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def put(folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_plans_are_written_with_provenance(spark, tmp_path):
    at = put(tmp_path / "in", boxes=boxes(spark))
    got = commands.run(spark, "plan-change", at, {**SETTINGS, "pair": ["a", "b"], "study_box": STUDY, "tile_count": 4}, str(tmp_path / "out"))
    assert spark.read.parquet(got["plan"]).count() == 4 and spark.read.parquet(got["summary"]).first().tiles == 4
    assert json.loads(files.read_text(spark, got["plan"] + ".provenance.json"))["row_count"] == 4
    epochs = commands.run(spark, "screen-epochs", None, SETTINGS, str(tmp_path / "epochs"))
    assert {r.name: r.admitted for r in spark.read.parquet(epochs["epochs"]).collect()} == {"a": True, "b": True, "winter": False}
    with pytest.raises(ValueError):
        commands.run(spark, "nothing", at, {}, "x")
    with pytest.raises(KeyError):
        commands.run(spark, "plan-change", at, {}, "x")


def test_line_commands(spark, tmp_path):
    cells, line = lined(spark)
    at = put(tmp_path / "in", labels=cells, segments=line)
    flags = commands.run(spark, "flag-lines", at, LINE, str(tmp_path / "flags"))
    assert spark.read.parquet(flags["flags"]).where("excluded").count() == 40
    assert spark.read.parquet(flags["counts"]).first().disputed_removed == 1
    check = commands.run(spark, "check-lines", at, LINE, str(tmp_path / "check"))
    assert json.loads(files.read_text(spark, check["check"]))["start"]["bands"]["near"]["isolated"]["observed"] == 10
    verified = commands.run(spark, "verify-lines", at, LINE, str(tmp_path / "verified"))
    assert len(json.loads(files.read_text(spark, verified["verification"]))["placebo"]) == 1


def test_growth_commands(spark, tmp_path):
    at = put(tmp_path / "in", cells=growth_frame(spark))
    gate = commands.run(spark, "growth-gate", at, {"screens": {"all": "true"}, "block_m": 500, "least": 50}, str(tmp_path / "gate"))
    assert json.loads(files.read_text(spark, gate["gate"]))["decision"] == "PASS"
    folds = commands.run(spark, "assign-folds", at, {"block_m": 500, "folds": 5}, str(tmp_path / "folds"))
    by = [r["count"] for r in spark.read.parquet(folds["folds"]).groupBy("fold").count().collect()]
    assert len(by) == 5 and max(by) - min(by) <= 1


def test_storage_and_text(spark, tmp_path):
    got = commands.run(spark, "estimate-storage", None, {"arrays": {"a": {"shape": [1024, 1024, 1024], "item_bytes": 4}}}, str(tmp_path / "s"))
    assert spark.read.parquet(got["storage"]).first().gib == 4.0
    at = put(tmp_path / "in", files=spark.createDataFrame([("a.txt", "fine\nbad —")], "path string, text string"))
    got = commands.run(spark, "check-text", at, {}, str(tmp_path / "t"))
    assert spark.read.parquet(got["characters"]).select(F.max("line")).first()[0] == 2


def test_everything_else_works_without_the_training_data_folders(tmp_path):
    """A copy without the operators, their tests and the pipeline still imports, registers its queries and keeps its SQL."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json"))
    assert not (copy / "understory" / "llm").exists() and not (copy / "corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e, understory.plans.commands; q = e.queries(); assert len(q) > 90 and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q); print('ok')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=300).stdout.strip() == "ok"
