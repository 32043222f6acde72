"""The package reaches the workers of a session that starts somewhere else."""

import os
import re
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = f"""
import sys
sys.path.insert(0, {ROOT!r})
from __spark_entry__ import queries
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,512]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", sys.argv[1]).config("spark.sql.shuffle.partitions", "2").config("spark.executor.memory", "512m").config(
    "spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate()
print("ROWS", queries()["quantiles_req_small_groups"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    # workers write below the home folder of Spark, which need not be writable: a folder of links stands in for it
    installed, home = os.path.dirname(pyspark.__file__), tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for name in os.listdir(installed):
        if name != "work":
            os.symlink(os.path.join(installed, name), home / name)
    # a small JVM of its own beside that of the other tests, which must not hand down its settings
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET", "SPARK_CONF_DIR"):
        env.pop(name, None)
    env |= {
        "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_HOME": str(home), "SPARK_LOCAL_DIRS": str(tmp_path / "local"),
        "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": f"--driver-memory 512m --driver-java-options -Djava.io.tmpdir={tmp_path} pyspark-shell",
    }
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM, str(tmp_path / "checkpoints")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS" in done.stdout, done.stderr[:3000] + "\n ... \n" + done.stderr[-1500:]


def test_without_the_training_data_package(monkeypatch, capsys):
    """A missing folder, or a library that only its operators need, leaves all other queries."""
    import __spark_entry__ as entry

    plain = entry.importlib.import_module

    def refuse(name, *rest):
        if name.startswith(("inodeatlas.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}")
        return plain(name, *rest)

    whole = set(entry.queries())
    monkeypatch.setattr(entry.importlib, "import_module", refuse)
    left = set(entry.queries())
    assert left and whole - left == {n for n in whole if re.match(r"op\d+_|pipeline$", n)}
    assert set(entry.oracle_sql()) <= left and "left out" in capsys.readouterr().err
