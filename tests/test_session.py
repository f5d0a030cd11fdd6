"""Checkpoint folder: the session's setting is used; a local session without one gets
a fresh temporary folder (tests), and materialised tables land under it."""

import json
import os
import subprocess
import sys
import tempfile

from conftest import ROOT

SCRIPT = """
import json, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from ticketspark.session import checkpoint_root, materialize
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
before = s.sparkContext.getCheckpointDir()
root = checkpoint_root(s)
df = materialize(s.range(10), "probe")
print(json.dumps({{"before": before, "root": root, "n": df.count(),
                   "files": df.inputFiles()[0]}}))
"""


def test_local_session_without_checkpoint_dir_gets_temp_folder():
    empty_conf = tempfile.mkdtemp(prefix="ts-noconf-")
    env = dict(os.environ, SPARK_CONF_DIR=empty_conf)
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], env=env,
                         capture_output=True, text=True, timeout=300)
    line = [l for l in out.stdout.splitlines() if l.startswith("{")][-1]
    r = json.loads(line)
    assert r["before"] is None
    assert "ticketspark-ckpt-" in r["root"] and r["n"] == 10
    assert "ticketspark-ckpt-" in r["files"]


def test_configured_checkpoint_dir_is_used(spark):
    from ticketspark.session import checkpoint_root
    assert checkpoint_root(spark) == spark.sparkContext.getCheckpointDir()


def test_release_saved_deletes_tables(spark):
    from ticketspark.session import materialize, release_saved
    df = materialize(spark.range(5), "release-probe")
    path = df.inputFiles()[0].split("/release-probe-")[0]
    folder = [f for f in os.listdir(path.replace("file:", "")) if f.startswith("release-probe-")]
    assert folder
    deleted = release_saved(spark)
    assert any("release-probe-" in d for d in deleted)
    left = [f for f in os.listdir(path.replace("file:", "")) if f in folder]
    assert left == []


def test_release_deletes_the_named_tables_only(spark):
    from ticketspark.session import materialize, release, saved_paths
    one, two = (materialize(spark.range(n), "release-some") for n in (3, 4))
    paths = saved_paths()[-2:]
    assert release(spark, paths[:1]) == paths[:1] and saved_paths()[-1] == paths[1]
    assert two.count() == 4 and release(spark, paths) == paths[1:]
    assert release(spark, ["/not/saved/here"]) == []
