"""Published versions (A3, A5, E8): whole or not at all, and verified when read."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ticketspark.operators import split
from ticketspark.sinks import manifest as MF
from ticketspark.sources import fixtures as fx


@pytest.fixture()
def table(spark):
    return split.stratified_split(fx.tickets(spark, SF001))


def ids(df):
    return sorted((r.split, r.ticket_id) for r in df.select("split", "ticket_id").collect())


def test_a_published_split_is_read_back_and_verified(spark, table, tmp_dir):
    m = MF.publish(table, tmp_dir + "/t", "split")
    assert m.version == 1 and m.rows == table.count() and set(m.parts) == {"train", "test"}
    assert MF.manifest(spark, tmp_dir + "/t") == m
    back = MF.read_published(spark, tmp_dir + "/t")
    assert ids(back) == ids(table) and set(back.columns) == set(table.columns)
    # neither order nor files matter, a changed cell does
    assert MF.fingerprints(table.repartition(9), "split") == m.parts
    changed = table.withColumn("intent", F.when(F.col("ticket_id") == 7, "x").otherwise(F.col("intent")))
    assert MF.fingerprints(changed, "split") != m.parts


def test_a_failure_midway_leaves_the_old_version(spark, table, tmp_dir):
    path = tmp_dir + "/t"
    MF.publish(table, path, "split")
    # a task that fails while the new version is written, and a check that fails after it
    bad = table.withColumn("n_chars", F.when(F.col("ticket_id") == 50, F.raise_error(F.lit("broken row"))).otherwise(F.col("n_chars")))
    with pytest.raises(Exception, match="broken row"):
        MF.publish(bad, path, "split")
    seen = []

    def refuse(folder):
        seen.append(spark.read.parquet(folder).count())
        raise ValueError("not good enough")
    with pytest.raises(ValueError, match="not good"):
        MF.publish(table.limit(5), path, "split", before_commit=refuse)
    assert seen == [5] and MF.versions(spark, path) == [1]
    assert ids(MF.read_published(spark, path)) == ids(table)
    # what the failures left goes, the version stays
    assert len(MF.clean(spark, path)) >= 1
    assert ids(MF.read_published(spark, path)) == ids(table)


def test_lost_added_and_changed_files_are_found(spark, table, tmp_dir):
    for k, harm in enumerate((os.remove, lambda f: shutil.copy(f, f.replace("part-", "part-9")),
                              lambda f: table.limit(1).drop("split").coalesce(1).write.mode("append").parquet(os.path.dirname(f)))):
        path = f"{tmp_dir}/t{k}"
        m = MF.publish(table, path, "split")
        harm(glob.glob(f"{path}/{m.folder}/split=test/part-*.parquet")[0])
        with pytest.raises(MF.ManifestError, match="test"):
            MF.read_published(spark, path)


def test_versions(spark, table, tmp_dir):
    path = tmp_dir + "/t"
    with pytest.raises(MF.ManifestError, match="no published"):
        MF.read_published(spark, path)
    MF.publish(table, path, "split")
    MF.publish(table.where("split = 'test'"), path, "split")
    MF.publish(table.limit(0), path)
    assert MF.versions(spark, path) == [1, 2, 3] and MF.read_published(spark, path).count() == 0
    assert ids(MF.read_published(spark, path, 1)) == ids(table)
    assert len(MF.clean(spark, path, keep=2)) == 1 and MF.versions(spark, path) == [2, 3]
    # a number that another writer took meanwhile is not taken again
    assert not MF._create(spark, path + "/" + MF.MANIFESTS, 3, "{}")


def test_nested_documents_and_nulls(spark, tmp_dir):
    df = spark.createDataFrame([(1, {"a": 1.5}, None, b"x"), (2, {}, "", None), (None, None, "n", b"")],
                               "i int, m map<string,double>, s string, b binary")
    MF.publish(df, tmp_dir + "/d")
    assert MF.read_published(spark, tmp_dir + "/d").count() == 3
    assert MF.fingerprints(df) != MF.fingerprints(df.fillna("", ["s"]))
