"""Publishing a table so that readers see the whole of it or what was there before (A3, A5).

A version is written to a folder of its own; what was written is read back, counted and
fingerprinted; only then a small manifest file names it, with the counts and fingerprints. A
reader goes by the newest manifest. A run that fails halfway leaves folders that no manifest
names, and the version before is read on. Nothing is renamed but the manifest, a file of a few
hundred bytes. (Writers that publish to one path at the same moment are told apart by the
file system's rename, which is atomic on HDFS and local disks; on stores where it isn't, let
one writer at a time publish.)
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.functions.hashing import hex_prefix

MANIFESTS, VERSIONS = "_manifests", "versions"


class ManifestError(RuntimeError):
    """No manifest, or data that differ from what their manifest says."""


@dataclass(frozen=True)
class Manifest:
    """A published version: its number, folder, file format, columns, partition column, and
    for each partition (one named '' without a partition column) the rows and their
    fingerprint."""
    version: int
    folder: str
    fmt: str
    schema: str
    partition_by: str | None
    parts: dict[str, tuple[int, str]]

    @property
    def rows(self) -> int:
        return sum(n for n, _ in self.parts.values())


def fingerprints(df: DataFrame, partition_by: str | None = None) -> dict[str, tuple[int, str]]:
    """(rows, fingerprint) of each partition: the sum of a digest of each row, so that neither
    the order of rows nor that of files matters. Nested columns count as JSON; nulls differ from
    empty strings."""
    cells = []
    for c, kind in sorted(df.dtypes):
        v = F.col(f"`{c}`")
        nested = kind.startswith(("struct", "array", "map"))
        v = F.to_json(F.struct(v)) if nested else v if kind == "binary" else v.cast("string")
        cells.append(F.coalesce(F.md5(v), F.lit("-")))
    term = hex_prefix(F.md5(F.concat_ws("|", *cells)), 15)
    part = F.coalesce(F.col(f"`{partition_by}`").cast("string"), F.lit("")) if partition_by else F.lit("")
    rows = df.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(term.cast("decimal(28,0)")).cast("string").alias("f")).collect()
    return {r["part"]: (r["n"], r["f"]) for r in rows}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions, oldest first."""
    _, folder, fs = _fs(spark, f"{path}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of a version (default: the newest)."""
    have = versions(spark, path)
    if not have or (version is not None and version not in have):
        raise ManifestError(f"{path} has no published version{'' if version is None else f' {version}'}")
    version = have[-1] if version is None else version
    text = "".join(r["value"] for r in spark.read.text(f"{path}/{MANIFESTS}/{version:08d}.json").collect())
    d = json.loads(text)
    return Manifest(version, d["folder"], d["format"], d["schema"], d["partition_by"], {k: tuple(v) for k, v in d["parts"].items()})


def publish(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet",
            before_commit=None) -> Manifest:
    """Write ``df`` as the next version under ``path`` and return its manifest.

    The fingerprints are those of the files, read back. Two writers that finish at once
    don't overwrite each other: the file of a manifest is created only if it isn't there, and
    the later writer takes the next number. ``before_commit`` is called with the folder and may
    raise, as a check of the data that stops a publication.
    """
    spark = df.sparkSession
    folder = f"{VERSIONS}/{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.format(fmt).save(f"{path}/{folder}")
    back = spark.read.format(fmt).schema(df.schema).load(f"{path}/{folder}")
    parts = fingerprints(back, partition_by)
    if before_commit:
        before_commit(f"{path}/{folder}")
    body = {"folder": folder, "schema": df.schema.json(), "partition_by": partition_by, "format": fmt,
            "parts": {k: list(v) for k, v in sorted(parts.items())}}
    version = (versions(spark, path) or [0])[-1] + 1
    while not _create(spark, f"{path}/{MANIFESTS}", version, json.dumps(body)):
        version += 1
    return Manifest(version, folder, fmt, body["schema"], partition_by, parts)


def _create(spark: SparkSession, folder: str, version: int, text: str) -> bool:
    """Put a manifest's file in place whole, unless there is one."""
    jvm, at, fs = _fs(spark, f"{folder}/{version:08d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        return False
    return True


def read_published(spark: SparkSession, path: str, version: int | None = None, verify: bool = True) -> DataFrame:
    """The rows of a published version (default: the newest). With ``verify`` their counts and
    fingerprints have to be the manifest's: a pass over the data, which finds lost, added or
    changed files."""
    from pyspark.sql import types as T
    m = manifest(spark, path, version)
    df = spark.read.format(m.fmt).schema(T.StructType.fromJson(json.loads(m.schema))).load(f"{path}/{m.folder}")
    if verify:
        found = fingerprints(df, m.partition_by)
        if found != m.parts:
            wrong = sorted(k for k in {*found, *m.parts} if found.get(k) != m.parts.get(k))
            raise ManifestError(f"version {m.version} of {path} differs from its manifest in {wrong}")
    return df


def clean(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete what no manifest of the newest ``keep`` versions names, older manifests included;
    returns the deleted folders. Not to be run beside a writer."""
    have = versions(spark, path)
    named = {manifest(spark, path, v).folder for v in have[-keep:]} if keep else set()
    _, root, fs = _fs(spark, f"{path}/{VERSIONS}")
    gone = []
    for v in have[:-keep] if keep else have:
        jvm, p, _ = _fs(spark, f"{path}/{MANIFESTS}/{v:08d}.json")
        fs.delete(p, False)
    for f in fs.listStatus(root) if fs.exists(root) else []:
        name = f"{VERSIONS}/{f.getPath().getName()}"
        if name not in named:
            fs.delete(f.getPath(), True)
            gone.append(name)
    return gone
