"""Saved inventories: a folder of Parquet rows and a sidecar that names its version, its state and a digest of the rows.

A folder is written under a name of its own and renamed when it is complete; it is never overwritten. Loading checks the
digest before the rows are used. The digest adds up three 60-bit slices of every row's SHA-256, so it doesn't depend on
the order or the number of files and needs no sort.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = (1, 2)


class ManifestError(ValueError):
    pass


def rows_digest(rows: DataFrame) -> str:
    # the row as JSON: nulls are left out, so a struct keeps its field names apart
    sha = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    slices = [F.sum(F.conv(F.substring(sha, k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 16, 31)]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *slices).head()
    return hashlib.sha256("|".join(str(x) for x in one).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_fresh(spark: SparkSession, path: str) -> bool:
    """Is there nothing at the path, or an empty folder?"""
    system, at = _files(spark, path)
    return not system.exists(at) or len(list(system.listStatus(at))) == 0


def save(rows: DataFrame, path: str, state: dict, parent: str | None = None) -> str:
    """Write rows and sidecar; the digest of the rows is returned. A target that holds something is an error."""
    spark = rows.sparkSession
    if not is_fresh(spark, path):
        raise ManifestError(f"{path} isn't empty; use a fresh folder or resume")
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    rows.write.mode("errorifexists").parquet(f"{part}/records")
    digest = rows_digest(spark.read.parquet(f"{part}/records"))
    sidecar = {"schema_version": 2, "records_sha256": digest, "parent_sha256": parent, "state": state}
    spark.createDataFrame([(json.dumps(sidecar, sort_keys=True),)], "value string").coalesce(1).write.text(f"{part}/manifest")
    system, target = _files(spark, path)
    if system.exists(target):
        system.delete(target, False)  # empty
    if not system.rename(_files(spark, part)[1], target):
        raise ManifestError(f"{path} was taken meanwhile")
    return digest


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(rows, sidecar), refused where the version is unknown or the rows aren't those that were saved."""
    sidecar = json.loads(spark.read.text(f"{path}/manifest").head().value)
    if sidecar.get("schema_version") not in SCHEMAS:
        raise ManifestError("unknown schema_version")
    rows = spark.read.parquet(f"{path}/records")
    if rows_digest(rows) != sidecar["records_sha256"]:
        raise ManifestError("the rows differ from those that were saved")
    return rows, sidecar


def resume(spark: SparkSession, parent: str, path: str, done: DataFrame | None, key: str, state: dict) -> tuple[DataFrame, DataFrame]:
    """A new folder with the same population and its parent's digest; (all rows, rows still to do)."""
    rows, sidecar = load(spark, parent)
    save(rows, path, state, parent=sidecar["records_sha256"])
    kept, _ = load(spark, path)
    return kept, kept if done is None else kept.join(done.select(key).distinct(), key, "left_anti")


def verify_sources(documents: DataFrame, objects: DataFrame, files: DataFrame, key: str = "document") -> DataFrame:
    """(document, object, problem) of everything that isn't as recorded: ``documents`` (document, sha256) and their derived
    ``objects`` (document, object, sha256) against ``files`` (name, content). Empty means verified."""
    held = files.select(F.col("name").alias("__name"), F.sha2("content", 256).alias("__sha"))
    claims = documents.select(key, F.col(key).cast("string").alias("object"), "sha256").unionByName(objects.select(key, F.col("object").cast("string"), "sha256"))
    joined = claims.join(held, F.col("object") == F.col("__name"), "left")
    problem = F.when(F.col("__sha").isNull(), "missing").when(F.col("__sha") != F.col("sha256"), "changed")
    loose = objects.join(documents.select(F.col(key).alias("__d")), F.col(key) == F.col("__d"), "left_anti").select(key, F.col("object").cast("string"), F.lit("unbound").alias("problem"))
    return joined.select(key, "object", problem.alias("problem")).where("problem is not null").unionByName(loose)


def cache_key(*parts) -> F.Column:
    """What an extraction depends on: source digest, parser, options, identity."""
    return F.sha2(F.to_json(F.array(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])), 256)


def cached(wanted: DataFrame, cache: DataFrame, key: str, payload: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their payload, misses); a payload that doesn't match its digest is a miss."""
    good = cache.where(F.sha2(F.col(payload), 256) == F.col(digest)).groupBy(F.col(key).alias("__key")).agg(F.min(payload).alias(payload))
    joined = wanted.join(good, F.col(key) == F.col("__key"), "left").drop("__key")
    return joined.where(F.col(payload).isNotNull()), joined.where(F.col(payload).isNull()).drop(payload)
