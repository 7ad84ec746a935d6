"""Write semantics: first write wins, upsert, counters, immutable versions, raw files.

Every function takes what exists and what comes in and returns the new table or
what is to be appended; ``append_absent`` and ``replace`` write Parquet.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def absent(incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key exists in neither table yet; of repeated keys the first by ``order`` counts."""
    if order:
        n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
        incoming = incoming.withColumn("_n", n).filter("_n = 1").drop("_n")
    else:
        incoming = incoming.dropDuplicates(keys)
    return incoming.join(existing.select(*keys), keys, "left_anti").select(*incoming.columns)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All keys of both; incoming values win, the last by ``order`` where keys repeat. Columns that only one side has are null for the other's rows."""
    last = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")
    kept = existing.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def counted(existing: DataFrame, attempts: DataFrame, keys: list[str], terminal: int) -> DataFrame:
    """(keys, attempts): one more for each attempt that failed, at least ``terminal`` once one was final."""
    new = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"), F.bool_or("final").alias("_final"))
    both = existing.join(new, keys, "full_outer")
    total = F.coalesce("attempts", F.lit(0)) + F.coalesce("_more", F.lit(0))
    return both.select(*keys, F.when(F.coalesce("_final", F.lit(False)), F.greatest(total, F.lit(terminal))).otherwise(total).cast("long").alias("attempts"))


def canonical_json(value: object) -> str:
    """Keys sorted at every level, no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_row(versions: DataFrame, label: str, config: dict) -> DataFrame | None:
    """The row to append for a configuration; None if the label has it already, an error if it has another."""
    text = canonical_json(config)
    digest = hashlib.sha256(text.encode()).hexdigest()
    held = versions.filter(F.col("version_label") == label).select("config_hash").take(1)
    if held:
        if held[0][0] != digest:
            raise ValueError(f"version {label} exists with other values; use a new label")
        return None
    return versions.sparkSession.createDataFrame([(label, digest, text)], "version_label string, config_hash string, config string")


def raw_key(source: Column, day: Column, body: Column, external_id: Column) -> Column:
    """source/day/hash-idhash.json, from contents alone."""
    safe = F.when(source.rlike("^[A-Za-z0-9_-]+$"), source).otherwise(F.raise_error("unsafe source key").cast("string"))
    return F.concat(safe, F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/"), F.substring(F.sha2(body, 256), 1, 16), F.lit("-"), F.substring(F.sha2(external_id, 256), 1, 12), F.lit(".json"))


def write_raw(items: DataFrame, folder: str) -> None:
    """Verbatim payloads under source and day; equal payloads get equal keys."""
    keyed = items.withColumn("key", raw_key(F.col("source"), F.col("received_at"), F.col("payload"), F.col("external_id"))).withColumn("day", F.to_date("received_at"))
    keyed.write.mode("append").partitionBy("source", "day").json(folder)


def read_raw(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    out = spark.read.json(folder)
    if keys is not None:
        if bad := [k for k in keys if not re.fullmatch(r"[\w-]+/\d{4}-\d\d-\d\d/[0-9a-f]+-[0-9a-f]+\.json", k)]:
            raise ValueError(f"unsafe keys: {bad[:3]}")
        out = out.filter(F.col("key").isin(keys))
    return out


def audit_key(signal_key: Column, at: Column) -> Column:
    """llm/day/hash.json: the same for another attempt on a day, so it replaces what the first one left."""
    return F.concat(F.lit("llm/"), F.date_format(at, "yyyy-MM-dd"), F.lit("/"), F.substring(F.sha2(signal_key, 256), 1, 16), F.lit(".json"))


def write_audit(attempts: DataFrame, existing: DataFrame) -> DataFrame:
    """Audit rows after attempts (signal_key, analyzed_at, ...): one for each key, the last attempt's."""
    keyed = attempts.withColumn("key", audit_key(F.col("signal_key"), F.col("analyzed_at")))
    return upserted(existing, keyed, ["key"], ["analyzed_at"])


@contextmanager
def single_writer(spark: SparkSession, path: str, wait_seconds: float = 600.0):
    """Hold a table's lock: a file beside it that only one writer can create, wherever the table is stored.

    Others wait for it. A writer that died leaves its lock, which then has to
    be removed by hand, since nothing tells it from one that is slow.
    """
    jvm = spark.sparkContext._jvm
    lock = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.lock")
    fs = lock.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(lock.getParent())
    local = jvm.java.io.File(lock.toUri().getPath()) if fs.getUri().getScheme() == "file" else None

    def made() -> bool:
        if local is not None:  # Spark's own local store looks first and creates then
            return local.createNewFile()
        try:
            fs.create(lock, False).close()
            return True
        except Py4JJavaError:
            if not fs.exists(lock):
                raise
            return False

    until = time.monotonic() + wait_seconds
    while not made():
        if time.monotonic() > until:
            raise TimeoutError(f"{lock.toString()} is held by another writer")
        time.sleep(0.2)
    try:
        yield
    finally:
        fs.delete(lock, False)


def append_absent(incoming: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> int:
    """Append rows of new keys to a Parquet table, one writer at a time; how many they were."""
    spark = incoming.sparkSession
    with single_writer(spark, path):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        existing = spark.read.parquet(path) if there else incoming.limit(0)  # the first write makes the table
        new = absent(incoming, existing, keys, order).persist()
        n = new.count()
        if n:
            new.write.mode("append").parquet(path)
        new.unpersist()
    return n
