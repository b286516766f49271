"""Where intermediate tables live.

Iterative jobs cut their lineage by writing a table to shared storage and reading it back:
the written files outlive any executor.  The folder is the one the cluster names in
``spark.checkpoint.dir``; where that is unset, one in the session's warehouse.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path of its own under the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/pagemill/{purpose}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and continue from the files, without a schema-inference pass."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From here on the session sends rows to Python in batches of about ``BATCH_BYTES``, or of less if it is set so.

    Spark writes a batch into vectors and again into a buffer of the worker, each of which doubles
    as it grows: ten thousand texts take some 100 MB outside the heap of every running task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * "bkmgtp".index(unit[:1] or "b") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote the table at ``path`` was committed."""
    system, marker = _hadoop_path(spark, f"{path}/_SUCCESS")
    return system.exists(marker)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder at ``path``, and not a file or nothing."""
    system, target = _hadoop_path(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built only if no earlier attempt completed it."""
    if is_complete(spark, path):
        return spark.read.parquet(path)
    df = build()
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` hashed by ``key`` into ``buckets`` sorted files (one each if it is dealt like that)."""
    name = f"pagemill_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_buckets(spark: SparkSession, path: str, schema: str, key: str, buckets: int, recursive: bool = False) -> DataFrame:
    """The table that ``write_buckets`` left: a join or grouping by ``key`` needs no exchange of it.

    Only a catalog tells Spark about buckets, so the files get an entry for a moment.  With
    ``recursive`` it is the tables of all folders below ``path``, as one.
    """
    name = f"pagemill_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (recursiveFileLookup '{str(recursive).lower()}') "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def buckets_once(
    spark: SparkSession, path: str, schema: str, key: str, buckets: int, build: Callable[[], DataFrame]
) -> DataFrame:
    """The bucketed table at ``path``, built only if no earlier attempt completed it."""
    if not is_complete(spark, path):
        write_buckets(build(), path, key, buckets)
    return read_buckets(spark, path, schema, key, buckets)


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row ``value``: how many rows there are and the sum of their hashes, whatever their order."""
    hashes = F.sum(F.xxhash64(*(F.col(c) for c in columns or df.columns)).cast("decimal(38,0)"))
    return df.agg(F.concat_ws(":", F.count(F.lit(1)), F.coalesce(hashes, F.lit(0).cast("decimal(38,0)"))).alias("value"))


def same_manifest(
    spark: SparkSession, path: str, options: dict[str, Any], inputs: dict[str, DataFrame] | None = None, what: str = "run",
) -> dict[str, str]:
    """Write down what the tables of a folder depend on; a later run must agree.

    Inputs are told apart by their fingerprints.  Options with a leading underscore may differ:
    the stored ones are returned and hold.
    """
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in options.items()]
    literals = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in rows))
    now = spark.range(1).select(F.inline(literals))
    for name, df in (inputs or {}).items():
        now = now.unionByName(fingerprint(df).select(F.lit(name).alias("name"), "value"))
    if not is_complete(spark, path):
        now.write.mode("overwrite").parquet(path)
        return dict(rows)
    # as many rows as there are options and inputs
    stored, given = ({r["name"]: r["value"] for r in x.collect()} for x in (spark.read.parquet(path), now))
    changed = sorted(k for k in stored.keys() | given.keys() if stored.get(k) != given.get(k) and not k.startswith("_"))
    if changed:
        raise ValueError(f"{path} belongs to a {what} with another {', '.join(changed)}")
    return stored


def delete_folder(spark: SparkSession, path: str) -> bool:
    """Remove a run folder through the Hadoop file system that holds it."""
    system, target = _hadoop_path(spark, path)
    return system.delete(target, True)


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
