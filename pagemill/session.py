"""Session settings this engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # runtime re-planning: partition sizes, broadcast only after measuring, skew splitting
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lets Spark prune large scans when one side of a join is small
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # bucketed tables with one file a bucket are joined as they lie, without sorting them again
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    # page rows are heavy; small Arrow batches keep Python workers flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    # JSON with a repeated key is kept, the last one counts, as in most JSON parsers
    "spark.sql.variant.allowDuplicateKeys": "true",
    # large expressions are built faster without a call-site record per column function
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # visited addresses are kept for the life of a stream
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
