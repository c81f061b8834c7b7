"""Written intermediate tables.

Some steps need the same rows twice with the same partition numbers (global prefix sums) or serve
many queries from one expensive table (the score table).  Those rows are written as Parquet in the
shared folder the session names in ``spark.checkpoint.dir``: the lineage is cut, a lost executor
costs a re-read instead of a re-computation, and later reads keep column pruning and pushdown.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a private one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before using this operator")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = "file://" + tempfile.mkdtemp(prefix="loyaltide-")
    return _local_roots[app]


def stage(df: DataFrame, name: str, cluster: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back.

    ``cluster``: a column by which the table is range-partitioned and sorted, so that a read of one
    value looks at the few row groups whose bounds hold it.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if cluster:
        df = df.repartitionByRange(cluster).sortWithinPartitions(cluster)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
