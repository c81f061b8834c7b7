"""Readers and writers of the customer tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loyaltide import fixed_values as fv

_TEXT = ("new_cell", "dualband", "marital", "kid0_2", "kid3_5", "kid6_10", "kid11_15", "kid16_17",
         "hnd_webcap", "prizm_social_one", "crclscod", "area", "asl_flag", "refurb_new",
         "creditcd", "ownrent", "dwlltype", "dwllsize", "HHstatin", "infobase", "ethnic")


def raw_schema(id_col: str = "Customer_ID", target: str = "churn") -> T.StructType:
    """Explicit schema of the raw customer file: blocks of numbers, 21 texts, target and id."""
    numbers = [c for block in fv.VARIABLE_BLOCKS.values() for c in block]
    return T.StructType([
        *[T.StructField(c, T.DoubleType()) for c in numbers],
        *[T.StructField(c, T.StringType()) for c in _TEXT],
        T.StructField(target, T.IntegerType()), T.StructField(id_col, T.LongType())])


def load_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             nrows: int | None = None) -> DataFrame:
    """CSV scan with a given schema (columns matched by header); NaN text becomes null."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option(
        "enforceSchema", False)
    wanted = schema or raw_schema()
    header = reader.csv(path).columns                  # header only, no inference
    types = {f.name: f.dataType for f in wanted}
    ordered = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = reader.schema(ordered).csv(path)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c)
                     if isinstance(types.get(c), (T.DoubleType, T.FloatType)) else F.col(c)
                     for c in header])
    return df if nrows is None else df.limit(nrows)


def base_profile(df: DataFrame, target: str = "churn", id_col: str = "customer_id") -> DataFrame:
    """Count and share of each target value, and whether the id is unique."""
    classes = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    unique = df.agg((F.count(F.lit(1)) == F.countDistinct(id_col)).alias("id_unique"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return classes.withColumn("pct", share).crossJoin(F.broadcast(unique))  # one row


def save_splits(df: DataFrame, path: str, partition: str = "partition") -> None:
    """Write the parts as one table with a directory per part (reads prune to the part asked)."""
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def load_train(spark: SparkSession, path: str, partition: str = "partition") -> DataFrame:
    return spark.read.parquet(path).filter(F.col(partition) == fv.TRAIN_OOF)


def load_test(spark: SparkSession, path: str, final_evaluation: bool = False,
              partition: str = "partition") -> DataFrame:
    """The test part, locked until the final evaluation is stated."""
    if not final_evaluation:
        raise PermissionError("the test part is read only with final_evaluation=True")
    return spark.read.parquet(path).filter(F.col(partition) == fv.TEST)


STORE_TABLES = ("scores", "contributions", "factors", "bands", "thresholds", "outliers")


def save_store(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write the store tables, scores split by partition."""
    for name in STORE_TABLES:
        writer = tables[name].write.mode("overwrite")
        if name == "scores":
            writer = writer.partitionBy("partition")
        writer.parquet(f"{path}/{name}")


def read_store(spark: SparkSession, path: str, names: Sequence[str] = STORE_TABLES
               ) -> dict[str, DataFrame]:
    """Read the store tables; the error lists every missing one."""
    found, missing = {}, []
    for name in names:
        try:
            found[name] = spark.read.parquet(f"{path}/{name}")
        except Exception as exc:  # the path check belongs to the file system of the path
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            missing.append(name)
    if missing:
        raise FileNotFoundError(f"missing store tables: {', '.join(missing)}")
    return found


def write_kpi_bundle(kpis: DataFrame, path: str) -> None:
    """The key figures of a job (one row) as one JSON object, and as long ``nom, valeur`` lines."""
    kpis.coalesce(1).write.mode("overwrite").json(f"{path}/kpis")
    long = kpis.unpivot([], [F.col(c).cast("double").alias(c) for c in kpis.columns], "nom", "valeur")
    long.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/kpis_lignes")


def write_reports(tables: Mapping[str, DataFrame], path: str) -> None:
    """Small result tables as CSV with header and as JSON lines."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/csv/{name}")
        table.write.mode("overwrite").json(f"{path}/json/{name}")
