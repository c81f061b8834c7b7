"""Reading and naming shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII blanks (the same set as ``bytes.split``).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given columns only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; every machine has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened until none of them is among the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def draw(labelled: DataFrame, key: str, marks: list[str], most: int, rare: float = 0.1) -> DataFrame:
    """A sample of distinct ``key`` with its ``marks``, by hash of the key, of bounded size.

    About ``most`` rows in the proportions of the mark values; a value that would have fewer than
    ``rare`` of ``most`` gets that many (all it has, if fewer), so the sample has at most
    ``most * (1 + rare * values)`` rows.
    """
    sizes = labelled.groupBy(*marks).agg(F.count(F.lit(1)).alias("_of"))
    sizes = sizes.withColumn("_all", F.sum("_of").over(Window.partitionBy()))   # a row per value
    share = F.floor(F.lit(float(most)) * F.col("_of") / F.greatest(F.col("_all"), F.lit(most)))
    placed = (labelled.join(F.broadcast(sizes), marks)
              .withColumn("_quota", F.greatest(share, F.lit(int(rare * most))))
              .withColumn("_u", uniform(F.col(key))))
    # Twice the quota by hash value, so that what is ranked is bounded too.
    few = placed.filter(F.col("_u") * F.col("_of") < 2 * F.col("_quota") + 100)
    rank = F.row_number().over(Window.partitionBy(*marks).orderBy("_u", key))
    return (few.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_quota"))
            .drop("_rank", "_of", "_all", "_quota", "_u"))


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of 1000 rows where the session keeps Spark's default of 10 000.

    Whole texts are large rows; batches of them are what Python workers and the JVM hold at a time.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")
    return df


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on and serve
    other operators next to the JVM's heap."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
