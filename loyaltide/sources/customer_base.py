"""Derived customer table: one row per customer with orders before the cut-off.

Features read only orders before ``CUTOFF``; the label is the absence of orders in the window
[CUTOFF, LABEL_END).  Money is summed in integer cents, so totals do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loyaltide.functions.expressions import seeded_hash
from loyaltide.operators.splits import make_folds, split_train_test
from loyaltide.staging import stage

CUTOFF, LABEL_END = "2001-01-01", "2001-08-01"
YEAR_START, HALF_START = "2000-01-01", "2000-07-01"
N_FOLDS = 5

_LINE_SUMS = ("n_lines", "qty", "qty_kept", "disc", "disc_odd", "n_ret", "n_open", "n_done",
              "n_odd", "n_odd_done", "n_oor", "n_eor", "n_ook", "n_eok", "retail", "n_retail")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _line_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines collapsed to one row per order (partial sums before the only shuffle of the lines)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", _cents("p_retailprice").alias("retail"))
    quantity = F.col("l_quantity").cast("bigint")
    discount = _cents("l_extendedprice") * _cents("l_discount")
    odd = F.col("l_linenumber") % 2 == 1
    returned, still_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    count_if = F.count_if
    return (lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
            .groupBy("l_orderkey").agg(
                F.count(F.lit(1)).alias("n_lines"),
                F.sum(quantity).alias("qty"),
                F.sum(F.when(~returned, quantity).otherwise(0)).alias("qty_kept"),
                F.sum(discount).alias("disc"),
                F.sum(F.when(odd, discount).otherwise(0)).alias("disc_odd"),
                count_if(returned).alias("n_ret"),
                count_if(still_open).alias("n_open"),
                count_if(~still_open).alias("n_done"),
                count_if(odd).alias("n_odd"),
                count_if(odd & ~still_open).alias("n_odd_done"),
                count_if(odd & still_open & returned).alias("n_oor"),
                count_if(~odd & still_open & returned).alias("n_eor"),
                count_if(odd & still_open & ~returned).alias("n_ook"),
                count_if(~odd & still_open & ~returned).alias("n_eok"),
                F.sum("retail").alias("retail"),
                F.count("retail").alias("n_retail")))


def _customer_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (spark.read.parquet(f"{sf_dir}/orders.parquet")
              .filter(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(f"{LABEL_END} 00:00:00")))
              .select("o_orderkey", F.col("o_custkey").alias("customer_id"), "o_orderstatus",
                      "o_orderpriority", F.col("o_orderdate").cast("date").alias("d"),
                      _cents("o_totalprice").alias("cents")))
    sums = _line_sums(spark, sf_dir)
    joined = orders.join(sums, orders.o_orderkey == sums.l_orderkey, "left")
    past = F.col("d") < F.lit(CUTOFF).cast("date")
    year = past & (F.col("d") >= F.lit(YEAR_START).cast("date"))
    half = past & (F.col("d") >= F.lit(HALF_START).cast("date"))

    def total(c: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))

    aggs = [
        F.count_if(past).alias("totcalls"),
        F.count_if(~past).alias("n_label"),
        F.min(F.when(past, F.col("d"))).alias("first_d"),
        F.max(F.when(past, F.col("d"))).alias("last_d"),
        # Day number and priority digit in one integer: keeps the aggregate hash-based.
        F.max(F.when(past, F.unix_date("d") * 8 + F.substring("o_orderpriority", 1, 1)
                     .cast("int"))).alias("last_code"),
        F.count_if(year).alias("n12"),
        total("cents", past).alias("cents_all"), total("cents", year).alias("cents12"),
        total("cents", half).alias("cents6"),
        total("cents", past & (F.col("o_orderstatus") != "P")).alias("cents_adj"),
        total("qty", year).alias("qty12"), total("qty", half).alias("qty6"),
        F.count_if(past & (F.col("o_orderstatus") == "O")).alias("actvsubs"),
        F.count_if(past & (F.col("o_orderstatus") != "P")).alias("adjqty"),
        F.count(F.when(past, F.col("n_lines"))).alias("phones"),
        F.count_if(past & (F.col("n_ret") > 0)).alias("models"),
        *[total(c, past).alias(f"all_{c}") for c in _LINE_SUMS],
    ]
    return joined.groupBy("customer_id").agg(*aggs).filter(F.col("totcalls") > 0)


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table without folds; see the module text for its rules."""
    sums = _customer_sums(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("crclscod"), F.col("c_nationkey").alias("nk"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(
        "r_regionkey", F.col("r_name").alias("area"))
    df = (sums.join(customer, "customer_id")
          .join(nation, F.col("nk") == F.col("n_nationkey"))
          .join(region, F.col("n_regionkey") == F.col("r_regionkey")))

    months = ((F.lit(2001) - F.year("first_d")) * 12 + 1 - F.month("first_d")).cast("int")
    recent = F.col("n12") > 0

    def dbl(c: str) -> Column:
        return F.col(c).cast("double")

    def per_month(c: str) -> Column:
        return dbl(f"all_{c}") / F.col("months")

    def if_recent(c: Column) -> Column:
        return F.when(recent, c)

    half_rev, year_rev = dbl("cents6") / 600, dbl("cents12") / 1200
    half_qty, year_qty = dbl("qty6") / 6, dbl("qty12") / 12
    disc, disc_odd = dbl("all_disc") / 10000, dbl("all_disc_odd") / 10000
    priority = F.pmod(F.col("last_code"), F.lit(8))
    digest = seeded_hash("customer_id")
    df = df.withColumn("months", months)
    return df.select(
        "customer_id",
        F.when(F.col("n_label") == 0, 1).otherwise(0).alias("churn"),
        "months",
        F.date_diff(F.lit(CUTOFF).cast("date"), F.col("last_d")).alias("eqpdays"),
        if_recent(year_rev).alias("rev_Mean"), if_recent(year_qty).alias("mou_Mean"),
        if_recent(half_rev).alias("avg3rev"), if_recent(year_rev).alias("avg6rev"),
        if_recent(half_qty).alias("avg3mou"), if_recent(year_qty).alias("avg6mou"),
        if_recent(half_rev - year_rev).alias("change_rev"),
        if_recent(half_qty - year_qty).alias("change_mou"),
        (dbl("cents_all") / 100).alias("totrev"), F.col("totcalls"),
        (dbl("cents_all") / (F.lit(100) * F.col("totcalls"))).alias("totmrc_Mean"),
        (disc / F.col("months")).alias("ovrrev_Mean"),
        (disc_odd / F.col("months")).alias("vceovr_Mean"),
        ((disc - disc_odd) / F.col("months")).alias("datovr_Mean"),
        per_month("n_ret").alias("custcare_Mean"), per_month("n_open").alias("drop_blk_Mean"),
        per_month("n_oor").alias("drop_vce_Mean"), per_month("n_eor").alias("drop_dat_Mean"),
        per_month("n_ook").alias("blck_vce_Mean"), per_month("n_eok").alias("blck_dat_Mean"),
        per_month("n_lines").alias("attempt_Mean"), per_month("n_done").alias("complete_Mean"),
        per_month("n_odd").alias("plcd_vce_Mean"),
        ((dbl("all_n_lines") - dbl("all_n_odd")) / F.col("months")).alias("plcd_dat_Mean"),
        per_month("n_odd_done").alias("comp_vce_Mean"),
        ((dbl("all_n_done") - dbl("all_n_odd_done")) / F.col("months")).alias("comp_dat_Mean"),
        F.when(F.col("all_n_retail") > 0,
               dbl("all_retail") / (F.lit(100) * F.col("all_n_retail"))).alias("hnd_price"),
        F.col("totcalls").alias("uniqsubs"), "actvsubs",
        dbl("all_qty").alias("totmou"), dbl("all_qty_kept").alias("adjmou"), "adjqty",
        (dbl("cents_adj") / 100).alias("adjrev"), "phones", "models",
        "acctbal", "crclscod", "area",
        F.when(priority == 4, "UNKW").when(priority <= 2, "WCMB").when(priority == 3, "WC")
        .alias("hnd_webcap"),
        F.when((F.col("all_n_lines") > 0) & (F.col("all_n_ret") * 3 > F.col("all_n_lines")), "R")
        .otherwise("N").alias("refurb_new"),
        F.when(F.col("nk") % 3 == 0, "U").when(F.col("nk") % 3 == 1, "Y").otherwise("N")
        .alias("new_cell"),
        F.when(F.col("nk") % 5 == 0, "U").when(F.col("nk") % 5 == 1, "S")
        .when(F.col("nk") % 5 == 2, "M").when(F.col("nk") % 5 == 3, "A").otherwise("B")
        .alias("marital"),
        F.when(digest % 13 != 0, F.substring(F.lit("SUTCR"), (digest % 5 + 1).cast("int"), 1))
        .alias("prizm_social_one"),
        F.when(F.col("acctbal") >= 0, (1 + F.floor(F.col("acctbal") / 1200)).cast("int"))
        .alias("income"),
        F.when(digest % 3 > 0, (digest % 16).cast("int")).alias("lor"))


_bases: dict[tuple[str, str], DataFrame] = {}


def load_customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer table with folds and train/test parts, written once per session and source folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        _bases[key] = stage(split_train_test(
            make_folds(customer_base(spark, sf_dir), N_FOLDS)), "customer_base")
    return _bases[key]
