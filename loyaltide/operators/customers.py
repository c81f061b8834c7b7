"""Customer lists, sheets and exports over the score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv
from loyaltide.functions.french import label_of
from loyaltide.operators.dashboards import Filters, apply_filters
from loyaltide.operators.explain import effect_words, family
from loyaltide.operators.ranking import row_numbers

# Sort fields of the list.
SORT_FIELDS = {
    "p_real": "proba_reelle",
    "revenue_at_risk_monthly": "revenu_en_jeu",
    "monthly_bill": "rev_Mean",
    "tenure_months": "months",
    "handset_age_days": "eqpdays",
    "customer_id": "customer_id",
}


def select_customers(scores: DataFrame, filters: Filters | None = None, sort: str = "p_real",
                     order: str = "desc", search: str | None = None
                     ) -> tuple[DataFrame, list[Column]]:
    """Filtered (and searched) rows, and the sort order: missing values last, ties by id."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"unknown sort field {sort}; known: {', '.join(SORT_FIELDS)}")
    if order not in ("asc", "desc"):
        raise ValueError("order must be asc or desc")
    rows = apply_filters(scores, filters)
    if search and search.strip():
        rows = rows.filter(F.col("id_text").contains(search.strip()))
    column = F.col(SORT_FIELDS[sort])
    key = column.desc_nulls_last() if order == "desc" else column.asc_nulls_last()
    return rows, [key, F.col("customer_id").asc()]


def _summary() -> list[Column]:
    return [F.col("customer_id"), F.col("partition"), F.col("niveau").alias("risk_level"),
            F.col("proba_reelle").alias("p_real"), F.col("proba_calibree").alias("p_calibrated"),
            F.col("segment"), F.col("action"), F.col("raison_1").alias("top_reason"),
            F.col("revenu_en_jeu").alias("revenue_at_risk_monthly"),
            F.col("rev_Mean").alias("monthly_bill"), F.col("months").alias("tenure_months"),
            F.col("eqpdays").alias("handset_age_days"), F.col("area"),
            F.col("inactif").alias("inactive")]


def list_customers(scores: DataFrame, filters: Filters | None = None, sort: str = "p_real",
                   order: str = "desc", page: int = 1, size: int = 25,
                   search: str | None = None) -> DataFrame:
    """One page of the list: a top-N sort with an offset, each task keeps ``page * size`` rows.

    For reading far into a long list see :func:`page_by_position`.
    """
    if page < 1 or not 1 <= size <= fv.MAX_PAGE_SIZE:
        raise ValueError(f"page >= 1 and 1 <= size <= {fv.MAX_PAGE_SIZE}")
    rows, ordering = select_customers(scores, filters, sort, order, search)
    return rows.orderBy(*ordering).offset((page - 1) * size).limit(size).select(*_summary())


def page_by_position(scores: DataFrame, filters: Filters | None = None, sort: str = "p_real",
                     order: str = "desc", page: int = 1, size: int = 25,
                     search: str | None = None) -> DataFrame:
    """The same page cut from distributed row positions: its cost does not grow with its number."""
    if page < 1 or not 1 <= size <= fv.MAX_PAGE_SIZE:
        raise ValueError(f"page >= 1 and 1 <= size <= {fv.MAX_PAGE_SIZE}")
    rows, _ = select_customers(scores, filters, sort, order, search)
    place = numbered_selection(scores, filters, sort, order, search).select(
        "customer_id", "position").filter(
            F.col("position").between((page - 1) * size + 1, page * size))
    return rows.join(place, "customer_id").orderBy("position").select(*_summary())


def list_totals(scores: DataFrame, filters: Filters | None = None, size: int = 25,
                search: str | None = None) -> DataFrame:
    rows, _ = select_customers(scores, filters, search=search)
    return rows.agg(F.count(F.lit(1)).alias("total_n_rows")).withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_n_rows") / size)))


def list_at_risk(scores: DataFrame, filters: Filters | None = None, limit: int = 10,
                 sort: str = "p_real", include_inactive: bool = False) -> DataFrame:
    """The default list of customers to retain: inactive ones left out unless asked for."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    chosen = dict(filters or {})
    if not include_inactive and not chosen.get("risk_level"):
        chosen["risk_level"] = [fv.HIGH, fv.MEDIUM, fv.LOW]
    return list_customers(scores, chosen, sort, "desc", 1, limit)


def customer_factors(scores: DataFrame, contributions: DataFrame, in_window: Column,
                     customer_id: int) -> DataFrame:
    """Reasons and context lines of one customer with family and contribution."""
    row = scores.filter(F.col("customer_id") == customer_id).withColumn("_window", in_window)
    slots = [(k, f"raison_{k}") for k in (1, 2, 3)] + [(k, f"contexte_{k}") for k in (1, 2)]
    lines = row.select("customer_id", "_window", F.explode(F.array(*[
        F.struct(F.lit(name.split("_")[0]).alias("kind"), F.lit(k).alias("rang"),
                 F.col(f"{name}_variable").alias("variable"), F.col(name).alias("text"))
        for k, name in slots])).alias("x")).select("customer_id", "_window", "x.*")
    parts = contributions.filter(F.col("customer_id") == customer_id).drop("customer_id")
    out = lines.filter(F.col("variable").isNotNull()).join(parts, "variable")
    fam = family(F.col("variable"), F.col("_window"))
    return out.select("customer_id", "kind", "rang", "variable",
                      label_of(F.col("variable")).alias("label"), "text", fam.alias("family"),
                      (fam != fv.CONTEXT).alias("actionable"), "contribution",
                      effect_words(F.col("contribution")).alias("effect"))


def get_customer(scores: DataFrame, customer_id: int) -> DataFrame:
    """Sheet of one customer, read in one job; an unknown id is an error."""
    rows = scores.filter(F.col("customer_id") == customer_id).limit(1).collect()
    if not rows:
        raise LookupError(f"customer {customer_id} not found")
    return scores.sparkSession.createDataFrame(rows, scores.schema).select(
        "customer_id", "partition", F.col("proba_brute").alias("p_raw"),
        F.col("proba_calibree").alias("p_calibrated"), F.col("proba_reelle").alias("p_real"),
        F.col("niveau").alias("risk_level"), F.col("inactif").alias("inactive"), "segment_id",
        "segment", "tenure_band", "handset_age_band", "usage_band", "action",
        F.col("famille_dominante").alias("dominant_family"),
        F.col("rev_Mean").alias("monthly_bill"),
        F.col("revenu_en_jeu").alias("revenue_at_risk_monthly"),
        F.col("churn").alias("historical_churn_label"))


def customer_profile(scores: DataFrame, customer_id: int, hide_sensitive: bool = True
                     ) -> DataFrame:
    """Profile lines ``variable, label, value, unit`` of one customer."""
    fields = [f for f in fv.PROFILE_FIELDS if f[0] in scores.columns
              and not (hide_sensitive and f[0] in fv.SENSITIVE_VARIABLES)]
    row = scores.filter(F.col("customer_id") == customer_id)
    lines = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(label).alias("label"),
                               F.col(c).cast("string").alias("value"), F.lit(unit).alias("unit"))
                      for c, label, unit in fields])
    return row.select("customer_id", F.inline(lines))


def _decimal_comma(c: Column, digits: int) -> Column:
    """Shortest plain text (never an exponent) of the rounded number with a decimal comma.

    Whole numbers keep one decimal, as ``12,0``.
    """
    plain = F.bround(c, digits).cast(f"decimal(38,{max(digits, 1)})").cast("string")
    return F.regexp_replace(F.regexp_replace(plain, r"(\.\d+?)0+$", "$1"), r"\.", ",")


def export_customers(scores: DataFrame, filters: Filters | None = None, sort: str = "p_real",
                     order: str = "desc", search: str | None = None, ordered: bool = True
                     ) -> DataFrame:
    """The whole filtered selection with the 14 export columns, numbers as French text.

    The global order is a range-partitioned sort, so the file parts follow each other.
    """
    rows, ordering = select_customers(scores, filters, sort, order, search)
    if ordered:
        rows = rows.orderBy(*ordering)
    shown = {"proba_reelle": _decimal_comma(100 * F.col("proba_reelle"), 2),
             "proba_calibree": _decimal_comma(F.col("proba_calibree"), 4),
             "revenu_en_jeu": _decimal_comma(F.col("revenu_en_jeu"), 2),
             "rev_Mean": _decimal_comma(F.col("rev_Mean"), 6)}
    names = [("customer_id" if c == "Customer_ID" else c, label) for c, label in fv.EXPORT_COLUMNS]
    return rows.select(*[shown.get(c, F.col(c)).alias(label) for c, label in names])


def write_export(table: DataFrame, path: str) -> None:
    """Semicolon CSV parts whose header starts with a byte-order mark."""
    marked = table.withColumnRenamed(table.columns[0], "﻿" + table.columns[0])
    marked.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def numbered_selection(scores: DataFrame, filters: Filters | None = None, sort: str = "p_real",
                       order: str = "desc", search: str | None = None) -> DataFrame:
    """Position of every selected row (for deep paging without re-sorting)."""
    rows, _ = select_customers(scores, filters, sort, order, search)
    column = SORT_FIELDS[sort]
    keys = [(column, order)] if column == "customer_id" else [(column, order), "customer_id"]
    slim = rows.select("customer_id", *({column} - {"customer_id"}))
    return row_numbers(slim, keys, name="position")
