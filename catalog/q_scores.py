"""Score-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base_sql import BASE, STORE
from catalog.registry import query
from loyaltide.plans.score_table import load_store
from loyaltide.sources.customer_base import load_customer_base


@query("base_customer_table", BASE + " SELECT * FROM cust")
def base_customer_table(spark, sf):
    return load_customer_base(spark, sf)


_COLS = ["customer_id", "churn", "fold", "partition", "proba_calibree", "proba_reelle", "inactif",
         "niveau", "action", "revenu_en_jeu", "poids_portefeuille", "segment_id", "segment",
         "tenure_band", "handset_age_band", "usage_band", "id_text", "area", "valeur_base",
         "raison_1_variable", "raison_2_variable", "raison_3_variable", "famille_dominante",
         "contexte_1_variable", "contexte_2_variable", "segment_regles"]
_MONEY = {"proba_calibree": 9, "proba_reelle": 9, "revenu_en_jeu": 4, "poids_portefeuille": 6,
          "valeur_base": 9}


@query("store_scores", STORE + " SELECT " + ", ".join(
    f"round({c}, {_MONEY[c]}) AS {c}" if c in _MONEY else c for c in _COLS) + " FROM scores")
def store_scores(spark, sf):
    return load_store(spark, sf).scores.select(*[
        F.round(c, _MONEY[c]).alias(c) if c in _MONEY else F.col(c) for c in _COLS])
