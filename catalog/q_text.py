"""Text audits over documents and conversations, public views, sources and the batch job."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from catalog.base_sql import BASE, SCORED, STORE
from catalog.q_portfolio import DRIVERS, FILTERS, WINDOW
from catalog.registry import query, rounded, sql
from loyaltide import fixed_values as fv
from loyaltide.operators import dashboards, text_audit as ta
from loyaltide.plans.score_table import build_store, load_store, model_scorer, rate_scorer
from loyaltide.sources import tables
from loyaltide.sources.customer_base import load_customer_base as base
from loyaltide.staging import staging_root

def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@query("k01_extract_numbers")
def k01(spark, sf):
    return ta.extract_numbers(documents(spark, sf), ["doc_id"])


# A number may not be glued to a letter, digit, underscore, point or comma before it, nor to a letter or
# underscore after it.
@query("k01_digit_free_texts", r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(^|[^\p{L}\p{N}_.,])[0-9]+([.,][0-9]+)?($|[^\p{L}\p{N}_])')")
def k01b(spark, sf):
    docs = documents(spark, sf)
    numbers = ta.extract_numbers(docs, ["doc_id"])
    return docs.join(numbers, "doc_id", "left_anti").select("doc_id")


_ANS = STORE + """, ans AS (SELECT customer_id, round_even(rev_Mean, 0) AS a, round_even(100 * proba_reelle, 1) AS b, CAST(totcalls AS DOUBLE) AS c, CAST(months * 7 AS DOUBLE) AS d, rev_Mean, proba_reelle, totcalls, CAST(rev_Mean IS NULL AS INTEGER) AS gap FROM scores
), num AS (SELECT customer_id, 0 AS pos, a AS valeur, 0 AS decimales FROM ans WHERE a IS NOT NULL UNION ALL SELECT customer_id, 1 - gap, b, 1 FROM ans UNION ALL SELECT customer_id, 2 - gap, c, 0 FROM ans UNION ALL SELECT customer_id, 3 - gap, d, 0 FROM ans
), alw AS (SELECT customer_id, rev_Mean AS v FROM ans UNION ALL SELECT customer_id, proba_reelle FROM ans UNION ALL SELECT customer_id, 100 * proba_reelle FROM ans UNION ALL SELECT customer_id, totcalls FROM ans UNION ALL SELECT customer_id, 100 * totcalls FROM ans WHERE totcalls <= 1
   UNION ALL SELECT customer_id, 100 * rev_Mean FROM ans WHERE rev_Mean <= 1)"""


def answers(spark, sf):
    """One sentence per customer: three faithful numbers (two without a bill) and one that has no
    source."""
    df = load_store(spark, sf).scores
    bill = F.when(F.col("rev_Mean").isNotNull(), F.format_string("%.0f", F.bround("rev_Mean", 0)))
    text = F.concat(F.lit("Facture "), F.coalesce(bill, F.lit("inconnue")),
                    F.lit(" $, risque "),
                    F.translate(F.format_string("%.1f", F.bround(100 * F.col("proba_reelle"), 1)),
                                ".", ","),
                    F.lit(" %, appels "), F.col("totcalls").cast("string"), F.lit(", code "),
                    (F.col("months") * 7).cast("string"), F.lit(" fin"))
    return df.select("customer_id", "rev_Mean", "proba_reelle", "totcalls", text.alias("text"))


@query("k01_numbers_of_answers", sql(_ANS, "SELECT customer_id, pos, valeur, CAST(decimales AS INTEGER) AS decimales FROM num", "valeur"))
def k01c(spark, sf):
    return rounded(ta.extract_numbers(answers(spark, sf), ["customer_id"]).drop("texte"))


@query("k02_number_fidelity", sql(_ANS, """SELECT n.customer_id, n.pos, n.valeur FROM num n WHERE valeur NOT IN (0, 1, 2, 3, 4, 5, 100, 1000) AND NOT EXISTS (
  SELECT 1 FROM alw WHERE alw.customer_id = n.customer_id AND abs(n.valeur - v) <= greatest(0.5 * pow(10.0::DOUBLE, -decimales) + 1e-9, 0.01 * v))""", "valeur"))
def k02(spark, sf):
    df = answers(spark, sf)
    numbers = ta.extract_numbers(df, ["customer_id"])
    allowed = ta.allowed_values(df, ["customer_id"], ["rev_Mean", "proba_reelle", "totcalls"])
    out = ta.unsupported_numbers(numbers, allowed, ["customer_id"])
    return rounded(out.select("customer_id", "pos", "valeur"))


TERMS = ["enfant", "avec", "que", "the and", "éle", "ethni"]


def term_sql(source: str, ids: str, text: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{t}' AS terme FROM {source} WHERE contains(strip_accents(lower({text})), strip_accents('{t}'))"
        for t in TERMS)


@query("k03_sensitive_terms", term_sql("documents", "doc_id", "text"))
def k03(spark, sf):
    return ta.sensitive_hits(documents(spark, sf), ["doc_id"], terms=TERMS)


@query("k03_sensitive_terms_conversations", term_sql("conversations", "conv_id, turn", "text"))
def k03b(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    return ta.sensitive_hits(rows, ["conv_id", "turn"], terms=TERMS)


def _sms(i: int) -> str:
    def quote(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"
    cases = " ".join(f"WHEN '{f}' THEN {quote(t[i])}" for f, t in fv.RETENTION_TEMPLATES.items())
    return f"CASE WHEN inactif THEN {quote(fv.INACTIVE_TEMPLATE[i])} ELSE CASE famille_dominante {cases} ELSE {quote(fv.DEFAULT_TEMPLATE[i])} END END"


@query("k04_retention_messages", STORE + f" SELECT customer_id, {_sms(0)} AS sms, {_sms(1)} AS email_subject, {_sms(2)} AS email_body, false AS chiffres_ou_montant FROM scores")
def k04(spark, sf):
    return ta.retention_messages(load_store(spark, sf).scores).select(
        "customer_id", "sms", "email_subject", "email_body", "chiffres_ou_montant")


EVAL = """WITH c AS (SELECT conv_id, list_distinct(list(role)) AS appels, count(*) AS n FROM conversations GROUP BY 1
), e AS (SELECT *, CASE WHEN n % 2 = 0 THEN ['user', 'assistant'] ELSE ['user'] END AS attendus FROM c)"""


@query("k05_evaluation_summary", sql(EVAL, """SELECT count(*) AS n, avg((len(list_filter(appels, lambda x: NOT list_contains(attendus, x))) = 0 AND len(appels) > 0)::INT) AS routage,
  avg((n > 2)::INT) AS fidelite FROM e WHERE n >= 2""", "routage fidelite"))
def k05(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    per = rows.groupBy("conv_id").agg(F.collect_set("role").alias("appels"),
                                      F.count(F.lit(1)).alias("n"))
    per = per.select("appels", F.when(F.col("n") % 2 == 0, F.array(
        F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("user"))).alias("attendus"),
        (F.col("n") > 2).alias("fidele"), (F.col("n") >= 2).alias("evalue"))
    return rounded(ta.evaluation_summary(per))


@query("j36_public_customers", sql(STORE, """SELECT customer_id, niveau, inactif, CAST(round_even(CAST(100 * proba_reelle AS DECIMAL(28,12)), 2) AS DOUBLE) AS risque_mensuel_pct, segment, action AS action_suggeree,
  CAST(round_even(CAST(rev_Mean AS DECIMAL(28,10)), 2) AS DOUBLE) AS facture_mensuelle_dollars, CAST(round_even(CAST(revenu_en_jeu AS DECIMAL(28,10)), 2) AS DOUBLE) AS revenu_mensuel_en_jeu_dollars,
  (SELECT count(*) FROM ranked_f r WHERE r.customer_id = s.customer_id AND rang_raison <= 3 AND variable <> 'income') AS n_raisons,
  (SELECT count(*) FROM ranked_f r WHERE r.customer_id = s.customer_id AND rang_contexte <= 2 AND variable <> 'income') AS n_contexte FROM scores s""",
    "risque_mensuel_pct facture_mensuelle_dollars revenu_mensuel_en_jeu_dollars"))
def j36(spark, sf):
    store = load_store(spark, sf)
    return rounded(ta.public_view(store.scores, store.factors))


@query("j36_public_drivers", sql(DRIVERS + """, dr AS (SELECT *, family <> 'contexte' AS actionable, row_number() OVER (PARTITION BY family <> 'contexte' ORDER BY mean_abs_shap DESC, variable) AS rang FROM dt
), dp AS (SELECT *, row_number() OVER (PARTITION BY actionable ORDER BY rang) AS position FROM dr WHERE variable <> 'income')""",
    "SELECT actionable, position, round_even(share_pct, 1) AS part_importance_pct, round_even(100 * share_rows_increasing, 0) AS part_clients_en_hausse_pct FROM dp WHERE position <= 8",
    "part_importance_pct part_clients_en_hausse_pct"))
def j36b(spark, sf):
    store = load_store(spark, sf)
    return rounded(ta.public_drivers(dashboards.drivers(
        store.scores, store.contributions, FILTERS, WINDOW)).drop("facteur", "famille"))


@query("j38_score_table_build", STORE + " SELECT partition, niveau, action, count(*) AS n FROM scores GROUP BY ALL")
def j38(spark, sf):
    store = build_store(base(spark, sf), scorer=rate_scorer)
    return store.scores.groupBy("partition", "niveau", "action").agg(F.count(F.lit(1)).alias("n"))


# The job with fitted models: SQL knows who must be in it and how much each row counts; what models
# must satisfy on every row is checked in the query and expected to hold.
_J38 = sql(SCORED, f"""SELECT customer_id, scored.partition, fold, inactif,
  CASE WHEN churn = 1 THEN 0.02::DOUBLE / rate.s ELSE (1 - 0.02::DOUBLE) / (1 - rate.s) END * 100000 / (SELECT sum(churn) * (0.02::DOUBLE / any_value(r.s)) + (count(*) - sum(churn)) * ((1 - 0.02::DOUBLE) / (1 - any_value(r.s))) FROM scored, rate r) AS poids_portefeuille,
  true AS score_explique, true AS score_borne, true AS niveau_coherent FROM scored, rate""", "poids_portefeuille")


def _model_table(spark, sf, scorer):
    store = build_store(base(spark, sf), scorer=scorer)
    total = store.contributions.groupBy("customer_id").agg(F.sum("contribution").alias("_sum"))
    high, medium = F.col("high"), F.col("medium")
    p = F.col("proba_calibree")
    level = (F.when(F.col("inactif"), "Inactif").when(p >= high, "High").when(p >= medium, "Medium")
             .otherwise("Low"))
    df = store.scores.join(total, "customer_id").crossJoin(store.thresholds)      # one row
    return rounded(df.select(
        "customer_id", "partition", "fold", "inactif", "poids_portefeuille",
        (F.abs(F.col("proba_brute") - 1 / (1 + F.exp(-F.col("valeur_base") - F.col("_sum")))) < 1e-6)
        .alias("score_explique"),
        (F.col("proba_brute").between(0, 1) & p.between(0, 1) & (F.col("proba_brute") != p)
         & (F.col("proba_reelle") <= p)).alias("score_borne"),
        (F.col("niveau") == level).alias("niveau_coherent")))


@query("j38_model_score_table", _J38)
def j38m(spark, sf):
    return _model_table(spark, sf, model_scorer)


@query("j38_boosted_score_table", _J38)
def j38b(spark, sf):
    return _model_table(spark, sf, partial(model_scorer, kind="boosting"))


@query("a01_load_raw", BASE + " SELECT customer_id, months, rev_Mean, area FROM cust")
def a01(spark, sf):
    df = base(spark, sf).select("customer_id", "months", "rev_Mean", "area")
    path = f"{staging_root(spark)}/a01-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return tables.load_raw(spark, path, df.schema)


@query("a03_save_and_load_splits", BASE + " SELECT customer_id, churn FROM cust WHERE partition = 'train_oof'")
def a03(spark, sf):
    path = f"{staging_root(spark)}/a03-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    tables.save_splits(base(spark, sf), path)
    return tables.load_train(spark, path).select("customer_id", "churn")


@query("a04_load_test", BASE + " SELECT customer_id, churn FROM cust WHERE partition = 'test'")
def a04(spark, sf):
    path = f"{staging_root(spark)}/a04-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    tables.save_splits(base(spark, sf), path)
    return tables.load_test(spark, path, final_evaluation=True).select("customer_id", "churn")


@query("a05_load_store", STORE + " SELECT niveau, count(*) AS n, count(DISTINCT id_text) AS ids FROM scores GROUP BY 1")
def a05(spark, sf):
    store = load_store(spark, sf)
    path = f"{staging_root(spark)}/a05-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    tables.save_store(store.__dict__, path)
    scores = tables.read_store(spark, path)["scores"]
    return scores.groupBy("niveau").agg(F.count(F.lit(1)).alias("n"),
                                        F.countDistinct("id_text").alias("ids"))


@query("a08_report_sinks", sql(STORE, "SELECT bande, niveau, lift FROM tiers", "lift"))
def a08(spark, sf):
    store = load_store(spark, sf)
    path = f"{staging_root(spark)}/a08-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    tables.write_reports({"tier_bands": store.bands}, path)
    return rounded(spark.read.schema(store.bands.schema).option("header", True)
                   .csv(f"{path}/csv/tier_bands").select("bande", "niveau", "lift"))


@query("a08_kpi_bundle", sql(STORE, """SELECT 'n_rows' AS nom, CAST(count(*) AS DOUBLE) AS valeur FROM scores UNION ALL SELECT 'inactive_n_rows', count(*) FILTER (WHERE inactif) FROM scores
  UNION ALL SELECT 'expected_churners', sum(poids_portefeuille * proba_reelle) FROM scores UNION ALL SELECT 'revenue_at_risk_monthly', sum(poids_portefeuille * revenu_en_jeu) FROM scores
  UNION ALL SELECT 'n_portfolio_equiv', sum(poids_portefeuille) FROM scores""", "valeur:2"))
def a08k(spark, sf):
    """The bundle written, its JSON object read back with a schema, and its lines compared."""
    path = f"{staging_root(spark)}/a08k-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    table = dashboards.kpis(load_store(spark, sf).scores)
    tables.write_kpi_bundle(table, path)
    back = spark.read.schema(table.schema).json(f"{path}/kpis")
    names = ["n_rows", "inactive_n_rows", "expected_churners", "revenue_at_risk_monthly",
             "n_portfolio_equiv"]
    long = back.unpivot([], [F.col(c).cast("double").alias(c) for c in names], "nom", "valeur")
    lines = spark.read.option("header", True).schema("nom string, ligne double").csv(
        f"{path}/kpis_lignes")
    return rounded(long.join(lines, "nom").filter("abs(valeur - ligne) <= 1e-9 * abs(valeur)")
                   .select("nom", "valeur"), 2)


@query("j36_public_lines", sql(STORE, """SELECT customer_id, nature, row_number() OVER (PARTITION BY customer_id, nature ORDER BY rang) AS position, variable,
  round_even(contribution, 3) AS contribution, CASE WHEN contribution > 0 THEN 'hausse' ELSE 'baisse' END AS sens FROM (
  SELECT customer_id, 'raison' AS nature, rang_raison AS rang, variable, contribution FROM ranked_f WHERE rang_raison <= 3
  UNION ALL SELECT customer_id, 'contexte', rang_contexte, variable, contribution FROM ranked_f WHERE rang_contexte <= 2) WHERE variable <> 'income'""", "contribution:3"))
def j36c(spark, sf):
    return rounded(ta.public_lines(load_store(spark, sf).factors), 3)


@query("j36_public_segments", sql(STORE + """, sg AS (SELECT segment, count(*) AS n_rows, sum(poids_portefeuille) AS w, sum(poids_portefeuille * proba_reelle) AS e, sum(poids_portefeuille * revenu_en_jeu) AS m,
  sum(poids_portefeuille) FILTER (WHERE niveau = 'High') AS h FROM scores GROUP BY 1)""", """SELECT segment, n_rows, round_even(100 * w / sum(w) OVER (), 1) AS part_pct, round_even(100 * e / w, 2) AS risque_mensuel_pct,
  round_even(100 * coalesce(h, 0) / w, 1) AS part_high_pct, round_even(m, 0) AS revenu_en_jeu_dollars FROM sg""", "part_pct risque_mensuel_pct part_high_pct revenu_en_jeu_dollars"))
def j36d(spark, sf):
    from loyaltide.operators.dashboards import group_rows
    return rounded(ta.public_segments(group_rows(load_store(spark, sf).scores, ["segment"])))


@query("k02_fidelity_with_question", sql(_ANS, """SELECT n.customer_id, n.pos, n.valeur FROM num n WHERE valeur NOT IN (0, 1, 2, 3, 4, 5, 100, 1000) AND NOT EXISTS (
  SELECT 1 FROM (SELECT * FROM alw UNION ALL SELECT customer_id, d FROM ans WHERE customer_id % 2 = 0 UNION ALL SELECT customer_id, 100 * d FROM ans WHERE customer_id % 2 = 0 AND d <= 1) x
  WHERE x.customer_id = n.customer_id AND abs(n.valeur - v) <= greatest(0.5 * pow(10.0::DOUBLE, -decimales) + 1e-9, 0.01 * v))""", "valeur"))
def k02q(spark, sf):
    """Half of the questions name the code, which the answer may then cite."""
    scores = load_store(spark, sf).scores.select("customer_id", F.when(
        F.col("customer_id") % 2 == 0, F.concat(F.lit("Que dire du code "), (
            F.col("months") * 7).cast("string"), F.lit(" ?"))).alias("question"))
    df = answers(spark, sf).join(scores, "customer_id")
    allowed = ta.allowed_values(df, ["customer_id"], ["rev_Mean", "proba_reelle", "totcalls"])
    allowed = allowed.unionByName(ta.allowed_in_texts(df, ["customer_id"], ["question"])).distinct()
    out = ta.unsupported_numbers(ta.extract_numbers(df, ["customer_id"]), allowed, ["customer_id"])
    return rounded(out.select("customer_id", "pos", "valeur"))


@query("a08_store_sinks", sql(STORE, """SELECT 'contributions' AS source, variable, count(*) AS n, sum(contribution) AS total FROM contrib GROUP BY 2
  UNION ALL SELECT 'scores', niveau, count(*), sum(proba_reelle) FROM scores GROUP BY 2
  UNION ALL SELECT 'bands', niveau, count(*), sum(lift) FROM tiers GROUP BY 2""", "total"))
def a08s(spark, sf):
    """Every table of the store written and read back."""
    store = load_store(spark, sf)
    path = f"{staging_root(spark)}/a08s-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    tables.save_store({n: getattr(store, n) for n in tables.STORE_TABLES}, path)
    back = tables.read_store(spark, path)
    parts = [("contributions", "variable", "contribution"), ("scores", "niveau", "proba_reelle"),
             ("bands", "niveau", "lift")]
    out = None
    for name, key, value in parts:
        rows = back[name].groupBy(F.col(key).alias("variable")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
                F.lit(name).alias("source"), "variable", "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out)
