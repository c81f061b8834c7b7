"""SQL text of the derived customer table, the prefix of every comparison query.

Written for DuckDB over the registered tables.  ``BASE`` is an open WITH list:
append ``, more AS (...) SELECT ...``.
"""

def _stir_sql(x: str) -> str:
    for _ in range(2):
        x = f"list_transform([{x}], lambda v: (xor(v, v >> 16) * 73244475) % 4294967296)[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> 16))[1]"


def mixed_hash_sql(column: str, seed: int = 0) -> str:
    """The hash with unrelated seeds, of a key that is not negative."""
    key = f"CAST({column} AS BIGINT)"
    high = _stir_sql(f"xor(({key} >> 32) % 4294967296, CAST({seed} AS BIGINT))")
    return _stir_sql(f"xor({key} % 4294967296, {high})")


def hash_sql(column: str, seed: int = 0) -> str:
    """Arithmetic hash shared with the Spark side (same values in both engines)."""
    return f"(((({column} + {seed}) % 2147483648) * 2654435761) % 4294967296)"


BASE = f"""WITH line_sums AS (
  SELECT l_orderkey,
    count(*) AS n_lines,
    sum(CAST(l_quantity AS BIGINT)) AS qty,
    sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS qty_kept,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS disc,
    sum(CASE WHEN l_linenumber % 2 = 1 THEN CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) ELSE 0 END) AS disc_odd,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret,
    sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_open,
    sum(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS n_done,
    sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS n_odd,
    sum(CASE WHEN l_linenumber % 2 = 1 AND l_linestatus <> 'O' THEN 1 ELSE 0 END) AS n_odd_done,
    sum(CASE WHEN l_linenumber % 2 = 1 AND l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_odd_open_ret,
    sum(CASE WHEN l_linenumber % 2 = 0 AND l_linestatus = 'O' AND l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_even_open_ret,
    sum(CASE WHEN l_linenumber % 2 = 1 AND l_linestatus = 'O' AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS n_odd_open_kept,
    sum(CASE WHEN l_linenumber % 2 = 0 AND l_linestatus = 'O' AND l_returnflag <> 'R' THEN 1 ELSE 0 END) AS n_even_open_kept,
    sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS retail,
    count(p_retailprice) AS n_retail
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY l_orderkey
), cust_sums AS (
  SELECT o_custkey AS c_id,
    count(*) FILTER (WHERE d < DATE '2001-01-01') AS totcalls,
    count(*) FILTER (WHERE d >= DATE '2001-01-01') AS n_label,
    min(d) FILTER (WHERE d < DATE '2001-01-01') AS first_d,
    max(d) FILTER (WHERE d < DATE '2001-01-01') AS last_d,
    max(date_diff('day', DATE '1970-01-01', d) * 8 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER))
      FILTER (WHERE d < DATE '2001-01-01') AS last_code,
    count(*) FILTER (WHERE d >= DATE '2000-01-01' AND d < DATE '2001-01-01') AS n12,
    sum(cents) FILTER (WHERE d < DATE '2001-01-01') AS cents_all,
    coalesce(sum(cents) FILTER (WHERE d >= DATE '2000-01-01' AND d < DATE '2001-01-01'), 0) AS cents12,
    coalesce(sum(cents) FILTER (WHERE d >= DATE '2000-07-01' AND d < DATE '2001-01-01'), 0) AS cents6,
    coalesce(sum(cents) FILTER (WHERE d < DATE '2001-01-01' AND o_orderstatus <> 'P'), 0) AS cents_adj,
    coalesce(sum(qty) FILTER (WHERE d >= DATE '2000-01-01' AND d < DATE '2001-01-01'), 0) AS qty12,
    coalesce(sum(qty) FILTER (WHERE d >= DATE '2000-07-01' AND d < DATE '2001-01-01'), 0) AS qty6,
    coalesce(sum(qty) FILTER (WHERE d < DATE '2001-01-01'), 0) AS qty_all,
    coalesce(sum(qty_kept) FILTER (WHERE d < DATE '2001-01-01'), 0) AS qty_kept,
    coalesce(sum(disc) FILTER (WHERE d < DATE '2001-01-01'), 0) AS disc,
    coalesce(sum(disc_odd) FILTER (WHERE d < DATE '2001-01-01'), 0) AS disc_odd,
    coalesce(sum(n_lines) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_lines,
    coalesce(sum(n_ret) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_ret,
    coalesce(sum(n_open) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_open,
    coalesce(sum(n_done) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_done,
    coalesce(sum(n_odd) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_odd,
    coalesce(sum(n_odd_done) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_odd_done,
    coalesce(sum(n_odd_open_ret) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_odd_open_ret,
    coalesce(sum(n_even_open_ret) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_even_open_ret,
    coalesce(sum(n_odd_open_kept) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_odd_open_kept,
    coalesce(sum(n_even_open_kept) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_even_open_kept,
    sum(retail) FILTER (WHERE d < DATE '2001-01-01') AS retail,
    coalesce(sum(n_retail) FILTER (WHERE d < DATE '2001-01-01'), 0) AS n_retail,
    count(*) FILTER (WHERE d < DATE '2001-01-01' AND o_orderstatus = 'O') AS actvsubs,
    count(*) FILTER (WHERE d < DATE '2001-01-01' AND o_orderstatus <> 'P') AS adjqty,
    count(n_lines) FILTER (WHERE d < DATE '2001-01-01') AS phones,
    count(*) FILTER (WHERE d < DATE '2001-01-01' AND n_ret > 0) AS models
  FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d,
               CAST(round(o_totalprice * 100) AS BIGINT) AS cents
        FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01') o
  LEFT JOIN line_sums ON l_orderkey = o_orderkey
  GROUP BY o_custkey
  HAVING count(*) FILTER (WHERE d < DATE '2001-01-01') > 0
), base0 AS (
  SELECT c_id AS customer_id,
    CAST(CASE WHEN n_label = 0 THEN 1 ELSE 0 END AS INTEGER) AS churn,
    CAST((2001 - year(first_d)) * 12 + 1 - month(first_d) AS INTEGER) AS months,
    CAST(date_diff('day', last_d, DATE '2001-01-01') AS INTEGER) AS eqpdays,
    CASE WHEN n12 > 0 THEN CAST(cents12 AS DOUBLE) / 1200 END AS rev_Mean,
    CASE WHEN n12 > 0 THEN CAST(qty12 AS DOUBLE) / 12 END AS mou_Mean,
    CASE WHEN n12 > 0 THEN CAST(cents6 AS DOUBLE) / 600 END AS avg3rev,
    CASE WHEN n12 > 0 THEN CAST(cents12 AS DOUBLE) / 1200 END AS avg6rev,
    CASE WHEN n12 > 0 THEN CAST(qty6 AS DOUBLE) / 6 END AS avg3mou,
    CASE WHEN n12 > 0 THEN CAST(qty12 AS DOUBLE) / 12 END AS avg6mou,
    CASE WHEN n12 > 0 THEN CAST(cents6 AS DOUBLE) / 600 - CAST(cents12 AS DOUBLE) / 1200 END AS change_rev,
    CASE WHEN n12 > 0 THEN CAST(qty6 AS DOUBLE) / 6 - CAST(qty12 AS DOUBLE) / 12 END AS change_mou,
    CAST(cents_all AS DOUBLE) / 100 AS totrev,
    CAST(totcalls AS BIGINT) AS totcalls,
    CAST(cents_all AS DOUBLE) / (100 * totcalls) AS totmrc_Mean,
    CAST(disc AS DOUBLE) / 10000 AS disc_total,
    CAST(disc_odd AS DOUBLE) / 10000 AS disc_odd_total,
    CAST(n_ret AS DOUBLE) AS n_ret, CAST(n_open AS DOUBLE) AS n_open,
    CAST(n_lines AS DOUBLE) AS n_lines, CAST(n_done AS DOUBLE) AS n_done,
    CAST(n_odd AS DOUBLE) AS n_odd, CAST(n_odd_done AS DOUBLE) AS n_odd_done,
    CAST(n_odd_open_ret AS DOUBLE) AS n_oor, CAST(n_even_open_ret AS DOUBLE) AS n_eor,
    CAST(n_odd_open_kept AS DOUBLE) AS n_ook, CAST(n_even_open_kept AS DOUBLE) AS n_eok,
    CASE WHEN n_retail > 0 THEN CAST(retail AS DOUBLE) / (100 * n_retail) END AS hnd_price,
    CAST(totcalls AS BIGINT) AS uniqsubs, CAST(actvsubs AS BIGINT) AS actvsubs,
    CAST(qty_all AS DOUBLE) AS totmou, CAST(qty_kept AS DOUBLE) AS adjmou,
    CAST(adjqty AS BIGINT) AS adjqty, CAST(cents_adj AS DOUBLE) / 100 AS adjrev,
    CAST(phones AS BIGINT) AS phones, CAST(models AS BIGINT) AS models,
    c_acctbal AS acctbal, c_mktsegment AS crclscod, r_name AS area, c_nationkey AS nk,
    CASE last_code % 8 WHEN 4 THEN 'UNKW' WHEN 1 THEN 'WCMB' WHEN 2 THEN 'WCMB' WHEN 3 THEN 'WC' END AS hnd_webcap
  FROM cust_sums JOIN customer ON c_custkey = c_id
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
), base AS (
  SELECT customer_id, churn, months, eqpdays, rev_Mean, mou_Mean, avg3rev, avg6rev, avg3mou, avg6mou,
    change_rev, change_mou, totrev, totcalls, totmrc_Mean,
    disc_total / months AS ovrrev_Mean, disc_odd_total / months AS vceovr_Mean,
    (disc_total - disc_odd_total) / months AS datovr_Mean,
    n_ret / months AS custcare_Mean, n_open / months AS drop_blk_Mean,
    n_oor / months AS drop_vce_Mean, n_eor / months AS drop_dat_Mean,
    n_ook / months AS blck_vce_Mean, n_eok / months AS blck_dat_Mean,
    n_lines / months AS attempt_Mean, n_done / months AS complete_Mean,
    n_odd / months AS plcd_vce_Mean, (n_lines - n_odd) / months AS plcd_dat_Mean,
    n_odd_done / months AS comp_vce_Mean, (n_done - n_odd_done) / months AS comp_dat_Mean,
    hnd_price, uniqsubs, actvsubs, totmou, adjmou, adjqty, adjrev, phones, models,
    acctbal, crclscod, area, hnd_webcap,
    CASE WHEN n_lines > 0 AND n_ret * 3 > n_lines THEN 'R' ELSE 'N' END AS refurb_new,
    CASE nk % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'Y' ELSE 'N' END AS new_cell,
    CASE nk % 5 WHEN 0 THEN 'U' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'A' ELSE 'B' END AS marital,
    CASE WHEN {hash_sql('customer_id')} % 13 = 0 THEN NULL ELSE
      substr('SUTCR', CAST({hash_sql('customer_id')} % 5 AS INTEGER) + 1, 1) END AS prizm_social_one,
    CASE WHEN acctbal >= 0 THEN CAST(1 + floor(acctbal / 1200) AS INTEGER) END AS income,
    CASE WHEN {hash_sql('customer_id')} % 3 > 0 THEN CAST({hash_sql('customer_id')} % 16 AS INTEGER) END AS lor
  FROM base0
), cust AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY churn ORDER BY {hash_sql('customer_id')}, customer_id)) % 5 AS INTEGER) AS fold,
    CASE WHEN row_number() OVER (PARTITION BY churn ORDER BY {hash_sql('customer_id', 42)}, customer_id)
      <= round(0.2 * count(*) OVER (PARTITION BY churn)) THEN 'test' ELSE 'train_oof' END AS partition
  FROM base
)"""


# Out-of-fold segment rates, corrected scores, weights.
TRAIN = "partition = 'train_oof'"
SCORED = BASE + f""", seg AS (
  SELECT * REPLACE (CASE WHEN {TRAIN} THEN fold ELSE -1 END AS fold),
    CASE WHEN months < 64 THEN '< 64 mois' WHEN months < 69 THEN '64-68 mois' ELSE '>= 69 mois' END AS anciennete,
    CASE WHEN mou_Mean < 10 THEN 'Usage < 10' WHEN mou_Mean < 20 THEN 'Usage 10-19' WHEN mou_Mean >= 20 THEN 'Usage >= 20' END AS usage,
    CASE WHEN eqpdays < 90 THEN 'Achat < 90 j' WHEN eqpdays < 270 THEN 'Achat 90-269 j' ELSE 'Achat >= 270 j' END AS terminal
  FROM cust
), labelled AS (
  SELECT *, CASE WHEN anciennete IS NULL OR usage IS NULL OR terminal IS NULL THEN 'Non segmenté'
    ELSE anciennete || ' | ' || usage || ' | ' || terminal END AS segment_regles FROM seg
), cells AS (
  SELECT segment_regles AS s, fold AS f, count(*) FILTER (WHERE {TRAIN}) AS n,
    coalesce(sum(churn) FILTER (WHERE {TRAIN}), 0) AS pos
  FROM labelled GROUP BY 1, 2
), oof AS (
  SELECT s, f, sum(pos) OVER () - sum(pos) OVER (PARTITION BY f) AS g_pos,
    sum(n) OVER () - sum(n) OVER (PARTITION BY f) AS g_n,
    sum(pos) OVER (PARTITION BY s) - pos AS s_pos, sum(n) OVER (PARTITION BY s) - n AS s_n
  FROM cells
), scored0 AS (
  SELECT l.*, CAST(g_pos AS DOUBLE) / g_n AS taux_appris,
    coalesce(CASE WHEN s_n > 0 THEN CAST(s_pos AS DOUBLE) / s_n END, CAST(g_pos AS DOUBLE) / g_n) AS proba_calibree,
    mou_Mean IS NULL OR mou_Mean = 0 AS inactif
  FROM labelled l JOIN oof ON segment_regles = s AND fold = f
), scored1 AS (
  SELECT *, least(greatest(proba_calibree, 1e-9), 1 - 1e-9) AS pc FROM scored0
), scored AS (
  SELECT * EXCLUDE (pc), pc * (0.02::DOUBLE / taux_appris) / (pc * (0.02::DOUBLE / taux_appris) + (1 - pc) * ((1 - 0.02::DOUBLE) / (1 - taux_appris))) AS proba_reelle,
    pc * (0.02::DOUBLE / taux_appris) / (pc * (0.02::DOUBLE / taux_appris) + (1 - pc) * ((1 - 0.02::DOUBLE) / (1 - taux_appris))) * coalesce(rev_Mean, 0) AS revenu_en_jeu
  FROM scored1
), rate AS (
  SELECT CAST(sum(churn) AS DOUBLE) / count(*) AS s FROM scored WHERE {TRAIN}
)"""


def bands_sql(source: str, score: str, band: float, real_rate: str | None, rate: str,
              prefix: str = "") -> str:
    """CTEs ``{prefix}rows`` (with band numbers) and ``{prefix}bands`` of a scored source."""
    up = f"({real_rate}::DOUBLE / {rate})" if real_rate else "1.0::DOUBLE"
    down = f"((1 - {real_rate}::DOUBLE) / (1 - {rate}))" if real_rate else "1.0::DOUBLE"
    n = int(round(1 / band))
    return f""", {prefix}ranked AS (
  SELECT customer_id, churn, {score} AS score, {up} AS up, {down} AS down,
    sum(churn) OVER w AS pos_cum, sum(1 - churn) OVER w AS neg_cum,
    sum(churn) OVER () AS pos_all, sum(1 - churn) OVER () AS neg_all
  FROM {source}
  WINDOW w AS (ORDER BY {score} DESC, customer_id ROWS UNBOUNDED PRECEDING)
), {prefix}rows AS (
  SELECT *, CASE WHEN churn = 1 THEN up ELSE down END AS w,
    least(CAST(floor((pos_cum * up + neg_cum * down - CASE WHEN churn = 1 THEN up ELSE down END)
      / (pos_all * up + neg_all * down) / {band}::DOUBLE + 1e-9) AS INTEGER), {n - 1}) AS bande
  FROM {prefix}ranked
), {prefix}bands AS (
  SELECT bande, 100 * {band}::DOUBLE * bande AS debut_pct, 100 * {band}::DOUBLE * (bande + 1) AS fin_pct, n,
    churners / poids AS taux,
    churners / poids / (sum(churners) OVER () / sum(poids) OVER ()) AS lift,
    sum(churners) OVER w / sum(poids) OVER w / (sum(churners) OVER () / sum(poids) OVER ()) AS lift_cumule,
    score_min
  FROM (SELECT bande, count(*) AS n, sum(w) AS poids, sum(w * churn) AS churners, min(score) AS score_min
        FROM {prefix}rows GROUP BY bande)
  WINDOW w AS (ORDER BY bande ROWS UNBOUNDED PRECEDING)
)"""


def tiers_sql(band: float, capacity: float, prefix: str = "") -> str:
    n_high = int(round(capacity / band))
    return f""", {prefix}tiers AS (
  SELECT *, CASE WHEN bande < {n_high} THEN 'High'
    WHEN min(CASE WHEN bande < {n_high} THEN 1 WHEN lift > 1.2 THEN 1 ELSE 0 END) OVER (ORDER BY bande ROWS UNBOUNDED PRECEDING) = 1
    THEN 'Medium' ELSE 'Low' END AS niveau FROM {prefix}bands
), {prefix}thr AS (
  SELECT min(score_min) FILTER (WHERE niveau = 'High') AS high, min(score_min) FILTER (WHERE niveau <> 'Low') AS medium,
    count(*) FILTER (WHERE niveau <> 'Low') * {band}::DOUBLE AS medium_end
  FROM {prefix}tiers
)"""


EXPLAINED = ["months", "in_contract_end", "eqpdays", "change_mou", "avg3mou", "ratio_mou_3m_6m",
             "totmrc_Mean", "rev_Mean", "ovrrev_Mean", "drop_vce_Mean", "custcare_Mean",
             "has_custcare", "hnd_price", "actvsubs", "uniqsubs", "income", "lor"]
SOURCE_OF = {"in_contract_end": "months", "ratio_mou_3m_6m": "avg3mou",
             "has_custcare": "custcare_Mean"}

ACTIVE_TIERS = (", active AS (SELECT scored.*, rate.s AS s FROM scored, rate WHERE "
                + TRAIN + " AND NOT inactif)"
                + bands_sql("active", "proba_calibree", 0.05, "0.02", "s").replace(
                    "SELECT customer_id, churn,", "SELECT customer_id, churn, s,", 1)
                + tiers_sql(0.05, 0.10))

STORE = SCORED + ACTIVE_TIERS + """, feats AS (
  SELECT *, CASE WHEN months IN (69, 70) THEN 1 ELSE 0 END AS in_contract_end,
    CASE WHEN avg6mou <> 0 THEN avg3mou / avg6mou END AS ratio_mou_3m_6m,
    CASE WHEN custcare_Mean > 0 THEN 1 ELSE 0 END AS has_custcare
  FROM scored
), long AS (
""" + "\nUNION ALL ".join(
    f"SELECT customer_id, churn, partition, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM feats"
    for f in EXPLAINED) + f"""
), coefs AS (
  SELECT feature, round(avg(value), 6) AS mean,
    round(coalesce(CASE WHEN var_pop(value) <> 0 THEN (avg(value) FILTER (WHERE churn = 1) - avg(value) FILTER (WHERE churn = 0)) / var_pop(value) END, 0), 12) AS coef
  FROM long WHERE {TRAIN} AND value IS NOT NULL GROUP BY feature
), feature_contrib AS (
  SELECT customer_id, feature, coalesce(coef * (value - mean), 0) AS contribution FROM long JOIN coefs USING (feature)
), contrib AS (
  SELECT customer_id, CASE feature WHEN 'in_contract_end' THEN 'months' WHEN 'ratio_mou_3m_6m' THEN 'avg3mou'
    WHEN 'has_custcare' THEN 'custcare_Mean' ELSE feature END AS variable, sum(contribution) AS contribution
  FROM feature_contrib GROUP BY 1, 2
), fam AS (
  SELECT c.*, CASE WHEN variable = 'months' AND in_contract_end = 1 THEN 'engagement'
      WHEN variable IN ('eqpdays', 'hnd_price') THEN 'terminal'
      WHEN variable IN ('change_mou', 'avg3mou') THEN 'usage'
      WHEN variable IN ('totmrc_Mean', 'rev_Mean', 'ovrrev_Mean') THEN 'forfait'
      WHEN variable = 'drop_vce_Mean' THEN 'reseau' WHEN variable = 'custcare_Mean' THEN 'service_client'
      WHEN variable IN ('actvsubs', 'uniqsubs') THEN 'lignes' ELSE 'contexte' END AS famille
  FROM contrib c JOIN feats USING (customer_id)
), ranked_f AS (
  SELECT *, famille <> 'contexte' AS actionnable,
    row_number() OVER (PARTITION BY customer_id ORDER BY abs(contribution) DESC, variable) AS rang,
    CASE WHEN famille <> 'contexte' AND contribution > 0 THEN row_number() OVER (PARTITION BY customer_id
      ORDER BY CASE WHEN famille <> 'contexte' AND contribution > 0 THEN 0 ELSE 1 END, contribution DESC, variable) END AS rang_raison,
    CASE WHEN famille = 'contexte' AND contribution <> 0 THEN row_number() OVER (PARTITION BY customer_id
      ORDER BY CASE WHEN famille = 'contexte' AND contribution <> 0 THEN 0 ELSE 1 END, abs(contribution) DESC, variable) END AS rang_contexte
  FROM fam
), reasons AS (
  SELECT customer_id, max(variable) FILTER (WHERE rang_raison = 1) AS raison_1_variable,
    max(variable) FILTER (WHERE rang_raison = 2) AS raison_2_variable,
    max(variable) FILTER (WHERE rang_raison = 3) AS raison_3_variable,
    max(famille) FILTER (WHERE rang_raison = 1) AS famille_dominante,
    max(variable) FILTER (WHERE rang_contexte = 1) AS contexte_1_variable,
    max(variable) FILTER (WHERE rang_contexte = 2) AS contexte_2_variable
  FROM ranked_f GROUP BY customer_id
), tiered AS (
  SELECT scored.*, CASE WHEN inactif THEN 'Inactif' WHEN proba_calibree >= high THEN 'High'
    WHEN proba_calibree >= medium THEN 'Medium' ELSE 'Low' END AS niveau FROM scored, thr
), mass AS (
  SELECT sum(churn) * (0.02::DOUBLE / any_value(s)) + (count(*) - sum(churn)) * ((1 - 0.02::DOUBLE) / (1 - any_value(s))) AS m, any_value(s) AS s
  FROM scored, rate
), zstats AS (
  SELECT avg(months) AS m1, stddev_pop(months) AS s1, avg(eqpdays) AS m2, stddev_pop(eqpdays) AS s2,
    avg(totmrc_Mean) AS m3, stddev_pop(totmrc_Mean) AS s3 FROM scored
), zrows AS (
  SELECT customer_id, crclscod, (months - m1) / s1 AS z1, (eqpdays - m2) / s2 AS z2, (totmrc_Mean - m3) / s3 AS z3 FROM scored, zstats
), centres AS (
  SELECT row_number() OVER (ORDER BY crclscod) - 1 AS segment_id, avg(z1) AS c1, avg(z2) AS c2, avg(z3) AS c3 FROM zrows GROUP BY crclscod
), nearest AS (
  SELECT customer_id, segment_id FROM zrows, centres
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY (z1-c1)*(z1-c1) + (z2-c2)*(z2-c2) + (z3-c3)*(z3-c3), segment_id) = 1
), scores AS (
  SELECT t.* REPLACE (coalesce(area, 'inconnue') AS area), r.* EXCLUDE (customer_id),
    CASE WHEN niveau = 'Inactif' THEN 'Vérifier la ligne / reconquête'
      WHEN niveau NOT IN ('High', 'Medium') THEN 'Pas d''action de campagne (suivi)'
      ELSE CASE famille_dominante WHEN 'terminal' THEN 'Offre de renouvellement du terminal'
        WHEN 'engagement' THEN 'Offre de réengagement' WHEN 'usage' THEN 'Offre adaptée à l''usage'
        WHEN 'forfait' THEN 'Changement de forfait' WHEN 'reseau' THEN 'Geste commercial + ticket technique'
        WHEN 'service_client' THEN 'Contact de fidélisation (suivi service client)'
        WHEN 'lignes' THEN 'Contact de fidélisation (offre multi-lignes)' ELSE 'Contact de fidélisation' END END AS action,
    CASE WHEN churn = 1 THEN 0.02::DOUBLE / mass.s ELSE (1 - 0.02::DOUBLE) / (1 - mass.s) END * 100000 / m AS poids_portefeuille,
    CAST(segment_id AS INTEGER) AS segment_id, 'Segment ' || segment_id AS segment,
    CASE WHEN months <= 55 THEN '0-55 mois' WHEN months <= 62 THEN '56-62 mois' WHEN months <= 66 THEN '63-66 mois'
      WHEN months <= 69 THEN '67-69 mois' ELSE '70 mois et plus' END AS tenure_band,
    CASE WHEN eqpdays <= 182 THEN 'moins de 6 mois' WHEN eqpdays <= 299 THEN '6-9 mois' WHEN eqpdays <= 365 THEN '10-12 mois'
      WHEN eqpdays <= 730 THEN '1-2 ans' WHEN eqpdays > 730 THEN 'plus de 2 ans' ELSE 'inconnu' END AS handset_age_band,
    CASE WHEN coalesce(mou_Mean, 0) <= 0 THEN 'aucun usage (0 min ou non mesuré)' WHEN mou_Mean <= 10 THEN '1-10'
      WHEN mou_Mean <= 20 THEN '11-20' WHEN mou_Mean <= 30 THEN '21-30' ELSE 'plus de 30' END AS usage_band,
    CAST(customer_id AS VARCHAR) AS id_text,
    ln(mass.s / (1 - mass.s)) AS valeur_base
  FROM tiered t JOIN reasons r USING (customer_id) JOIN nearest USING (customer_id), mass
)"""
