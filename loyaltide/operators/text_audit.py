"""Audits over tables of texts: numbers, their fidelity, sensitive terms, retention messages."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv

# Number pattern (thousands separated by a space, a no-break or a narrow no-break
# space; decimals after a comma or a point; no glued letter), constants and tolerance.
NUMBER_PATTERN = ("(?<![\\p{L}\\p{N}_.,])(\\d{1,3}(?:[   ]\\d{3})+|\\d+)(?:[.,](\\d+))?"
                  "(?![\\p{L}\\p{N}_])")
ALWAYS_ALLOWED = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 1000.0)
RELATIVE_TOLERANCE = 0.01
EXTRA_SENSITIVE_TERMS = ("ethni", "origine ethnique", "situation familiale", "revenus du foyer",
                         "tranche de revenu", "enfant", "propriétaire ou locataire")
SMS_MAX_CHARS = 300

_SPACES = "   "


def sensitive_terms() -> list[str]:
    """Lower-case terms no text may mention."""
    named = {fv.LABELS[v].lower() for v in fv.SENSITIVE_VARIABLES if v in fv.LABELS}
    return sorted(named | set(EXTRA_SENSITIVE_TERMS))


def numbers_in(text: Column) -> Column:
    """Array of ``(text, value, decimals)`` of the numbers written in a text."""
    found = F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))

    def parse(t: Column) -> Column:
        plain = F.translate(F.translate(t, _SPACES, ""), ",", ".")
        decimals = F.when(F.instr(plain, ".") > 0,
                          F.length(F.substring_index(plain, ".", -1))).otherwise(F.lit(0))
        return F.struct(t.alias("texte"), plain.cast("double").alias("valeur"),
                        decimals.cast("int").alias("decimales"))

    return F.transform(found, parse)


def extract_numbers(df: DataFrame, id_cols: Sequence[str], text: str = "text") -> DataFrame:
    """One row per number: ``ids..., pos, texte, valeur, decimales``."""
    return df.select(*id_cols, F.posexplode(numbers_in(F.col(text))).alias("pos", "n")).select(
        *id_cols, "pos", "n.*")


def allowed_values(df: DataFrame, id_cols: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Values a text may cite: absolute value of each column, and the percentage of a proportion."""
    long = df.unpivot([F.col(c) for c in id_cols],
                      [F.abs(F.col(c).cast("double")).alias(c) for c in columns], "source", "v")
    known = long.filter(F.col("v").isNotNull())
    both = F.when(F.col("v") <= 1, F.array(F.col("v"), 100 * F.col("v"))).otherwise(
        F.array(F.col("v")))
    return known.select(*id_cols, F.explode(both).alias("autorise")).distinct()


def unsupported_numbers(numbers: DataFrame, allowed: DataFrame, id_cols: Sequence[str]
                        ) -> DataFrame:
    """Numbers matching no allowed value of their text: half a unit of the last digit, or 1 %.

    Allowed values are put in the octave (power of two) they belong to; a number can only match a
    value of its own or a neighbouring octave, so the join is an equality on (id, octave) and a text
    with very many values is spread over many keys.  Values and tolerances under one share octave 0.
    """
    value, digits = F.col("valeur"), F.col("decimales")
    half = F.lit(0.5) * F.pow(F.lit(10.0), -digits) + 1e-9

    def octave(x: Column) -> Column:
        return F.when(x < 1, F.lit(0)).otherwise(F.floor(F.log2(x)) + 1).cast("int")

    keyed = numbers.filter(~value.isin(*ALWAYS_ALLOWED)).withColumn("_key", F.monotonically_increasing_id())
    # Reach of the number: the widest interval of values it could stand for.
    low = F.greatest(F.least(value - half, value / (1 + RELATIVE_TOLERANCE)), F.lit(0.0))
    high = F.greatest(value + half, value / (1 - RELATIVE_TOLERANCE))
    probes = keyed.withColumn("_octave", F.explode(F.sequence(octave(low), octave(high))))
    values = allowed.withColumn("_octave", octave(F.col("autorise")))
    gap = F.abs(value - F.col("autorise"))
    close = gap <= F.greatest(half, RELATIVE_TOLERANCE * F.col("autorise"))
    matched = (probes.join(values, [*id_cols, "_octave"]).filter(close)
               .select(*id_cols, "pos").distinct())
    return (keyed.drop("_key").join(matched, [*id_cols, "pos"], "left_anti"))


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Lower-case Latin letters that decompose to a plain letter and marks, and the plain letters."""
    found = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xE0, 0x250),
                                                                     *range(0x1E00, 0x1F00)])]
    found = [(c, d[0]) for c, d in found if c.islower() and len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


def normalised(text: Column) -> Column:
    """Lower case without accents, composed or as separate combining marks."""
    accents, plain = _accents()
    return F.regexp_replace(F.translate(F.lower(text), accents, plain), r"\p{M}", "")


def sensitive_hits(df: DataFrame, id_cols: Sequence[str], text: str = "text",
                   terms: Sequence[str] | None = None) -> DataFrame:
    """Terms mentioned by each text: ``ids..., terme``.  The term list is a literal array."""
    words = F.array(*[F.lit(t) for t in (sensitive_terms() if terms is None else terms)])
    found = F.filter(words, lambda t: F.contains(F.col("_norm"), normalised(t)))
    return (df.select(*id_cols, normalised(F.col(text)).alias("_norm"))
            .select(*id_cols, F.explode(found).alias("terme")))


def shorten_sms(sms: Column, limit: int = SMS_MAX_CHARS) -> Column:
    """Cut at the last sentence end inside the limit, else at the limit with an ellipsis."""
    head = F.substring(sms, 1, limit)
    tail = F.reverse(head)
    ends = [F.when(F.instr(tail, mark) > 0, F.lit(limit) - F.instr(tail, mark) + 1).otherwise(0)
            for mark in (".", "!", "?")]
    end = F.greatest(*ends)
    cut = F.when(end > 81, F.left(head, end)).otherwise(
        F.concat(F.rtrim(F.substring(sms, 1, limit - 1)), F.lit("…")))
    return F.when(F.length(sms) <= limit, sms).otherwise(cut)


def retention_messages(scores: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Message of each customer by inactivity, then dominant family, then the default template."""
    def pick(i: int) -> Column:
        pairs = [F.lit(x) for family, t in fv.RETENTION_TEMPLATES.items() for x in (family, t[i])]
        by_family = F.try_element_at(F.create_map(*pairs), F.col("famille_dominante"))
        return F.when(F.col("inactif"), fv.INACTIVE_TEMPLATE[i]).otherwise(
            F.coalesce(by_family, F.lit(fv.DEFAULT_TEMPLATE[i])))

    out = scores.select(id_col, F.col("famille_dominante").alias("dominant_family"), "action",
                        shorten_sms(pick(0)).alias("sms"), pick(1).alias("email_subject"),
                        pick(2).alias("email_body"))
    whole = F.concat_ws("\n", "sms", "email_subject", "email_body")
    return out.withColumns({
        "sms_length": F.length("sms"),
        "chiffres_ou_montant": (F.size(numbers_in(whole)) > 0) | whole.rlike("[%€$]")})


def evaluation_summary(answers: DataFrame, called: str = "appels", expected: str = "attendus",
                       faithful: str = "fidele", evaluated: str = "evalue") -> DataFrame:
    """Routing accuracy (a non-empty subset of the expected tools, or none when none is expected)
    and fidelity over the evaluated rows."""
    inside = F.size(F.array_except(called, expected)) == 0
    ok = F.when(F.size(expected) == 0, F.size(called) == 0).otherwise(
        inside & (F.size(called) > 0))
    return answers.filter(F.col(evaluated)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("routage"),
        F.avg(F.col(faithful).cast("double")).alias("fidelite"))


def public_view(scores: DataFrame, factors: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Rounded customer view without sensitive variables: context lines naming one are dropped."""
    hidden = sorted(fv.SENSITIVE_VARIABLES)
    shown = (factors.filter(~F.col("variable").isin(*hidden))
             .filter((F.col("rang_raison") <= 3) | (F.col("rang_contexte") <= 2)))
    lines = shown.groupBy(id_col).agg(
        F.count_if(F.col("rang_raison") <= 3).alias("n_raisons"),
        F.count_if(F.col("rang_contexte") <= 2).alias("n_contexte"))
    return scores.join(lines, id_col, "left").select(
        id_col, F.col("niveau"), F.col("inactif"),
        F.bround(100 * F.col("proba_reelle"), 2).alias("risque_mensuel_pct"), "segment",
        F.col("action").alias("action_suggeree"),
        F.bround("rev_Mean", 2).alias("facture_mensuelle_dollars"),
        F.bround("revenu_en_jeu", 2).alias("revenu_mensuel_en_jeu_dollars"),
        F.coalesce("n_raisons", F.lit(0)).alias("n_raisons"),
        F.coalesce("n_contexte", F.lit(0)).alias("n_contexte"))


def public_lines(factors: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """The reasons and context lines of a public customer view, one row per line: ``nature`` (raison
    or contexte), ``position``, ``facteur``, ``sens``.  Lines naming a sensitive variable are left out,
    and the rest move up."""
    kinds = F.array(*[F.when(F.col(rank) <= most, F.struct(
        F.lit(kind).alias("nature"), F.col(rank).alias("_rang")))
        for kind, rank, most in (("raison", "rang_raison", 3), ("contexte", "rang_contexte", 2))])
    shown = (factors.filter(~F.col("variable").isin(*sorted(fv.SENSITIVE_VARIABLES)))
             .withColumn("_kinds", F.filter(kinds, lambda k: k.isNotNull()))
             .select(id_col, "variable", "contribution", F.inline("_kinds")))
    place = F.row_number().over(Window.partitionBy(id_col, "nature").orderBy("_rang"))
    return shown.select(id_col, "nature", place.alias("position"), "variable",
                        F.bround("contribution", 3).alias("contribution"),
                        F.when(F.col("contribution") > 0, "hausse").otherwise("baisse").alias("sens"))


def public_segments(segments: DataFrame) -> DataFrame:
    """Rounded segment view: size, expected and observed rates in percent, money."""
    return segments.select(
        "segment", "n_rows", F.bround(100 * F.col("share_of_portfolio"), 1).alias("part_pct"),
        F.bround(100 * F.col("expected_churn_rate"), 2).alias("risque_mensuel_pct"),
        F.bround(100 * F.col("share_high"), 1).alias("part_high_pct"),
        F.bround("revenue_at_risk", 0).alias("revenu_en_jeu_dollars"))


def allowed_in_texts(df: DataFrame, id_cols: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Numbers that texts themselves bring: those of the question and of text results, ``ids...,
    autorise``; a number of 1 or less may be cited in percent too."""
    long = df.unpivot([F.col(c) for c in id_cols], [F.col(c) for c in texts], "source", "text")
    found = extract_numbers(long.filter(F.col("text").isNotNull()), id_cols)
    value = F.col("valeur")
    both = F.when(value <= 1, F.array(value, 100 * value)).otherwise(F.array(value))
    return found.select(*id_cols, F.explode(both).alias("autorise")).distinct()


def public_drivers(driver_table: DataFrame, top: int = 8) -> DataFrame:
    """The driver lists without sensitive variables, re-ranked and rounded."""
    order = Window.partitionBy("actionable").orderBy("rang")
    rows = driver_table.filter(~F.col("variable").isin(*sorted(fv.SENSITIVE_VARIABLES)))
    return (rows.withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= top)
            .select("actionable", "position", F.col("label").alias("facteur"),
                    F.col("family_label").alias("famille"),
                    F.bround("share_pct", 1).alias("part_importance_pct"),
                    F.bround(100 * F.col("share_rows_increasing"), 0)
                    .alias("part_clients_en_hausse_pct")))
