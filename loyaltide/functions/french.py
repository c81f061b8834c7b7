"""French text helpers: number format and the sentence describing a customer's situation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loyaltide import fixed_values as fv

# Fixed value: thousands separator of the sentences.
THOUSANDS = " "


def number(x: Column, digits: int = 0) -> Column:
    """``1234.5`` -> ``1 234,5``."""
    text = F.format_number(x.cast("double"), digits)
    return F.translate(F.translate(text, ",", THOUSANDS), ".", ",")


def _amount(column: str, text: str) -> Column:
    c = F.col(column)
    return F.when(c.isNull(), F.lit(f"{text} inconnu")).otherwise(
        F.concat(F.lit(f"{text} : "), number(c), F.lit(" $ par mois")))


def _frequency(column: str, text: str, digits: int) -> Column:
    c = F.col(column)
    return F.when(c.isNull(), F.lit(f"{text} : non renseigné")).otherwise(
        F.concat(F.lit(f"{text} : "), number(c, digits), F.lit(" par mois")))


def _move(column: str, unknown: str, subject: str, unit: str, scale: Column | None = None
          ) -> Column:
    c = F.col(column) if scale is None else scale
    return F.when(c.isNull(), F.lit(unknown)).otherwise(F.concat(
        F.lit(f"{subject} en "), F.when(c < 0, "baisse").otherwise("hausse"), F.lit(" de "),
        number(F.abs(c)), F.lit(unit)))


# Sentences of amounts per month (column -> subject).
AMOUNTS = {
    "totmrc_Mean": "Forfait",
    "rev_Mean": "Facture",
    "ovrrev_Mean": "Dépassements",
    "avgrev": "Facture moyenne depuis l'ouverture",
    "avg6rev": "Facture moyenne sur 6 mois",
}
# Sentences of quantities per month (column -> subject, digits).
FREQUENCIES = {
    "mou_Mean": ("Minutes d'appel", 0),
    "drop_vce_Mean": ("Appels coupés", 1),
    "custcare_Mean": ("Appels au service client", 1),
    "avgqty": ("Appels depuis l'ouverture", 0),
    "avg3qty": ("Appels sur 3 mois", 0),
    "avg6qty": ("Appels sur 6 mois", 0),
    "avgmou": ("Minutes depuis l'ouverture", 0),
    "avg6mou": ("Minutes sur 6 mois", 0),
    "drop_blk_Mean": ("Appels coupés ou bloqués", 1),
    "blck_vce_Mean": ("Appels bloqués", 1),
    "unan_vce_Mean": ("Appels sans réponse", 1),
    "mou_cvce_Mean": ("Minutes d'appels aboutis", 0),
    "iwylis_vce_Mean": ("Appels entrants vers la messagerie", 1),
    "mouiwylisv_Mean": ("Minutes d'appels entrants manqués", 1),
    "inonemin_Mean": ("Appels entrants de moins d'une minute", 1),
    "roam_Mean": ("Appels en itinérance", 1),
    "ovrmou_Mean": ("Minutes hors forfait", 0),
}


def _special_sentences(available: set[str]) -> dict[str, Column]:
    """Sentences with their own shape, for the variables whose columns exist."""
    n = F.col
    out: dict[str, Column] = {}
    if "months" in available:
        prefix = F.lit("Ancienneté : ")
        tail = F.lit(" mois")
        plain = F.concat(prefix, n("months").cast("int").cast("string"), tail)
        ended = F.concat(F.lit("Fin d'engagement : "), n("months").cast("int").cast("string"),
                         F.lit(" mois d'ancienneté"))
        out["months"] = (F.when(n("in_contract_end") == 1, ended).otherwise(plain)
                         if "in_contract_end" in available else plain)
    if "eqpdays" in available:
        kind = F.when(n("eqpdays") >= fv.HANDSET_OLD_DAYS, "Terminal ancien : ").otherwise(
            "Terminal récent : ")
        out["eqpdays"] = F.when(n("eqpdays").isNull(), "Âge du terminal inconnu").otherwise(
            F.concat(kind, number(n("eqpdays") / fv.PHRASE_DAYS_PER_MONTH), F.lit(" mois")))
    if "change_mou" in available:
        out["change_mou"] = _move("change_mou", "Évolution de l'usage non mesurée", "Usage",
                                  " minutes par mois")
    if "change_rev" in available:
        out["change_rev"] = _move("change_rev", "Évolution de la facture non mesurée", "Facture",
                                  " $ par mois (3 derniers mois)")
    if "ratio_mou_3m_6m" in available:
        out["avg3mou"] = _move("", "Tendance d'usage récente non mesurée", "Usage",
                               " % (3 derniers mois contre 6 mois)",
                               100 * (n("ratio_mou_3m_6m") - 1))
    if "ratio_rev_3m_6m" in available:
        out["avg3rev"] = _move("", "Tendance de facture récente non mesurée", "Facture",
                               " % (3 derniers mois contre 6 mois)",
                               100 * (n("ratio_rev_3m_6m") - 1))
    if "hnd_price" in available:
        out["hnd_price"] = F.when(n("hnd_price").isNull(), "Prix du terminal inconnu").otherwise(
            F.concat(F.lit("Terminal à "), number(n("hnd_price")), F.lit(" $")))
    if "crclscod" in available:
        out["crclscod"] = F.concat(F.lit("Classe de crédit "), n("crclscod"))
    if "area" in available:
        out["area"] = F.when(n("area").isNull(), "Région inconnue").otherwise(F.concat(
            F.lit("Région : "), F.replace(title_case(F.col("area")), F.lit(" Area"), F.lit(""))))
    if "lor" in available:
        years = n("lor").cast("int")
        out["lor"] = F.when(years.isNull(), "Durée de résidence inconnue").otherwise(F.concat(
            F.lit("Durée de résidence : "), years.cast("string"),
            F.when(years <= 1, " an").otherwise(" ans")))
    if "phones" in available:
        out["phones"] = F.concat(n("phones").cast("int").cast("string"),
                                 F.lit(" terminaux utilisés depuis l'ouverture"))
    if {"actvsubs", "uniqsubs"} <= available:
        out["actvsubs"] = F.concat(n("actvsubs").cast("int").cast("string"),
                                   F.lit(" ligne(s) active(s) sur "),
                                   n("uniqsubs").cast("int").cast("string"))
    if "uniqsubs" in available:
        lines = n("uniqsubs").cast("int")
        out["uniqsubs"] = F.concat(lines.cast("string"), F.when(
            lines <= 1, " ligne ouverte sur le compte").otherwise(
                " lignes ouvertes sur le compte"))
    if "refurb_new" in available:
        out["refurb_new"] = (F.when(n("refurb_new").isNull(), "État du terminal inconnu")
                             .when(n("refurb_new") == "R", "Terminal reconditionné")
                             .otherwise("Terminal acheté neuf"))
    if "hnd_webcap" in available:
        cap = n("hnd_webcap")
        out["hnd_webcap"] = (F.when(cap.isNull() | (cap == fv.UNKNOWN_LEVEL),
                                    "Capacité web du terminal inconnue")
                             .when(cap == "WCMB", "Terminal compatible web mobile")
                             .otherwise("Terminal à accès web limité"))
    return out


def title_case(text: Column) -> Column:
    """Lower case with a capital after every character that is no letter."""
    characters = F.split(F.lower(text), "")
    capital = F.transform(characters, lambda c, i: F.when(
        (i == 0) | ~F.get(characters, i - 1).rlike(r"^\p{L}$"), F.upper(c)).otherwise(c))
    return F.array_join(capital, "")


def label_of(variable: Column) -> Column:
    """Readable label of a variable; its own name when it has none."""
    pairs = [F.lit(x) for item in fv.LABELS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), variable), variable)


def describe(variable: Column, columns: Sequence[str], types: dict[str, str]) -> Column:
    """Sentence for the variable named in each row, from the row's own value columns.

    Args:
        variable: column holding the variable name.
        columns: value columns present on the row; a variable outside them reads "not recorded".
        types: Spark type name per value column (decides the generic number format).
    """
    available = set(columns)
    sentences = {c: _amount(c, t) for c, t in AMOUNTS.items() if c in available}
    sentences |= {c: _frequency(c, t, d) for c, (t, d) in FREQUENCIES.items() if c in available}
    sentences |= _special_sentences(available)
    for c in columns:
        if c in sentences:
            continue
        title = fv.LABELS.get(c, c)
        shown = number(F.col(c), 1) if types.get(c) in ("double", "float") else (
            F.col(c).cast("string"))
        sentences[c] = F.when(F.col(c).isNull(), F.lit(f"{title} : non renseigné")).otherwise(
            F.concat(F.lit(f"{title} : "), shown))
    out = F.concat(label_of(variable), F.lit(" : non renseigné"))
    for name, sentence in sentences.items():
        out = F.when(variable == name, sentence).otherwise(out)
    return out
