"""Words, labels, lookup tables and formats that results must carry unchanged."""

from __future__ import annotations

# --- Fixed values: risk tiers and actions --------------------------------------------------
HIGH, MEDIUM, LOW, INACTIVE = "High", "Medium", "Low", "Inactif"
TIERS = [HIGH, MEDIUM, LOW, INACTIVE]
TRAIN_OOF, TEST = "train_oof", "test"
INACTIVE_ROW = "Inactifs (vérification / reconquête)"
WHOLE_ROW = "Portefeuille entier"
PORTFOLIO_WEIGHT = "poids_portefeuille"
UNKNOWN_AREA = "inconnue"
UNSEGMENTED = "Non segmenté"
OTHERS = "Autres"
RARE = "Rare"
MISSING = "Manquant"
UNKNOWN_LEVEL = "Unknown"
INCREASES, DECREASES = "augmente le risque", "réduit le risque"
ATYPICAL_NOTE = " (valeur atypique, à vérifier)"

# --- Fixed values: business parameters -----------------------------------------------------
REAL_RATE = 0.02
SENSITIVITY_RATES = (0.01, 0.02, 0.03)
CAPACITY = 0.10
CAPACITIES = (0.05, 0.10, 0.20)
MEDIUM_MIN_LIFT = 1.2
LIFT_BAND = 0.05
PORTFOLIO_SIZE = 100000
MIN_ROWS_FOR_RATE = 30
HISTOGRAM_STEP_PCT = 0.5
HISTOGRAM_MAX_PCT = 15.0
MAX_PAGE_SIZE = 200
CONTRACT_MONTHS = (11, 12)
HANDSET_OLD_DAYS = 300
DAYS_PER_TENURE_MONTH = 30
PHRASE_DAYS_PER_MONTH = 30.4
OUTLIER_HIGH, OUTLIER_LOW = 0.999, 0.001

# --- Fixed values: display bands -----------------------------------------------------------
HANDSET_AGE_BANDS = ["moins de 6 mois", "6-9 mois", "10-12 mois", "1-2 ans", "plus de 2 ans",
                     "inconnu"]
USAGE_BANDS = ["aucun usage (0 min ou non mesuré)", "1-100 min", "101-300 min", "301-600 min",
               "plus de 600 min"]
HANDSET_CUTS = (182, 299, 365, 730)
USAGE_CUTS = (100, 300, 600)

# --- Fixed values: rule segments -----------------------------------------------------------
TENURE_EDGES = [0, 11, 13, float("inf")]
TENURE_LABELS = ["6-10 mois", "11-12 mois", ">= 13 mois"]
USAGE_EDGES = [0, 150, 700, float("inf")]
USAGE_LABELS = ["Usage faible (< 150 min)", "Usage moyen (150-699 min)", "Usage fort (>= 700 min)"]
DEVICE_EDGES = [0, 300, 730, float("inf")]
DEVICE_LABELS = ["Terminal < 300 j", "Terminal 300-729 j", "Terminal >= 730 j"]

# --- Fixed values: dimensions --------------------------------------------------------------
DIMENSIONS: dict[str, str] = {
    "risk_level": "niveau",
    "cluster": "segment",
    "area": "area",
    "tenure_band": "tenure_band",
    "handset_age_band": "handset_age_band",
    "usage_band": "usage_band",
    "action": "action",
}

# --- Fixed values: families, actions, sensitive variables -----------------------------------
TERMINAL, ENGAGEMENT, USAGE, PLAN = "terminal", "engagement", "usage", "forfait"
NETWORK, CARE, LINES, CONTEXT = "reseau", "service_client", "lignes", "contexte"

FAMILIES: dict[str, list[str]] = {
    TERMINAL: ["eqpdays", "hnd_price", "hnd_webcap", "refurb_new", "dualband", "phones",
               "models"],
    ENGAGEMENT: ["months"],
    USAGE: ["mou_Mean", "change_mou", "avg3mou", "avg6mou", "avgmou", "avgqty", "avg3qty",
            "avg6qty", "adjmou", "adjqty", "totmou", "totcalls", "attempt_Mean",
            "complete_Mean", "comp_vce_Mean", "comp_dat_Mean", "plcd_vce_Mean",
            "plcd_dat_Mean", "mou_cvce_Mean", "mou_cdat_Mean", "mou_rvce_Mean",
            "mou_opkv_Mean", "mou_opkd_Mean", "mou_peav_Mean", "mou_pead_Mean",
            "peak_vce_Mean", "peak_dat_Mean", "opk_vce_Mean", "opk_dat_Mean", "recv_vce_Mean",
            "recv_sms_Mean", "inonemin_Mean", "owylis_vce_Mean", "mouowylisv_Mean",
            "iwylis_vce_Mean", "mouiwylisv_Mean", "unan_vce_Mean", "unan_dat_Mean",
            "threeway_Mean", "callwait_Mean", "callfwdv_Mean", "da_Mean", "roam_Mean"],
    PLAN: ["totmrc_Mean", "rev_Mean", "ovrrev_Mean", "ovrmou_Mean", "vceovr_Mean",
           "datovr_Mean", "avgrev", "avg3rev", "avg6rev", "adjrev", "totrev", "change_rev",
           "asl_flag"],
    NETWORK: ["drop_vce_Mean", "drop_dat_Mean", "blck_vce_Mean", "blck_dat_Mean",
              "drop_blk_Mean"],
    CARE: ["custcare_Mean", "cc_mou_Mean", "ccrndmou_Mean"],
    LINES: ["actvsubs", "uniqsubs"],
}
SENSITIVE_VARIABLES: frozenset[str] = frozenset({
    "ethnic", "income", "marital", "adults", "kid0_2", "kid3_5", "kid6_10", "kid11_15",
    "kid16_17", "HHstatin", "dwllsize", "dwlltype", "ownrent", "numbcars", "creditcd", "truck",
    "rv", "forgntvl", "prizm_social_one", "infobase",
})
FAMILY_LABELS: dict[str, str] = {
    TERMINAL: "Terminal", ENGAGEMENT: "Fin d'engagement", USAGE: "Usage", PLAN: "Forfait",
    NETWORK: "Qualité réseau", CARE: "Service client", LINES: "Lignes", CONTEXT: "Contexte",
}
ACTIONS: dict[str, str] = {
    TERMINAL: "Offre de renouvellement du terminal",
    ENGAGEMENT: "Offre de réengagement",
    USAGE: "Offre adaptée à l'usage",
    PLAN: "Changement de forfait",
    NETWORK: "Geste commercial + ticket technique",
    CARE: "Contact de fidélisation (suivi service client)",
    LINES: "Contact de fidélisation (offre multi-lignes)",
}
DEFAULT_ACTION = "Contact de fidélisation"
INACTIVE_ACTION = "Vérifier la ligne / reconquête"
NO_ACTION = "Pas d'action de campagne (suivi)"

# --- Fixed values: missing patterns and feature names ----------------------------------------
NEGATIVE_COLUMNS = ("rev_Mean", "totmrc_Mean", "avg6rev", "eqpdays")
NEGATIVE_SUFFIX = "_was_negative"
MISSING_PATTERNS: dict[str, str] = {
    "manquant_numbcars": "numbcars",
    "manquant_dwllsize": "dwllsize",
    "manquant_HHstatin": "HHstatin",
    "manquant_ownrent": "ownrent",
    "manquant_dwlltype": "dwlltype",
    "manquant_lor": "lor",
    "manquant_income": "income",
    "manquant_adults": "adults",
    "manquant_infobase": "infobase",
    "manquant_hnd_webcap": "hnd_webcap",
    "manquant_prizm_social_one": "prizm_social_one",
    "manquant_avg6mou_bloc": "avg6mou",
    "manquant_truck_bloc": "truck",
    "manquant_hnd_price": "hnd_price",
    "manquant_area": "area",
}
ALREADY_GONE_PATTERNS: dict[str, str] = {
    "sans_usage": "rev_Mean",
    "change_manquant": "change_mou",
}
NEGATIVE_FLAGS = [f"{c}{NEGATIVE_SUFFIX}" for c in NEGATIVE_COLUMNS]
DERIVED_TO_SOURCE: dict[str, str] = {
    "in_contract_end": "months",
    "handset_old": "eqpdays",
    "eqpdays_per_tenure_day": "eqpdays",
    "ratio_mou_3m_6m": "avg3mou",
    "ratio_rev_3m_6m": "avg3rev",
    "drop_blk_rate": "drop_blk_Mean",
    "complete_rate": "complete_Mean",
    "has_custcare": "custcare_Mean",
    "custcare_per_mou": "custcare_Mean",
    "overage_share_rev": "ovrrev_Mean",
    "recurring_share_rev": "totmrc_Mean",
    "active_lines_share": "actvsubs",
    "phones_per_month": "phones",
    **MISSING_PATTERNS,
    **ALREADY_GONE_PATTERNS,
}

# --- Fixed values: labels of variables -------------------------------------------------------
LABELS: dict[str, str] = {
    "months": "Ancienneté",
    "eqpdays": "Âge du terminal",
    "change_mou": "Évolution de l'usage",
    "change_rev": "Évolution de la facture",
    "mou_Mean": "Minutes d'appel par mois",
    "avg3mou": "Usage récent (3 mois / 6 mois)",
    "avg3rev": "Facture récente (3 mois / 6 mois)",
    "avgqty": "Appels par mois depuis l'ouverture",
    "avgmou": "Minutes par mois depuis l'ouverture",
    "avgrev": "Facture moyenne depuis l'ouverture",
    "rev_Mean": "Facture mensuelle",
    "totmrc_Mean": "Forfait mensuel",
    "ovrrev_Mean": "Dépassements de forfait",
    "hnd_price": "Prix du terminal",
    "hnd_webcap": "Capacité web du terminal",
    "crclscod": "Classe de crédit",
    "area": "Région",
    "lor": "Durée de résidence",
    "drop_vce_Mean": "Appels coupés",
    "drop_blk_Mean": "Appels coupés ou bloqués",
    "blck_vce_Mean": "Appels bloqués",
    "unan_vce_Mean": "Appels sans réponse",
    "custcare_Mean": "Appels au service client",
    "phones": "Nombre de terminaux",
    "models": "Nombre de modèles de terminal",
    "actvsubs": "Lignes actives",
    "uniqsubs": "Lignes ouvertes",
    "asl_flag": "Limite de dépense",
    "dualband": "Terminal bi-bande",
    "refurb_new": "Terminal reconditionné",
    "prizm_social_one": "Type de zone d'habitation",
    "income": "Tranche de revenu",
    "totrev": "Revenu total",
    "roam_Mean": "Itinérance",
    "mou_cvce_Mean": "Minutes d'appels aboutis",
    "mouowylisv_Mean": "Minutes d'appels sortants sans réponse",
    "mouiwylisv_Mean": "Minutes d'appels entrants manqués",
    "recv_vce_Mean": "Appels reçus",
    "da_Mean": "Appels à l'assistance annuaire",
    "callwait_Mean": "Double appel",
    "avg6rev": "Facture moyenne sur 6 mois",
    "avg6mou": "Minutes moyennes sur 6 mois",
    "avg6qty": "Appels moyens sur 6 mois",
    "avg3qty": "Appels moyens sur 3 mois",
    "adults": "Adultes dans le foyer",
    "numbcars": "Véhicules du foyer",
    "marital": "Situation familiale",
    "creditcd": "Carte de crédit",
    "new_cell": "Nouvel utilisateur de mobile",
    "ovrmou_Mean": "Minutes hors forfait",
    "vceovr_Mean": "Dépassements voix",
    "datovr_Mean": "Dépassements data",
    "totmou": "Minutes depuis l'ouverture",
    "totcalls": "Appels depuis l'ouverture",
    "adjmou": "Minutes ajustées depuis l'ouverture",
    "adjqty": "Appels ajustés depuis l'ouverture",
    "adjrev": "Revenu ajusté depuis l'ouverture",
    "attempt_Mean": "Tentatives d'appel",
    "complete_Mean": "Appels aboutis",
    "comp_vce_Mean": "Appels voix aboutis",
    "plcd_vce_Mean": "Appels voix passés",
    "peak_vce_Mean": "Appels voix en heures pleines",
    "opk_vce_Mean": "Appels voix en heures creuses",
    "mou_peav_Mean": "Minutes voix en heures pleines",
    "mou_opkv_Mean": "Minutes voix en heures creuses",
    "mou_rvce_Mean": "Minutes d'appels reçus",
    "inonemin_Mean": "Appels entrants de moins d'une minute",
    "owylis_vce_Mean": "Appels sortants vers messagerie",
    "iwylis_vce_Mean": "Appels entrants vers messagerie",
    "threeway_Mean": "Conférences à trois",
    "callfwdv_Mean": "Renvois d'appel",
    "cc_mou_Mean": "Minutes au service client",
    "ccrndmou_Mean": "Minutes arrondies au service client",
    "drop_dat_Mean": "Sessions data coupées",
    "blck_dat_Mean": "Sessions data bloquées",
    "recv_sms_Mean": "SMS reçus",
    "HHstatin": "Statut du foyer",
    "dwllsize": "Taille du logement",
    "dwlltype": "Type de logement",
    "ownrent": "Propriétaire ou locataire",
    "infobase": "Source des données client",
    "forgntvl": "Voyages à l'étranger",
    "truck": "Possède un utilitaire",
    "rv": "Possède un camping-car",
    "kid0_2": "Enfant de 0 à 2 ans",
    "kid3_5": "Enfant de 3 à 5 ans",
    "kid6_10": "Enfant de 6 à 10 ans",
    "kid11_15": "Enfant de 11 à 15 ans",
    "kid16_17": "Enfant de 16 à 17 ans",
}

# --- Fixed values: variable blocks ------------------------------------------------------------
VARIABLE_BLOCKS: dict[str, list[str]] = {
    "Revenu / facture": [
        "rev_Mean", "totmrc_Mean", "ovrrev_Mean", "vceovr_Mean", "datovr_Mean", "totrev",
        "adjrev", "avgrev", "avg3rev", "avg6rev",
    ],
    "Usage": [
        "mou_Mean", "ovrmou_Mean", "plcd_vce_Mean", "plcd_dat_Mean", "recv_vce_Mean",
        "recv_sms_Mean", "comp_vce_Mean", "comp_dat_Mean", "mou_cvce_Mean", "mou_cdat_Mean",
        "mou_rvce_Mean", "peak_vce_Mean", "peak_dat_Mean", "mou_peav_Mean", "mou_pead_Mean",
        "opk_vce_Mean", "opk_dat_Mean", "mou_opkv_Mean", "mou_opkd_Mean", "attempt_Mean",
        "complete_Mean", "totcalls", "totmou", "adjmou", "adjqty", "avgmou", "avgqty",
        "avg3mou", "avg3qty", "avg6mou", "avg6qty", "roam_Mean", "da_Mean", "threeway_Mean",
        "callfwdv_Mean", "callwait_Mean", "inonemin_Mean", "owylis_vce_Mean",
        "iwylis_vce_Mean", "mouowylisv_Mean", "mouiwylisv_Mean",
    ],
    "Tendance": ["change_mou", "change_rev"],
    "Qualité réseau": [
        "drop_vce_Mean", "drop_dat_Mean", "blck_vce_Mean", "blck_dat_Mean", "unan_vce_Mean",
        "unan_dat_Mean", "drop_blk_Mean",
    ],
    "Service client": ["custcare_Mean", "ccrndmou_Mean", "cc_mou_Mean"],
    "Terminal": ["eqpdays", "hnd_price", "phones", "models"],
    "Compte": ["months", "uniqsubs", "actvsubs"],
    "Socio-démographie": ["income", "adults", "lor", "numbcars", "truck", "rv", "forgntvl"],
}

# --- Fixed values: linear-model column groups --------------------------------------------------
LOG_COLUMNS: tuple[str, ...] = (
    "actvsubs", "avgqty", "avgrev", "blck_dat_Mean", "blck_vce_Mean", "callfwdv_Mean",
    "callwait_Mean", "custcare_Mean", "da_Mean", "datovr_Mean", "drop_dat_Mean",
    "drop_vce_Mean", "mou_Mean", "mou_cvce_Mean", "mouiwylisv_Mean", "mouowylisv_Mean",
    "opk_dat_Mean", "ovrrev_Mean", "peak_dat_Mean", "phones", "phones_per_month",
    "recurring_share_rev", "recv_sms_Mean", "recv_vce_Mean", "rev_Mean", "roam_Mean",
    "threeway_Mean", "unan_dat_Mean", "unan_vce_Mean", "uniqsubs",
)
SIGNED_LOG_COLUMNS: tuple[str, ...] = ("change_mou", "change_rev")
SPLINE_COLUMNS: tuple[str, ...] = ("months", "eqpdays")
USAGE_BLOCK = ("rev_Mean", "mou_Mean", "totmrc_Mean", "da_Mean", "ovrmou_Mean", "ovrrev_Mean",
               "vceovr_Mean", "datovr_Mean", "roam_Mean")
LEAK_COLUMNS = (*USAGE_BLOCK, "change_mou", "change_rev")

# --- Fixed values: behavioural segmentation ----------------------------------------------------
CLUSTER_LOG = ["mou_Mean", "rev_Mean", "totmrc_Mean", "ovrrev_Mean", "custcare_Mean",
               "drop_blk_Mean", "uniqsubs"]
CLUSTER_SIGNED = ["change_mou"]
CLUSTER_RAW = ["months", "eqpdays", "hnd_price"]
N_CLUSTERS = 5
NAME_SECONDARY_LINES = "Lignes secondaires à petit forfait"
NAME_HEAVY_DECLINING = "Gros consommateurs en baisse d'usage"
NAME_HEAVY_GROWING = "Gros consommateurs en hausse d'usage"
NAME_MODERATE_RECENT = "Usage modéré, clients récents"
NAME_TENURED_OLD_DEVICE = "Clients anciens à terminal ancien et bon marché"
PROFILE_TRAITS: list[tuple[str, str, str]] = [
    ("months", "Ancienneté", "mois"),
    ("eqpdays", "Âge du terminal", "jours"),
    ("mou_Mean", "Minutes d'appel", "min / mois"),
    ("change_mou", "Évolution de l'usage", "min / mois"),
    ("totmrc_Mean", "Forfait", "$ / mois"),
    ("rev_Mean", "Facture", "$ / mois"),
    ("hnd_price", "Prix du terminal", "$"),
    ("ovrrev_Mean", "Dépassements", "$ / mois"),
]
PROFILE_FIELDS: list[tuple[str, str, str]] = [
    ("months", "Ancienneté", "mois"),
    ("eqpdays", "Âge du terminal", "jours"),
    ("hnd_price", "Prix du terminal", "$"),
    ("mou_Mean", "Minutes d'appel par mois", "minutes / mois"),
    ("change_mou", "Évolution de l'usage", "minutes / mois"),
    ("totmrc_Mean", "Forfait mensuel", "$ / mois"),
    ("rev_Mean", "Facture mensuelle", "$ / mois"),
    ("ovrrev_Mean", "Dépassements de forfait", "$ / mois"),
    ("custcare_Mean", "Appels au service client", "appels / mois"),
    ("drop_vce_Mean", "Appels coupés", "appels / mois"),
    ("actvsubs", "Lignes actives", "lignes"),
    ("crclscod", "Classe de crédit", ""),
    ("area", "Région", ""),
]
EXPORT_COLUMNS: list[tuple[str, str]] = [
    ("Customer_ID", "identifiant"),
    ("niveau", "niveau"),
    ("proba_reelle", "risque_mensuel_pct_taux_suppose_2pct"),
    ("proba_calibree", "probabilite_calibree_echantillon"),
    ("raison_1", "raison_principale"),
    ("raison_2", "raison_2"),
    ("raison_3", "raison_3"),
    ("action", "action_suggeree"),
    ("rev_Mean", "facture_mensuelle_dollars"),
    ("revenu_en_jeu", "revenu_mensuel_en_jeu_dollars"),
    ("segment", "segment"),
    ("area", "region"),
    ("months", "anciennete_mois"),
    ("partition", "partition"),
]

# --- Fixed values: retention messages ----------------------------------------------------------
RETENTION_TEMPLATES: dict[str, tuple[str, str, str]] = {
    "terminal": ("Bonjour, votre téléphone commence à dater ? Nous avons préparé pour vous une "
                 "offre personnalisée de renouvellement. Passez en boutique ou répondez à ce SMS "
                 "pour être rappelé par un conseiller.",
                 "Une offre de renouvellement pensée pour vous",
                 "Bonjour,\n\nVotre téléphone vous accompagne depuis un moment. Nous avons "
                 "préparé une offre personnalisée pour le renouveler dans les meilleures "
                 "conditions. Un conseiller peut vous la présenter en boutique ou par téléphone, "
                 "au moment qui vous convient.\n\nÀ bientôt,\nVotre service client"),
    "engagement": ("Bonjour, votre engagement arrive à échéance. Nous serions ravis de continuer "
                   "ensemble : une offre personnalisée vous attend. Répondez à ce SMS pour être "
                   "rappelé par un conseiller.",
                   "Continuons ensemble : une offre pour vous",
                   "Bonjour,\n\nVotre engagement arrive bientôt à son terme et nous tenons à "
                   "vous remercier de votre fidélité. Nous avons préparé une offre "
                   "personnalisée pour la suite. Un conseiller peut vous la présenter quand "
                   "vous le souhaitez.\n\nÀ bientôt,\nVotre service client"),
    "usage": ("Bonjour, vos besoins ont peut-être changé. Un conseiller peut vous proposer une "
              "offre mieux adaptée à votre utilisation. Répondez à ce SMS pour être rappelé.",
              "Une offre adaptée à votre utilisation",
              "Bonjour,\n\nVotre façon d'utiliser votre ligne a évolué ces derniers mois. Nous "
              "pouvons vous proposer une offre personnalisée, mieux adaptée à vos besoins "
              "actuels. Un conseiller se tient à votre disposition pour en parler.\n\nÀ "
              "bientôt,\nVotre service client"),
    "forfait": ("Bonjour, votre forfait est-il toujours adapté ? Un conseiller peut faire le "
                "point avec vous et vous proposer une offre personnalisée. Répondez à ce SMS "
                "pour être rappelé.",
                "Faisons le point sur votre forfait",
                "Bonjour,\n\nNous vous proposons de faire le point sur votre forfait afin qu'il "
                "corresponde au mieux à votre utilisation. Un conseiller peut vous présenter une "
                "offre personnalisée, sans engagement de votre part.\n\nÀ bientôt,\nVotre "
                "service client"),
    "reseau": ("Bonjour, nous avons constaté que votre qualité de service n'a pas toujours été à "
               "la hauteur. Un conseiller va vous contacter pour trouver une solution et vous "
               "proposer un geste commercial.",
               "Votre qualité de service nous importe",
               "Bonjour,\n\nNous avons constaté que votre qualité de service n'a pas toujours "
               "été à la hauteur de vos attentes. Nos équipes techniques sont informées et un "
               "conseiller va vous contacter pour vous proposer un geste commercial.\n\nÀ "
               "bientôt,\nVotre service client"),
}
DEFAULT_TEMPLATE = ("Bonjour, merci pour votre fidélité. Un conseiller peut vous présenter une "
                    "offre personnalisée adaptée à vos besoins. Répondez à ce SMS pour être "
                    "rappelé.", "Une attention pour vous",
                    "Bonjour,\n\nMerci pour votre fidélité. Nous avons préparé une offre "
                    "personnalisée et un conseiller peut vous la présenter au moment qui vous "
                    "convient.\n\nÀ bientôt,\nVotre service client")
INACTIVE_TEMPLATE = ("Bonjour, nous n'avons pas constaté d'utilisation récente de votre ligne. "
                     "Tout fonctionne-t-il bien ? Répondez à ce SMS ou contactez-nous pour "
                     "vérifier votre ligne.", "Votre ligne fonctionne-t-elle bien ?",
                     "Bonjour,\n\nNous n'avons pas constaté d'utilisation récente de votre "
                     "ligne. Nous souhaitons vérifier avec vous que tout fonctionne "
                     "correctement. Un conseiller se tient à votre disposition.\n\nÀ bientôt,\n"
                     "Votre service client")


