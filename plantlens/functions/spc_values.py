"""Fixed values of the control charts."""

# Run rule -> kind of special cause.
RULE_CATEGORY = {
    1: "hors_controle",
    2: "shift",
    3: "trend",
    4: "instabilite",
    5: "shift_partiel",
    6: "shift_partiel",
    7: "stratification",
    8: "instabilite",
}

# Kind of special cause -> display label.
PATTERN_LABELS = {
    "none": "Aucun",
    "hors_controle": "Hors controle (point extreme)",
    "shift": "Decalage de moyenne",
    "shift_partiel": "Decalage partiel",
    "trend": "Tendance (derive)",
    "instabilite": "Instabilite",
    "stratification": "Stratification (sigma sous-estime)",
}

SIGMA_FLOOR = 1e-12  # below: the series is constant
MIN_POINTS_RULES = 9
MIN_POINTS_DRIFT = 10
EWMA_LAMBDA = 0.2
EWMA_WIDTH = 3.0
CUSUM_SLACK = 0.5
CUSUM_DECISION = 4.0
