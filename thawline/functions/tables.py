"""Fixed values of the field campaign: quality codes, limits, thresholds, rules.

Kept as data, so that one plan serves every network and sensor.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

# Codes that each use of a variable keeps, (stage, network or *, variable).
KEEP_CODES: dict[tuple[str, str, str], tuple[int, ...]] = {
    ("impute", "*", "T1"): (0, 3, 5, 6, 7, 8, 10),
    ("impute", "*", "T3"): (0, 6, 9, 11),
    ("impute", "*", "moist"): (0, 3, 4, 5, 7, 11),
    ("impute_cv_literal", "*", "moist"): (0, 6, 9, 11),
    ("spike_own", "*", "T1"): (0, 3, 5, 6, 7, 8),
    ("spike_own", "*", "T2"): (0, 3, 4, 5, 6, 9),
    ("spike_own", "oulu", "T3"): (0, 6, 9),
    ("spike_own", "roslin", "T3"): (0, 6, 9, 11),
    ("spike_peer", "*", "T1"): (0, 3, 5, 6, 7, 8),
    ("spike_peer", "*", "T2"): (0, 3, 4, 5, 6, 9),
    ("spike_peer", "oulu", "T3"): (0, 3, 6, 9),
    ("spike_peer", "roslin", "T3"): (0, 3, 6, 9, 11),
}

# Codes dropped from final plots; moisture also needs T1 above 1.
PLOT_DROP_CODES: dict[tuple[str, str], tuple[int, ...]] = {
    ("oulu", "T1"): (1, 4, 9), ("oulu", "T2"): (1, 7, 8), ("oulu", "T3"): (1, 4, 5, 7, 8),
    ("roslin", "T1"): (1, 4, 9, 11), ("roslin", "T2"): (1, 7, 8, 11), ("roslin", "T3"): (1, 4, 5, 7, 8),
    ("oulu", "moist"): (1, 6, 8, 9), ("roslin", "moist"): (1, 6, 8, 9),
}

# Possible range per variable (network, site or *, variable, low, high, high excluded).
LIMITS = [
    ("*", "*", "T1", -50.0, 50.0, False),
    ("*", "*", "T2", -50.0, 50.0, False),
    ("*", "*", "T3", -50.0, 50.0, False),
    ("oulu", "*", "moist", 200.0, 4096.0, True),
    ("roslin", "*", "moist", 600.0, 4096.0, True),
    ("roslin", "K25", "moist", 1000.0, 4096.0, True),
]

# Spike rules in the order they act, per sensor. Ratios divide by
# the rolling mean; `before` and `after` are the steps from the previous and next
# reading; `reset` says that the rule clears the flag where it does not hold.
# (rel_diff, rel_change, rel_before bound, rel_after bound, reset)
SPIKE_RATIO_RULES = {
    "T1": [(10, 10, 10, 5, True), (10, 10, -10, -5, False), (20, 20, 10, None, False), (20, 20, None, -10, False)],
    "T2": [(10, 10, 10, 5, True), (10, 10, -10, -5, False), (15, 15, 7, 5, True), (15, 15, -7, -5, False),
           (20, 20, 10, None, False), (20, 20, None, -10, False)],
    "T3": [(10, 10, 10, 5, True), (15, 15, -10, -5, False), (20, 20, 10, None, False), (20, 20, None, -10, False)],
}
SPIKE_STEP_LIMIT = {"T1": 3.0, "T2": 5.0, "T3": 6.0}
SPIKE_QUIET, SPIKE_HUGE = 1.0, 20.0

# Plausible logger dates, both ends excluded; the study period, both included.
PLAUSIBLE = (dt.date(2020, 6, 1), dt.date(2022, 9, 28))
STUDY = (dt.date(2019, 9, 1), dt.date(2023, 8, 31))
# Site prefixes outside the study.
OTHER_AREAS = ("L", "AE", "SE", "SAL", "X")

# Day until which a logger was not yet in the field (code 2).
IN_FIELD_AFTER = {
    "2020-08-25": "Haap.11/15 Haap.11/16 Haap.15/6 Haap.17/8 Haap.17/9 Haap.19/9 Haap.3/20",
    "2020-08-26": "Haap.17/13 Haap.19/10 Haap.19/13 Haap.19/14 Haap.2/16 Haap.4/25 Haap.4/28",
    "2020-08-27": "Haap.16/3 Haap.16/5 Haap.17/12 Haap.19/12 Haap.3/19 Haap.4/21 Haap.5/16 Haap.7/23",
    "2020-08-28": "Haap.3/21 Haap.5/13 Haap.7/21",
    "2020-08-29": "Haap.15/4 Haap.19/8 Haap.3/17 Haap.3/18 Haap.4/20 Haap.5/11",
    "2020-08-31": "Haap.10/41 Haap.10/42 Haap.11/20 Haap.17/6 Haap.2/14 Haap.2/15 Haap.4/17 Haap.5/6",
    "2020-09-01": "Haap.11/17 Haap.15/7 Haap.3/22",
    "2020-09-02": "Haap.11/18 Haap.17/11 Haap.3/23",
    "2020-06-12": "K02 K03 K07 K10 K11 K14 K15 K18 K20 K21 K23 K25 K27 K29 K32 K33 K35",
    "2020-06-13": "K05",
    "2020-06-15": "K12 K24 K28",
    "2020-06-16": "K09 K22 K26 K30",
    "2020-06-17": "K01 K16 K31",
    "2020-06-18": "K04 K13 K19",
    "2020-06-19": "K06 K08 K17 K34",
}
# Further code ranges; a later entry wins.
CODE_RANGES = [
    ("K20", 1, "2020-09-08", "2021-06-09"),
    ("K26", 1, "2021-08-07", "2021-08-12"),
    ("K27", 1, "2020-06-12", "2020-08-24"),
    ("K27", 11, "2020-08-25", None),
]
RULE_SCHEMA = "site string, date_from date, date_to date, code int, priority int"


def keep_codes_for(stage: str, network: str, variable: str) -> tuple[int, ...]:
    return KEEP_CODES.get((stage, network, variable)) or KEEP_CODES[(stage, "*", variable)]


def quality_rules(spark: SparkSession) -> DataFrame:
    rows = [(s, None, dt.date.fromisoformat(day), 2, 0)
            for day, sites in IN_FIELD_AFTER.items() for s in sites.split()]
    iso = lambda d: dt.date.fromisoformat(d) if d else None
    rows += [(s, iso(lo), iso(hi), code, i + 1) for i, (s, code, lo, hi) in enumerate(CODE_RANGES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
