"""Keyword vocabularies used to classify free-text DESCRIPTION columns.

A vocabulary is an ordered list of ``(type, [keywords])``. Order matters in
two places: within a type the first keyword that yields data wins, and across
types the *last* type with data wins for the collapsed vital/lab channel.

Matching modes
* ``regex``   case-insensitive regular-expression search (timeline / feature
              vocabularies; ``bmi 30+`` is therefore a regex),
* ``literal`` lower-cased substring test (outcome targets),
* ``escaped`` case-insensitive alternation of escaped literals (split flags).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vocab:
    name: str
    types: tuple[tuple[str, tuple[str, ...]], ...]
    mode: str = "regex"
    notes: str = field(default="", compare=False)

    @staticmethod
    def of(name: str, items, mode: str = "regex") -> "Vocab":
        return Vocab(name, tuple((t, tuple(kws)) for t, kws in items), mode)

    @property
    def type_names(self) -> list[str]:
        return [t for t, _ in self.types]

    def all_keywords(self) -> list[str]:
        return [kw for _, kws in self.types for kw in kws]


def keyword_match(desc: Column, keyword: str, mode: str = "regex") -> Column:
    """Boolean column: does ``desc`` contain ``keyword``? Null text -> false."""
    if mode == "regex":
        m = desc.rlike("(?iu)" + keyword)
    elif mode == "literal":
        m = F.lower(desc).contains(keyword.lower())
    elif mode == "escaped":
        m = desc.rlike("(?iu)" + re.escape(keyword))
    else:
        raise ValueError(f"unknown match mode {mode!r}")
    return F.coalesce(m, F.lit(False))


def any_keyword(desc: Column, keywords, mode: str = "regex") -> Column:
    """One pattern for a whole keyword list (used as a cheap pre-filter)."""
    kws = list(keywords)
    if not kws:
        return F.lit(False)
    if mode == "regex":
        pat = "(?iu)(" + "|".join(f"(?:{k})" for k in kws) + ")"
        return F.coalesce(desc.rlike(pat), F.lit(False))
    if mode == "escaped":
        pat = "(?iu)(" + "|".join(re.escape(k) for k in kws) + ")"
        return F.coalesce(desc.rlike(pat), F.lit(False))
    m = F.lit(False)
    low = F.lower(desc)
    for k in kws:
        m = m | low.contains(k.lower())
    return F.coalesce(m, F.lit(False))


# ---------------------------------------------------------------------------
# These must equal the reference's keyword lists exactly, in
# their original order (order is semantic, see module doc).
# ---------------------------------------------------------------------------

COHORT_KEYWORDS = ("covid", "coronavirus", "sars-cov-2", "covid-19", "covid19",
                   "pneumonia", "respiratory", "acute respiratory")

TIMELINE_VITALS = Vocab.of("timeline_vital_signs", [
    ("temperature", ["temperature", "temp"]),
    ("heart_rate", ["heart rate", "pulse"]),
    ("blood_pressure_systolic", ["systolic", "bp systolic"]),
    ("blood_pressure_diastolic", ["diastolic", "bp diastolic"]),
    ("oxygen_saturation", ["oxygen saturation", "o2 sat"]),
    ("respiratory_rate", ["respiratory rate", "resp rate"]),
])

TIMELINE_LABS = Vocab.of("timeline_laboratory_values", [
    ("glucose", ["glucose", "blood glucose"]),
    ("creatinine", ["creatinine"]),
    ("sodium", ["sodium", "na"]),
    ("potassium", ["potassium", "k"]),
    ("hemoglobin", ["hemoglobin", "hgb"]),
    ("white_blood_cells", ["white blood cell", "wbc"]),
    ("platelets", ["platelet"]),
    ("c_reactive_protein", ["c-reactive protein", "crp"]),
])

# The same list with the one- and two-letter symbols as whole words only.
TIMELINE_LABS_STRICT = Vocab("timeline_laboratory_values_strict", tuple(
    (name, tuple({"na": r"\bna\b", "k": r"\bk\b"}.get(k, k) for k in kws)) for name, kws in TIMELINE_LABS.types), TIMELINE_LABS.mode)

TIMELINE_MEDICATIONS = Vocab.of("timeline_medications", [
    ("remdesivir", ["remdesivir"]),
    ("dexamethasone", ["dexamethasone"]),
    ("hydroxychloroquine", ["hydroxychloroquine"]),
    ("azithromycin", ["azithromycin"]),
    ("tocilizumab", ["tocilizumab"]),
    ("baricitinib", ["baricitinib"]),
])

TIMELINE_PROCEDURES = Vocab.of("timeline_procedures", [
    ("intubation", ["intubation", "endotracheal"]),
    ("ventilation", ["ventilation", "mechanical ventilation"]),
    ("ecmo", ["ecmo", "extracorporeal"]),
    ("dialysis", ["dialysis", "hemodialysis"]),
    ("tracheostomy", ["tracheostomy"]),
])

TIMELINE_DEVICES = Vocab.of("timeline_devices", [
    ("ventilator", ["ventilator", "mechanical ventilator"]),
    ("ecmo", ["ecmo", "extracorporeal"]),
    ("oxygen", ["oxygen", "o2"]),
    ("monitor", ["monitor", "cardiac monitor"]),
])

COMORBIDITIES = Vocab.of("feature_comorbidities", [
    ("diabetes", ["diabetes", "diabetic"]),
    ("hypertension", ["hypertension", "high blood pressure"]),
    ("obesity", ["obesity", "bmi 30+"]),
    ("copd", ["copd", "chronic obstructive"]),
    ("heart_disease", ["heart disease", "cardiovascular"]),
])

FEATURE_VITALS = Vocab("feature_vital_signs", TIMELINE_VITALS.types, TIMELINE_VITALS.mode)

FEATURE_LABS = Vocab.of("feature_laboratory_values", [
    ("crp", ["crp", "c-reactive protein"]),
    ("d_dimer", ["d-dimer", "d dimer"]),
    ("white_blood_cells", ["white blood cells", "wbc", "leukocytes"]),
    ("platelets", ["platelets", "platelet count"]),
    ("lymphocytes", ["lymphocytes", "lymphocyte count"]),
    ("neutrophils", ["neutrophils", "neutrophil count"]),
    ("creatinine", ["creatinine"]),
    ("troponin", ["troponin"]),
])

FEATURE_MEDICATIONS = Vocab.of("feature_medications", [
    ("remdesivir", ["remdesivir"]),
    ("dexamethasone", ["dexamethasone"]),
    ("tocilizumab", ["tocilizumab"]),
    ("supportive_care", ["acetaminophen", "ibuprofen", "paracetamol"]),
    ("anticoagulants", ["heparin", "enoxaparin", "warfarin"]),
])

FEATURE_PROCEDURES = Vocab.of("feature_procedures", [
    ("intubation", ["intubation", "endotracheal"]),
    ("mechanical_ventilation", ["mechanical ventilation", "ventilator"]),
    ("diagnostic_tests", ["covid test", "pcr test", "antigen test"]),
    ("imaging_studies", ["chest x-ray", "ct scan", "chest ct"]),
])

FEATURE_DEVICES = Vocab.of("feature_devices", [
    ("ventilator_settings", ["ventilator", "respirator"]),
    ("monitoring_equipment", ["monitor", "ecg", "ekg"]),
    ("life_support", ["ecmo", "extracorporeal"]),
])

# Outcome-target keyword lists (lower-cased literal containment).
TARGET_SEVERE_CONDITION = ("severe", "critical", "acute respiratory", "pneumonia")
TARGET_CRITICAL_PROCEDURE = ("intubation", "mechanical ventilation", "ecmo")
TARGET_ICU_ENCOUNTER = ("icu", "intensive care", "critical care")
TARGET_ICU_PROCEDURE = ("intubation", "mechanical ventilation")
TARGET_VENTILATOR_PROCEDURE = ("mechanical ventilation", "ventilator")

# Split-label keyword lists (escaped, case-insensitive alternation).
SPLIT_ICU_KEYWORDS = ("icu", "intensive care", "critical care")
SPLIT_VENTILATOR_KEYWORDS = ("mechanical ventilation", "ventilator", "intubation")

# Static feature vector order (15) and the subset that is standard-scaled.
STATIC_FEATURES = ("age", "gender", "race", "ethnicity",
                   "diabetes", "hypertension", "obesity", "copd", "heart_disease",
                   "healthcare_coverage", "income_level",
                   "age_risk", "age_group", "comorbidity_count", "high_comorbidity")
SCALED_STATIC = ("age", "diabetes", "hypertension", "obesity", "copd", "heart_disease",
                 "healthcare_coverage", "income_level")

# Label-encoder classes, in sorted (byte) order as the encoder assigns codes.
GENDER_CLASSES = ("F", "M", "Unknown")
RACE_CLASSES = ("Unknown", "asian", "black", "native", "other", "white")
ETHNICITY_CLASSES = ("Unknown", "hispanic", "nonhispanic")

# Socioeconomic placeholders.
HEALTHCARE_COVERAGE = 1.0
INCOME_LEVEL = 0.5

# The 26 temporal channels: feature vocabularies in category order.
TEMPORAL_CATEGORIES = (
    ("vital_signs", FEATURE_VITALS),
    ("laboratory_values", FEATURE_LABS),
    ("medications", FEATURE_MEDICATIONS),
    ("procedures", FEATURE_PROCEDURES),
    ("devices", FEATURE_DEVICES),
)

