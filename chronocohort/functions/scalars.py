"""Scalar expressions shared by the sequence, report and attribution operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved tokens, type ids, cardiac lab panel, lab names.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[V_START]", "[V_END]"]
GAP_TOKENS = ["W0", "W1", "W2", "W3", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "M10", "M11", "LT"]
RESERVED = SPECIAL_TOKENS + GAP_TOKENS
PAD, UNK, CLS, V_START, V_END = range(5)
TYPE_IDS = {"special": 0, "diagnosis": 1, "procedure": 2, "lab": 3, "medication": 4}
EVENT_TYPES = ["special", "diagnosis", "procedure", "medication", "lab"]
CARDIAC_LABS = [51002, 51003, 52042, 51214, 50963, 50912, 51006, 50971, 50983, 50960, 50902, 50882, 50893,
                51222, 51221, 51265, 51301, 50861, 50878, 50885, 50862, 50931, 50954, 50889]
LAB_NAMES = {
    "50963": "NTproBNP", "51003": "Troponin T", "51002": "Troponin I", "52642": "Troponin I (alt)",
    "50912": "Creatinine", "50868": "Anion Gap", "50882": "Bicarbonate", "50931": "Glucose",
    "51006": "Urea Nitrogen", "51222": "Hemoglobin", "51301": "WBC", "51265": "Platelets", "50983": "Sodium",
    "50971": "Potassium", "50960": "Magnesium", "50893": "Calcium", "50861": "ALT", "50878": "AST",
    "50863": "Alk Phosphatase", "50885": "Bilirubin", "50954": "LDH", "50902": "Chloride", "50820": "pH",
    "51279": "RBC", "50976": "Protein",
}
EPOCH = "2000-01-01"


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def days_since_epoch(ts: Column) -> Column:
    """Whole days since the reference date, 0 before it."""
    return F.greatest(F.datediff(ts.cast("date"), F.lit(EPOCH).cast("date")), F.lit(0))


def gap_token(days: Column) -> Column:
    """Weeks below 28 days, 30-day months below 360, else long term.  28 and 29 days give 'M0', which is
    not a reserved token and is therefore encoded as unknown."""
    return (F.when(days < 28, F.concat(F.lit("W"), F.floor(days / 7).cast("string")))
            .when(days < 360, F.concat(F.lit("M"), F.floor(days / 30).cast("string")))
            .otherwise("LT"))


def gap_id(days: Column) -> Column:
    ids = literal_map({t: i + len(SPECIAL_TOKENS) for i, t in enumerate(GAP_TOKENS)})
    return F.coalesce(F.try_element_at(ids, gap_token(days)), F.lit(UNK))


def age_years(anchor_age: Column, anchor_year: Column, at: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), anchor_age + F.year(at) - anchor_year), F.lit(0)).cast("double")


def age_bucket(years: Column) -> Column:
    return F.least(F.lit(9), F.floor(years / 10)).cast("int")


def quartile_suffix(value: Column, p25: Column, p50: Column, p75: Column, stem: str) -> Column:
    """'<stem>1'..'<stem>4' by closed upper cut-offs; empty when value or cut-offs are missing."""
    return (F.when(value.isNull() | p25.isNull(), "")
            .when(value <= p25, f"{stem}1").when(value <= p50, f"{stem}2")
            .when(value <= p75, f"{stem}3").otherwise(f"{stem}4"))


def first_number(text: Column) -> Column:
    """The first decimal number in a text, NULL when there is none."""
    return F.regexp_extract(text, r"(\d+\.?\d*)", 1).try_cast("double")


def token_type(token: Column) -> Column:
    prefix = F.split(token, "::")[0]
    return F.when(token.contains("::") & prefix.isin(EVENT_TYPES), prefix).otherwise("special")


def token_label(token: Column) -> Column:
    """Readable form of a token: lab name, code without version, drug cut to 22 characters."""
    prefix = F.substring_index(token, "::", 1)
    value = F.split(token, "::", 2)[1]
    head = F.split(value, "_")[0]
    return (F.when(~token.contains("::"), token)
            .when(prefix == "lab", F.concat(F.lit("lab:"), F.coalesce(F.try_element_at(literal_map(LAB_NAMES), head), head)))
            .when(prefix == "diagnosis", F.concat(F.lit("dx:"), head))
            .when(prefix == "procedure", F.concat(F.lit("proc:"), head))
            .when(prefix == "medication", F.concat(F.lit("rx:"), F.substring(head, 1, 22)))
            .otherwise(F.substring(token, 1, 28)))
