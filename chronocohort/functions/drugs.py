"""Drug classes (ordered name patterns), prefilters and monitoring windows per class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class -> name patterns, in match order.
TEN_CLASSES = {
    "anthracycline": "doxorubicin|adriamycin|doxil|caelyx|myocet|daunorubicin|cerubidine|daunoxome|epirubicin|"
                     "ellence|pharmorubicin|idarubicin|idamycin|zavedos|mitoxantrone|novantrone",
    "her2_targeted": "trastuzumab|herceptin|pertuzumab|perjeta|ado[- ]?trastuzumab|kadcyla|emtansine|"
                     "trastuzumab.deruxtecan|enhertu|margetuximab|margenza|lapatinib|tykerb|neratinib|nerlynx|"
                     "tucatinib|tukysa",
    "immune_checkpoint_inhibitor": "pembrolizumab|keytruda|nivolumab|opdivo|cemiplimab|libtayo|atezolizumab|"
                                   "tecentriq|durvalumab|imfinzi|avelumab|bavencio|ipilimumab|yervoy|"
                                   "tremelimumab|imjudo",
    "taxane": "paclitaxel|taxol|abraxane|docetaxel|taxotere|cabazitaxel|jevtana",
    "fluoropyrimidine": "fluorouracil|5-fluorouracil|5fu|capecitabine|xeloda",
    "vegf_inhibitor": "bevacizumab|avastin|aflibercept|zaltrap|eylea|ramucirumab|cyramza",
    "egfr_inhibitor": "cetuximab|erbitux|panitumumab|vectibix",
    "tyrosine_kinase_inhibitor": "sunitinib|sutent|imatinib|gleevec|glivec|dasatinib|sprycel|nilotinib|tasigna|"
                                 "ponatinib|iclusig|sorafenib|nexavar|pazopanib|votrient|cabozantinib|cabometyx|"
                                 "cometriq|axitinib|inlyta|lenvatinib|lenvima",
    "proteasome_inhibitor": "bortezomib|velcade|carfilzomib|kyprolis|ixazomib|ninlaro",
    "immunomodulatory_agent": "lenalidomide|revlimid|thalidomide|thalomid|pomalidomide|pomalyst",
}
THREE_CLASSES = {name: TEN_CLASSES[name] for name in
                 ("anthracycline", "her2_targeted", "immune_checkpoint_inhibitor")}
MAIN_CLASSES = {
    "anthracycline": "doxorubicin|daunorubicin|epirubicin|idarubicin",
    "immune_checkpoint_inhibitor": "nivolumab|pembrolizumab|atezolizumab|ipilimumab|durvalumab|avelumab|cemiplimab",
    "her2_targeted": "trastuzumab|pertuzumab|ado-trastuzumab|emtansine",
    "taxane": "paclitaxel|docetaxel|cabazitaxel",
    "fluoropyrimidine": "fluorouracil|5-fluorouracil|capecitabine",
    "vegf_inhibitor": "bevacizumab|aflibercept|ramucirumab",
    "egfr_inhibitor": "cetuximab|panitumumab",
    "tyrosine_kinase_inhibitor": "sunitinib|imatinib|dasatinib|nilotinib|ponatinib|sorafenib|pazopanib|"
                                 "cabozantinib|axitinib|lenvatinib",
    "proteasome_inhibitor": "bortezomib|carfilzomib|ixazomib",
    "immunomodulatory_agent": "lenalidomide|thalidomide|pomalidomide",
}
MAIN_V1_PREFILTER = ("doxorubicin|daunorubicin|epirubicin|trastuzumab|paclitaxel|docetaxel|fluorouracil|"
                     "5-fluorouracil|capecitabine|bevacizumab|cetuximab|sunitinib|imatinib|bortezomib|carfilzomib|"
                     "lenalidomide|thalidomide|pomalidomide|nivolumab|pembrolizumab|atezolizumab")
LIKE_TERMS = ["doxorubicin", "daunorubicin", "epirubicin", "cyclophosphamide", "cisplatin", "carboplatin", "5-fu",
              "fluorouracil", "capecitabine", "trastuzumab", "paclitaxel", "docetaxel", "sunitinib", "sorafenib",
              "imatinib"]
REPORTING_GROUPS = {
    "anthracycline": "Anthracycline",
    "her2_targeted": "HER2-targeted",
    "immune_checkpoint_inhibitor": "Immune checkpoint inhibitor",
    "taxane": "Taxane",
    "fluoropyrimidine": "Antimetabolite",
    "vegf_inhibitor": "Other targeted",
    "egfr_inhibitor": "Other targeted",
    "tyrosine_kinase_inhibitor": "Other targeted",
    "proteasome_inhibitor": "Other targeted",
    "immunomodulatory_agent": "Other targeted",
}

# Class -> (monitoring days, rationale text).
WINDOWS_UNIFORM = {
    "anthracycline": (365, "uniform 365-day window"),
    "her2_targeted": (365, "uniform 365-day window"),
    "immune_checkpoint_inhibitor": (365, "uniform 365-day window (ESC 2022 acute window is 90d)"),
    "taxane": (365, "uniform 365-day window"),
    "fluoropyrimidine": (365, "uniform 365-day window"),
    "vegf_inhibitor": (365, "uniform 365-day window"),
    "egfr_inhibitor": (365, "uniform 365-day window"),
    "tyrosine_kinase_inhibitor": (365, "uniform 365-day window"),
    "proteasome_inhibitor": (365, "uniform 365-day window"),
    "immunomodulatory_agent": (365, "uniform 365-day window"),
}
WINDOWS_BIMODAL = {
    "anthracycline": (365, "moderate window: cumulative dose-dependent cardiotoxicity"),
    "her2_targeted": (365, "moderate window: reversible LV dysfunction over months"),
    "vegf_inhibitor": (365, "moderate window: hypertension and HF risk over months"),
    "egfr_inhibitor": (365, "moderate window: sustained CV surveillance"),
    "tyrosine_kinase_inhibitor": (365, "moderate window: sustained CV surveillance"),
    "proteasome_inhibitor": (365, "moderate window: HF and arrhythmia risk over months"),
    "immunomodulatory_agent": (365, "moderate window: thrombotic and CV risk over months"),
    "immune_checkpoint_inhibitor": (90, "acute window: myocarditis median onset 28-43 days"),
    "taxane": (90, "acute window: acute arrhythmia and hypersensitivity"),
    "fluoropyrimidine": (90, "acute window: coronary vasospasm, typically within weeks"),
}
WINDOWS_THREE = {
    "anthracycline": (365, "ESC 2022: >=12 months post-treatment; late-onset HF not captured in this window"),
    "her2_targeted": (365, "ESC 2022: q3 months during treatment + 12 months post-completion"),
    "immune_checkpoint_inhibitor": (90, "Onset literature: 28-43 day median; 90-day window captures acute "
                                        "myocarditis-related HF"),
}
WINDOWS_FIRST_CLASS = {
    "anthracycline": (365, "ESC 2022: >=12 months post-treatment"),
    "her2_targeted": (365, "ESC 2022: q3 months during treatment + 12 months post-completion"),
    "immune_checkpoint_inhibitor": (90, "Onset literature: 28-43 day median; 90-day acute window"),
    "taxane": (90, "Shorter window for acute/subacute CV events"),
    "fluoropyrimidine": (30, "Acute/subacute ischemia and vasospasm window"),
    "vegf_inhibitor": (180, "Hypertension/HF/ischemic risk over months"),
    "egfr_inhibitor": (180, "General CV surveillance window"),
    "tyrosine_kinase_inhibitor": (180, "General CV surveillance window"),
    "proteasome_inhibitor": (180, "HF/ischemia/arrhythmia risk over months"),
    "immunomodulatory_agent": (180, "Thrombotic/CV risk over months"),
}
WINDOWS_PER_CYCLE = {
    "anthracycline": (365, "Early-onset and late CTRCD/HF assessed within 1 year (ESC 2022)"),
    "her2_targeted": (365, "HER2-related LV dysfunction monitored over 1 year (ESC 2022)"),
    "immune_checkpoint_inhibitor": (90, "ICI myocarditis mostly within weeks–3 months (ESC 2022)"),
    "taxane": (90, "Acute/subacute CV events; shorter surveillance window"),
    "fluoropyrimidine": (30, "Acute vasospasm/ischemia; very early onset"),
    "vegf_inhibitor": (180, "Hypertension, HF, and ischemic risk over months"),
    "egfr_inhibitor": (180, "General cardio-oncology surveillance window"),
    "tyrosine_kinase_inhibitor": (180, "General cardio-oncology surveillance window"),
    "proteasome_inhibitor": (180, "HF, ischemia, arrhythmia risk over months"),
    "immunomodulatory_agent": (180, "Thrombotic and CV risk over months"),
    "other_oncology": (365, "Conservative fallback window"),
}
WINDOWS_MAIN = {
    "anthracycline": (365, "Early-onset CTRCD/HF commonly assessed within 1 year"),
    "immune_checkpoint_inhibitor": (90, "ICI myocarditis usually occurs early, often within weeks to 3 months"),
    "her2_targeted": (365, "HER2-related LV dysfunction commonly monitored over months to 1 year"),
    "taxane": (90, "Shorter window for acute/subacute CV events"),
    "fluoropyrimidine": (30, "Often acute/subacute ischemia/vasospasm window"),
    "vegf_inhibitor": (180, "Hypertension/HF/ischemic risk over months"),
    "egfr_inhibitor": (180, "General CV surveillance window"),
    "tyrosine_kinase_inhibitor": (180, "General CV surveillance window"),
    "proteasome_inhibitor": (180, "HF/ischemia/arrhythmia risk over months"),
    "immunomodulatory_agent": (180, "Thrombotic/CV risk over months"),
    "other_oncology": (365, "Fallback window"),
}
FALLBACK_DAYS = 365


@dataclass(frozen=True)
class Classifier:
    """Ordered class patterns; the first match wins, otherwise ``fallback``."""

    classes: Mapping[str, str]
    prefilter: str | None = None
    fallback: str | None = None

    @property
    def any_name(self) -> str:
        return self.prefilter or "|".join(self.classes.values())

    def class_of(self, drug: Column) -> Column:
        chain = None
        for name, pattern in self.classes.items():
            hit = drug.rlike(pattern)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain.otherwise(F.lit(self.fallback))


TEN = Classifier(TEN_CLASSES)
THREE = Classifier(THREE_CLASSES)
MAIN_V1 = Classifier(MAIN_CLASSES, prefilter=MAIN_V1_PREFILTER, fallback="other_oncology")
MAIN_V2 = Classifier(MAIN_CLASSES, fallback="other_oncology")


def window_table(spark: SparkSession, windows: Mapping[str, tuple[int, str]]) -> DataFrame:
    """The class windows as an inline dimension: at most one row per class, so broadcasting is bounded."""
    rows = ", ".join(f"('{name}', {days}, '{why}')" for name, (days, why) in windows.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(drug_class, toxicity_window_days, window_rationale)")


def reporting_group(drug_class: Column) -> Column:
    """Ten classes to six reporting groups; anything else non-null is 'Other targeted'."""
    table = F.create_map(*[F.lit(x) for pair in REPORTING_GROUPS.items() for x in pair])
    return F.when(drug_class.isNull(), "unknown").otherwise(
        F.coalesce(F.try_element_at(table, drug_class), F.lit("Other targeted")))
