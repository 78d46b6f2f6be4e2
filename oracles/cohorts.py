"""Cohort relations, written per variant from a few lists.  Relation names carry the variant as prefix."""

from __future__ import annotations

from oracles import name

# Name patterns per class.
NAMES = {
    "anthracycline": "doxorubicin|adriamycin|doxil|caelyx|myocet|daunorubicin|cerubidine|daunoxome|epirubicin|ellence|"
                     "pharmorubicin|idarubicin|idamycin|zavedos|mitoxantrone|novantrone",
    "her2_targeted": "trastuzumab|herceptin|pertuzumab|perjeta|ado[- ]?trastuzumab|kadcyla|emtansine|trastuzumab.deruxtecan|enhertu|"
                     "margetuximab|margenza|lapatinib|tykerb|neratinib|nerlynx|tucatinib|tukysa",
    "immune_checkpoint_inhibitor": "pembrolizumab|keytruda|nivolumab|opdivo|cemiplimab|libtayo|atezolizumab|tecentriq|"
                                   "durvalumab|imfinzi|avelumab|bavencio|ipilimumab|yervoy|tremelimumab|imjudo",
    "taxane": "paclitaxel|taxol|abraxane|docetaxel|taxotere|cabazitaxel|jevtana",
    "fluoropyrimidine": "fluorouracil|5-fluorouracil|5fu|capecitabine|xeloda",
    "vegf_inhibitor": "bevacizumab|avastin|aflibercept|zaltrap|eylea|ramucirumab|cyramza",
    "egfr_inhibitor": "cetuximab|erbitux|panitumumab|vectibix",
    "tyrosine_kinase_inhibitor": "sunitinib|sutent|imatinib|gleevec|glivec|dasatinib|sprycel|nilotinib|tasigna|ponatinib|"
                                 "iclusig|sorafenib|nexavar|pazopanib|votrient|cabozantinib|cabometyx|cometriq|axitinib|"
                                 "inlyta|lenvatinib|lenvima",
    "proteasome_inhibitor": "bortezomib|velcade|carfilzomib|kyprolis|ixazomib|ninlaro",
    "immunomodulatory_agent": "lenalidomide|revlimid|thalidomide|thalomid|pomalidomide|pomalyst",
}
THREE = list(NAMES)[:3]
GENERIC = {
    "anthracycline": "doxorubicin|daunorubicin|epirubicin|idarubicin",
    "immune_checkpoint_inhibitor": "nivolumab|pembrolizumab|atezolizumab|ipilimumab|durvalumab|avelumab|cemiplimab",
    "her2_targeted": "trastuzumab|pertuzumab|ado-trastuzumab|emtansine",
    "taxane": "paclitaxel|docetaxel|cabazitaxel",
    "fluoropyrimidine": "fluorouracil|5-fluorouracil|capecitabine",
    "vegf_inhibitor": "bevacizumab|aflibercept|ramucirumab",
    "egfr_inhibitor": "cetuximab|panitumumab",
    "tyrosine_kinase_inhibitor": "sunitinib|imatinib|dasatinib|nilotinib|ponatinib|sorafenib|pazopanib|cabozantinib|axitinib|lenvatinib",
    "proteasome_inhibitor": "bortezomib|carfilzomib|ixazomib",
    "immunomodulatory_agent": "lenalidomide|thalidomide|pomalidomide",
}
V1_LIST = ("doxorubicin|daunorubicin|epirubicin|trastuzumab|paclitaxel|docetaxel|fluorouracil|5-fluorouracil|capecitabine|bevacizumab|cetuximab|"
           "sunitinib|imatinib|bortezomib|carfilzomib|lenalidomide|thalidomide|pomalidomide|nivolumab|pembrolizumab|atezolizumab")

# Code prefixes.
HF = {10: "I50", 9: "428"}
CMP = {10: "I42", 9: "425"}
ARR = {10: "I44|I45|I47|I48|I49", 9: "426|427"}
NARROW = {10: "I21|I22|I23|I30|I31|I40|I41|I42|I46|I50|I514", 9: "410|411|420|421|422|423|425|428"}
BROAD = {10: "I21|I22|I23|I30|I31|I40|I41|I42|I44|I45|I46|I47|I48|I49|I50|I514", 9: "410|411|420|421|422|423|425|426|427|428"}
YEAR = "425|428|410|411|412|413|414|I42|I50|I21|I22|I23|I63|I64"
V1 = "425|428|410|411|412|413|414|420|421|422|423|426|427|I42|I50|I21|I22|I23|I63|I64|I30|I31|I40|I41|I44|I45|I46|I47|I48|I49|I514"
V2 = "425|428|410|411|413|420|421|422|423|426|427|I42|I50|I21|I22|I23|I63|I64|I30|I31|I40|I41|I44|I45|I46|I47|I48|I49|I51"
PRIOR = {9: "14|15|16|17|18|19|20|23", 10: "C|D0"}


def coded(codes, alias="") -> str:
    a = f"{alias}." if alias else ""
    if isinstance(codes, str):
        return f"regexp_matches({a}icd_code, '^({codes})')"
    return "(" + " OR ".join(f"({a}icd_version = {v} AND regexp_matches({a}icd_code, '^({p})'))" for v, p in codes.items()) + ")"


def class_case(patterns: dict, fallback: str = "NULL", column: str = "lower(drug)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{c}'" for c, p in patterns.items()) + f" ELSE {fallback} END"


# Windows per class.
UNIFORM = {c: (365, "uniform 365-day window") for c in NAMES} | {
    "immune_checkpoint_inhibitor": (365, "uniform 365-day window (ESC 2022 acute window is 90d)")}
BIMODAL = {
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
HFWIN = {
    "anthracycline": (365, "ESC 2022: >=12 months post-treatment; late-onset HF not captured in this window"),
    "her2_targeted": (365, "ESC 2022: q3 months during treatment + 12 months post-completion"),
    "immune_checkpoint_inhibitor": (90, "Onset literature: 28-43 day median; 90-day window captures acute myocarditis-related HF"),
}
FIRSTWIN = {
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
CYCLEWIN = {
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
MAINWIN = {
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


def values(windows: dict) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {d}, '{w}')" for c, (d, w) in windows.items()) + ") w(drug_class, days, why)"


def exposures(p: str, keys: str, windows: dict | None, fallback: str = "fallback", strict: bool = False) -> None:
    """Day, numbered-day and cycle relations over {p}_starts; ``keys`` is the partition."""
    name(**{
        f"{p}_days": f"""SELECT {keys}, starttime::DATE AS d, min(starttime) AS t0, count(*) AS n,
            string_agg(DISTINCT drug, ' | ' ORDER BY drug) AS day_list FROM {p}_starts GROUP BY {keys}, starttime::DATE""",
        f"{p}_gaps": f"""SELECT *, lag(d) OVER (PARTITION BY {keys} ORDER BY d) AS pd FROM {p}_days""",
        f"{p}_numbered": f"""SELECT *, CAST(count(*) FILTER (WHERE pd IS NULL OR d - pd > 7)
            OVER (PARTITION BY {keys} ORDER BY d ROWS UNBOUNDED PRECEDING) AS INT) AS cycle_number FROM {p}_gaps""",
    })
    if windows is not None:
        name(**{f"{p}_windows": values(windows)})
    span = f"""min(t0) AS prediction_time, min(d) AS cycle_start_date, max(d) AS cycle_end_date,
        count(*) AS n_exposure_start_days_in_cycle, CAST(sum({'n * n' if strict else 'n'}) AS BIGINT) AS n_prescription_rows_in_cycle"""
    if "drug_class" in keys:
        name(**{f"{p}_cycles": f"""SELECT c.*, days AS toxicity_window_days, why AS window_rationale FROM (
            SELECT {keys}, cycle_number, {span}, string_agg(DISTINCT day_list, ' | ' ORDER BY day_list) AS drugs_in_cycle
            FROM {p}_numbered GROUP BY {keys}, cycle_number) c LEFT JOIN {p}_windows USING (drug_class)"""})
        return
    flags = ", ".join(f"CAST(max(CASE WHEN s.drug_class = '{c}' THEN 1 ELSE 0 END) AS INT) AS exposed_{c}" for c in NAMES)
    if windows is None:
        extra, join = "365 AS toxicity_window_days", ""
    else:
        extra = f"""max(coalesce(days, 365)) AS toxicity_window_days,
            string_agg(DISTINCT coalesce(why, '{fallback}'), ' | ' ORDER BY coalesce(why, '{fallback}')) AS window_rationales"""
        join = f"LEFT JOIN {p}_windows w ON w.drug_class = s.drug_class"
    name(**{
        f"{p}_spans": f"SELECT subject_id, cycle_number, {span} FROM {p}_numbered GROUP BY subject_id, cycle_number",
        f"{p}_sets": f"""SELECT n.subject_id, n.cycle_number, string_agg(DISTINCT s.drug, ' | ' ORDER BY s.drug) AS drugs_in_cycle,
            string_agg(DISTINCT s.drug_class, ' | ' ORDER BY s.drug_class) AS drug_classes_in_cycle, {extra}, {flags}
            FROM {p}_numbered n JOIN {p}_starts s ON s.subject_id = n.subject_id AND s.starttime::DATE = n.d {join}
            GROUP BY n.subject_id, n.cycle_number""",
        f"{p}_cycles": f"SELECT * FROM {p}_spans JOIN {p}_sets USING (subject_id, cycle_number)",
    })


def baseline(p: str, anchor: str, at: str) -> None:
    """Last LVEF and strain value in the 365 days before the anchor, as arg_max over packed keys."""
    for kind, sign in (("lvef", ""), ("gls", "-")):
        name(**{f"{p}_base_{kind}": f"""SELECT a.subject_id, a.{at}, max(m.t) AS bt, arg_max(m.v, (m.t, {sign}m.v)) AS b
            FROM {anchor} a LEFT JOIN {kind} m ON m.subject_id = a.subject_id AND m.t < a.{at} AND m.t >= a.{at} - INTERVAL 365 DAY
            GROUP BY ALL"""})


def labelled(p: str, event: str, died: str, strict: str, body: str, out: str) -> None:
    name(**{
        f"{out}_state": f"""SELECT *, CASE WHEN {event} <= prediction_time THEN 'exclude_already_toxic'
                WHEN {event} <= prediction_window_end THEN 'positive'
                WHEN death_time > prediction_time AND death_time <= prediction_window_end AND coalesce({event} > death_time, TRUE) THEN 'censored_death'
                WHEN last_observation_time >= prediction_window_end THEN 'negative_observed'
                ELSE 'unknown_insufficient_followup' END AS label FROM ({body})""",
        out: f"""SELECT *, CASE WHEN last_observation_time >= prediction_window_end THEN 1 ELSE 0 END AS observed_through_prediction_window,
            CASE WHEN death_time > prediction_time AND death_time <= prediction_window_end AND coalesce({event} > death_time, TRUE) THEN 1 ELSE 0 END AS {died},
            CASE label WHEN 'positive' THEN 1 WHEN 'negative_observed' THEN 0 END AS binary_label,
            CASE WHEN label IN ('positive', 'negative_observed') AND {strict} = 0 THEN 1 ELSE 0 END AS eligible_strict,
            CASE WHEN label IN ('positive', 'negative_observed') THEN 1 ELSE 0 END AS eligible_inclusive FROM {out}_state""",
    })


ECHO = ["first_echo_event_time", "first_echo_event_type", "baseline_lvef", "event_lvef", "lvef_drop_pp", "baseline_gls", "event_gls", "gls_relative_decrease"]


def cohort(p: str, classes=tuple(NAMES), windows=UNIFORM, incident=BROAD, arrhythmia=False, echo=True, joint=False, first_class=None,
           strict=False) -> None:
    keys = "subject_id" if joint else "subject_id, drug_class"
    name(**{
        f"{p}_starts": f"""SELECT * FROM (SELECT subject_id, hadm_id, pharmacy_id, starttime, lower(drug) AS drug,
            {class_case({c: NAMES[c] for c in classes})} AS drug_class FROM rx) WHERE drug_class IS NOT NULL AND subject_id IN (FROM elig)""",
        f"{p}_anchor": f"SELECT subject_id, min(starttime) AS f FROM {p}_starts GROUP BY subject_id",
    })
    exposures(p, keys, windows, strict=strict)
    groups = {"hf": HF, "cmp": CMP} | ({"arrhythmia": ARR} if arrhythmia else {})
    past = ", ".join(f"CAST(coalesce(max(CASE WHEN {coded(c, 'd')} AND s.dischtime <= a.f {'OR ' + coded({10: c[10]}, 'd') if strict else ''} THEN 1 END), 0) AS INT)"
                     f" AS has_pre_existing_{g}" for g, c in groups.items())
    any_two = "greatest(has_pre_existing_hf, has_pre_existing_cmp) AS has_pre_existing_hf_or_cmp"
    any_all = ", greatest(has_pre_existing_hf, has_pre_existing_cmp, has_pre_existing_arrhythmia) AS has_pre_existing_cardiac" if arrhythmia else ""
    name(**{
        f"{p}_history": f"""SELECT *, {any_two}{any_all} FROM (SELECT a.subject_id, {past} FROM {p}_anchor a
            LEFT JOIN dx d ON d.subject_id = a.subject_id LEFT JOIN adm s ON s.hadm_id = d.hadm_id GROUP BY a.subject_id)""",
        f"{p}_admissions": f"""SELECT a.subject_id, s.admittime AS t, s.hadm_id AS h, string_agg(DISTINCT d.icd_code, ' | ' ORDER BY d.icd_code) AS codes
            FROM {p}_anchor a JOIN dx d ON d.subject_id = a.subject_id JOIN adm s ON s.hadm_id = d.hadm_id
            WHERE {coded(incident, 'd')} AND s.admittime > a.f GROUP BY ALL""",
        f"{p}_incident": f"""SELECT DISTINCT ON (subject_id) subject_id, t AS hf_event_time, h AS hf_hadm_id, codes AS hf_icd_codes
            FROM {p}_admissions ORDER BY subject_id, t, h""",
    })
    baseline(p, f"{p}_anchor", "f")
    name(**{
        f"{p}_drops": f"""SELECT b.subject_id, m.t, 'lvef_ctrcd' AS kind, b.b, m.v, b.b - m.v AS chg FROM {p}_base_lvef b
            JOIN lvef m ON m.subject_id = b.subject_id AND m.t > b.f WHERE b.b >= 50 AND b.b - m.v >= 10 AND m.v < 50""",
        f"{p}_strains": f"""SELECT b.subject_id, m.t, 'gls_subclinical' AS kind, b.b, m.v, (m.v - b.b) / abs(b.b) AS chg FROM {p}_base_gls b
            JOIN gls m ON m.subject_id = b.subject_id AND m.t > b.f WHERE b.b < 0 AND (m.v - b.b) / abs(b.b) > 0.15""",
        f"{p}_echo": f"""SELECT DISTINCT ON (subject_id) subject_id, t AS first_echo_event_time, kind AS first_echo_event_type,
            CASE kind WHEN 'lvef_ctrcd' THEN b END AS baseline_lvef, CASE kind WHEN 'lvef_ctrcd' THEN v END AS event_lvef,
            CASE kind WHEN 'lvef_ctrcd' THEN chg END AS lvef_drop_pp, CASE kind WHEN 'gls_subclinical' THEN b END AS baseline_gls,
            CASE kind WHEN 'gls_subclinical' THEN v END AS event_gls, CASE kind WHEN 'gls_subclinical' THEN chg END AS gls_relative_decrease
            FROM (FROM {p}_drops UNION ALL FROM {p}_strains) ORDER BY subject_id, t, kind DESC, chg DESC""",
        f"{p}_event": f"""SELECT a.subject_id, least(hf_event_time, first_echo_event_time) AS first_event_time,
            CASE WHEN hf_event_time IS NULL OR first_echo_event_time < hf_event_time THEN first_echo_event_type ELSE 'hf_admission' END AS first_event_type,
            hf_event_time, hf_hadm_id, hf_icd_codes, {', '.join(ECHO)}
            FROM {p}_anchor a LEFT JOIN {p}_incident USING (subject_id) LEFT JOIN {p}_echo USING (subject_id)""",
        f"{p}_death": f"""SELECT subject_id, coalesce((SELECT max(deathtime) FROM adm s WHERE s.subject_id = p.subject_id), dod::TIMESTAMP) AS death_time
            FROM pat p WHERE dod IS NOT NULL AND subject_id IN (SELECT subject_id FROM {p}_anchor)""",
        f"{p}_seen": f"""SELECT subject_id, max(t) AS last_observation_time FROM (SELECT subject_id, unnest([admittime, dischtime]) AS t FROM adm
            UNION ALL SELECT subject_id, starttime FROM {p}_starts) WHERE subject_id IN (SELECT subject_id FROM {p}_anchor) GROUP BY subject_id""",
    })
    cycles = f"{p}_cycles"
    if first_class:
        name(**{
            f"{p}_firsts": f"""SELECT subject_id FROM (SELECT subject_id, min(starttime) FILTER (WHERE drug_class = '{first_class}') AS mine,
                min(starttime) FILTER (WHERE drug_class <> '{first_class}') AS other FROM {p}_starts GROUP BY subject_id)
                WHERE mine IS NOT NULL AND NOT coalesce(other < mine, FALSE)""",
            f"{p}_only": f"""SELECT c.*, CASE WHEN EXISTS (FROM {p}_starts s WHERE s.subject_id = c.subject_id AND s.drug_class <> '{first_class}'
                AND s.starttime::DATE BETWEEN c.cycle_start_date AND c.cycle_end_date) THEN 1 ELSE 0 END AS has_concurrent_other_class
                FROM {p}_cycles c WHERE drug_class = '{first_class}' AND subject_id IN (FROM {p}_firsts)""",
        })
        cycles = f"{p}_only"

    def body(events: str) -> str:
        return f"""SELECT * , prediction_time + to_days(toxicity_window_days) AS prediction_window_end FROM {cycles} LEFT JOIN {events} USING (subject_id)
            LEFT JOIN {p}_history USING (subject_id) LEFT JOIN {p}_death USING (subject_id) LEFT JOIN {p}_seen USING (subject_id)"""

    clean = "has_pre_existing_cardiac" if arrhythmia else "has_pre_existing_hf_or_cmp"
    if echo:
        labelled(p, "first_event_time", "died_in_window_before_event", clean, body(f"{p}_event"), f"{p}_table")
    else:
        labelled(p, "hf_event_time", "died_in_window_before_hf", clean, body(f"{p}_incident"), f"{p}_table")
    labelled(p, "first_echo_event_time", "died_in_window_before_echo_event", clean, body(f"{p}_echo"), f"{p}_echo_table")


cohort("ctrcd")
cohort("bimodal", windows=BIMODAL)
cohort("broad", arrhythmia=True)
cohort("narrow", incident=NARROW)
cohort("hf", classes=THREE, windows=HFWIN, incident=HF, echo=False)
cohort("hfb", classes=THREE, windows=HFWIN, incident=HF)
cohort("fco", windows=FIRSTWIN, first_class="anthracycline")
cohort("pcr", windows=CYCLEWIN, incident=HF, joint=True)
cohort("pcs", windows=CYCLEWIN, incident=HF, joint=True, strict=True)
cohort("pcu", windows=None, incident=HF, joint=True)


def main_chain(p: str, listed: str, codes: str, prior: bool, floor: bool, death: bool) -> None:
    name(**{
        f"{p}_drugs": f"""SELECT subject_id, pharmacy_id, starttime, lower(drug) AS drug, {class_case(GENERIC, "'other_oncology'")} AS drug_class
            FROM rx WHERE regexp_matches(lower(drug), '{listed}')""",
        f"{p}_starts": f"SELECT * FROM {p}_drugs WHERE subject_id IN (FROM elig)",
        f"{p}_anchor": f"SELECT subject_id, min(starttime) AS f FROM {p}_drugs WHERE subject_id IN (FROM elig) GROUP BY subject_id",
        f"{p}_prior": f"""SELECT DISTINCT a.subject_id FROM {p}_anchor a JOIN dx d ON d.subject_id = a.subject_id JOIN adm s ON s.hadm_id = d.hadm_id
            WHERE s.admittime <= a.f AND {coded(PRIOR, 'd')}""",
        f"{p}_index": f"SELECT * FROM {p}_anchor" + (f" WHERE subject_id IN (FROM {p}_prior)" if prior else ""),
    })
    exposures(p, "subject_id", MAINWIN, "Fallback window")
    baseline(p, f"{p}_index", "f")
    extra = "UNION ALL SELECT subject_id, dod::TIMESTAMP FROM pat WHERE dod IS NOT NULL" if death else ""
    name(**{
        f"{p}_stays": f"""SELECT i.subject_id, i.f, s.hadm_id, s.admittime AS t, bool_or({coded(codes, 'd')}) AS hit,
            string_agg(DISTINCT d.icd_code, ' | ' ORDER BY d.icd_code) AS codes
            FROM {p}_index i JOIN dx d ON d.subject_id = i.subject_id JOIN adm s ON s.hadm_id = d.hadm_id GROUP BY ALL""",
        f"{p}_lvef_events": f"""SELECT b.subject_id, m.t, b.b, m.v, b.b - m.v AS drop FROM {p}_base_lvef b JOIN lvef m
            ON m.subject_id = b.subject_id AND m.t >= b.f WHERE b.b - m.v >= 10 AND m.v < 50 {'AND b.b >= 50' if floor else ''}""",
        f"{p}_first": f"""SELECT DISTINCT ON (subject_id) subject_id, t AS first_toxicity_time, kind AS first_toxicity_type, v AS first_event_lvef,
            drop AS first_absolute_lvef_drop, codes AS first_cv_event_icd_codes FROM (
            SELECT subject_id, t, 'lvef_ctrctd' AS kind, v, drop, NULL AS codes FROM {p}_lvef_events UNION ALL
            SELECT subject_id, t, 'cv_diagnosis_admission', NULL, NULL, codes FROM {p}_stays WHERE hit AND t >= f)
            ORDER BY subject_id, t, kind, drop DESC, codes""",
        f"{p}_before": f"SELECT DISTINCT subject_id, 1 AS pre FROM {p}_stays WHERE hit AND t < f",
        f"{p}_points": f"""SELECT subject_id, admittime AS t FROM adm UNION ALL SELECT subject_id, t FROM lvef
            UNION ALL SELECT subject_id, starttime FROM {p}_drugs {extra}""",
        f"{p}_last": f"SELECT subject_id, max(t) AS last_observation_time FROM {p}_points GROUP BY subject_id",
        f"{p}_windowed": f"SELECT *, prediction_time + to_days(toxicity_window_days) AS prediction_window_end FROM {p}_cycles",
        f"{p}_seen_in": f"""SELECT DISTINCT w.subject_id, w.cycle_number, 1 AS seen FROM {p}_windowed w JOIN {p}_points o
            ON o.subject_id = w.subject_id AND o.t > w.prediction_time AND o.t <= w.prediction_window_end""",
        f"{p}_joined": f"""SELECT w.*, x.* EXCLUDE (subject_id), coalesce(pre, 0) AS pre_existing_cv_history, b.bt AS baseline_time, b.b AS baseline_lvef,
            last_observation_time, coalesce(seen, 0) AS has_observation_in_prediction_window,
            CASE WHEN first_toxicity_time <= prediction_time THEN 'exclude_already_toxic'
                WHEN first_toxicity_time <= prediction_window_end THEN 'positive'
                WHEN last_observation_time >= prediction_window_end THEN 'negative_observed'
                ELSE 'unknown_no_followup_evidence' END AS label
            FROM {p}_windowed w LEFT JOIN {p}_first x ON x.subject_id = w.subject_id LEFT JOIN {p}_before h ON h.subject_id = w.subject_id
            LEFT JOIN {p}_base_lvef b ON b.subject_id = w.subject_id LEFT JOIN {p}_last l ON l.subject_id = w.subject_id
            LEFT JOIN {p}_seen_in s ON s.subject_id = w.subject_id AND s.cycle_number = w.cycle_number""",
        f"{p}_table": f"""SELECT *, CASE WHEN label = 'positive' THEN 1 ELSE 0 END AS toxicity_in_window,
            CASE WHEN last_observation_time >= prediction_window_end THEN 1 ELSE 0 END AS observed_through_prediction_window,
            CASE WHEN label IN ('positive', 'negative_observed') THEN 1 ELSE 0 END AS eligible_for_binary_label,
            CASE label WHEN 'positive' THEN 1 WHEN 'negative_observed' THEN 0 END AS binary_label FROM {p}_joined""",
    })


main_chain("mva", V1_LIST, V1, prior=False, floor=False, death=False)
main_chain("mvb", "|".join(GENERIC.values()), V2, prior=True, floor=True, death=True)

name(
    yr_anchor=f"""SELECT subject_id, min(starttime) AS first_oncology_time FROM rx
        WHERE regexp_matches(lower(drug), '{V1_LIST}') AND subject_id IN (FROM elig) GROUP BY subject_id""",
    yr_coded=f"""SELECT DISTINCT a.subject_id, s.hadm_id, s.admittime AS t, a.first_oncology_time AS f
        FROM yr_anchor a JOIN dx d ON d.subject_id = a.subject_id JOIN adm s ON s.hadm_id = d.hadm_id WHERE {coded(YEAR, 'd')}""",
    yr_cv="""SELECT subject_id, min(t) AS first_cv_event_time_1yr, count(DISTINCT hadm_id) AS n_cv_event_admissions_1yr
        FROM yr_coded WHERE t >= f AND t < f + INTERVAL 1 YEAR GROUP BY subject_id""",
    yr_hist="""SELECT DISTINCT subject_id FROM yr_coded WHERE t < f""",
    yr_values="""SELECT subject_id, measurement_datetime AS t, TRY_CAST(result AS DOUBLE) AS v FROM ech WHERE measurement = 'lvef'""",
    yr_base="""SELECT DISTINCT ON (a.subject_id) a.subject_id, a.first_oncology_time, m.t AS baseline_time, m.v AS baseline_lvef
        FROM yr_anchor a LEFT JOIN yr_values m ON m.subject_id = a.subject_id AND m.t < a.first_oncology_time
        AND m.t >= a.first_oncology_time - INTERVAL 1 YEAR ORDER BY a.subject_id, m.t DESC NULLS LAST, m.v DESC NULLS LAST""",
    yr_lvef="""SELECT b.*, CASE WHEN baseline_lvef IS NULL THEN 0 ELSE 1 END AS has_baseline_lvef,
        CASE WHEN count(m.v) > 0 THEN 1 ELSE 0 END AS has_followup_lvef_1yr,
        min(m.v) AS worst_followup_lvef_1yr, min(m.t) AS first_followup_lvef_time_1yr,
        CAST(coalesce(bool_or(baseline_lvef - m.v >= 10), FALSE) AS INT) AS lvef_drop_10_1yr,
        CAST(coalesce(bool_or(m.v < 50), FALSE) AS INT) AS lvef_below_50_1yr,
        CAST(coalesce(bool_or(baseline_lvef - m.v >= 10 AND m.v < 50), FALSE) AS INT) AS definite_lvef_ctrcd_1yr
        FROM yr_base b LEFT JOIN yr_values m ON m.subject_id = b.subject_id AND m.t >= b.first_oncology_time
        AND m.t < b.first_oncology_time + INTERVAL 1 YEAR GROUP BY ALL""",
    yr_follow="""SELECT a.subject_id, 1 AS has_followup_admission_1yr, min(s.admittime) AS first_followup_admission_time_1yr,
        count(DISTINCT s.hadm_id) AS n_followup_admissions_1yr FROM yr_anchor a JOIN adm s ON s.subject_id = a.subject_id
        AND s.admittime >= a.first_oncology_time AND s.admittime < a.first_oncology_time + INTERVAL 1 YEAR GROUP BY a.subject_id""",
    yr_bits="""SELECT l.*, CASE WHEN c.subject_id IS NULL THEN 0 ELSE 1 END AS cv_event_1yr,
        CASE WHEN h.subject_id IS NULL THEN 0 ELSE 1 END AS pre_existing_cv_history, coalesce(has_followup_admission_1yr, 0) AS fa
        FROM yr_lvef l LEFT JOIN yr_cv c ON c.subject_id = l.subject_id LEFT JOIN yr_hist h ON h.subject_id = l.subject_id
        LEFT JOIN yr_follow a ON a.subject_id = l.subject_id""",
    yr_table="""SELECT * EXCLUDE (fa), CASE WHEN cv_event_1yr + definite_lvef_ctrcd_1yr > 0 THEN 1 ELSE 0 END AS cardiotoxicity_1yr,
        CASE WHEN cv_event_1yr + has_followup_lvef_1yr + fa > 0 THEN 1 ELSE 0 END AS has_outcome_evidence_1yr,
        CASE WHEN cv_event_1yr + definite_lvef_ctrcd_1yr > 0 THEN 'positive' WHEN has_followup_lvef_1yr + fa > 0 THEN 'negative_observed'
             ELSE 'unknown_no_followup_evidence' END AS cardiotoxicity_label_1yr,
        CASE WHEN cv_event_1yr + definite_lvef_ctrcd_1yr + has_followup_lvef_1yr + fa > 0 THEN 1 ELSE 0 END AS eligible_for_binary_label_1yr
        FROM yr_bits""",
)
