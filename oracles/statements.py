"""The oracle statement per registered query."""

from __future__ import annotations

import oracles.clinic  # noqa: F401
import oracles.scores  # noqa: F401
import oracles.sequences as sequences
from oracles import statement
from oracles.cohorts import ARR, BROAD, CMP, ECHO, GENERIC, HF, NAMES, NARROW, PRIOR, THREE, V1, V1_LIST, V2, YEAR, class_case, coded

ANY = "|".join(NAMES.values())
ANY3 = "|".join(NAMES[c] for c in THREE)
ANY_MAIN = "|".join(GENERIC.values())
CLASS_WINDOW_ROWS = "SELECT drug_class, days AS toxicity_window_days, why AS window_rationale FROM bimodal_windows"
GROUPS = """CASE WHEN drug_class IS NULL THEN 'unknown' WHEN drug_class = 'anthracycline' THEN 'Anthracycline' WHEN drug_class = 'her2_targeted' THEN 'HER2-targeted'
    WHEN drug_class = 'immune_checkpoint_inhibitor' THEN 'Immune checkpoint inhibitor' WHEN drug_class = 'taxane' THEN 'Taxane'
    WHEN drug_class = 'fluoropyrimidine' THEN 'Antimetabolite' ELSE 'Other targeted' END"""
FEATURES = [f"exposed_{c}" for c in GENERIC] + ["has_pre_existing_hf_or_cmp", "baseline_lvef", "cycle_number", "toxicity_window_days",
                                                "n_prescription_rows_in_cycle", "n_exposure_start_days_in_cycle"]
CLINICAL = f"""SELECT s.subject_id, s.cycle_number, s.binary_label, {', '.join(
    'coalesce(b.b, (SELECT median(b2.b) FROM smp s2 LEFT JOIN pcu_base_lvef b2 ON b2.subject_id = s2.subject_id)) AS f_baseline_lvef'
    if f == 'baseline_lvef' else f't.{f}::DOUBLE AS f_{f}' for f in FEATURES)}
    FROM smp s JOIN pcu_table t ON t.subject_id = s.subject_id AND t.cycle_number = s.cycle_number LEFT JOIN pcu_base_lvef b ON b.subject_id = s.subject_id"""
CLINICAL_BY_CLASS = f"""SELECT s.subject_id, s.cycle_number, s.drug_class, s.binary_label, {', '.join(
    'coalesce(b.b, (SELECT median(b2.b) FROM smp_c s2 LEFT JOIN ctrcd_base_lvef b2 ON b2.subject_id = s2.subject_id)) AS f_baseline_lvef' if f == 'baseline_lvef'
    else f"CASE WHEN s.drug_class = '{f.removeprefix('exposed_')}' THEN 1.0 ELSE 0.0 END::DOUBLE AS f_{f}" if f.startswith('exposed_') else f't.{f}::DOUBLE AS f_{f}' for f in FEATURES)}
    FROM smp_c s JOIN ctrcd_table t ON t.subject_id = s.subject_id AND t.cycle_number = s.cycle_number AND t.drug_class = s.drug_class
    LEFT JOIN ctrcd_base_lvef b ON b.subject_id = s.subject_id"""
YFLAGS = ["cv_event_1yr", "has_baseline_lvef", "has_followup_lvef_1yr", "lvef_drop_10_1yr", "lvef_below_50_1yr", "definite_lvef_ctrcd_1yr",
          "pre_existing_cv_history", "cardiotoxicity_1yr", "has_outcome_evidence_1yr"]
YLABEL = "CASE WHEN cardiotoxicity_1yr = 1 THEN 'positive' WHEN has_outcome_evidence_1yr = 1 THEN 'negative' ELSE 'unknown' END"
YLABELLED = f"""(SELECT *, {YLABEL} AS label, CAST(floor(epoch(first_oncology_time - baseline_time) / 86400) AS INT) AS days_baseline_to_drug,
    CAST(floor(epoch(first_followup_lvef_time_1yr - first_oncology_time) / 86400) AS INT) AS days_drug_to_first_followup_lvef FROM yr_table)"""


def table(p: str, echo: bool = True, echo_only: bool = False) -> str:
    source = f"{p}_echo_table" if echo_only else f"{p}_table"
    fix = " REPLACE (round(gls_relative_decrease, 6) AS gls_relative_decrease)" if echo else ""
    drop = " EXCLUDE (n_exposure_start_days_in_cycle, n_prescription_rows_in_cycle, window_rationale)" if echo_only else ""
    return f"SELECT *{drop}{fix} FROM {source}"


def describe(column: str) -> str:
    return f"""SELECT '{column}' AS variable, count({column}) AS n, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
        min({column})::DOUBLE AS min, round(quantile_cont({column}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({column}::DOUBLE, 0.5), 6) AS p50,
        round(quantile_cont({column}::DOUBLE, 0.75), 6) AS p75, max({column})::DOUBLE AS max, count(*) - count({column}) AS n_missing,
        round((count(*) - count({column})) / count(*) * 100, 2) AS pct_missing FROM {YLABELLED}"""


def breakdown(source: str, by: str, positive: str | None = None) -> str:
    extra = f", coalesce(sum({positive}), 0)::BIGINT AS n_positive_rows" if positive else ""
    return f"SELECT {by}, count(*) AS n_cycle_rows, count(DISTINCT subject_id) AS n_patients{extra} FROM {source} GROUP BY {by}"


def status(unknown: str) -> str:
    return f"""CASE WHEN bool_or(label = 'positive') THEN 'positive_patient' WHEN bool_or(label = 'negative_observed') THEN 'negative_observed_patient'
        WHEN bool_or(label = '{unknown}') THEN 'unknown_patient' WHEN bool_or(label = 'exclude_already_toxic') THEN 'only_excluded_rows_review'
        ELSE 'unclassified_review' END AS patient_status"""


def quartile(value: str, part: str) -> str:
    q = [f"quantile_cont({value}, {p}) OVER (PARTITION BY {part})" for p in (0.25, 0.5, 0.75)]
    return f"CASE WHEN {value} IS NULL THEN '' WHEN {value} <= {q[0]} THEN '1' WHEN {value} <= {q[1]} THEN '2' WHEN {value} <= {q[2]} THEN '3' ELSE '4' END"


def label_share(cohort: str, where: str) -> str:
    base = f"(SELECT {YLABEL} AS label FROM yr_table {where})"
    return f"""SELECT '{cohort}' AS cohort, l.label, count(b.label) AS n, round(count(b.label) / nullif((SELECT count(*) FROM {base}), 0) * 100, 2) AS pct
        FROM (SELECT unnest(['positive', 'negative', 'unknown']) AS label) l LEFT JOIN {base} b ON b.label = l.label GROUP BY l.label"""


def overview(cohort: str, where: str, applied: int) -> str:
    return f"""SELECT '{cohort}' AS cohort, unnest(['original_n_patients', 'analyzed_n_patients', 'excluded_due_to_pre_existing_cv_history',
        'excluded_cv_history_applied', 'unique_subjects']) AS label, unnest([o, a, o - a, {applied}, u]) AS n, NULL::DOUBLE AS pct
        FROM (SELECT (SELECT count(*) FROM yr_table) AS o, count(*) AS a, count(DISTINCT subject_id) AS u FROM yr_table {where})"""


def count_stats(source: str, label: str) -> str:
    return f"""SELECT '{label}' AS rows_of, count(*) AS num_keys, round(avg(n), 6) AS mean, round(median(n), 6) AS median, min(n) AS min, max(n) AS max,
        round(stddev_samp(n), 6) AS std FROM (SELECT subject_id, count(*) AS n FROM {source} GROUP BY subject_id)"""


SQL: dict[str, str] = {
    # sources and sinks
    "src_csv": "SELECT * FROM pat",
    "src_pruned": "SELECT subject_id, hadm_id, admittime FROM adm",
    "src_semijoin_scan": """SELECT * FROM lab WHERE storetime IS NOT NULL AND flag IS NOT NULL AND subject_id IN (FROM elig)
        AND hadm_id IN (SELECT hadm_id FROM adm WHERE subject_id IN (FROM elig))""",
    "src_parquet_else_csv": "SELECT *, unnest(['parquet', 'csv']) AS found FROM prc",
    "src_inline_values": f"SELECT w.*, count(s.subject_id) AS n_rows FROM ({CLASS_WINDOW_ROWS}) w LEFT JOIN ctrcd_starts s USING (drug_class) GROUP BY ALL",
    "src_json_runs": """SELECT variant AS grp, seed::VARCHAR AS seed, CASE WHEN seed % 2 = 0 THEN 1 ELSE 0 END AS preferred, round(auroc, 6) AS auroc,
        round(auprc, 6) AS auprc, CASE WHEN seed % 2 = 0 THEN u.f1 ELSE c.f1 END AS f1, CASE WHEN seed % 2 = 0 THEN u.sensitivity ELSE c.sensitivity END AS sensitivity,
        CASE WHEN seed % 2 = 0 THEN u.specificity ELSE c.specificity END AS specificity, round(loss, 6) AS loss
        FROM cs_rates c JOIN cu_rates u USING (variant, seed) JOIN gs_auc USING (variant, seed) JOIN gs_ap USING (variant, seed) JOIN gs_loss USING (variant, seed)""",
    "sink_table": "SELECT * FROM ctrcd_cycles",
    "sink_sequences": f"""SELECT subject_id, cycle_number, concept_ids || repeat(' 0', {sequences.LEN} - seq_len) AS concept_ids,
        rtrim(repeat('1 ', seq_len) || repeat('0 ', {sequences.LEN} - seq_len)) AS attention_mask, seq_len FROM sq_text""",
    "sink_vocab_meta": f"""SELECT token, id::BIGINT AS value FROM voc UNION ALL SELECT 'meta:' || unnest(['n_samples', 'n_positive', 'n_truncated', 'max_seq_len_observed']),
        unnest([count(*), sum(binary_label), count(*) FILTER (WHERE raw_seq_len > {sequences.LEN}), max(seq_len)])::BIGINT FROM sq_text JOIN smp USING (subject_id, cycle_number)""",
    "sink_predictions": """SELECT 'test' AS split, row_idx AS split_pos, row_idx, subject_id, cycle_number, prediction_time, y AS true_label,
        CAST(p >= 0.5 AS INT) AS pred_label, round(p, 6) AS prob_cardiotoxic, CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS correct FROM sc""",
    "sink_splits": """SELECT 42 AS seed, split, subject_id, count(*) AS n_cycles, string_agg(row_idx, ';' ORDER BY row_idx) AS row_indices
        FROM smp JOIN sp USING (subject_id) GROUP BY split, subject_id""",
    # filters
    "code_range_filter": "SELECT DISTINCT subject_id, hadm_id, seq_num, icd_code, icd_version FROM cancer_rows",
    "code_prefix_filter": f"""SELECT * FROM (SELECT subject_id, hadm_id, seq_num, icd_code, icd_version, {', '.join(
        f'CAST({coded(c)} AS INT) AS is_{n}' for n, c in (('hf', HF), ('hf_cmp', {10: 'I50|I42', 9: '428|425'}), ('arrhythmia', ARR), ('broad', BROAD),
        ('narrow', NARROW), ('prior', PRIOR), ('past', {9: 'V10', 10: 'Z85'}), ('main_v1', V1), ('main_v2', V2), ('one_year', YEAR)))} FROM dx)
        WHERE is_hf + is_hf_cmp + is_arrhythmia + is_broad + is_narrow + is_prior + is_past + is_main_v1 + is_main_v2 + is_one_year > 0""",
    "procedure_filter": """SELECT subject_id, hadm_id, seq_num, chartdate, icd_code, icd_version FROM prc WHERE (icd_version = 9 AND (icd_code LIKE '922%'
        OR icd_code = '9925')) OR (icd_version = 10 AND icd_code LIKE 'D7%')""",
    "drug_regex_prefilter": f"""SELECT * FROM (SELECT subject_id, hadm_id, pharmacy_id, starttime, lower(drug) AS drug, CAST(regexp_matches(lower(drug), '{ANY}') AS INT) AS in_ten,
        CAST(regexp_matches(lower(drug), '{ANY3}') AS INT) AS in_three, CAST(regexp_matches(lower(drug), '{V1_LIST}') AS INT) AS in_main_v1,
        CAST(regexp_matches(lower(drug), '{ANY_MAIN}') AS INT) AS in_main_v2 FROM rx) WHERE in_ten + in_three + in_main_v1 + in_main_v2 > 0""",
    "drug_like_prefilter": "SELECT subject_id, hadm_id, pharmacy_id, starttime, lower(drug) AS drug FROM rx WHERE " + " OR ".join(
        f"drug ILIKE '%{t}%'" for t in ("doxorubicin", "daunorubicin", "epirubicin", "cyclophosphamide", "cisplatin", "carboplatin", "5-fu", "fluorouracil",
                                        "capecitabine", "trastuzumab", "paclitaxel", "docetaxel", "sunitinib", "sorafenib", "imatinib")),
    "drug_classify": f"""SELECT subject_id, hadm_id, pharmacy_id, starttime, lower(drug) AS drug, {class_case(NAMES)} AS class_ten,
        {class_case({c: NAMES[c] for c in THREE})} AS class_three, {class_case(GENERIC, "'other_oncology'")} AS class_main FROM rx WHERE starttime IS NOT NULL""",
    "class_group_map": f"SELECT drug_class, {GROUPS} AS drug_group, count(*) AS n FROM (SELECT {class_case(NAMES)} AS drug_class FROM rx) GROUP BY drug_class",
    "measurement_extract": """SELECT subject_id, t AS measurement_datetime, 'lvef' AS kind, v AS value FROM lvef
        UNION ALL SELECT subject_id, t, 'gls', v FROM gls""",
    "threshold_filter": "SELECT subject_id, t AS measurement_datetime, v AS lvef_value FROM lvef WHERE v < 50",
    "year_filter": "SELECT subject_id, hadm_id, admittime, dischtime FROM adm WHERE EXTRACT(year FROM admittime) IN (1996, 1999)",
    "lab_filter": f"SELECT subject_id, hadm_id, itemid, storetime, flag FROM lab WHERE storetime IS NOT NULL AND flag IS NOT NULL AND itemid IN ({sequences.PANEL})",
    "membership_filter": "SELECT subject_id, hadm_id, admittime FROM adm WHERE subject_id IN (FROM elig)",
    "null_defaults": """SELECT subject_id, CASE WHEN subject_id IN (FROM elig) THEN 1 ELSE 0 END AS is_eligible, coalesce(dod, DATE '9999-12-31') AS dod FROM pat""",
    "binary_table_filter": """SELECT 'strict' AS kind, drug_class, subject_id, cycle_number, label, binary_label FROM ctrcd_table WHERE eligible_strict = 1
        UNION ALL SELECT 'inclusive', drug_class, subject_id, cycle_number, label, binary_label FROM ctrcd_table WHERE eligible_inclusive = 1
        UNION ALL SELECT 'main', NULL, subject_id, cycle_number, label, binary_label FROM mvb_table
            WHERE eligible_for_binary_label = 1 AND coalesce(baseline_lvef >= 50, TRUE)""",
    # joins
    "join_inner_chain": f"""SELECT d.subject_id, d.hadm_id, icd_code, icd_version, a.f AS first_drug_time, s.admittime, s.dischtime
        FROM ctrcd_anchor a JOIN dx d ON d.subject_id = a.subject_id JOIN adm s ON s.hadm_id = d.hadm_id WHERE {coded(BROAD, 'd')}""",
    "join_cohort_restrict": "SELECT * FROM ctrcd_starts",
    "join_left_assemble": """SELECT subject_id, drug_class, cycle_number, first_event_time, has_pre_existing_hf_or_cmp, death_time, last_observation_time FROM ctrcd_table""",
    "join_left_lookup": """SELECT p.subject_id, p.hadm_id, seq_num, admittime, visit_id FROM prc p LEFT JOIN (SELECT *, row_number() OVER
        (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS visit_id FROM adm WHERE subject_id IN (FROM elig)) v ON v.hadm_id = p.hadm_id""",
    "join_dim_broadcast": f"""SELECT subject_id, pharmacy_id, starttime, drug_class, toxicity_window_days, window_rationale
        FROM ctrcd_starts LEFT JOIN ({CLASS_WINDOW_ROWS}) USING (drug_class)""",
    "join_semi_in": "SELECT * FROM ech WHERE subject_id IN (SELECT subject_id FROM ctrcd_anchor)",
    "join_anti_first_class": """SELECT a.subject_id, a.drug_class AS first_class FROM (SELECT subject_id, drug_class, min(starttime) AS t FROM ctrcd_starts GROUP BY ALL) a
        WHERE drug_class IN ('anthracycline', 'taxane') AND NOT EXISTS (FROM ctrcd_starts o WHERE o.subject_id = a.subject_id
        AND o.drug_class <> a.drug_class AND o.starttime < a.t)""",
    "join_exists_range": """SELECT subject_id, cycle_number, 'concurrent' AS kind, has_concurrent_other_class AS found FROM fco_only
        UNION ALL SELECT w.subject_id, w.cycle_number, 'observed', CASE WHEN EXISTS (FROM mvb_points o WHERE o.subject_id = w.subject_id
            AND o.t > w.prediction_time AND o.t <= w.prediction_window_end) THEN 1 ELSE 0 END FROM mvb_windowed w""",
    "join_asof_lookback": """SELECT l.subject_id, l.f AS first_drug_time, l.bt AS baseline_lvef_time, l.b AS baseline_lvef, g.bt AS baseline_gls_time,
        g.b AS baseline_gls FROM ctrcd_base_lvef l JOIN ctrcd_base_gls g USING (subject_id)""",
    "join_range_followup": """SELECT a.subject_id, a.f AS first_drug_time, m.t AS measurement_datetime, m.v AS lvef_value FROM ctrcd_anchor a
        JOIN lvef m ON m.subject_id = a.subject_id AND m.t >= a.f AND m.t < a.f + INTERVAL 1 YEAR""",
    "join_day_expand": """SELECT n.subject_id, n.cycle_number, count(*) AS n_joined_rows, count(DISTINCT n.d) AS n_days,
        CAST(sum(n.n) AS BIGINT) AS n_prescription_rows_joined FROM pcu_numbered n JOIN pcu_starts s ON s.subject_id = n.subject_id AND s.starttime::DATE = n.d GROUP BY ALL""",
    "join_cumulative_window": """SELECT b.subject_id, b.cycle_number, b.visit_id, count(*) AS n_before, max(b.event_time) AS last_before,
        CASE WHEN count(*) = any_value(w.n) THEN 1 ELSE 0 END AS whole FROM before b JOIN (SELECT subject_id, visit_id, count(*) AS n FROM tl GROUP BY ALL) w
        ON w.subject_id = b.subject_id AND w.visit_id = b.visit_id GROUP BY b.subject_id, b.cycle_number, b.visit_id""",
    "join_enrich_samples": """SELECT s.subject_id, s.cycle_number, t.drug_classes_in_cycle, t.n_prescription_rows_in_cycle,
        first_value(t.drug_classes_in_cycle) OVER (PARTITION BY s.subject_id ORDER BY s.cycle_number) AS primary_drug_class
        FROM smp s LEFT JOIN pcr_table t USING (subject_id, cycle_number)""",
    "intersect_patients": f"""SELECT subject_id, 'drugs' AS other FROM elig WHERE subject_id IN (SELECT subject_id FROM rx WHERE regexp_matches(lower(drug), '{ANY}'))
        UNION ALL SELECT subject_id, 'low_lvef' FROM elig WHERE subject_id IN (SELECT subject_id FROM lvef WHERE v < 50)
        UNION ALL SELECT subject_id, 'procedures' FROM elig WHERE subject_id IN (SELECT subject_id FROM prc WHERE (icd_version = 9
            AND regexp_matches(icd_code, '^(922|9925$)')) OR (icd_version = 10 AND icd_code LIKE 'D7%'))""",
    # aggregations
    "agg_first_exposure": "SELECT subject_id, f AS first_drug_time FROM ctrcd_anchor",
    "agg_class_span": "SELECT subject_id, drug_class, min(starttime) AS first_class_drug_time, max(starttime) AS last_class_drug_time FROM ctrcd_starts GROUP BY ALL",
    "agg_exposure_days": """SELECT subject_id, drug_class, d AS start_date, t0 AS first_starttime_that_day, n AS n_prescription_rows_that_day, day_list AS drugs_that_day,
        drug_class AS classes_that_day FROM ctrcd_days UNION ALL SELECT subject_id, NULL, starttime::DATE, min(starttime), count(*),
        string_agg(DISTINCT drug, ' | ' ORDER BY drug), string_agg(DISTINCT drug_class, ' | ' ORDER BY drug_class) FROM ctrcd_starts GROUP BY subject_id, starttime::DATE""",
    "agg_cycles_by_class": "SELECT * FROM ctrcd_cycles",
    "agg_cycles_joint": "SELECT * FROM pcr_cycles",
    "agg_pivot_flags": "SELECT subject_id, " + ", ".join(f"CAST(bool_or(drug_class = '{c}') AS INT) AS exposed_{c}" for c in NAMES) + " FROM ctrcd_starts GROUP BY subject_id",
    "agg_admission_flag": """SELECT 'main_v1' AS chain, subject_id, f AS first_oncology_time, hadm_id, t AS admittime, CAST(hit AS INT) AS cv_event, codes AS cv_event_icd_codes FROM mva_stays
        UNION ALL SELECT 'main_v2', subject_id, f, hadm_id, t, CAST(hit AS INT), codes FROM mvb_stays""",
    "agg_outcome_1yr": "SELECT subject_id, 1 AS cv_event_1yr, first_cv_event_time_1yr, n_cv_event_admissions_1yr FROM yr_cv",
    "agg_lvef_outcome_1yr": "SELECT * FROM yr_lvef",
    "agg_followup_1yr": "SELECT * FROM yr_follow",
    "agg_last_observation": "SELECT *, 'class' AS chain FROM ctrcd_seen UNION ALL SELECT *, 'main' FROM mvb_last",
    "agg_death_time": "SELECT * FROM ctrcd_death",
    "agg_count_stats": count_stats("adm", "admissions") + " UNION ALL " + count_stats("ech", "echo"),
    "agg_distinct_patients": """SELECT count(DISTINCT subject_id) AS n_patients, 'echo' AS table_name FROM ech UNION ALL SELECT count(DISTINCT subject_id), 'diagnoses' FROM dx
        UNION ALL SELECT count(DISTINCT subject_id), 'patients' FROM pat UNION ALL SELECT count(DISTINCT subject_id), 'procedures' FROM prc
        WHERE (icd_version = 9 AND regexp_matches(icd_code, '^(922|9925$)')) OR (icd_version = 10 AND icd_code LIKE 'D7%')""",
    "agg_label_breakdown": breakdown("ctrcd_table", "drug_class, label"),
    "agg_binary_breakdown": breakdown("(FROM ctrcd_table WHERE eligible_inclusive = 1)", "drug_class, label, binary_label"),
    "agg_class_breakdown": f"""SELECT 'class' AS by, drug_classes_in_cycle, NULL::INT AS cycle_number, * EXCLUDE (drug_classes_in_cycle) FROM
        ({breakdown('mva_table', 'drug_classes_in_cycle', 'toxicity_in_window')}) UNION ALL
        SELECT 'cycle', NULL, cycle_number, * EXCLUDE (cycle_number) FROM ({breakdown('mva_table', 'cycle_number', 'toxicity_in_window')})""",
    "agg_preexisting_breakdown": """SELECT has_pre_existing_hf, has_pre_existing_cmp, has_pre_existing_arrhythmia, count(DISTINCT subject_id) AS n_patients
        FROM broad_table GROUP BY ALL""",
    "agg_patient_status": f"SELECT subject_id, {status('unknown_insufficient_followup')} FROM ctrcd_table GROUP BY subject_id",
    "agg_patient_summary": f"""SELECT patient_status, count(*) AS n_patients FROM (SELECT subject_id, {status('unknown_no_followup_evidence')}
        FROM mva_table GROUP BY subject_id) GROUP BY patient_status""",
    "agg_cohort_accounting": " UNION ALL ".join(f"SELECT 'patients_in_{n}' AS metric, count(DISTINCT subject_id) AS n_patients FROM {s}" for n, s in (
        ("eligible", "elig"), ("first_drug", "ctrcd_anchor"), ("table", "ctrcd_table"), ("inclusive", "ctrcd_table WHERE eligible_inclusive = 1"),
        ("strict", "ctrcd_table WHERE eligible_strict = 1"))),
    "agg_group_quartiles": """SELECT 'lab ' || itemid AS item, round(quantile_cont(valuenum, 0.25), 6) AS p25, round(quantile_cont(valuenum, 0.5), 6) AS p50,
        round(quantile_cont(valuenum, 0.75), 6) AS p75 FROM lab WHERE valuenum IS NOT NULL GROUP BY itemid
        UNION ALL SELECT 'dose ' || trim(lower(drug)), round(quantile_cont(x, 0.25), 6), round(quantile_cont(x, 0.5), 6), round(quantile_cont(x, 0.75), 6)
        FROM (SELECT drug, TRY_CAST(regexp_extract(dose_val_rx, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS x FROM rx) WHERE x IS NOT NULL GROUP BY trim(lower(drug))""",
    "agg_describe_missing": " UNION ALL ".join(describe(c) for c in ("baseline_lvef", "worst_followup_lvef_1yr", "days_baseline_to_drug", "days_drug_to_first_followup_lvef")),
    "agg_flag_summary": " UNION ALL ".join(f"""SELECT '{c}' AS variable, sum({c})::BIGINT AS n_positive, count(*) AS n_total,
        round(sum({c}) / count(*) * 100, 2) AS pct_positive FROM yr_table""" for c in YFLAGS),
    "agg_label_component": f"SELECT label, {', '.join(f'round(avg({c}) * 100, 2) AS pct_{c}' for c in YFLAGS)} FROM {YLABELLED} GROUP BY label",
    "agg_label_pct": " UNION ALL ".join([
        label_share("full_cohort", ""), label_share("excluded_pre_existing_cv_history", "WHERE pre_existing_cv_history = 0"),
        overview("full_cohort", "", 0), overview("excluded_pre_existing_cv_history", "WHERE pre_existing_cv_history = 0", 1)]),
    "agg_seq_stats": f"""SELECT count(*) AS n_samples, sum(binary_label)::BIGINT AS n_positive, count(*) - sum(binary_label)::BIGINT AS n_negative,
        round(avg(binary_label), 6) AS positive_rate, round(avg(seq_len), 6) AS mean_seq_len, round(median(seq_len), 6) AS median_seq_len,
        round(stddev_pop(seq_len), 6) AS std_seq_len, min(seq_len) AS min_seq_len, max(seq_len) AS max_seq_len_observed,
        count(*) FILTER (WHERE raw_seq_len > {sequences.LEN}) AS n_truncated, (SELECT max(v) FROM sq_rows) AS max_visit_id
        FROM sq_text JOIN smp USING (subject_id, cycle_number)""",
    "agg_dataset_summary": """SELECT 'cohort' AS section, unnest(['n_patients', 'n_samples', 'max_cycle', 'mean_cycles', 'median_cycles', 'positive_patients']) AS item,
            unnest([count(*), sum(n), max(last), round(avg(n), 6), median(n), sum(pos)])::DOUBLE AS value FROM (SELECT subject_id, count(*) AS n,
            max(cycle_number) AS last, max(binary_label) AS pos FROM smp GROUP BY subject_id)
        UNION ALL SELECT 'length_from', e::VARCHAR, count(*)::DOUBLE FROM (SELECT CASE WHEN seq_len < 50 THEN 0 WHEN seq_len < 100 THEN 50 WHEN seq_len < 200 THEN 100
            WHEN seq_len < 300 THEN 200 WHEN seq_len < 400 THEN 300 WHEN seq_len < 500 THEN 400 ELSE 500 END AS e FROM sq_text) GROUP BY e
        UNION ALL SELECT 'age_decade', least(9, floor(age_years / 10))::INT::VARCHAR, count(*)::DOUBLE FROM smp GROUP BY 2
        UNION ALL SELECT 'vocab_type', split_part(token, '::', 1), count(*)::DOUBLE FROM voc WHERE contains(token, '::') GROUP BY 2
        UNION ALL SELECT 'vocabulary', 'used', count(DISTINCT cid)::DOUBLE FROM sq_rows WHERE cid > 4
        UNION ALL SELECT 'vocabulary', 'size', count(*)::DOUBLE FROM voc""",
    "agg_split_summary": """SELECT split, count(DISTINCT subject_id) AS n_patients, count(*) AS n_samples, sum(binary_label)::BIGINT AS n_positive,
        sum(1 - binary_label)::BIGINT AS n_negative, round(100 * sum(binary_label) / count(*), 1) AS pct_positive,
        round(100 * count(DISTINCT subject_id) / (SELECT count(*) FROM sp), 1) AS pct_patients FROM smp JOIN sp USING (subject_id) GROUP BY split""",
    # windows
    "win_gap": """SELECT subject_id, drug_class, d AS start_date, pd AS previous_start_date, CAST(d - pd AS INT) AS days_since_previous_start FROM ctrcd_gaps""",
    "win_sessionize": """SELECT subject_id, drug_class, d AS start_date, CASE WHEN coalesce(d - pd, 99) > 7 THEN 1 ELSE 0 END AS is_new_cycle, cycle_number FROM ctrcd_numbered
        UNION ALL SELECT subject_id, NULL, d, CASE WHEN coalesce(d - pd, 99) > 7 THEN 1 ELSE 0 END, cycle_number FROM pcr_numbered""",
    "win_sessionize_stream": "SELECT * FROM ctrcd_cycles",
    "materialize_incremental": "SELECT * FROM ctrcd_cycles",
    "win_first_event": "SELECT * FROM ctrcd_incident",
    "win_first_of_union": "SELECT * FROM mva_first",
    "win_visit_number": "SELECT subject_id, hadm_id, admittime, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS visit_id FROM adm",
    "win_event_priority": """SELECT subject_id, hadm_id, starttime, pharmacy_id, trim(lower(drug)) AS drug_norm, CAST(row_number() OVER
        (PARTITION BY subject_id, hadm_id, starttime ORDER BY pharmacy_id, trim(lower(drug))) - 1 AS INT) AS event_priority FROM rx""",
    "win_share_in_group": f"""SELECT pre_existing_cv_history, label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pre_existing_cv_history) * 100, 2) AS pct
        FROM {YLABELLED} GROUP BY pre_existing_cv_history, label""",
    "win_visit_change": """SELECT * FROM (SELECT subject_id, cycle_number, position, v AS visit_id, lag(v) OVER w AS previous_visit, CAST(lag(day) OVER w AS INT) AS previous_date,
        CAST(day - lag(day) OVER w AS INT) AS days FROM sq_rows WHERE position > 0 WINDOW w AS (PARTITION BY subject_id, cycle_number ORDER BY position))
        WHERE previous_visit IS DISTINCT FROM visit_id""",
    "win_tail_k": "SELECT subject_id, cycle_number, concept_ids, seq_len, raw_seq_len FROM sqk_text",
    "win_first_value": "SELECT subject_id, arg_min(drug_classes_in_cycle, cycle_number) AS first_class FROM pcr_cycles GROUP BY subject_id",
    # sort, limit, top-k
    "sort_export": "SELECT subject_id, drug_class, cycle_number, prediction_time FROM ctrcd_cycles ORDER BY ALL",
    "sort_timeline": """SELECT subject_id, visit_id, event_time, event_type, event_priority, concept_token, row_number() OVER (PARTITION BY subject_id
        ORDER BY visit_id, event_time, event_type, event_priority, concept_token) AS place FROM tl""",
    "limit_preview": "SELECT subject_id, hadm_id, admittime FROM adm ORDER BY subject_id, hadm_id LIMIT 25",
    "topk_global": """SELECT * FROM (SELECT 'token' AS kind, subject_id, position, ig_score_l2 FROM att ORDER BY ig_score_l2 DESC, subject_id, position LIMIT 40)
        UNION ALL SELECT * FROM (SELECT 'subject', subject_id, count(*), NULL FROM mva_table GROUP BY subject_id ORDER BY 3 DESC, 2 LIMIT 10)""",
    "topk_per_group": """SELECT subject_id, cycle_number, v AS visit_id, position, cid AS concept_id, CAST(row_number() OVER (PARTITION BY subject_id, cycle_number, v
        ORDER BY position) AS INT) AS rank_in_visit FROM sq_rows QUALIFY rank_in_visit <= 3""",
    # set operations
    "set_union_distinct": "SELECT DISTINCT subject_id FROM (SELECT subject_id FROM cancer_rows UNION ALL SELECT subject_id FROM history_rows)",
    "set_union_all": """SELECT subject_id, admittime AS observation_time, 'admission' AS kind, NULL::VARCHAR AS drug_class FROM adm WHERE subject_id IN (SELECT subject_id FROM ctrcd_anchor)
        UNION ALL SELECT subject_id, dischtime, 'discharge', NULL FROM adm WHERE subject_id IN (SELECT subject_id FROM ctrcd_anchor)
        UNION ALL SELECT subject_id, starttime, 'drug_administration', drug_class FROM ctrcd_starts""",
    "set_concat_events": "SELECT event_type, count(*) AS n, count(DISTINCT subject_id) AS n_patients, count(DISTINCT concept_token) AS n_tokens FROM tl GROUP BY event_type",
    "set_distinct": f"SELECT DISTINCT subject_id, icd_code FROM dx WHERE {coded(BROAD)}",
    "set_difference": "SELECT concept_token AS token FROM tl EXCEPT SELECT token FROM reserved",
    # scalar functions
    "fn_string": """SELECT subject_id, pharmacy_id, starttime, lower(drug) AS lowered, left(drug, 3) AS head, CAST(suffix(drug, 'mab') AS INT) AS is_mab,
        CASE WHEN lower(drug) LIKE 'asp%' THEN 0 ELSE 1 END AS not_asp, trim(lower(drug)) AS name, CAST(prefix(drug, 'Tra') AS INT) AS starts_tra FROM rx""",
    "fn_regex": """SELECT subject_id, pharmacy_id, starttime, CAST(regexp_matches(lower(drug), 'rubicin|mab$') AS INT) AS hit,
        TRY_CAST(regexp_extract(dose_val_rx, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS dose FROM rx""",
    "fn_cast": """SELECT subject_id, measurement_datetime, measurement, TRY_CAST(result AS DOUBLE) AS value, TRY_CAST(result AS INT) AS whole,
        measurement_datetime::DATE AS day, NULL::TIMESTAMP AS as_time FROM ech""",
    "fn_date": """SELECT hadm_id, admittime::DATE AS day, CAST(date_diff('day', admittime, dischtime) AS INT) AS days, CAST(year(admittime) AS INT) AS year,
        admittime + to_days(90) AS plus_90, admittime - to_years(1) AS minus_year, CAST(greatest(date_diff('day', DATE '2000-01-01', admittime::DATE), 0) AS INT) AS epoch_days FROM adm""",
    "fn_math": """SELECT subject_id, measurement_datetime, measurement, abs(v) AS size, round(v / 7, 6) AS ratio, v - 50 AS diff, CAST(floor(v / 10) AS BIGINT) AS tens,
        CASE WHEN v > 45 OR v IS NULL THEN 45 WHEN v < 0 THEN 0 ELSE v END AS clipped FROM (SELECT *, TRY_CAST(result AS DOUBLE) AS v FROM ech)""",
    "fn_conditional": """SELECT subject_id, measurement_datetime, measurement, ifnull(v, -1) AS value, CASE WHEN v IS NULL THEN 'missing' WHEN v < 0 THEN 'negative'
        WHEN v < 40 THEN 'low' WHEN v < 50 THEN 'mid' ELSE 'high' END AS band FROM (SELECT *, TRY_CAST(result AS DOUBLE) AS v FROM ech)""",
    "fn_age": """SELECT hadm_id, a::DOUBLE AS age_years, CAST(least(9, a // 10) AS INT) AS age_id FROM (SELECT hadm_id,
        coalesce(greatest(0, anchor_age + year(admittime) - anchor_year), 0) AS a FROM adm LEFT JOIN pat USING (subject_id))""",
    "fn_gap_token": """SELECT hadm_id, CASE WHEN g < 28 THEN 'W' || (g // 7) WHEN g < 360 THEN 'M' || (g // 30) ELSE 'LT' END AS token,
        CAST(CASE WHEN g < 28 THEN 5 + g // 7 WHEN g < 30 THEN 1 WHEN g < 360 THEN 8 + g // 30 ELSE 20 END AS INT) AS token_id
        FROM (SELECT hadm_id, hadm_id % 400 AS g FROM adm)""",
    "fn_quartile_bucket": f"""SELECT subject_id, hadm_id, itemid, storetime, CASE WHEN valuenum IS NULL THEN '' ELSE '_Q' || ({quartile('valuenum', 'itemid')}) END AS suffix FROM lab""",
    "fn_token_label": "SELECT token, label, event_type, count(*) AS n FROM att_named GROUP BY ALL",
    "fn_array": """SELECT subject_id, cycle_number, CAST(len(a) AS INT) AS n, array_to_string(a[-3:], ' ') AS tail, a[1] AS head, CAST(list_contains(a, 1) AS INT) AS has_unknown,
        CAST(list_position(a, a[-1]) AS BIGINT) AS first_place_of_last FROM (SELECT subject_id, cycle_number, list(cid ORDER BY position) AS a FROM sq_rows GROUP BY ALL)""",
    "fn_json": """SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{"k":' || (props->>'k') || ',"user":' || user_id || '}' AS text FROM events""",
    # outcomes and labels
    "eligible_patients": "SELECT subject_id FROM elig",
    "prior_dx_check": f"""SELECT DISTINCT a.subject_id FROM (SELECT subject_id, min(starttime) AS f FROM mvb_drugs GROUP BY subject_id) a JOIN dx d ON d.subject_id = a.subject_id
        JOIN adm s ON s.hadm_id = d.hadm_id WHERE s.admittime <= a.f AND {coded(PRIOR, 'd')}""",
    "preexisting_flags": "SELECT * FROM broad_history",
    "incident_event": "SELECT * FROM narrow_incident",
    "lvef_drop_event": """SELECT subject_id, t AS event_time, b AS baseline_lvef, v AS event_lvef, chg AS lvef_drop_pp, 'class' AS chain FROM ctrcd_drops
        UNION ALL SELECT subject_id, t, b, v, drop, 'main' FROM mva_lvef_events""",
    "gls_relative_event": """SELECT subject_id, t AS event_time, kind AS event_type, b AS baseline_gls, v AS event_gls, round(chg, 6) AS gls_relative_decrease FROM ctrcd_strains""",
    "first_echo_event": "SELECT * REPLACE (round(gls_relative_decrease, 6) AS gls_relative_decrease) FROM ctrcd_echo",
    "combined_event": "SELECT * REPLACE (round(gls_relative_decrease, 6) AS gls_relative_decrease) FROM ctrcd_event",
    "label_5way": "SELECT subject_id, drug_class, cycle_number, label FROM ctrcd_table",
    "label_4way": "SELECT subject_id, cycle_number, label, binary_label, toxicity_in_window, eligible_for_binary_label FROM mva_table",
    "label_flags": """SELECT subject_id, drug_class, cycle_number, binary_label, eligible_strict, eligible_inclusive, observed_through_prediction_window,
        died_in_window_before_event FROM ctrcd_table""",
    "label_1yr_master": """SELECT subject_id, cv_event_1yr, definite_lvef_ctrcd_1yr, cardiotoxicity_1yr, has_outcome_evidence_1yr, cardiotoxicity_label_1yr,
        eligible_for_binary_label_1yr FROM yr_table""",
    "label_echo_only": table("hf", echo_only=True),
    "label_multi_horizon": """SELECT subject_id, cycle_number, prediction_time, CAST(task_id AS INT) AS task_id, CAST(window_days AS INT) AS window_days,
        CASE WHEN window_days = 365 THEN binary_label WHEN epoch(first_event_time - prediction_time) / 86400.0 > 0 AND epoch(first_event_time - prediction_time) / 86400.0 <= window_days
        THEN 1 ELSE 0 END AS binary_label FROM smp, (SELECT unnest([0, 1, 2]) AS task_id, unnest([90, 180, 365]) AS window_days)""",
    # cohorts
    "cohort_pan_cancer_ctrcd": table("ctrcd"),
    "cohort_pan_cancer_bimodal": table("bimodal"),
    "cohort_broad_cv": table("broad"),
    "cohort_per_cycle_strict": table("pcs"),
    "cohort_narrow_cv": table("narrow"),
    "cohort_hf": table("hf", echo=False),
    "cohort_hf_v2": table("hfb"),
    "cohort_first_class_only": table("fco"),
    "cohort_per_cycle": table("pcr"),
    "cohort_uniform_365": table("pcu"),
    "cohort_main_v1": "SELECT * FROM mva_table",
    "cohort_main_v2": "SELECT * FROM mvb_table",
    "cohort_1yr_master": "SELECT * EXCLUDE (label, days_baseline_to_drug, days_drug_to_first_followup_lvef) FROM " + YLABELLED,
    # sequences
    "seq_events": "SELECT * FROM tl",
    "seq_vocab": "SELECT token, id FROM voc",
    "seq_encode": "SELECT subject_id, visit_id, cid AS concept_id, tid AS type_id, count(*) AS n FROM enc GROUP BY ALL",
    "seq_window": "SELECT * FROM sq_text",
    "seq_gap_tokens": "SELECT * FROM sqg_text",
    "seq_visit_delims": "SELECT * FROM sqd_text",
    "seq_pad_mask": """SELECT subject_id, cycle_number, concept_ids || repeat(' 0', m - seq_len) AS concept_ids,
        array_to_string(range(seq_len), ' ') || repeat(' 0', m - seq_len) AS position_ids, rtrim(repeat('1 ', seq_len) || repeat('0 ', m - seq_len)) AS attention_mask
        FROM sq_text, (SELECT max(seq_len) AS m FROM sq_text)""",
    "seq_bucket_labs": f"""SELECT concept_token, count(*) AS n, count(DISTINCT subject_id) AS n_patients FROM (SELECT subject_id, 'lab::' || itemid ||
        CASE WHEN valuenum IS NULL THEN '' ELSE '_Q' || ({quartile('valuenum', 'itemid')}) END AS concept_token FROM labs_kept) GROUP BY concept_token""",
    "seq_bucket_meds": f"""SELECT concept_token, count(*) AS n, count(DISTINCT subject_id) AS n_patients FROM (SELECT subject_id, 'medication::' || drug_norm ||
        CASE WHEN x IS NULL THEN '' ELSE '_dose_Q' || ({quartile('x', 'drug_norm')}) END AS concept_token
        FROM (SELECT *, TRY_CAST(regexp_extract(dose_val_rx, '(\\d+\\.?\\d*)', 1) AS DOUBLE) AS x FROM med)) GROUP BY concept_token""",
    "seq_decode": """SELECT subject_id, cycle_number, position, token, label, label || ' [V' || v || ']' AS visit_label FROM (SELECT r.*, token,
        CASE event_type WHEN 'lab' THEN 'lab:' || coalesce(map {'50963': 'NTproBNP', '51003': 'Troponin T', '50912': 'Creatinine', '50868': 'Anion Gap', '51006': 'Urea Nitrogen',
            '51222': 'Hemoglobin', '51265': 'Platelets', '50983': 'Sodium', '50971': 'Potassium', '50820': 'pH'}[body], body)
            WHEN 'diagnosis' THEN 'dx:' || body WHEN 'procedure' THEN 'proc:' || body WHEN 'medication' THEN 'rx:' || left(body, 22) ELSE token END AS label
        FROM sq_rows r JOIN (SELECT *, split_part(token, '::', 1) AS event_type, split_part(split_part(token, '::', 2), '_', 1) AS body FROM voc) v ON v.id = r.cid)""",
    "seq_lookup": "SELECT subject_id, cycle_number, row_idx, split, prediction_time, binary_label FROM smp JOIN sp USING (subject_id)",
    "seq_show": """SELECT subject_id, cycle_number, v AS visit_id, ['diagnosis', 'procedure', 'lab', 'medication'][tid] AS event_type, count(*) AS n
        FROM sq_rows WHERE tid > 0 GROUP BY ALL""",
    "seq_perturb_zero": """SELECT subject_id, cycle_number, string_agg(CASE WHEN position > 0 AND cid IN (SELECT id FROM voc WHERE token LIKE 'lab::%') THEN 0 ELSE cid END, ' '
        ORDER BY position) AS concept_ids FROM sq_rows GROUP BY ALL""",
    "seq_perturb_replace": """SELECT subject_id, cycle_number, string_agg(CASE WHEN position > 0 AND cid = (SELECT id FROM voc WHERE token = 'medication::aspirin')
        THEN (SELECT id FROM voc WHERE token = 'medication::imatinib') ELSE cid END, ' ' ORDER BY position) AS concept_ids FROM sq_rows GROUP BY ALL""",
    "seq_perturb_visit": """SELECT subject_id, cycle_number, visit_offset, string_agg(CASE WHEN position > 0 AND v = target THEN 0 ELSE cid END, ' ' ORDER BY position) AS concept_ids
        FROM sq_rows JOIN (SELECT subject_id, cycle_number, -1 AS visit_offset, max(v) AS target FROM sq_rows GROUP BY ALL
            UNION ALL SELECT subject_id, cycle_number, 2, list_sort(list_distinct(list(v) FILTER (WHERE v > 0)))[3] FROM sq_rows GROUP BY ALL) USING (subject_id, cycle_number)
        GROUP BY ALL""",
    "split_patients": "SELECT * FROM splits_all",
    "split_check": "SELECT 1::BIGINT AS n_splits, count(*) AS n_patients FROM sp",
    # features
    "feat_clinical": CLINICAL,
    "feat_bow": "SELECT subject_id, cycle_number, cid AS token_id, count(*) AS n FROM sq_rows WHERE cid >= 21 GROUP BY ALL",
    "feat_combined": f"""SELECT subject_id, cycle_number, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{', '.join(f'f_{f}' for f in FEATURES)}]) AS value
        FROM ({CLINICAL}) UNION ALL SELECT subject_id, cycle_number, 'token_' || cid, count(*)::DOUBLE FROM sq_rows WHERE cid >= 21 GROUP BY ALL""",
    "feat_scale": f"""SELECT subject_id, cycle_number, binary_label, {', '.join(f'round((f_{f} - m_{f}) / coalesce(nullif(s_{f}, 0), 1), 6) AS f_{f}' for f in FEATURES)}
        FROM ({CLINICAL}), (SELECT {', '.join(f'avg(f_{f}) AS m_{f}, stddev_pop(f_{f}) AS s_{f}' for f in FEATURES)} FROM ({CLINICAL})
        WHERE subject_id IN (SELECT subject_id FROM sp WHERE split = 'train'))""",
    "feat_class_weight": """SELECT count(*) AS n, sum(y)::BIGINT AS n_positive, round((count(*) - sum(y)) / sum(y), 6) AS scale_pos_weight,
        round(1 / (1 - avg(y)), 6) AS weight_negative, round(1 / avg(y), 6) AS weight_positive
        FROM (SELECT binary_label AS y FROM smp WHERE subject_id IN (SELECT subject_id FROM sp WHERE split = 'train'))""",
    # evaluation
    "eval_confusion": "SELECT *, 0.5::DOUBLE AS threshold FROM cv_rates UNION ALL SELECT *, 0.85 FROM cw_rates",
    "eval_auroc": "SELECT NULL::VARCHAR AS variant, round(auroc, 6) AS auroc FROM ga_auc UNION ALL SELECT variant, round(auroc, 6) FROM gv_auc",
    "eval_auprc": "SELECT NULL::VARCHAR AS variant, round(auprc, 6) AS auprc FROM ga_ap UNION ALL SELECT variant, round(auprc, 6) FROM gv_ap",
    "eval_logloss": "SELECT variant, round(loss, 6) AS loss FROM gv_loss",
    "eval_threshold_sweep": """SELECT threshold, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(youden, 6) AS youden, round(f1, 6) AS f1,
        round(precision, 6) AS precision, CASE WHEN threshold = (SELECT threshold FROM swept ORDER BY youden DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS best_j,
        CASE WHEN threshold = (SELECT threshold FROM swept WHERE sensitivity >= 0.7 ORDER BY youden DESC, threshold LIMIT 1) THEN 1 ELSE 0 END AS best_target FROM swept""",
    "eval_per_task": """SELECT r.*, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(loss, 6) AS loss FROM ct_rates r JOIN gt_auc USING (task_id)
        JOIN gt_ap USING (task_id) JOIN gt_loss USING (task_id)""",
    "eval_seed_summary": """SELECT s.*, CAST(rank AS INT) AS rank FROM (SELECT variant, metric, count(*) AS n, round(avg(value), 6) AS mean,
        round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM run_values GROUP BY variant, metric) s
        JOIN (SELECT variant, row_number() OVER (ORDER BY avg(value) DESC, variant) AS rank FROM run_values WHERE metric = 'auroc' GROUP BY variant) USING (variant)""",
    "eval_history_band": """SELECT variant, CAST(step AS INT) AS step, round(avg(loss), 6) AS mean, round(avg(loss) - coalesce(stddev_samp(loss), 0), 6) AS low,
        round(avg(loss) + coalesce(stddev_samp(loss), 0), 6) AS high FROM (SELECT *, row_number() OVER (PARTITION BY variant, seed ORDER BY epoch) AS step,
        FROM hist) JOIN (SELECT variant, min(n) AS m FROM (SELECT variant, seed, count(*) AS n FROM hist GROUP BY ALL) GROUP BY variant) USING (variant)
        WHERE step <= m GROUP BY variant, step""",
    "eval_delta_prob": """SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN 'zero_labs' ELSE 'drop_last_visit' END AS edit, round(p, 6) AS prob_orig,
        round(((row_idx * 6101) % 1000) / 1000.0::DOUBLE, 6) AS prob_perturb, round(((row_idx * 6101) % 1000) / 1000.0::DOUBLE - p, 6) AS delta_prob FROM sc""",
    # attributions
    "attr_population": """SELECT token, label, event_type, round(avg(ig_score_signed), 6) AS mean_ig_signed, round(stddev_samp(ig_score_signed), 6) AS std_ig_signed,
        count(*) AS n, round(stddev_samp(ig_score_signed) / sqrt(count(*)), 6) AS sem_ig_signed, round(abs(avg(ig_score_signed)), 6) AS abs_mean_ig FROM att_named GROUP BY ALL""",
    "attr_feature_agg": """SELECT subject_id, cycle_number, token, label, event_type, count(*) AS n, round(avg(rollout_score), 6) AS mean_rollout, round(avg(ig_score_l2), 6) AS mean_ig_l2,
        round(avg(ig_score_signed), 6) AS mean_ig_signed, round(stddev_samp(ig_score_signed), 6) AS std_ig_signed, round(avg(visit), 6) AS mean_visit,
        round(avg(days_before), 6) AS mean_days_before, min(days_before) AS earliest_days, max(days_before) AS latest_days FROM att_named GROUP BY ALL""",
    "attr_event_type": """SELECT event_type, round(sum(rollout_score), 4) AS rollout_score, round(sum(ig_score_l2), 4) AS ig_score_l2,
        CAST(list_position(['special', 'diagnosis', 'procedure', 'medication', 'lab'], event_type) - 1 AS INT) AS place FROM att_named GROUP BY event_type""",
    "attr_feature_by_cycle": """WITH tops AS (SELECT DISTINCT subject_id, token FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, cycle_number
            ORDER BY rollout_score DESC, token, position) AS r FROM att) WHERE r <= 5),
        cells AS (SELECT a.subject_id, a.token, a.cycle_number, max(rollout_score) AS score FROM att a JOIN tops t ON t.subject_id = a.subject_id AND t.token = a.token GROUP BY ALL),
        peaks AS (SELECT subject_id, token, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY max(score) DESC, token) AS INT) AS rank FROM cells GROUP BY subject_id, token)
        SELECT c.*, p.rank FROM cells c JOIN peaks p ON p.subject_id = c.subject_id AND p.token = c.token WHERE p.rank <= 5""",
    "seq_window_by_class": "SELECT * FROM sqc_text",
    "seq_visit_delims_by_class": "SELECT * FROM sqcd_text",
    "feat_bow_by_class": "SELECT subject_id, cycle_number, drug_class, cid AS token_id, count(*) AS n FROM sqc_rows WHERE cid >= 21 GROUP BY ALL",
    "feat_clinical_by_class": CLINICAL_BY_CLASS,
    "seq_multi_horizon": """SELECT subject_id, cycle_number, h.task_id, h.window_days, CASE WHEN h.window_days = 365 THEN smp.binary_label
            WHEN epoch(first_event_time - prediction_time) / 86400.0 > 0 AND epoch(first_event_time - prediction_time) / 86400.0 <= h.window_days THEN 1 ELSE 0 END AS binary_label,
        concept_ids, seq_len FROM smp JOIN sq_text USING (subject_id, cycle_number),
        (SELECT CAST(unnest([0, 1, 2]) AS INT) AS task_id, CAST(unnest([90, 180, 365]) AS INT) AS window_days) h""",
    "model_gbt": f"""WITH f AS ({CLINICAL}), c AS (SELECT subject_id, cycle_number, {' + '.join(f'(f_{f} IS NOT NULL)::INT' for f in FEATURES)} AS n FROM f),
        t AS (SELECT subject_id, cycle_number, count(DISTINCT cid) AS n FROM sq_rows WHERE cid >= 21 GROUP BY ALL)
        SELECT s.subject_id, s.cycle_number, p.split, v.variant, d.seed, s.binary_label AS true_label,
        CAST(CASE v.variant WHEN 'clinical' THEN c.n WHEN 'bow' THEN coalesce(t.n, 0) ELSE c.n + coalesce(t.n, 0) END AS INT) AS n_features
        FROM smp s JOIN sp p ON p.subject_id = s.subject_id AND p.split = 'test' JOIN c ON c.subject_id = s.subject_id AND c.cycle_number = s.cycle_number
        LEFT JOIN t ON t.subject_id = s.subject_id AND t.cycle_number = s.cycle_number,
        (SELECT unnest(['clinical', 'bow', 'combined']) AS variant) v, (SELECT CAST(unnest([42, 43]) AS INT) AS seed) d""",
    "model_gbt_split": f"""WITH f AS ({CLINICAL}),
        tr AS (SELECT subject_id, cycle_number, binary_label AS y FROM smp WHERE subject_id IN (SELECT subject_id FROM sp WHERE split = 'train')),
        pw AS (SELECT (count(*) - sum(y))::DOUBLE / sum(y) AS w FROM tr),
        r AS (SELECT subject_id, cycle_number, CAST(round_even((0.5::DOUBLE - y) * CASE y WHEN 1 THEN w ELSE 1.0::DOUBLE END * 16777216.0::DOUBLE, 0) AS BIGINT) AS g,
            CAST(round_even(0.25::DOUBLE * CASE y WHEN 1 THEN w ELSE 1.0::DOUBLE END * 16777216.0::DOUBLE, 0) AS BIGINT) AS h FROM tr, pw),
        whole AS (SELECT CAST(sum(g) AS BIGINT) AS tg, CAST(sum(h) AS BIGINT) AS th FROM r),
        cells AS (SELECT subject_id, cycle_number, unnest(range(0, {len(FEATURES)})) AS fid, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature,
            unnest([{', '.join(f'f_{f}' for f in FEATURES)}]) AS value FROM f
            UNION ALL SELECT subject_id, cycle_number, cid + {len(FEATURES)}, 'token_' || cid, CASE WHEN count(*) <= 16 THEN count(*) ELSE 16 + floor(log2(count(*) / 16.0)) END::DOUBLE
            FROM sq_rows WHERE cid >= 21 GROUP BY subject_id, cycle_number, cid),
        hist AS (SELECT fid, feature, value, sum(g) AS g, sum(h) AS h FROM cells JOIN r USING (subject_id, cycle_number) WHERE value IS NOT NULL GROUP BY ALL),
        cum AS (SELECT *, sum(g) OVER w AS cg, sum(h) OVER w AS ch, sum(g) OVER (PARTITION BY fid) AS fg, sum(h) OVER (PARTITION BY fid) AS fh FROM hist WINDOW w AS (PARTITION BY fid ORDER BY value)),
        sides AS (SELECT fid, feature, value, m AS missing_left, CAST(cg + CASE WHEN m THEN tg - fg ELSE 0 END AS BIGINT) AS lg,
            CAST(ch + CASE WHEN m THEN th - fh ELSE 0 END AS BIGINT) AS lh, tg, th FROM cum, whole, (SELECT unnest([FALSE, TRUE]) AS m)),
        sized AS (SELECT *, lg / 16777216.0::DOUBLE AS a, (tg - lg) / 16777216.0::DOUBLE AS b, tg / 16777216.0::DOUBLE AS c FROM sides WHERE lh >= 5 * 16777216 AND th - lh >= 5 * 16777216),
        cut AS (SELECT *, {', '.join(f"CASE WHEN {x} > 0.1::DOUBLE THEN {x} - 0.1::DOUBLE WHEN {x} < -0.1::DOUBLE THEN {x} + 0.1::DOUBLE ELSE 0 END AS {x}{x}" for x in 'abc')} FROM sized),
        gains AS (SELECT *, aa * aa / (lh / 16777216.0::DOUBLE + 1) + bb * bb / ((th - lh) / 16777216.0::DOUBLE + 1) - cc * cc / (th / 16777216.0::DOUBLE + 1) AS gain FROM cut),
        top AS (SELECT v.variant, gains.*, row_number() OVER (PARTITION BY v.variant ORDER BY gain DESC, fid, value, missing_left DESC) AS k
            FROM gains JOIN (SELECT unnest(['clinical', 'bow', 'combined']) AS variant) v ON CASE v.variant WHEN 'clinical' THEN fid < {len(FEATURES)} WHEN 'bow' THEN fid >= {len(FEATURES)} ELSE TRUE END)
        SELECT variant, feature, value::DOUBLE AS at_most, missing_left, round(gain, 6) AS gain, lg AS left_g, lh AS left_h FROM top WHERE k = 1 AND gain > 1e-9""",
    "pca_project": """WITH RECURSIVE e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), c AS (SELECT vec_id, e.i, x - m AS x FROM e JOIN m ON m.i = e.i),
        g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM embeddings) - 1) AS s FROM c a JOIN c b ON b.vec_id = a.vec_id GROUP BY a.i, b.i),
        matrix AS MATERIALIZED (SELECT list(line ORDER BY i) AS s FROM (SELECT i, list(s ORDER BY j) AS line FROM g GROUP BY i)),
        power AS (SELECT 0 AS step, list_transform(range(64), lambda k: 1.0 + k / 100.0) AS v, 0.0::DOUBLE AS top
            UNION ALL SELECT step + 1, list_transform(w, lambda k: k / sqrt(list_dot_product(w, w))), list_dot_product(v, w) / list_dot_product(v, v)
            FROM (SELECT step, v, list_transform(s, lambda line: list_dot_product(line, v)) AS w FROM power, matrix WHERE step < 400))
        SELECT count(*) AS n, count(*) AS n_ids, 3::BIGINT AS n_sources, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS covariance,
        (SELECT round(top, 4) FROM power WHERE step = 400) AS variance_1, TRUE AS ordered FROM embeddings""",
}


def all_statements() -> dict[str, str]:
    out = {}
    for key, sql in SQL.items():
        out[key] = statement(sql) if not sql.startswith("WITH ") else statement("SELECT * FROM (" + sql + ")")
    return out
