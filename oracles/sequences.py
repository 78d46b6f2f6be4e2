"""Samples, timeline, vocabulary and sequences in DuckDB form."""

from oracles import name

# Fixed values.
RESERVED = ["[PAD]", "[UNK]", "[CLS]", "[V_START]", "[V_END]", "W0", "W1", "W2", "W3"] + [f"M{i}" for i in range(1, 12)] + ["LT"]
PANEL = ("51002, 51003, 52042, 51214, 50963, 50912, 51006, 50971, 50983, 50960, 50902, 50882, 50893, 51222, 51221, 51265, 51301, "
         "50861, 50878, 50885, 50862, 50931, 50954, 50889")
LEN = 600

def chain(x: str, key: str, samples: str) -> None:
    """Samples, visits, timeline, vocabulary and the events before each index time; ``x`` ends the names, ``key`` tells samples apart."""
    name(**{
        f"smp{x}": samples,
        f"vis{x}": f"""SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY admittime, hadm_id) AS visit_id FROM adm
            WHERE subject_id IN (SELECT subject_id FROM smp{x})""",
        f"med{x}": f"""SELECT r.*, trim(lower(drug)) AS drug_norm, v.visit_id, v.admittime,
            CAST(row_number() OVER (PARTITION BY r.subject_id, r.hadm_id, starttime ORDER BY pharmacy_id, trim(lower(drug))) - 1 AS INT) AS prio
            FROM rx r JOIN vis{x} v ON v.hadm_id = r.hadm_id""",
        f"labs_kept{x}": f"""SELECT l.*, v.visit_id, v.admittime FROM lab l JOIN vis{x} v ON v.hadm_id = l.hadm_id
            WHERE storetime IS NOT NULL AND l.subject_id IN (SELECT subject_id FROM vis{x})""",
        f"tl{x}": f"""SELECT d.subject_id, d.hadm_id, admittime, dischtime AS event_time, 'diagnosis' AS event_type,
                format('diagnosis::{{}}_ICDver{{}}', icd_code, icd_version) AS concept_token, seq_num AS event_priority, CAST(visit_id AS INT) AS visit_id
                FROM dx d JOIN vis{x} v ON v.hadm_id = d.hadm_id
            UNION ALL SELECT p.subject_id, p.hadm_id, admittime, chartdate::TIMESTAMP, 'procedure', format('procedure::{{}}_ICDver{{}}', icd_code, icd_version),
                seq_num, CAST(visit_id AS INT) FROM prc p JOIN vis{x} v ON v.hadm_id = p.hadm_id
            UNION ALL SELECT subject_id, hadm_id, admittime, starttime, 'medication', 'medication::' || drug_norm, prio, CAST(visit_id AS INT) FROM med{x}
            UNION ALL SELECT subject_id, hadm_id, admittime, storetime, 'lab', 'lab::' || itemid, 0, CAST(visit_id AS INT) FROM labs_kept{x} WHERE flag IS NOT NULL""",
        f"voc{x}": f"""SELECT token, id FROM reserved UNION ALL SELECT concept_token, CAST(20 + row_number() OVER (ORDER BY concept_token) AS INT)
            FROM (SELECT DISTINCT concept_token FROM tl{x} WHERE concept_token NOT IN (SELECT token FROM reserved))""",
        f"enc{x}": f"""SELECT t.*, coalesce(v.id, 1) AS cid, CASE event_type WHEN 'diagnosis' THEN 1 WHEN 'procedure' THEN 2 WHEN 'lab' THEN 3
            WHEN 'medication' THEN 4 ELSE 0 END AS tid, greatest(event_time::DATE - DATE '2000-01-01', 0) AS day FROM tl{x} t LEFT JOIN voc{x} v ON v.token = t.concept_token""",
        f"before{x}": f"""SELECT {', '.join('s.' + c for c in key.split(', '))}, s.prediction_time, e.visit_id, e.event_time, e.cid, e.tid, e.day,
            row_number() OVER w AS k, lag(e.visit_id) OVER w AS pv, lag(e.day) OVER w AS pday, lead(e.visit_id) OVER w AS nv
            FROM smp{x} s JOIN enc{x} e ON e.subject_id = s.subject_id AND e.event_time < s.prediction_time
            WINDOW w AS (PARTITION BY {', '.join('s.' + c for c in key.split(', '))} ORDER BY e.visit_id, e.event_time, e.event_type, e.event_priority, e.concept_token)""",
        f"gapped{x}": f"""SELECT *, greatest(day - pday, 0) AS gap FROM before{x} WHERE pv <> visit_id""",
    })


SAMPLE, BY_CLASS = "subject_id, cycle_number", "subject_id, cycle_number, drug_class"

name(reserved="SELECT token, CAST(row_number() OVER () - 1 AS INT) AS id FROM (SELECT unnest([" + ", ".join(f"'{t}'" for t in RESERVED) + "]) AS token)")
chain("", SAMPLE, """SELECT subject_id, cycle_number, prediction_time, binary_label, first_event_time, drug_classes_in_cycle,
    CAST(greatest(0, coalesce(anchor_age + year(prediction_time) - anchor_year, 0)) AS DOUBLE) AS age_years,
    row_number() OVER (ORDER BY subject_id, cycle_number) - 1 AS row_idx
    FROM pcu_table LEFT JOIN pat USING (subject_id) WHERE eligible_inclusive = 1""")
chain("_c", BY_CLASS, "SELECT subject_id, cycle_number, drug_class, prediction_time, binary_label FROM ctrcd_table WHERE eligible_inclusive = 1")


def event(key: str, x: str) -> str:
    return f"SELECT {key}, k, 3 AS sub, cid, tid, visit_id AS v, day FROM before{x}"


def gap(key: str, x: str) -> str:
    return f""" UNION ALL SELECT {key}, k, 1, CASE WHEN gap < 28 THEN 5 + gap // 7 WHEN gap < 30 THEN 1
    WHEN gap < 360 THEN 8 + gap // 30 ELSE 20 END, 0, visit_id, day FROM gapped{x}"""


def delimiters(key: str, x: str) -> str:
    return f""" UNION ALL SELECT {key}, k, 0, 4, 0, pv, pday FROM gapped{x}
    UNION ALL SELECT {key}, k, 2, 3, 0, visit_id, day FROM before{x} WHERE pv IS DISTINCT FROM visit_id
    UNION ALL SELECT {key}, k, 4, 4, 0, visit_id, day FROM before{x} WHERE nv IS NULL"""


def sequence(p: str, length: int, tokens: str, key: str = SAMPLE, x: str = "") -> None:
    name(**{
        f"{p}_all": tokens,
        f"{p}_ranked": f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY k DESC, sub DESC) AS back,
            count(*) OVER (PARTITION BY {key}) AS total FROM {p}_all""",
        f"{p}_rows": f"""SELECT {key}, 0 AS position, 2 AS cid, 0 AS tid, 0 AS v,
                CAST(greatest(prediction_time::DATE - DATE '2000-01-01', 0) AS BIGINT) AS day FROM smp{x}
            UNION ALL SELECT {key}, CAST(least(total, {length - 1}) - back + 1 AS INT), CAST(cid AS INT), tid, v, day
            FROM {p}_ranked WHERE back < {length}""",
        f"{p}_text": f"""SELECT {key}, string_agg(r.cid, ' ' ORDER BY position) AS concept_ids,
            string_agg(r.tid, ' ' ORDER BY position) AS type_ids, string_agg(r.v, ' ' ORDER BY position) AS visit_ids,
            string_agg(r.day, ' ' ORDER BY position) AS dates, CAST(count(*) AS INT) AS seq_len,
            CAST(1 + coalesce(max(a.n), 0) AS INT) AS raw_seq_len FROM {p}_rows r
            LEFT JOIN (SELECT {key}, count(*) AS n FROM {p}_all GROUP BY ALL) a USING ({key}) GROUP BY ALL""",
    })


sequence("sq", LEN, event(SAMPLE, ""))
sequence("sqg", LEN, event(SAMPLE, "") + gap(SAMPLE, ""))
sequence("sqd", LEN, event(SAMPLE, "") + gap(SAMPLE, "") + delimiters(SAMPLE, ""))
sequence("sqk", 32, event(SAMPLE, ""))
sequence("sqc", LEN, event(BY_CLASS, "_c"), BY_CLASS, "_c")
sequence("sqcd", LEN, event(BY_CLASS, "_c") + gap(BY_CLASS, "_c") + delimiters(BY_CLASS, "_c"), BY_CLASS, "_c")

name(
    people="""SELECT subject_id, max(binary_label) AS patient_label FROM smp GROUP BY subject_id""",
    seeds="""SELECT unnest([42, 43]) AS seed""",
    ordered="""SELECT seed, subject_id, patient_label, row_number() OVER (PARTITION BY seed, patient_label ORDER BY md5(concat(seed, '-', subject_id)), subject_id) AS r,
        count(*) OVER (PARTITION BY seed, patient_label) AS n FROM people, seeds""",
    sized="""SELECT *, greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS kt FROM ordered""",
    splits_all="""SELECT seed, subject_id, patient_label, CASE WHEN r <= kt THEN 'test'
        WHEN r <= kt + greatest(1, round_even((n - kt) * (0.15::DOUBLE / (0.70::DOUBLE + 0.15::DOUBLE)), 0)) THEN 'val' ELSE 'train' END AS split FROM sized""",
    sp="""SELECT subject_id, patient_label, split FROM splits_all WHERE seed = 42""",
)
