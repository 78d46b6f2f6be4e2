"""The clinical tables in DuckDB form, and the membership relations."""

from oracles import name

name(
    li="""SELECT l.*, o_custkey, o_orderdate FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    pat="""SELECT c_custkey AS subject_id, CAST(20 + c_custkey % 75 AS INT) AS anchor_age, 1995 AS anchor_year,
        CASE WHEN c_custkey % 6 = 0 THEN CAST(DATE '1998-01-01' + CAST(c_custkey * 7 % 1200 AS INT) AS DATE) END AS dod
        FROM customer""",
    adm="""SELECT o_orderkey AS hadm_id, o_custkey AS subject_id,
        o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS admittime,
        o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR + (1 + o_orderkey % 14) * INTERVAL '1' DAY AS dischtime,
        CASE WHEN o_custkey % 12 = 0 AND o_orderkey % 50 = 0 THEN o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR
             + (1 + o_orderkey % 14) * INTERVAL '1' DAY END AS deathtime
        FROM orders""",
    dx="""SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
        CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 9 END AS icd_version,
        CASE WHEN l_partkey % 2 = 0
             THEN coalesce(['I500','I420','I480','C509','Z853','I214','I514','I440'][1 + CAST((l_partkey // 2 + l_suppkey) % 160 AS INT)], 'E119')
             ELSE coalesce(['4280','4254','42731','1749','V103','41071','4260','4111'][1 + CAST((l_partkey // 2 + l_suppkey) % 160 AS INT)], '25000')
        END AS icd_code FROM li""",
    rx="""SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_partkey * 10 + l_linenumber AS pharmacy_id,
        l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR AS starttime,
        coalesce(['Doxorubicin HCl','Trastuzumab','Nivolumab','Paclitaxel','Fluorouracil','Bevacizumab','Cetuximab','Imatinib',
                  'Bortezomib','Lenalidomide'][1 + CAST((l_partkey + l_suppkey) % 40 AS INT)], 'aspirin') AS drug,
        CASE WHEN l_partkey % 9 = 0 THEN 'per protocol' ELSE concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), ' mg') END AS dose_val_rx
        FROM li""",
    ech="""SELECT o_custkey AS subject_id, l_shipdate AS measurement_datetime,
        CASE WHEN l_suppkey % 2 = 0 THEN 'lvef' ELSE 'GLS avg' END AS measurement,
        CASE WHEN l_partkey % 50 = 0 THEN 'n/a'
             WHEN l_suppkey % 2 = 0 THEN CAST(30 + (l_partkey * 13 + l_orderkey) % 40 AS VARCHAR)
             ELSE CAST(-(14 + (l_partkey * 7 + l_orderkey) % 8) AS VARCHAR) END AS result
        FROM li WHERE l_linenumber = 1""",
    prc="""SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num,
        CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 9 END AS icd_version,
        coalesce(['9925','9229','D7001ZZ','8856'][1 + CAST(l_partkey % 20 AS INT)], '0001') AS icd_code,
        CAST(l_shipdate AS DATE) AS chartdate FROM li WHERE l_returnflag = 'R'""",
    lab="""SELECT o_custkey AS subject_id, l_orderkey AS hadm_id,
        [50912,51006,50971,50983,51222,51265,50963,51003,50868,50820][1 + CAST(l_suppkey % 10 AS INT)] AS itemid,
        l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR AS storetime,
        CASE WHEN l_partkey % 3 = 0 THEN 'abnormal' END AS flag,
        CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice END AS valuenum FROM li WHERE l_returnflag <> 'R'""",
    cancer_rows="""SELECT * FROM dx WHERE
        (icd_version = 9 AND TRY_CAST(icd_code[1:3] AS INT) BETWEEN 140 AND 208 AND TRY_CAST(icd_code[1:3] AS INT) <> 173)
        OR (icd_version = 10 AND icd_code[1] = 'C' AND icd_code[1:3] <> 'C44')""",
    history_rows="""SELECT * FROM dx WHERE (icd_version = 9 AND icd_code[1:3] = 'V10') OR (icd_version = 10 AND icd_code[1:3] = 'Z85')""",
    elig="""SELECT subject_id FROM cancer_rows UNION SELECT subject_id FROM history_rows""",
    lvef="""SELECT subject_id, measurement_datetime AS t, TRY_CAST(result AS DOUBLE) AS v FROM ech
        WHERE lower(measurement) = 'lvef' AND TRY_CAST(result AS DOUBLE) IS NOT NULL""",
    gls="""SELECT subject_id, measurement_datetime AS t, TRY_CAST(result AS DOUBLE) AS v FROM ech
        WHERE regexp_matches(lower(measurement), 'gls|global longitudinal|global_longitudinal') AND TRY_CAST(result AS DOUBLE) < 0""",
)
