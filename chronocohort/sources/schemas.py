"""Declared schemas of the input tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


PATIENTS = _schema(subject_id=_L, anchor_age=_I, anchor_year=_I, dod=_DATE)
ADMISSIONS = _schema(hadm_id=_L, subject_id=_L, admittime=_TS, dischtime=_TS, deathtime=_TS)
DIAGNOSES = _schema(subject_id=_L, hadm_id=_L, seq_num=_I, icd_version=_I, icd_code=_S)
PROCEDURES = _schema(subject_id=_L, hadm_id=_L, seq_num=_I, icd_version=_I, icd_code=_S, chartdate=_DATE)
PRESCRIPTIONS = _schema(subject_id=_L, hadm_id=_L, pharmacy_id=_L, starttime=_TS, drug=_S, dose_val_rx=_S)
ECHO = _schema(subject_id=_L, measurement_datetime=_TS, measurement=_S, result=_S)
LABS = _schema(subject_id=_L, hadm_id=_L, itemid=_I, storetime=_TS, flag=_S, valuenum=_D)

BY_NAME = {
    "patients": PATIENTS,
    "admissions": ADMISSIONS,
    "diagnoses": DIAGNOSES,
    "procedures": PROCEDURES,
    "prescriptions": PRESCRIPTIONS,
    "echo": ECHO,
    "labevents": LABS,
}
