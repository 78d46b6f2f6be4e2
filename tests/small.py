"""Hand-written clinical tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from chronocohort.sources import schemas

DAY0 = datetime(2020, 1, 1)


def at(days: float, seconds: int = 0) -> datetime:
    return DAY0 + timedelta(days=days, seconds=seconds)


class Tables:
    """Clinical tables from rows; a table that is not given is empty."""

    def __init__(self, spark, **rows):
        self.spark = spark
        for name, schema in schemas.BY_NAME.items():
            setattr(self, name, spark.createDataFrame(rows.get(name, []), schema))


def rx(subject, when, drug="doxorubicin", hadm=1, pharmacy=1, dose="10 mg"):
    return (subject, hadm, pharmacy, when, drug, dose)


def dx(subject, hadm, code, version=10, seq=1):
    return (subject, hadm, seq, version, code)


def adm(hadm, subject, start, end, death=None):
    return (hadm, subject, start, end, death)


def pat(subject, dod: date | None = None, age=50, year=2020):
    return (subject, age, year, dod)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
