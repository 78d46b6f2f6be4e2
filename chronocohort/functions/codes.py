"""Diagnosis and procedure code sets: version -> prefixes, as set lookups on the leading characters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(code: Column, prefixes: Sequence[str]) -> Column:
    """One set lookup per prefix length, instead of one test or regex branch per prefix; '=9925' asks for the whole code."""
    tests = [code.isin([p[1:] for p in prefixes if p.startswith("=")])] if any(p.startswith("=") for p in prefixes) else []
    for n in sorted({len(p) for p in prefixes if not p.startswith("=")}):
        tests.append(F.substring(code, 1, n).isin([p for p in prefixes if len(p) == n and not p.startswith("=")]))
    return reduce(or_, tests)


@dataclass(frozen=True)
class CodeSet:
    """Prefixes per code version; ``any_version`` prefixes ignore the version column."""

    versions: Mapping[int, Sequence[str]] = field(default_factory=dict)
    any_version: Sequence[str] = ()

    def matches(self, code: Column | str = "icd_code", version: Column | str = "icd_version") -> Column:
        code = F.col(code) if isinstance(code, str) else code
        version = F.col(version) if isinstance(version, str) else version
        tests = [(version == number) & _starts(code, prefixes) for number, prefixes in self.versions.items()]
        if self.any_version:
            tests.append(_starts(code, self.any_version))
        return reduce(or_, tests)

    def __or__(self, other: "CodeSet") -> "CodeSet":
        merged = {v: [*self.versions.get(v, ()), *other.versions.get(v, ())]
                  for v in {*self.versions, *other.versions}}
        return CodeSet(merged, [*self.any_version, *other.any_version])


# Code prefixes per ICD version.
HEART_FAILURE = CodeSet({10: ["I50"], 9: ["428"]})
CARDIOMYOPATHY = CodeSet({10: ["I42"], 9: ["425"]})
ARRHYTHMIA = CodeSet({10: ["I44", "I45", "I47", "I48", "I49"], 9: ["426", "427"]})
NARROW_CV = CodeSet({
    10: ["I21", "I22", "I23", "I30", "I31", "I40", "I41", "I42", "I46", "I50", "I514"],
    9: ["410", "411", "420", "421", "422", "423", "425", "428"],
})
BROAD_CV = CodeSet({
    10: ["I21", "I22", "I23", "I30", "I31", "I40", "I41", "I42", "I44", "I45", "I46", "I47", "I48", "I49",
         "I50", "I514"],
    9: ["410", "411", "420", "421", "422", "423", "425", "426", "427", "428"],
})
CANCER_HISTORY = CodeSet({9: ["V10"], 10: ["Z85"]})
PRIOR_CANCER = CodeSet({9: ["14", "15", "16", "17", "18", "19", "20", "23"], 10: ["C", "D0"]})
ONE_YEAR_CV = CodeSet(any_version=["425", "428", "410", "411", "412", "413", "414",
                                   "I42", "I50", "I21", "I22", "I23", "I63", "I64"])
MAIN_V1_CV = CodeSet(any_version=["425", "428", "410", "411", "412", "413", "414", "420", "421", "422", "423",
                                  "426", "427", "I42", "I50", "I21", "I22", "I23", "I63", "I64", "I30", "I31",
                                  "I40", "I41", "I44", "I45", "I46", "I47", "I48", "I49", "I514"])
MAIN_V2_CV = CodeSet(any_version=["425", "428", "410", "411", "413", "420", "421", "422", "423",
                                  "426", "427", "I42", "I50", "I21", "I22", "I23", "I63", "I64", "I30", "I31",
                                  "I40", "I41", "I44", "I45", "I46", "I47", "I48", "I49", "I51"])
TREATMENT_PROCEDURES = CodeSet({9: ["922", "=9925"], 10: ["D7"]})


def active_cancer(code: str = "icd_code", version: str = "icd_version") -> Column:
    """ICD-9 140-172 and 174-208 by numeric prefix, ICD-10 C codes other than C44 (skin excluded)."""
    number = F.expr(f"try_cast(substring({code}, 1, 3) AS INT)")
    icd9 = (F.col(version) == 9) & (number.between(140, 172) | number.between(174, 208))
    icd10 = (F.col(version) == 10) & F.col(code).startswith("C") & ~F.col(code).startswith("C44")
    return F.coalesce(icd9, F.lit(False)) | F.coalesce(icd10, F.lit(False))
