"""The seven clinical tables, derived from the driver's order tables as FIXTURES.md defines them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocohort.session import tune_tables

# Fixed values of FIXTURES.md, part B.
CODES_10 = ["I500", "I420", "I480", "C509", "Z853", "I214", "I514", "I440"]
CODES_9 = ["4280", "4254", "42731", "1749", "V103", "41071", "4260", "4111"]
DRUGS = ["Doxorubicin HCl", "Trastuzumab", "Nivolumab", "Paclitaxel", "Fluorouracil", "Bevacizumab",
         "Cetuximab", "Imatinib", "Bortezomib", "Lenalidomide"]
PROCEDURE_CODES = ["9925", "9229", "D7001ZZ", "8856"]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
LAB_ITEMS = [50912, 51006, 50971, 50983, 51222, 51265, 50963, 51003, 50868, 50820]


def _pick(values: list, index: str, default=None):
    """values[index], or the default past the end."""
    found = F.get(F.array(*[F.lit(v) for v in values]), F.expr(f"CAST({index} AS INT)"))
    return found if default is None else F.coalesce(found, F.lit(default))


class Clinic:
    """Lazy clinical tables over one folder of driver parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune_tables(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        # both sides grow with the data, so neither is broadcast; the sort-merge join can spill
        orders = self.raw("orders").select("o_orderkey", "o_custkey").hint("merge")
        return self.raw("lineitem").select(*LINE).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")

    @cached_property
    def patients(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("subject_id"),
            F.expr("CAST(20 + c_custkey % 75 AS INT)").alias("anchor_age"),
            F.lit(1995).alias("anchor_year"),
            F.expr("CASE WHEN c_custkey % 6 = 0 THEN date_add(DATE '1998-01-01', CAST(c_custkey * 7 % 1200 AS INT)) END")
            .alias("dod"),
        )

    @cached_property
    def admissions(self) -> DataFrame:
        admit = "o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR"
        discharge = f"{admit} + (1 + o_orderkey % 14) * INTERVAL '1' DAY"
        return self.raw("orders").select(
            F.col("o_orderkey").alias("hadm_id"),
            F.col("o_custkey").alias("subject_id"),
            F.expr(admit).alias("admittime"),
            F.expr(discharge).alias("dischtime"),
            F.expr(f"CASE WHEN o_custkey % 12 = 0 AND o_orderkey % 50 = 0 THEN {discharge} END").alias("deathtime"),
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        slot = "(l_partkey div 2 + l_suppkey) % 160"
        even = F.expr("l_partkey % 2 = 0")
        return self.lines.select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("seq_num"),
            F.when(even, 10).otherwise(9).alias("icd_version"),
            F.when(even, _pick(CODES_10, slot, "E119")).otherwise(_pick(CODES_9, slot, "25000")).alias("icd_code"),
        )

    @cached_property
    def prescriptions(self) -> DataFrame:
        return self.lines.select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.expr("l_partkey * 10 + l_linenumber").alias("pharmacy_id"),
            F.expr("l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR").alias("starttime"),
            _pick(DRUGS, "(l_partkey + l_suppkey) % 40", "aspirin").alias("drug"),
            F.expr("CASE WHEN l_partkey % 9 = 0 THEN 'per protocol'"
                   " ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), ' mg') END").alias("dose_val_rx"),
        )

    @cached_property
    def echo(self) -> DataFrame:
        return self.lines.where("l_linenumber = 1").select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_shipdate").alias("measurement_datetime"),
            F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'lvef' ELSE 'GLS avg' END").alias("measurement"),
            F.expr("CASE WHEN l_partkey % 50 = 0 THEN 'n/a'"
                   " WHEN l_suppkey % 2 = 0 THEN CAST(30 + (l_partkey * 13 + l_orderkey) % 40 AS STRING)"
                   " ELSE CAST(-(14 + (l_partkey * 7 + l_orderkey) % 8) AS STRING) END").alias("result"),
        )

    @cached_property
    def procedures(self) -> DataFrame:
        return self.lines.where("l_returnflag = 'R'").select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            F.col("l_linenumber").alias("seq_num"),
            F.expr("CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 9 END").alias("icd_version"),
            _pick(PROCEDURE_CODES, "l_partkey % 20", "0001").alias("icd_code"),
            F.expr("CAST(l_shipdate AS DATE)").alias("chartdate"),
        )

    @cached_property
    def labevents(self) -> DataFrame:
        return self.lines.where("l_returnflag <> 'R'").select(
            F.col("o_custkey").alias("subject_id"),
            F.col("l_orderkey").alias("hadm_id"),
            _pick(LAB_ITEMS, "l_suppkey % 10").alias("itemid"),
            F.expr("l_shipdate + (l_partkey % 24) * INTERVAL '1' HOUR").alias("storetime"),
            F.expr("CASE WHEN l_partkey % 3 = 0 THEN 'abnormal' END").alias("flag"),
            F.expr("CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice END").alias("valuenum"),
        )
