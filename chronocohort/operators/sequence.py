"""Bounded token sequences per sample: window, insertions, padding, decoding, edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocohort.functions import scalars as S
from chronocohort.operators.ordering import as_of, carried, large_keys, running_index
from chronocohort.session import durable

SAMPLE = ["subject_id", "cycle_number"]
MAX_SEQ_LEN = 600
#: Events of a patient that one row may hold; longer histories are read as ranges of places.
HELD = 1 << 14
#: Visits of a patient that are read together.
VISIT_BLOCK = 64
ARRAYS = ["concept_ids", "type_ids", "visit_ids", "position_ids", "dates"]


def sample_key(df: DataFrame) -> list[str]:
    """What tells samples apart: patient and cycle number, and the class where cycles are counted per class."""
    return [*SAMPLE, "drug_class"] if "drug_class" in df.columns else list(SAMPLE)


def unique_samples(samples: DataFrame) -> DataFrame:
    """``samples``, and an error at run time if two rows share a key: their events would run together."""
    key = sample_key(samples)
    rest = [c for c in samples.columns if c not in key]
    once = samples.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rest])
    clash = F.when(F.col("_n") > 1, F.raise_error(F.lit("two samples share a key"))).otherwise(F.lit(True))
    return once.where(clash).select(*samples.columns)


def visit_rank() -> Column:
    """Visits in timeline order; rows without an admission (visit 0) come last."""
    return F.when(F.col("visit_id") == 0, F.lit(2**31 - 1)).otherwise(F.col("visit_id"))


def order_within_patient() -> list[Column]:
    """The total order of a patient's events: visit-major, then time, type, priority, token."""
    return [visit_rank(), F.col("event_time"), F.col("event_type"), F.col("event_priority"), F.col("concept_token")]


def placed(encoded: DataFrame) -> DataFrame:
    """Encoded events with their place in the patient's total order, and only what sequences need.

    The five-column order is sorted once per event here, not once per sample and event later.
    """
    chunk = F.struct(visit_rank().alias("v"), F.date_trunc("HOUR", "event_time").alias("h"))
    return running_index(encoded, ["subject_id"], order_within_patient(), chunk, "place", large_keys(encoded, ["subject_id"])).select(
        "subject_id", "visit_id", "event_time", "place", "concept_id", "type_id")


def visit_summary(events: DataFrame) -> DataFrame:
    """Per patient and visit: events and their times, and running over the visits in order: latest time, events and visits so far."""
    per = events.groupBy("subject_id", "visit_id").agg(
        F.count("*").alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).withColumn("rank", visit_rank())
    per = per.withColumn("_one", F.when(F.col("visit_id") != 0, 1).otherwise(0))
    levels = (F.shiftright("rank", 12), F.shiftright("rank", 24))  # at most 128 coarse chunks, as ranks are ints
    folds = {"latest": ("max", "hi"), "n_upto": ("sum", "n"), "visits_upto": ("sum", "_one")}
    return carried(per, ["subject_id"], levels, ["rank"], folds, large_keys(events, ["subject_id"])).drop("_one")


def history(samples: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What lies strictly before each index time, without a row for each sample and event.

    Visits are ordered, and up to some visit all of them end before the index: those count from a running sum, found as of the
    index time.  Of the later visits only those up to the last that begins before the index matter, and they are read as a range, in blocks of VISIT_BLOCK;
    their events before the index are the first ones of the visit, up to the last place as of the index.

    Returns the samples with ``n_whole``, ``visits_whole`` (that run of whole visits), and one row per sample and later visit with
    ``first`` (place of the visit's first event), ``n_before`` and ``n_newer`` (the ``n_before`` of the sample's newer visits together).
    """
    key = sample_key(samples)
    patient = ["subject_id"]
    large = large_keys(events, patient)
    summary = durable(visit_summary(events).withColumn("first", F.col("n_upto") - F.col("n") + 1))
    index = samples.select(*key, "prediction_time")
    whole = as_of(index, summary, patient, "prediction_time", "latest", {"_m": ("last", F.struct("rank", "n_upto", "visits_upto"))}, large)
    begun = summary.where("visit_id <> 0").select("subject_id", "lo", "rank")
    whole = as_of(whole, begun, patient, "prediction_time", "lo", {"last_begun": ("max", F.col("rank"))}, large)
    whole = durable(whole.select(*key, "prediction_time", F.col("_m.rank").alias("last_whole"), "last_begun", F.coalesce("_m.n_upto", F.lit(0)).alias("n_whole"),
                                 F.coalesce("_m.visits_upto", F.lit(0)).alias("visits_whole")))
    facts = ["visit_id", "rank", "first", "lo"]
    span = whole.select(*key, "prediction_time", (F.coalesce("last_whole", F.lit(-1)).cast("long") + 1).alias("_from"), F.col("last_begun").cast("long").alias("_to"))
    inside = span.where("_from <= _to").withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {VISIT_BLOCK}"), F.expr(f"_to div {VISIT_BLOCK}"))))
    numbered = summary.where("visit_id <> 0").select("subject_id", *facts, F.expr(f"rank div {VISIT_BLOCK}").alias("_block"))
    later = inside.join(numbered, ["subject_id", "_block"]).where("rank between _from and _to and lo < prediction_time").drop("_block")
    outside = span.join(summary.where("visit_id = 0").select("subject_id", *facts), "subject_id").where("rank >= _from and lo < prediction_time")
    later = later.unionByName(outside).select(*key, "visit_id", "rank", "first", "prediction_time")
    counted = as_of(later, events.select("subject_id", "visit_id", "event_time", "place"), ["subject_id", "visit_id"], "prediction_time", "event_time", {"last_place": ("max", F.col("place"))}, large)
    counted = counted.select(*key, "visit_id", "rank", "first", (F.col("last_place") - F.col("first") + 1).alias("n_before"))
    newer = Window.partitionBy(*key).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    return whole, durable(counted.withColumn("n_newer", F.coalesce(F.sum("n_before").over(newer), F.lit(0))))


@dataclass(frozen=True)
class Ranged:
    """Patients with long histories, stored: their samples, events in order, and what lies before each index."""

    samples: DataFrame
    events: DataFrame
    whole: DataFrame
    visits: DataFrame


@dataclass(frozen=True)
class Past:
    """What all sequences of one sample set share, stored.

    ``held`` has one row for each patient with at most HELD events: ``asked``, the patient's samples, and ``visits``, the visits with their events, both in order. So
    what lies before an index is cut out of that row, and no step after it shuffles. ``ranged`` has the patients with more, if any: their events are read as ranges.
    """

    columns: list[str]
    held: DataFrame
    ranged: Ranged | None


def past(samples: DataFrame, encoded: DataFrame, most: int = HELD) -> Past:
    samples = unique_samples(samples)
    large = durable(large_keys(encoded.where("subject_id IS NOT NULL"), ["subject_id"], most))
    ranged = None
    if large.head(1):
        few, long = samples.join(F.broadcast(large), "subject_id", "left_semi"), encoded.join(F.broadcast(large), "subject_id", "left_semi")
        events = durable(placed(long))
        ranged = Ranged(few, events, *history(few, events))
        samples, encoded = samples.join(F.broadcast(large), "subject_id", "left_anti"), encoded.join(F.broadcast(large), "subject_id", "left_anti")
    return Past(samples.columns, durable(held_patients(samples, encoded)), ranged)


def held_patients(samples: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row per patient with samples; the total order is that of ``order_within_patient``. Events are shuffled once, by patient."""
    of_patient = encoded.where("subject_id IS NOT NULL").select(
        "subject_id", "visit_id", "event_time", "event_type", "event_priority", "concept_token", "concept_id", "type_id").repartition("subject_id")
    ordered = F.sort_array(F.collect_list(F.struct("event_time", "event_type", "event_priority", "concept_token", "concept_id", "type_id")))
    kept = F.transform(ordered, lambda e: F.struct(e["event_time"].alias("at"), e["concept_id"].alias("c"), e["type_id"].alias("t")))
    visits = of_patient.groupBy("subject_id", "visit_id").agg(kept.alias("events"))
    patients = visits.groupBy("subject_id").agg(F.sort_array(F.collect_list(F.struct(visit_rank().alias("rank"), "visit_id", "events"))).alias("visits"))
    rest = [c for c in samples.columns if c != "subject_id"]
    asked = samples.groupBy("subject_id").agg(F.collect_list(F.struct(*rest)).alias("asked"))
    return asked.join(patients, "subject_id", "left").select("subject_id", "asked", F.transform("visits", lambda v: F.struct(v["visit_id"], v["events"])).alias("visits"))


def _held_before(known: Past) -> DataFrame:
    """Each sample of a held patient with ``before``: the visits that have events before the index, with those events and their number in all."""
    each = known.held.select("subject_id", F.explode("asked").alias("_s"), "visits").select("subject_id", "_s.*", "visits").select(*known.columns, "visits")

    def cut(v: Column) -> Column:
        ended = F.element_at(v["events"], -1)["at"] < F.col("prediction_time")
        early = F.when(ended, v["events"]).otherwise(F.filter(v["events"], lambda e: e["at"] < F.col("prediction_time")))
        return F.struct(v["visit_id"].alias("v"), F.size(v["events"]).alias("n"), early.alias("events"))

    before = F.filter(F.transform("visits", cut), lambda v: F.size(v["events"]) > 0)
    return _once(each, known.columns, before, "before")


def _once(df: DataFrame, keep: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``value``, which is evaluated once however often it is used: a one-element explode, as projections would be merged."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def events_before(known: Past) -> DataFrame:
    """Per sample and visit the number of events before the index, the time of the last one, and whether that is the whole visit."""
    key = [c for c in [*SAMPLE, "drug_class"] if c in known.columns]
    cut = _held_before(known).select(*key, F.explode("before").alias("x"))
    out = cut.select(*key, F.col("x.v").alias("visit_id"), F.size("x.events").cast("long").alias("n_before"),
                     F.element_at("x.events", -1)["at"].alias("last_before"), (F.size("x.events") == F.col("x.n")).cast("int").alias("whole"))
    if known.ranged is None:
        return out
    events, whole, visits = known.ranged.events, known.ranged.whole, known.ranged.visits
    per = visit_summary(events).select("subject_id", "visit_id", "rank", "n", "hi")
    early = whole.join(per, "subject_id").where("rank <= last_whole").select(
        *key, "visit_id", F.col("n").alias("n_before"), F.col("hi").alias("last_before"), F.lit(1).alias("whole"))
    last = events.select("subject_id", F.col("place").alias("last_place"), F.col("event_time").alias("last_before"))
    later = (visits.withColumn("last_place", F.col("first") + F.col("n_before") - 1).join(last, ["subject_id", "last_place"])
             .join(per.select("subject_id", "visit_id", "n"), ["subject_id", "visit_id"]))
    later = later.select(*key, "visit_id", "n_before", "last_before", (F.col("n_before") == F.col("n")).cast("int").alias("whole"))
    return out.unionByName(early).unionByName(later)


def newest_rows(whole: DataFrame, visits: DataFrame, events: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` events before each index time: sample key and event columns.

    They are the ends of a few runs of places, so they are read as ranges: by patient and block of places, never by all events of a patient.
    """
    key = sample_key(whole)
    need = F.least(F.col("n_before"), F.greatest(F.lit(0), F.lit(keep) - F.col("n_newer")))
    parts = visits.withColumn("need", need).select(*key, (F.col("first") + F.col("n_before") - F.col("need")).alias("from"), (F.col("first") + F.col("n_before") - 1).alias("to"))
    later = visits.groupBy(*key).agg(F.sum("n_before").alias("n_later"))
    need = F.least(F.col("n_whole"), F.greatest(F.lit(0), F.lit(keep) - F.coalesce("n_later", F.lit(0))))
    parts = parts.unionByName(whole.join(later, key, "left").select(*key, (F.col("n_whole") - need + 1).alias("from"), F.col("n_whole").alias("to")))
    blocks = parts.where("`from` <= `to`").withColumn("block", F.explode(F.sequence(F.expr(f"`from` div {keep}"), F.expr(f"`to` div {keep}"))))
    return events.withColumn("block", F.expr(f"place div {keep}")).join(blocks, ["subject_id", "block"]).where("place between `from` and `to`").drop("block", "from", "to")


def _struct(concept: Column, kind: Column, visit: Column, date: Column) -> Column:
    return F.struct(concept.cast("int").alias("c"), kind.cast("int").alias("t"), visit.cast("int").alias("v"), date.cast("int").alias("d"))


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def _with_insertions(rows: Column, gaps: bool, delimiters: bool) -> Column:
    """For each event the tokens it brings: close the previous visit, gap, open this one, itself, close the last."""
    special = F.lit(0)

    def piece(x: Column, i: Column) -> Column:
        prev = F.get(rows, i - 1)
        last = i == F.size(rows) - 1
        opens = (i == 0) | (prev["v"] != x["v"])
        after_visit = opens & (i > 0) & (prev["v"] != 0)
        parts = []
        if delimiters:
            parts.append(F.when(after_visit, _struct(F.lit(S.V_END), special, prev["v"], prev["d"])))
        if gaps:
            gap = F.greatest(F.lit(0), x["d"] - prev["d"])
            parts.append(F.when(after_visit & (x["v"] != 0), _struct(S.gap_id(gap), special, x["v"], x["d"])))
        if delimiters:
            parts.append(F.when(opens & (x["v"] != 0), _struct(F.lit(S.V_START), special, x["v"], x["d"])))
        itself = _struct(x["c"], x["t"], x["v"], x["d"])
        parts.append(itself)
        if delimiters:
            parts.append(F.when(last & (x["v"] != 0), _struct(F.lit(S.V_END), special, x["v"], x["d"])))
        brings = opens | last if delimiters else after_visit  # most events bring only themselves
        return F.when(brings, F.filter(F.array(*parts), lambda p: p.isNotNull())).otherwise(F.array(itself))

    return F.transform(rows, piece)


def sequences(samples: DataFrame, encoded: DataFrame, max_seq_len: int = MAX_SEQ_LEN, gaps: bool = False,
              delimiters: bool = False) -> DataFrame:
    return sequences_of(past(samples, encoded), max_seq_len, gaps, delimiters)


def _held_rows(known: Past, newest: int) -> DataFrame:
    """Samples of held patients with the ``newest`` events before the index (``rows``) and how many events and visits there are in all."""
    def event(v: Column, e: Column) -> Column:
        return F.struct(e["c"].alias("c"), e["t"].alias("t"), v["v"].alias("v"), S.days_since_epoch(e["at"]).alias("d"))

    before = F.transform("before", lambda v: F.transform(v["events"], lambda e: event(v, e)))
    seen = F.coalesce(F.size(F.filter("before", lambda v: v["v"] != 0)), F.lit(0)).cast("long").alias("n_visits")
    flat = _held_before(known).select(*known.columns, seen, F.explode(F.array(F.flatten(before))).alias("all"))
    size = F.size("all")
    return flat.select(*known.columns, F.slice("all", F.greatest(size - newest + 1, F.lit(1)), F.lit(newest)).alias("rows"),
                       F.coalesce(size, F.lit(0)).cast("long").alias("n_events"), "n_visits")


def _ranged_rows(known: Ranged, newest: int) -> DataFrame:
    """The same for patients whose events are read as ranges."""
    samples, events, whole, visits = known.samples, known.events, known.whole, known.visits
    key = sample_key(samples)
    tail = newest_rows(whole, visits, events, newest).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("place"), F.col("concept_id").alias("c"), F.col("type_id").alias("t"),
        F.col("visit_id").alias("v"), S.days_since_epoch(F.col("event_time")).alias("d")))).alias("rows"))
    tail = tail.withColumn("rows", F.transform("rows", lambda x: F.struct(x["c"], x["t"], x["v"], x["d"])))
    totals = visits.groupBy(*key).agg(F.sum("n_before").alias("n_later"), F.sum(F.when(F.col("visit_id") != 0, 1).otherwise(0)).alias("visits_later"))
    out = samples.join(whole.select(*key, "n_whole", "visits_whole"), key, "left").join(totals, key, "left").join(tail, key, "left")

    def n(*columns: str) -> Column:
        return sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0))

    return out.select(*samples.columns, "rows", n("n_whole", "n_later").cast("long").alias("n_events"), n("visits_whole", "visits_later").cast("long").alias("n_visits"))


def sequences_of(known: Past, max_seq_len: int = MAX_SEQ_LEN, gaps: bool = False, delimiters: bool = False) -> DataFrame:
    """Token arrays per sample: [CLS], then the newest max_seq_len - 1 tokens of all earlier events.

    Insertions only add tokens, so the kept tokens lie within the newest max_seq_len - 1 events; one more event is
    read for the visit change at the cut.  They are cut out of the patient's row; of patients with long histories counts come from
    sums, and only those newest events are joined, so a sample brings at most max_seq_len rows, however long the history.
    """
    keep = max_seq_len - 1
    out = _held_rows(known, keep + 1)
    if known.ranged is not None:
        out = out.unionByName(_ranged_rows(known.ranged, keep + 1))
    others = [*known.columns, "n_events", "n_visits"]
    if gaps or delimiters:
        pieces = _with_insertions(F.col("rows"), gaps, delimiters)
        pieces = _bind(pieces, lambda p: F.slice(p, F.when(F.size("rows") > keep, 2).otherwise(1), F.lit(keep)))
        body = _bind(F.flatten(pieces), lambda b: F.slice(b, F.greatest(F.size(b) - keep + 1, F.lit(1)), F.lit(keep)))
    else:
        body = F.slice("rows", F.greatest(F.size("rows") - keep + 1, F.lit(1)), F.lit(keep))
    out = _once(out, others, body, "body")

    def after_cls(part: str, first: Column) -> Column:
        head = F.array(first.cast("int"))
        return F.coalesce(F.concat(head, F.col("body")[part]), head)

    index_day = S.days_since_epoch(F.col("prediction_time"))
    n_visits, n_body = F.col("n_visits"), F.when(F.col("body").isNull(), 0).otherwise(F.size("body"))
    raw = F.lit(1) + F.col("n_events")
    if delimiters:
        raw = raw + n_visits * 2
    if gaps:
        raw = raw + F.greatest(n_visits - 1, F.lit(0))
    return out.select(
        *known.columns, after_cls("c", F.lit(S.CLS)).alias("concept_ids"), after_cls("t", F.lit(0)).alias("type_ids"),
        after_cls("v", F.lit(0)).alias("visit_ids"), F.sequence(F.lit(0), n_body).alias("position_ids"),
        after_cls("d", index_day).alias("dates"), (n_body + 1).alias("seq_len"), raw.cast("int").alias("raw_seq_len"))


def horizon_sequences(seqs: DataFrame, horizons: DataFrame) -> DataFrame:
    """Every sequence once per horizon, with the horizon's task and label (see ``labels.multi_horizon``)."""
    key = sample_key(seqs)
    return seqs.drop("binary_label").join(horizons.select(*key, "task_id", "window_days", "binary_label"), key)


def with_age(samples: DataFrame, patients: DataFrame) -> DataFrame:
    known = patients.select("subject_id", "anchor_age", "anchor_year")
    years = S.age_years(F.col("anchor_age"), F.col("anchor_year"), F.col("prediction_time"))
    return (samples.join(known, "subject_id", "left").withColumn("age_years", years)
            .withColumn("age_id", S.age_bucket(F.col("age_years"))).drop("anchor_age", "anchor_year"))


def pad(seqs: DataFrame, length: int | None = None) -> DataFrame:
    """Right-pad every array with 0 and add the mask (id is not padding).  By default to the longest sequence."""
    longest = seqs.agg(F.max("seq_len")).scalar() if length is None else F.lit(length)
    padded = seqs
    for name in ARRAYS:
        fill = F.array_repeat(F.lit(0), longest - F.size(name))
        padded = padded.withColumn(name, F.concat(name, fill))
    return padded.withColumn("attention_mask", F.transform("concept_ids", lambda c: (c != S.PAD).cast("int")))


def token_rows(seqs: DataFrame) -> DataFrame:
    """One row per position."""
    key = sample_key(seqs)
    return seqs.select(*key, F.posexplode(F.arrays_zip("concept_ids", "type_ids", "visit_ids", "dates")).alias("position", "x")).select(
        *key, "position", F.col("x.concept_ids").alias("concept_id"), F.col("x.type_ids").alias("type_id"),
        F.col("x.visit_ids").alias("visit_id"), F.col("x.dates").alias("date"))


def decode(seqs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Positions with raw token, readable label and the label with its visit."""
    from chronocohort.operators.timeline import join_fitted

    rows = join_fitted(token_rows(seqs), vocab.select(F.col("id").alias("concept_id"), "token"), ["concept_id"], stored=True)
    token = F.coalesce("token", F.concat(F.lit("["), F.col("concept_id").cast("string"), F.lit("]")))
    label = S.token_label(F.col("token"))
    return rows.withColumn("token", token).select(
        *sample_key(seqs), "position", "token", label.alias("label"),
        F.concat(label, F.lit(" [V"), F.col("visit_id").cast("string"), F.lit("]")).alias("visit_label"))


def subject_cycles(samples: DataFrame, splits: DataFrame, subject_id: int | None = None) -> DataFrame:
    """All cycles of one patient (of every patient by default) with their split."""
    picked = samples if subject_id is None else samples.where(F.col("subject_id") == subject_id)
    return picked.join(splits.select("subject_id", "split"), "subject_id", "left")


def visit_type_counts(seqs: DataFrame) -> DataFrame:
    """Events per sample, visit and type; special tokens and padding left out."""
    names = F.create_map(*[F.lit(x) for name, i in S.TYPE_IDS.items() for x in (i, name)])
    return (token_rows(seqs).where((F.col("concept_id") != S.PAD) & (F.col("type_id") != 0))
            .groupBy(*sample_key(seqs), "visit_id", F.try_element_at(names, F.col("type_id")).alias("event_type")).agg(F.count("*").alias("n")))


def first_per_visit(seqs: DataFrame, k: int) -> DataFrame:
    """The first k positions of every visit of every sample."""
    order = Window.partitionBy(*sample_key(seqs), "visit_id").orderBy("position")
    return (token_rows(seqs).where(F.col("concept_id") != S.PAD).withColumn("rank_in_visit", F.row_number().over(order))
            .where(F.col("rank_in_visit") <= k))


# Edits.  Position 0 is never touched.

def zero_ids(ids: str, hit) -> Column:
    return F.transform(ids, lambda x, i: F.when((i > 0) & hit(x, i), F.lit(0)).otherwise(x))


def perturb_zero(seqs: DataFrame, vocab: DataFrame, prefix: str) -> DataFrame:
    """Set every token that starts with ``prefix`` to 0.

    Learned ids follow the binary token order, so those that match form one id range.
    """
    found = vocab.where(F.col("token").startswith(prefix) & (F.col("id") >= len(S.RESERVED)))
    bounds = found.agg(F.struct(F.min("id").alias("lo"), F.max("id").alias("hi"))).scalar()
    reserved = [i for i, t in enumerate(S.RESERVED) if t.startswith(prefix)]
    edited = seqs.withColumn("_b", bounds).withColumn("concept_ids", zero_ids("concept_ids", lambda x, i: F.coalesce(x.between(F.col("_b.lo"), F.col("_b.hi")), F.lit(False)) | x.isin(reserved)))
    return edited.drop("_b")


def token_id(vocab: DataFrame, token: str) -> int | None:
    row = vocab.where(F.col("token") == token).select("id").first()
    return row[0] if row else None


def perturb_replace(seqs: DataFrame, vocab: DataFrame, old: str, new: str) -> DataFrame:
    """Replace one token by another; unchanged when either is unknown."""
    a, b = token_id(vocab, old), token_id(vocab, new)
    if a is None or b is None:
        return seqs
    return seqs.withColumn("concept_ids", F.transform("concept_ids", lambda x, i: F.when((i > 0) & (x == a), F.lit(b)).otherwise(x)))


def perturb_visit(seqs: DataFrame, offset: int = -1) -> DataFrame:
    """Zero the n-th distinct visit, counted from the end when negative; unchanged when out of range.

    The visit is found in a step of its own (see ``_once``).
    """
    distinct = F.sort_array(F.array_distinct(F.filter(F.slice("visit_ids", F.lit(2), F.size("visit_ids")), lambda v: v > 0)))
    work = _once(seqs, ["*"], distinct, "_visits")
    index = F.size("_visits") + offset if offset < 0 else F.lit(offset)
    target = F.when(index >= 0, F.get("_visits", index))
    edited = F.transform("concept_ids", lambda x, i: F.when((i > 0) & (F.get("visit_ids", i) == F.col("_target")), F.lit(0)).otherwise(x))
    return _once(work, ["*"], target, "_target").withColumn("concept_ids", edited).drop("_visits", "_target")
