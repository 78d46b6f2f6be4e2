"""Second-order gradient boosting over quantised, sparse features.

Every sample is one row with the features it has, each as (feature, bin); what a sample lacks, a missing value or a token that does not occur, goes
where a split's learned direction sends it.  There is no cap on the number of features.  Several models (feature variants and seeds) grow side by side:

* the rows of 'train' and 'val' are packed once into blocks: cells in order, with the rows that have them, as plain numbers.  A pass neither sorts nor converts rows one by one, and
  passes below the first node read only blocks of 'train'.
* a level of a tree is one pass over the blocks; the first also brings the sums over all rows.  Tasks add up first and second derivatives per (model, node, feature, bin), of two nodes
  below a split only for the lighter one, as the other has what is left of the node above.  Spark adds up what the tasks found, and the best split of each node is found there; at most 2^depth splits per model reach the driver.
* derivatives are integers (multiples of 1 / SCALE), so their sums, and with them the trees, do not depend on how the rows are dealt out.
* scores of the trees so far are stored with the blocks every STORE_EVERY rounds, so a pass applies only the newest trees.
* after each round the area under the curve of the validation rows, in RANKS steps of the score, decides how long each model goes on; the trees up to its
  best round are kept.  Nothing is fitted twice.

Rows are sampled per tree by a hash of row, seed and round, features per tree by one of feature, seed and round.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronocohort.session import durable

SCALE = 1 << 24
RANKS = 4096
BINS = 256
#: Rows a task works on at once; places of rows in a block are stored in 16 bits.
BLOCK = 1 << 15
#: Blocks of a stored file, at most, beyond two files a core.
FILE_BLOCKS = 8
#: Features are numbers below this.
WIDTH = 1 << 31
STORE_EVERY = 8
HEAP = 64
ROWS = "row_id long, part string, label int, features array<int>, bins array<int>"
#: Each row a block of rows of one part; the binary columns hold numbers of the types in PACKED, ``margins`` those of each model in turn.
BLOCKS = "train boolean, n int, cells binary, starts binary, rows binary, row_id binary, label binary, margins binary"
PACKED = {"cells": np.int64, "starts": np.int32, "rows": np.uint16, "row_id": np.int64, "label": np.int32, "margins": np.float64}

SUMS = "model long, node long, feature long, bin long, g long, h long, n long"


@dataclass(frozen=True)
class Settings:
    rounds: int = 500
    patience: int = 30
    depth: int = 4
    step: float = 0.05
    least_weight: float = 5.0
    rows: float = 0.8
    columns: float = 0.8
    alpha: float = 0.1
    penalty: float = 1.0


@dataclass
class Tree:
    """Nodes by heap place: a split (feature, bin: at most this goes left, whether missing goes left) or a leaf value."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)


@dataclass
class Model:
    """One variant and seed; it sees features from ``first`` up to but not including ``last``."""

    name: str
    seed: int
    first: int
    last: int
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)
    weight: float = 1.0

    def best(self) -> int:
        return int(np.argmax(self.curve)) + 1 if self.curve else len(self.trees)


def mixed(x: np.ndarray, seed: int, salt: int) -> np.ndarray:
    """A hash in [0, 1) of each integer."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(((seed * 1_000_003 + salt) * 0x9E3779B97F4A7C15) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Block:
    """Some rows and what they have: each distinct cell (feature, bin) once, in order, and the rows of each cell one after another."""

    def __init__(self, rows: pa.RecordBatch | pa.Table):
        features, bins = (_joined(rows.column(c)) for c in ("features", "bins"))
        n = rows.num_rows
        at = np.repeat(np.arange(n), np.diff(features.offsets.to_numpy()))
        cells = features.flatten().to_numpy().astype(np.int64) * BINS + bins.flatten().to_numpy()
        small = len(cells) and 0 <= cells.min() and cells.max() < 1 << 16  # numbers of 16 bits are sorted by radix
        order = np.argsort(cells.astype(np.uint16) if small else cells, kind="stable")
        cells = cells[order]
        new = np.r_[True, cells[1:] != cells[:-1]][: len(cells)]
        self._set(n, cells[new], np.r_[np.flatnonzero(new), len(cells)], at[order])

    def _set(self, n: int, cells: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
        self.n, self.cells, self.starts, self.rows = n, cells, starts, rows
        self.columns: dict[int, np.ndarray] = {}

    @staticmethod
    def stored(batch: pa.RecordBatch, i: int) -> Block:
        """The block in row ``i`` of a batch of BLOCKS."""
        block, n = Block.__new__(Block), batch.column("n")[i].as_py()
        x = {c: np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in PACKED.items()}
        block._set(n, x["cells"], x["starts"], x["rows"])
        block.train, block.row_id, block.label, block.margins = batch.column("train")[i].as_py(), x["row_id"], x["label"], x["margins"].reshape(-1, n)
        return block

    def column(self, feature: int) -> np.ndarray:
        """The bin of each row, -1 where it has none."""
        if feature not in self.columns:
            c, d = np.searchsorted(self.cells, [feature * BINS, (feature + 1) * BINS])
            out = np.full(self.n, -1, np.int16)
            out[self.rows[self.starts[c] : self.starts[d]]] = np.repeat((self.cells[c:d] % BINS).astype(np.int16), np.diff(self.starts[c : d + 1]))
            self.columns[feature] = out
        return self.columns[feature]

    def places(self, tree: Tree) -> np.ndarray:
        """The leaf of each row."""
        at_node, node = {0: np.ones(self.n, bool)}, np.zeros(self.n, np.uint8)
        for at in sorted(tree.splits):
            feature, limit, missing_left = tree.splits[at]
            here, bins = at_node.pop(at), self.column(feature)
            left = here & ((bins if missing_left else bins.view(np.uint16)) <= limit)  # without a sign, what is missing is the largest number
            at_node[2 * at + 1], at_node[2 * at + 2] = left, here ^ left
        for at, here in at_node.items():
            if at:
                node += here.view(np.uint8) * np.uint8(at)
        return node

    @cached_property
    def often(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds, in cells, of the features that half of the rows or more have."""
        feature = self.cells // BINS
        first = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]][: len(feature)])
        last = np.r_[first[1:], len(feature)][: len(first)]
        many = 2 * (self.starts[last] - self.starts[first]) >= self.n
        return first[many], last[many]

    @cached_property
    def seldom(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The other features' cells, the starts of their entries, and each entry's row and place in these cells."""
        rare = np.ones(len(self.cells), bool)
        for c, d in zip(*self.often):
            rare[c:d] = False
        count = np.diff(self.starts)
        entries = np.repeat(rare, count)
        cells = np.flatnonzero(rare)
        return cells, np.r_[0, np.cumsum(count[cells])], self.rows[entries].astype(np.intp), np.repeat(np.arange(len(cells)), count[cells])

    def cell_sums(self, kept: np.ndarray, place: np.ndarray, places: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, cell, sum of g, sum of h) over the entries of the ``kept`` cells in rows whose place is not negative.

        Features that most rows have are added up row by row, others entry by entry."""
        used = np.flatnonzero(place >= 0)
        g, h = _for_sums(g), _for_sums(h)
        lines = g[used], h[used]
        none = bool((lines[1] <= 0).any())  # then a cell without a sum may have rows
        out = []

        def add(at: np.ndarray, values: Sequence[np.ndarray], size: int, cells) -> None:
            """``cells`` brings positions among the ``size`` sums to (place, cell); cells are left out where there are no rows."""
            if size > 4 * len(at) + (1 << 16):
                found, at = np.unique(at, return_inverse=True)
                sums = [_added(at, x, len(found)) for x in values]
            else:
                sums = [_added(at, x, size) for x in values]
                found = np.flatnonzero(np.bincount(at, minlength=size) if none else sums[1])
                sums = [x[found] for x in sums]
            where, cell = cells(found)
            ok = cell >= 0
            ok[ok] = kept[cell[ok]]
            out.append([x[ok] for x in (where, cell, *sums)])

        base = place[used].astype(np.int64) * (BINS + 1) + 1
        for c, d in zip(*self.often):
            if kept[c:d].any():
                by_bin = np.full(BINS + 1, -1)
                by_bin[self.cells[c:d] % BINS + 1] = np.arange(c, d)

                def frequent(found: np.ndarray, by_bin=by_bin) -> tuple[np.ndarray, np.ndarray]:
                    where, bin_ = np.divmod(found, BINS + 1)
                    return where, by_bin[bin_]

                add(base + self.column(int(self.cells[c]) // BINS).take(used), lines, places * (BINS + 1), frequent)
        cells, starts, rows, at = self.seldom
        wanted = np.flatnonzero(kept[cells])
        if len(wanted):  # cells are in order, so one range of entries holds them
            first, last = wanted[0], wanted[-1] + 1
            some, width = slice(starts[first], starts[last]), int(last - first)
            among = np.flatnonzero((place >= 0).take(rows[some]))
            rows = rows[some].take(among)

            def others(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                where, cell = np.divmod(found, width)
                return where, cells[first + cell]

            add((place * width - first).take(rows) + at[some].take(among), [x.take(rows) for x in (g, h)], width * places, others)
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros((4, 0), np.int64))

    def score(self, trees: Sequence[Tree], start: np.ndarray) -> np.ndarray:
        for tree in trees:
            values = np.zeros(2 * HEAP)
            values[list(tree.values)] = list(tree.values.values())
            start = start + values[self.places(tree)]
        return start


def _joined(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _for_sums(x: np.ndarray) -> np.ndarray:
    """As doubles, unless sums could leave the integers that doubles hold."""
    return x.astype(np.float64) if float(np.abs(x, dtype=np.float64).sum()) < 1 << 53 else x


def _added(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    if x.dtype == np.float64:
        return np.bincount(at, x, size).astype(np.int64)
    sums = np.zeros(size, np.int64)
    np.add.at(sums, at, x)
    return sums


def probability(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def _derivatives(block: Block, margin: np.ndarray, model: Model, s: Settings, round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of this tree, and their derivatives as integers."""
    p = probability(margin)
    weight = np.where(block.label == 1, model.weight, 1.0)
    used = mixed(block.row_id, model.seed, 2 * round_) < s.rows
    return used, np.rint((p - block.label) * weight * SCALE).astype(np.int64), np.rint(p * (1 - p) * weight * SCALE).astype(np.int64)


def _sums(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each distinct code, in order, and the sums of ``values`` over its entries."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    return codes[first], *[np.add.reduceat(x[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64) for x in values]


def _tables(stream: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.Table]:
    """The rows of all batches, ``size`` at a time."""
    held, n = [], 0
    for batch in stream:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(held)
            for k in range(0, n - n % size, size):
                yield table.slice(k, size)
            n %= size
            held = table.slice(table.num_rows - n).to_batches() if n else []
    if n:
        yield pa.Table.from_batches(held)


def _pack(stream: Iterator[pa.RecordBatch], models: int, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks (see BLOCKS) of ``size`` rows of part 'train' or 'val' with scores of 0; other rows are left out."""
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}

    def block(train: bool, table: pa.Table) -> pa.RecordBatch:
        b = Block(table)
        x = {"cells": b.cells, "starts": b.starts, "rows": b.rows, "row_id": _joined(table.column("row_id")).to_numpy(),
             "label": _joined(table.column("label").fill_null(0)).to_numpy(), "margins": np.zeros(models * b.n)}
        columns = [pa.array([train]), pa.array([b.n], pa.int32()), *[pa.array([x[c].astype(t).tobytes()], pa.binary()) for c, t in PACKED.items()]]
        return pa.RecordBatch.from_arrays(columns, names=["train", "n", *PACKED])

    for batch in stream:
        for train in held:
            some = batch.filter(pc.equal(batch.column("part"), "train" if train else "val"))
            if some.num_rows:
                held[train].append(some)
            if sum(x.num_rows for x in held[train]) >= size:
                tables = list(_tables(iter(held[train]), size))
                held[train] = [] if tables[-1].num_rows == size else tables.pop().to_batches()
                for table in tables:
                    yield block(train, table)
    for train in held:
        for table in _tables(iter(held[train]), size):
            yield block(train, table)


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in stream:
        for i in range(batch.num_rows):
            yield Block.stored(batch, i)


def _pass(stream: Iterator[pa.RecordBatch], active: list[tuple[int, Model, list[Tree], Tree, list[int]]], s: Settings, round_: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Sums per (model, node, feature, bin) of the open nodes over blocks of part 'train', with ``whole`` also those of the first node as such (feature -1); counts of
    the rows of each score step (feature -2) over blocks of part 'val'.  ``n`` is 0 where a cell has no rows, also after sums were taken from one another."""
    held: list[tuple] = []

    def code(model, node, feature, bin_):
        return ((model * 2 * HEAP + node) * (WIDTH + 2) + feature + 2) * RANKS + bin_

    for block in _blocks(stream):
        features, bins = np.divmod(block.cells, BINS)
        for number, model, newest, growing, open_ in active:
            margin = block.score(newest, block.margins[number])
            if not block.train:
                step = np.minimum((probability(margin) * RANKS).astype(np.int64), RANKS - 1)
                counts = [np.bincount(step[kept], minlength=RANKS) for kept in (block.label == 1, block.label == 0, slice(None))]
                found = np.flatnonzero(counts[2])
                held.append((code(number, 0, -2, found), *[x[found] for x in counts]))
                continue
            used, g, h = _derivatives(block, margin, model, s, round_)
            if whole:
                held.append((np.array([code(number, 0, -1, 0)]), *[np.array([x[used].sum()]) for x in (g, h, used)]))
            place = np.full(2 * HEAP, -1)
            place[open_] = np.arange(len(open_))
            place = np.where(used, place[block.places(growing)], -1)
            kept = (features >= model.first) & (features < model.last) & (mixed(features, model.seed, 2 * round_ + 1) < s.columns)
            node, cell, sum_g, sum_h = block.cell_sums(kept, place, len(open_), g, h)
            rows = sum_h  # without rows exactly where it is 0, if all rows have some weight
            if (h[used] <= 0).any():
                one = np.ones(block.n, np.int64)
                rows = block.cell_sums(kept, place, len(open_), one, one)[3]
            held.append((code(number, np.array(open_)[node], features[cell], bins[cell]), sum_g, sum_h, rows))
        if len(held) > 64 * max(1, len(active)):
            held = [_sums(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        codes, *sums = _sums(*(np.concatenate(x) for x in zip(*held)))
        rest, bins = np.divmod(codes, RANKS)
        rest, features = np.divmod(rest, WIDTH + 2)
        model, node = np.divmod(rest, 2 * HEAP)
        for k in range(0, len(codes), 10_000):
            cut = slice(k, k + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (model, node, features - 2, bins, *sums)], names=["model", "node", "feature", "bin", "g", "h", "n"])


def _worth(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    x = g / SCALE
    t = np.where(x > s.alpha, x - s.alpha, np.where(x < -s.alpha, x + s.alpha, 0.0))
    return t * t / (h / SCALE + s.penalty)


def _best(stream: Iterator[pa.RecordBatch], totals: dict[tuple[int, int], tuple[int, int]], made: dict[tuple[int, int], list[tuple[int, int]]], s: Settings) -> Iterator[pa.RecordBatch]:
    """The best split of each (model, node) among the features of one partition; ties go to the smaller feature and bin."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in stream if batch.num_rows]
    if not parts:
        return
    model, node, feature, bin_, *sums = (np.concatenate(x) for x in zip(*parts))
    place, terms = model * 2 * HEAP + node, []
    for p in np.unique(place):
        rows = place == p
        k, read = divmod(int(p), 2 * HEAP)
        for target, sign in made.get((k, read), []):
            terms.append((((k * 2 * HEAP + target) * WIDTH + feature[rows]) * BINS + bin_[rows], *[sign * x[rows] for x in sums]))
    if not terms:
        return
    codes, g, h, n = _sums(*(np.concatenate(x) for x in zip(*terms)))
    codes, g, h = (x[n != 0] for x in (codes, g, h))
    if not len(codes):
        return
    group, bin_ = np.divmod(codes, BINS)
    place, feature = np.divmod(group, WIDTH)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])

    def upto(x):
        run = np.cumsum(x)
        return run - np.repeat(run[first] - x[first], size), np.repeat(np.add.reduceat(x, first), size)

    (cg, fg), (ch, fh) = upto(g), upto(h)
    tg, th = (np.array([totals[divmod(int(k), 2 * HEAP)][i] for k in np.unique(place)], np.int64)[np.searchsorted(np.unique(place), place)] for i in (0, 1))
    heavy = int(s.least_weight * SCALE)
    rows = []
    for missing_left, lg, lh in ((False, cg, ch), (True, cg + tg - fg, ch + th - fh)):
        gain = _worth(lg, lh, s) + _worth(tg - lg, th - lh, s) - _worth(tg, th, s)
        ok = np.flatnonzero((lh >= heavy) & (th - lh >= heavy) & (gain > 1e-9))
        rows.append((place[ok], gain[ok], feature[ok], bin_[ok], np.full(len(ok), missing_left), lg[ok], lh[ok]))
    place, gain, feature, bin_, missing_left, lg, lh = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((~missing_left, bin_, feature, -gain, place))
    order = order[np.r_[True, place[order][1:] != place[order][:-1]]] if len(order) else order
    columns = [*np.divmod(place, 2 * HEAP), gain, feature, bin_, missing_left, lg, lh]
    yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], names=["model", "node", "gain", "feature", "bin", "missing_left", "left_g", "left_h"])


def best_splits(sums: DataFrame, totals: dict[tuple[int, int], tuple[int, int]], s: Settings, made: dict[tuple[int, int], list[tuple[int, int]]] | None = None) -> list:
    """(model, node, gain, feature, bin, missing_left, left_g, left_h) of each open node's best split.

    ``sums`` are the tasks' sums; Spark brings those of a feature together, and of each partition only one row per open node goes to the driver.
    ``made`` says to which nodes (node, sign) the sums of a (model, node) are added; by default the first nodes are as they were read."""
    kinds = "model long, node long, gain double, feature long, bin long, missing_left boolean, left_g long, left_h long"
    made = {k: [(k[1], 1)] for k in totals} if made is None else made
    found = sums.where("feature >= 0").repartition("model", "feature").mapInArrow(lambda stream: _best(stream, totals, made, s), kinds).collect()
    best: dict[tuple[int, int], tuple] = {}
    for r in found:
        rank = (-r["gain"], r["feature"], r["bin"], not r["missing_left"])
        if (r["model"], r["node"]) not in best or rank < best[r["model"], r["node"]][0]:
            best[r["model"], r["node"]] = (rank, r)
    return [r for _, r in best.values()]


def _leaf(g: int, h: int, s: Settings) -> float:
    x = g / SCALE
    t = x - s.alpha if x > s.alpha else x + s.alpha if x < -s.alpha else 0.0
    return -t / (h / SCALE + s.penalty) * s.step


def _area(steps: dict[int, tuple[int, int]]) -> float | None:
    """Area under the curve of counts (positive, negative) by score step."""
    above, area, pos, neg = 0, 0.0, sum(p for p, _ in steps.values()), sum(n for _, n in steps.values())
    for k in sorted(steps, reverse=True):
        p, n = steps[k]
        area += n * (above + p / 2)
        above += p
    return area / (pos * neg) if pos and neg else None


def _dealt(rows: DataFrame, least: int = 0) -> DataFrame:
    """``rows`` dealt over all cores: a small table comes in a few files, but each row costs much and is read in every pass."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, least))


def _packed(rows: DataFrame, models: list[Model]) -> DataFrame:
    """The blocks (see BLOCKS) of ``rows``, dealt over all cores, and the models with the weight of a positive row."""
    train = F.col("part") == "train"
    positive, n, n_val = rows.agg(F.count(F.when(train & (F.col("label") == 1), 1)), F.count(F.when(train, 1)), F.count(F.when(F.col("part") == "val", 1))).first()
    for m in models:
        m.weight = (n - positive) / positive if positive else 1.0
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    size = max(1, min(BLOCK, -(-(n + n_val) // tasks)))
    blocks = -(-(n + n_val) // size)
    found = rows.select("row_id", "part", "label", "features", "bins").coalesce(max(tasks, blocks))  # so that many small files do not become many small blocks
    return _dealt(found.mapInArrow(lambda stream, k=len(models): _pack(stream, k, size), BLOCKS), blocks // FILE_BLOCKS)


def _whole(sums: DataFrame, active: list) -> tuple[dict, dict]:
    """Sums over all rows of this round's trees, and the validation counts by score step, of each model."""
    found = sums.where("feature < 0").groupBy("model", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    totals, steps = {}, {k: {} for k, *_ in active}
    for r in found.collect():  # a total and RANKS counts for each model
        if r["feature"] == -1:
            totals[r["model"], 0] = (r["g"], r["h"])
        else:
            steps[r["model"]][r["bin"]] = (r["g"], r["h"])
    return totals, steps


def fit(rows: DataFrame, models: list[Model], s: Settings = Settings()) -> list[Model]:
    """Grow ``models`` on the rows (see ROWS) of part 'train', judged on part 'val'."""
    now = durable(_packed(rows, models))
    stored = 0
    going = list(range(len(models)))
    for round_ in range(s.rounds + 1):
        active = [(k, models[k], models[k].trees[stored:], Tree(), [0]) for k in going]
        blocks = now if round_ < s.rounds else now.where("not train")
        first = blocks.mapInArrow(lambda stream, a=active, r=round_: _pass(stream, a, s, r, True), SUMS)
        if round_ < s.rounds:
            first = first.persist()  # the sums of the tasks are read twice
        totals, steps = _whole(first, active)
        if round_:
            for k in going:
                area = _area(steps[k])
                if area is not None:
                    models[k].curve.append(area)
            going = [k for k in going if not models[k].curve or len(models[k].curve) - models[k].best() < s.patience]
        if round_ == s.rounds or not going:
            first.unpersist()
            return models
        trees = {k: Tree() for k in going}
        read = [first.where(F.col("model").isin(going))]  # of each level
        terms = {(k, 0): [(0, 1)] for k in going}  # the nodes read, and their signs, that give an open node's sums
        for level in range(s.depth):
            made: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for (k, n), of in terms.items():
                for at, sign in of:
                    made.setdefault((k, at), []).append((n, sign))
            above, terms, light = terms, {}, {k: [] for k in going}
            for r in best_splits(reduce(DataFrame.unionAll, read), totals, s, made):
                k, n = r["model"], r["node"]
                trees[k].splits[n] = (r["feature"], r["bin"], r["missing_left"])
                g, h = totals.pop((k, n))
                totals[k, 2 * n + 1], totals[k, 2 * n + 2] = (r["left_g"], r["left_h"]), (g - r["left_g"], h - r["left_h"])
                small, other = sorted((2 * n + 1, 2 * n + 2), key=lambda c: totals[k, c][1])
                light[k].append(small)
                terms[k, small], terms[k, other] = [(small, 1)], [*above[k, n], (small, -1)]
            active = [(k, models[k], models[k].trees[stored:], trees[k], light[k]) for k in going if light[k]]
            if not active or level == s.depth - 1:
                break
            read.append(now.where("train").mapInArrow(lambda stream, a=active, r=round_: _pass(stream, a, s, r, False), SUMS).persist())
        for df in (first, *read[1:]):
            df.unpersist()
        for k in going:
            trees[k].values = {n: _leaf(g, h, s) for (m, n), (g, h) in totals.items() if m == k}
            models[k].trees.append(trees[k])
        if (round_ + 1) % STORE_EVERY == 0:
            newest = [m.trees[stored : round_ + 1] for m in models]

            def moved(stream: Iterator[pa.RecordBatch], newest=newest) -> Iterator[pa.RecordBatch]:
                for batch in stream:
                    margins = [np.concatenate([b.score(t, b.margins[k]) for k, t in enumerate(newest)]).tobytes() for b in _blocks([batch])]
                    at = batch.schema.get_field_index("margins")
                    yield batch.set_column(at, batch.schema.field(at), pa.array(margins, pa.binary()))

            now = durable(now.mapInArrow(moved, now.schema))
            stored = round_ + 1
    return models


def first_splits(rows: DataFrame, models: list[Model], s: Settings) -> list:
    """The best split of each model's first node (see ``best_splits``)."""
    blocks = _packed(rows, models)
    active = [(k, m, [], Tree(), [0]) for k, m in enumerate(models)]
    sums = durable(blocks.mapInArrow(lambda stream: _pass(stream, active, s, 0, True), SUMS))
    return best_splits(sums, _whole(sums, active)[0], s)


def kept(models: list[Model]) -> list[Model]:
    """The models with the trees of their best rounds."""
    return [Model(m.name, m.seed, m.first, m.last, m.trees[: m.best()], m.curve, m.weight) for m in models]


def _scored(rows: DataFrame, models: list[Model], keep: Sequence[str], added: T.StructType, columns) -> DataFrame:
    """Columns ``keep`` of every row with ``columns`` of the probabilities (model by row) of each table of rows: lists of the ``added`` ones, each as many rows again."""
    names = [*keep, *added.names]

    def scored(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(stream):
            block = Block(table)
            old = [_joined(table.column(c)) for c in keep]
            for new in columns([probability(block.score(m.trees, np.zeros(block.n))) for m in models]):
                yield pa.RecordBatch.from_arrays([*old, *new], names=names)

    schema = T.StructType([rows.schema[c] for c in keep] + added.fields)
    return rows.select(*dict.fromkeys([*keep, "features", "bins"])).mapInArrow(scored, schema)


def score(rows: DataFrame, models: list[Model], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Columns ``keep`` of every row with (variant, seed, prob_cardiotoxic, n_trees) of every model."""

    def columns(found: list[np.ndarray]) -> Iterator[list[pa.Array]]:
        for m, p in zip(models, found):
            yield [pa.repeat(pa.scalar(m.name), len(p)), pa.array(np.full(len(p), m.seed, np.int32)), pa.array(p), pa.array(np.full(len(p), len(m.trees), np.int32))]

    return _scored(rows, models, keep, T.StructType.fromDDL("variant string, seed int, prob_cardiotoxic double, n_trees int"), columns)


def score_all(rows: DataFrame, models: list[Model], keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``scores``, the probability by each model in turn."""

    def columns(found: list[np.ndarray]) -> Iterator[list[pa.Array]]:
        offsets = np.arange(0, (len(found[0]) + 1) * len(models), len(models), dtype=np.int32)
        yield [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack(found, axis=1).ravel()))]

    return _scored(rows, models, keep, T.StructType.fromDDL("scores array<double>"), columns)


def as_table(spark, models: list[Model]) -> DataFrame:
    """The models as rows, one for each node: what a stage stores."""
    rows = []
    for m in models:
        for i, t in enumerate(m.trees):
            rows += [(m.name, m.seed, m.first, m.last, i, at, *t.splits[at], None) for at in t.splits]
            rows += [(m.name, m.seed, m.first, m.last, i, at, None, None, None, v) for at, v in t.values.items()]
    return spark.createDataFrame(rows, "variant string, seed int, first long, last long, tree int, node int, feature int, bin int, missing_left boolean, value double")


def from_table(table: DataFrame) -> list[Model]:
    """The models of a stored stage; a model has at most rounds x 2^(depth + 1) rows."""
    models: dict[tuple, Model] = {}
    for r in table.orderBy("variant", "seed", "tree", "node").collect():
        m = models.setdefault((r["variant"], r["seed"]), Model(r["variant"], r["seed"], r["first"], r["last"]))
        while len(m.trees) <= r["tree"]:
            m.trees.append(Tree())
        if r["feature"] is None:
            m.trees[r["tree"]].values[r["node"]] = r["value"]
        else:
            m.trees[r["tree"]].splits[r["node"]] = (r["feature"], r["bin"], r["missing_left"])
    return list(models.values())
