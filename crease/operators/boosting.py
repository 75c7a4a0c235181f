"""Second-order gradient boosting for binary labels over binned columns.

Features are cut into at most ``max_bins`` bins at quantiles (a mergeable sketch); rows travel as blocks of bin
numbers, one byte or two a value.  For each level of a tree one pass over the blocks adds up the gradients and Hessians of
the logistic loss by (node, feature, bin); from these sums alone the best splits follow:

    gain = GL²/(HL+λ) + GR²/(HR+λ) − G²/(H+λ)        leaf value = −η·G/(H+λ)

A task adds up all its blocks before it gives out one histogram, and of two children only the smaller is added up: the
other's sums are the parent's less these.  Gradients are whole numbers of 2⁻³⁰, so sums do not depend
on their order: the same rows and cuts give the same model in any partitioning, and again after a task is repeated.  Missing
values have a bin of their own and go to the side where they gain more.  Each tree sees a hash sample of the rows and a
seeded choice of the columns.

Blocks are Parquet files in the shared folder.  Each task takes its blocks to its executor's disk once and keeps there the
scores of its rows and the gradients of the tree that is grown, so a pass neither sends rows to Python nor works out older
trees again.  What a task does not find there it makes from the blocks and the trees, so a lost executor costs no tree.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.session import ship_package
from crease.sources.sinks import remove_path, scratch_path

#: Gradients and Hessians are whole numbers of this.
UNIT = 2.0 ** -30
#: Trees that go along with each pass; older ones are broadcast, for tasks that lost their rows' scores.
REFRESH = 10
#: Rows a task works on at once, so that their columns stay near the core.
CHUNK_ROWS = 32_768
#: Rows of one task at least, as a pass over less is mostly the cost of starting tasks, and beyond which tasks are made
#: though all cores have one; a tree takes one pass a level, so both count in each of them.  A task holds one chunk of its
#: rows at a time, and a pass over 5,000,000 takes it less than a second.
TASK_ROWS, FULL_TASK_ROWS = 20_000, 5_000_000
#: Inner nodes up to which all rows are held against all of a tree's tests.
TESTS = 64
#: Bytes of partial histograms that may come to the driver in one pass; beyond, they are added up on the executors.
DRIVER_BYTES = 64 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 divided by the golden ratio


@dataclass(frozen=True)
class BoostingParams:
    rounds: int = 300
    max_depth: int = 4
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    l2: float = 1.0
    min_child_weight: float = 1.0
    max_bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; children come after their parent, node 0 is the root, a leaf has feature -1.

    A row goes left where its value is under ``cut`` (its bin under ``bin``), or is missing and ``missing_left``.
    """

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf(self, goes_left: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
        """The node each of ``rows`` rows ends in, by one pass over a column for each test, from the leaves up."""
        ends: list = [np.int16(node) for node in range(len(self.feature))]
        for node in range(len(ends) - 1, -1, -1):
            if self.feature[node] >= 0:
                left, right = ends[self.left[node]], ends[self.right[node]]
                ends[node] = right ^ ((left ^ right) & -goes_left(node).astype(np.int16))  # a choice without a branch
                ends[self.left[node]] = ends[self.right[node]] = None
        return np.broadcast_to(ends[0], rows)

    @property
    def few_tests(self) -> bool:
        return np.count_nonzero(self.feature >= 0) <= TESTS

    def apply(self, values: np.ndarray, cuts: np.ndarray, is_missing: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The node each row ends in, by raw values and ``cut`` or by bins and ``bin``."""
        at, rows = np.zeros(len(values), np.int32), np.arange(len(values))
        while (inner := self.feature[at] >= 0).any():
            value = values[rows, np.maximum(self.feature[at], 0)]
            goes_left = (value < cuts[at]) | (self.missing_left[at] & is_missing(value))
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return at


@dataclass
class BoostedTrees:
    feature_cols: list[str]
    base: float  # log-odds before any tree
    trees: list[Tree] = field(default_factory=list)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table: at most rounds × 2^(depth + 1) rows."""
        rows = [(t, n, *(_plain(getattr(tree, c)[n]) for c in NODE_COLUMNS))
                for t, tree in enumerate(self.trees) for n in range(len(tree.feature))]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @staticmethod
    def from_nodes(nodes: DataFrame, feature_cols: Sequence[str], base: float) -> BoostedTrees:
        table = nodes.orderBy("tree", "node").toPandas()
        trees = [Tree(*(part[c].to_numpy() for c in NODE_COLUMNS)) for _, part in table.groupby("tree", sort=True)]
        return BoostedTrees(list(feature_cols), float(base), trees)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows of raw values, in the order of ``feature_cols``."""
        return self.scorer()(values)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """``margins`` with what does not depend on the rows worked out: trees over bins of the cuts they have."""
        cuts = cuts_of(((tree.feature, tree.cut) for tree in self.trees), len(self.feature_cols))
        trees = [replace(tree, bin=bins_of(tree.feature, tree.cut, cuts)) for tree in self.trees]

        def margins(values: np.ndarray) -> np.ndarray:
            out = np.full(len(values), self.base)
            block = Block.__new__(Block)
            block.bins, block.missing_bin = np.ascontiguousarray(bin_values(values, cuts).T), missing_bin(cuts)
            for tree in trees:
                out += tree.value[block.leaf(tree)]
            return out

        return margins

    def importance(self) -> dict[str, float]:
        """The gains of each feature's splits."""
        total = dict.fromkeys(self.feature_cols, 0.0)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    total[self.feature_cols[feature]] += float(gain)
        return total


NODE_COLUMNS = ["feature", "bin", "cut", "missing_left", "left", "right", "cover", "value", "gain"]
NODE_SCHEMA = ("tree int, node int, feature int, bin int, cut double, missing_left boolean, left int, right int, "
               "cover double, value double, gain double")


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


# ---------------------------------------------------------------- bins and blocks
def quantile_cuts(df: DataFrame, feature_cols: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Ascending cuts of each feature, at most ``max_bins - 1``; bin i holds the values from cut i - 1 up to cut i.

    A feature with few values is cut at each of them, others at quantiles of their values."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in feature_cols])
    most = int(0.8 * max_bins)

    def few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct values of each feature, or one more than ``most`` of them."""
        seen = [np.zeros(0) for _ in feature_cols]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(seen[i]) <= most:
                    values = column.to_numpy(zero_copy_only=False)
                    seen[i] = np.union1d(seen[i], values[~np.isnan(values)])[:most + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen, pa.list_(pa.float64()))],
                                         names=["feature", "found"])

    found = [np.zeros(0) for _ in feature_cols]
    many = set()
    for row in d.mapInArrow(few_values, "feature int, found array<double>").groupBy("feature").agg(
            F.max(F.size("found")).alias("size"),
            F.slice(F.array_distinct(F.flatten(F.collect_set("found"))), 1, most + 1).alias("found")).collect():
        found[row.feature] = row.found
        if max(row.size, len(row.found)) > most:
            many.add(row.feature)
    if many:
        order = sorted(many)
        shares = [i / max_bins for i in range(max_bins)]
        for i, values in zip(order, d.approxQuantile([feature_cols[i] for i in order], shares, 0.25 / max_bins)):
            found[i] = [v for v in values if not np.isnan(v)]
    return [np.unique(values)[1:] for values in found]  # nothing lies under the least value


def missing_bin(cuts: Sequence[np.ndarray]) -> int:
    return max((len(c) for c in cuts), default=0) + 1


def cuts_of(tests: Iterable[tuple[np.ndarray, np.ndarray]], n_features: int) -> list[np.ndarray]:
    """Of each feature, the ascending cuts that the (features, cuts) of trees' nodes have; leaves have feature -1."""
    feature, cut = (np.concatenate(part) for part in zip(*tests, (np.zeros(0, int), np.zeros(0))))
    return [np.unique(cut[feature == f]) for f in range(n_features)]


def bins_of(feature: np.ndarray, cut: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bins under which a value is under ``cut``."""
    return np.array([np.searchsorted(cuts[f], c, side="right") if f >= 0 else 0 for f, c in zip(feature, cut)], np.int32)


def bin_values(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers; a missing value has the number after the last bin of ``max(len(cuts))``."""
    missing = missing_bin(cuts)
    out = np.empty(values.shape, np.uint16)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(values[:, f]), missing, np.searchsorted(c, values[:, f], side="right"))
    return out


BLOCKS = "n long, bins binary, labels binary, ids binary, margins binary"


def _block_schema() -> pa.Schema:
    return pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("bins", "labels", "ids", "margins"))])


def to_blocks(df: DataFrame, feature_cols: Sequence[str], target: str, id_col: str, cuts: Sequence[np.ndarray],
              base: float) -> DataFrame:
    schema = _block_schema()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
                bins = bin_values(np.stack(columns[:-2], axis=1).astype(float), cuts)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                    (len(bins), bins.T.tobytes(), columns[-2].astype(np.uint8).tobytes(),
                     columns[-1].astype(np.int64).tobytes(), np.full(len(bins), base).tobytes()), schema)], schema=schema)

    chosen = df.select(*[F.col(c).cast("double") for c in feature_cols], F.col(target).cast("int"),
                       F.xxhash64(id_col).alias("_id"))
    return chosen.mapInArrow(pack, BLOCKS)


class Block:
    """Rows of one block with their scores by all trees so far; ``bins`` is (features, rows)."""

    def __init__(self, batch: pa.RecordBatch, at: int, n_features: int, missing_bin: int, trees: Sequence[Tree]):
        n = batch.column(0)[at].as_py()
        bins, labels, ids, margins = (batch.column(i)[at].as_buffer() for i in range(1, 5))
        self.bins = np.frombuffer(bins, np.uint16).reshape(n_features, n)
        self.labels = np.frombuffer(labels, np.uint8)
        self.ids = np.frombuffer(ids, np.uint64)
        self.margins = np.frombuffer(margins, np.float64)
        self.missing_bin = missing_bin
        for tree in trees:
            self.margins = self.margins + tree.value[self.leaf(tree)]

    def leaf(self, tree: Tree) -> np.ndarray:
        """The node each row ends in. A missing value's bin is the largest of all, so it is under no cut."""
        if not tree.few_tests:
            return tree.apply(self.bins.T, tree.bin, lambda bins: bins == self.missing_bin)

        def goes_left(node: int) -> np.ndarray:
            column = self.bins[tree.feature[node]]
            under = column < np.uint16(tree.bin[node])
            if tree.missing_left[node]:
                under |= column == np.uint16(self.missing_bin)
            return under

        return tree.leaf(goes_left, self.bins.shape[1])

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-self.margins))
        return np.rint((p - self.labels) / UNIT), np.rint(p * (1 - p) / UNIT)

    def sampled(self, number: int, share: float, seed: int) -> np.ndarray:
        """Which rows tree ``number`` sees: a hash of the row's id."""
        if share >= 1:
            return np.ones(len(self.ids), bool)
        with np.errstate(over="ignore"):
            x = self.ids + _MIX * np.uint64(seed * 1_000_003 + number + 1)
            x = (x ^ (x >> np.uint64(31))) * _MIX
            x = (x ^ (x >> np.uint64(29))) * _MIX
        return (x >> np.uint64(11)).astype(float) < share * 2.0 ** 53


class Rows:
    """The rows of one task, on the disk of its executor: bins, labels and ids, the scores before a tree and the gradients
    of the rows the tree sees.

    A file is complete before it gets its name and never changed after, so a repeated or doubled task does no harm.
    """

    FIXED = {"bins": np.uint16, "labels": np.uint8, "ids": np.uint64}
    OF_TREE = {"margins": np.float64, "gradients": np.float64, "hessians": np.float64, "sampled": np.bool_}

    def __init__(self, folder: str, files: Sequence[str], n_features: int, missing_bin: int):
        self.folder, self.n_features, self.missing_bin = folder, n_features, missing_bin
        if not os.path.isdir(folder):
            self._take(files)
        self.sizes = np.load(f"{folder}/sizes.npy").tolist()

    def _take(self, files: Sequence[str]) -> None:
        made = f"{self.folder}-{uuid.uuid4().hex}"
        os.makedirs(made)
        sizes, waiting = [], []
        with ExitStack() as stack:
            to = {name: stack.enter_context(open(f"{made}/{name}", "wb")) for name in (*self.FIXED, "margins-0")}

            def write() -> None:
                sizes.append(sum(len(block.labels) for block in waiting))
                for name, file in to.items():
                    np.concatenate([getattr(block, name.split("-")[0]) for block in waiting], axis=-1).tofile(file)
                waiting.clear()

            for uri in files:
                store, path = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as source:
                    for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                        waiting += [Block(batch, at, self.n_features, self.missing_bin, []) for at in range(batch.num_rows)]
                        if sum(len(block.labels) for block in waiting) >= CHUNK_ROWS:
                            write()
            if waiting:
                write()
        np.save(f"{made}/sizes.npy", np.array(sizes, np.int64))
        try:
            os.rename(made, self.folder)
        except OSError:  # another attempt of the task was first
            shutil.rmtree(made, ignore_errors=True)

    def _blocks(self, number: int, names: Sequence[str]) -> Iterator[Block]:
        """The rows chunk by chunk with these columns, as they are before tree ``number``."""
        types = {**{name: (name, kind) for name, kind in self.FIXED.items()},
                 **{name: (f"{name}-{number}", kind) for name, kind in self.OF_TREE.items()}}
        if not self.sizes:
            return
        columns = {name: np.memmap(f"{self.folder}/{types[name][0]}", types[name][1], "r") for name in names}
        start = 0
        for n in self.sizes:
            block = Block.__new__(Block)
            block.missing_bin = self.missing_bin
            for name, column in columns.items():
                wide = self.n_features if name == "bins" else 1
                part = np.asarray(column[start * wide:(start + n) * wide])
                setattr(block, name, part.reshape(wide, n) if name == "bins" else part)
            yield block
            start += n

    def before(self, number: int, trees: Callable[[int], Iterable[Tree]], params: BoostingParams) -> Iterator[Block]:
        """The rows chunk by chunk as tree ``number`` sees them; ``trees(k)`` are the trees before it from number k on."""
        if not os.path.exists(f"{self.folder}/sampled-{number}"):
            known = max(k for k in self._numbers() if k <= number)
            later, suffix = list(trees(known)), uuid.uuid4().hex
            with ExitStack() as stack:
                to = {name: stack.enter_context(open(f"{self.folder}/{name}.{suffix}", "wb")) for name in self.OF_TREE}
                for block in self._blocks(known, ["bins", "labels", "ids", "margins"]):
                    for tree in later:
                        block.margins = block.margins + tree.value[block.leaf(tree)]
                    block.margins.tofile(to["margins"])
                    for name, part in zip(("gradients", "hessians"), block.gradients()):
                        part.tofile(to[name])
                    block.sampled(number, params.subsample, params.seed).tofile(to["sampled"])
            for name in self.OF_TREE:
                os.replace(f"{self.folder}/{name}.{suffix}", f"{self.folder}/{name}-{number}")
            for old in self._numbers():
                if old < number - 1:
                    for name in self.OF_TREE:
                        try:
                            os.remove(f"{self.folder}/{name}-{old}")
                        except FileNotFoundError:
                            pass
        for block in self._blocks(number, ["bins", "gradients", "hessians", "sampled"]):
            sums, seen = (block.gradients, block.hessians), block.sampled
            block.gradients, block.sampled = lambda sums=sums: sums, lambda *_, seen=seen: seen
            yield block

    def _numbers(self) -> list[int]:
        """The trees before which the scores are known."""
        return [int(name.split("-")[1]) for name in os.listdir(self.folder) if name.startswith("margins-")]


def histogram(block: Block, tree: Tree, open_nodes: Sequence[int], features: Sequence[int], n_bins: int,
              rows: np.ndarray) -> np.ndarray:
    """(2, nodes, features, bins) sums of gradients and Hessians, in units, as whole numbers."""
    slot_of = np.full(len(tree.feature), -1)
    slot_of[list(open_nodes)] = np.arange(len(open_nodes))
    slot = np.where(rows, slot_of[block.leaf(tree)], -1)
    used = np.flatnonzero(slot >= 0)
    base = slot[used] * n_bins
    size = len(open_nodes) * n_bins
    out = np.empty((2, len(features), size), np.int64)
    sums = [part[used] for part in block.gradients()]
    for i, f in enumerate(features):
        at = block.bins[f][used]
        if len(open_nodes) > 1:
            at = at + base
        for kind, part in enumerate(sums):  # exact: whole numbers far below 2**53
            out[kind, i] = np.bincount(at, weights=part, minlength=size)
    return out.reshape(2, len(features), len(open_nodes), n_bins).transpose(0, 2, 1, 3)


# ---------------------------------------------------------------- splits
@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float]  # sums of gradients and Hessians
    right: tuple[float, float]


def best_split(sums: np.ndarray, features: Sequence[int], n_cuts: np.ndarray, params: BoostingParams) -> Split | None:
    """The best split of one node from its (2, features, bins) sums, the last bin that of missing values; the first
    feature and cut of those that gain the same.  ``n_cuts`` is the number of cuts of each of ``features``."""
    g, h = sums[0].astype(float) * UNIT, sums[1].astype(float) * UNIT
    total_g, total_h = g[0].sum(), h[0].sum()
    best: Split | None = None
    no_cut = np.arange(g.shape[1] - 2) >= n_cuts[:, None]
    for missing_left in (False, True):
        left_g, left_h = np.cumsum(g[:, :-1], axis=1)[:, :-1], np.cumsum(h[:, :-1], axis=1)[:, :-1]
        if missing_left:
            left_g, left_h = left_g + g[:, -1:], left_h + h[:, -1:]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = (left_g ** 2 / (left_h + params.l2) + right_g ** 2 / (right_h + params.l2)
                - total_g ** 2 / (total_h + params.l2))
        gain[no_cut | (left_h < params.min_child_weight) | (right_h < params.min_child_weight)] = -np.inf
        if not gain.size:
            continue
        f, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best.gain):
            best = Split(float(gain[f, b]), int(features[f]), int(b) + 1, missing_left,
                         (float(left_g[f, b]), float(left_h[f, b])), (float(right_g[f, b]), float(right_h[f, b])))
    return best


class _Growing:
    """A tree that is being grown, level by level."""

    def __init__(self, params: BoostingParams, cuts: Sequence[np.ndarray]):
        self.params, self.cuts = params, cuts
        self.rows: list[list] = []
        self.open = [self._add(None)]
        #: Of the open nodes, those whose sums are to be added up, and for each its sibling and their parent's sums.
        self.counted, self.siblings = list(self.open), {}

    def _add(self, sums: tuple[float, float] | None) -> int:
        value = 0.0 if sums is None else -self.params.learning_rate * sums[0] / (sums[1] + self.params.l2)
        self.rows.append([-1, 0, 0.0, False, -1, -1, 0.0 if sums is None else sums[1], value, 0.0])
        return len(self.rows) - 1

    def grow(self, sums: np.ndarray, features: Sequence[int], last: bool) -> None:
        """Split the open nodes by the (2, nodes, features, bins) sums of the counted ones."""
        sums_of = {node: sums[:, slot] for slot, node in enumerate(self.counted)}
        for node, (sibling, both) in self.siblings.items():
            sums_of[sibling] = both - sums_of[node]  # whole numbers, so nothing is lost
        opened, self.counted, self.siblings = [], [], {}
        for node in self.open:
            of_node = sums_of[node]
            if node == 0:
                g, h = (float(part[0].sum()) * UNIT for part in of_node)
                self.rows[0][6:8] = h, -self.params.learning_rate * g / (h + self.params.l2)
            split = best_split(of_node, features, np.array([len(self.cuts[f]) for f in features]), self.params)
            if split is not None:
                children = self._add(split.left), self._add(split.right)
                self.rows[node][:6] = (split.feature, split.bin, float(self.cuts[split.feature][split.bin - 1]),
                                       split.missing_left, *children)
                self.rows[node][8] = split.gain
                opened += children
                less, more = children if split.left[1] <= split.right[1] else children[::-1]
                self.counted.append(less)
                self.siblings[less] = (more, of_node)
        self.open = [] if last else opened

    def tree(self) -> Tree:
        types = (np.int32, np.int32, float, bool, np.int32, np.int32, float, float, float)
        return Tree(*(np.array(c, t) for c, t in zip(zip(*self.rows), types)))


def chosen_features(n_features: int, number: int, params: BoostingParams) -> list[int]:
    """The columns that tree ``number`` may use."""
    count = max(1, int(params.colsample * n_features))
    draw = np.random.default_rng([params.seed, number])
    return sorted(draw.permutation(n_features)[:count].tolist())


def grow_tree(sums_of: Callable[[Tree, list[int], list[int]], np.ndarray], number: int, cuts: Sequence[np.ndarray],
              params: BoostingParams) -> Tree:
    """One tree; ``sums_of(tree, nodes, features)`` gives the histograms of all rows in these nodes."""
    features = chosen_features(len(cuts), number, params)
    growing = _Growing(params, cuts)
    for level in range(params.max_depth):
        if growing.open:
            growing.grow(sums_of(growing.tree(), growing.counted, features), features, level == params.max_depth - 1)
    return growing.tree()


# ---------------------------------------------------------------- on Spark
@dataclass(frozen=True)
class _Parts:
    """The blocks' files by task, and the folder on the executors' disks; picklable."""

    name: str
    files: list[list[str]]
    n_features: int
    n_bins: int

    def folder(self, part: int) -> str:
        local = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")
        return f"{local[part % len(local)]}/{self.name}-{part}"

    def rows(self, part: int) -> Rows:
        return Rows(self.folder(part), self.files[part], self.n_features, self.n_bins - 1)

    def forget(self, part: int) -> None:
        shutil.rmtree(self.folder(part), ignore_errors=True)


def _all_sums(held: RDD, parts: _Parts, older, newest: list[Tree], tree: Tree, opened: list[int], features: list[int],
              number: int, params: BoostingParams) -> np.ndarray:
    """``older`` is the broadcast list of the trees before ``newest``, None if there are none."""
    n_bins = parts.n_bins
    shape = (2, len(opened), len(features), n_bins)

    def trees(known: int) -> list[Tree]:
        first = number - len(newest)
        return newest[known - first:] if known >= first else [*older.value[known:], *newest]

    def add_up(part: int, waiting: Iterator) -> list[tuple[int, np.ndarray]]:
        total = np.zeros(shape, np.int64)
        for block in parts.rows(part).before(number, trees, params):
            total += histogram(block, tree, opened, features, n_bins, block.sampled())
        for _ in waiting:  # read last, as Spark may be late to send it
            pass
        return [(slot, total[:, slot]) for slot in range(len(opened))]

    partial = held.mapPartitionsWithIndex(add_up)
    # one histogram a task; with many tasks they are first added up by node
    if len(parts.files) * 8 * int(np.prod(shape)) > DRIVER_BYTES:
        partial = partial.reduceByKey(lambda a, b: a + b, len(opened))
    out = np.zeros(shape, np.int64)
    for slot, sums in partial.collect():
        out[:, slot] += sums
    return out


def _stored(df: DataFrame, tasks: int) -> tuple[list[list[str]], str]:
    """Files of each of ``tasks`` tasks, and the folder they are in."""
    path = scratch_path(df.sparkSession, "blocks")
    df.write.parquet(path)
    files = sorted(df.sparkSession.read.schema(BLOCKS).parquet(path).inputFiles())
    return [files[part::tasks] for part in range(tasks)], path


def fit_boosted_trees(train: DataFrame, feature_cols: Sequence[str], target: str, id_col: str = "rid",
                      params: BoostingParams = BoostingParams()) -> BoostedTrees:
    """Boosted trees on the rows of ``train`` whose target is 0 or 1; the first score is the log-odds of their share of
    ones.  With no row, or one class only, there are no trees."""
    feature_cols = list(feature_cols)
    ship_package(train.sparkSession)
    labelled = train.where(F.col(target).isNotNull())
    n, positive = labelled.agg(F.count("*"), F.sum(F.col(target).cast("double"))).first()
    if not n or not 0 < positive < n:
        share = (positive or 0.0) / n if n else 0.5
        return BoostedTrees(feature_cols, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    model = BoostedTrees(feature_cols, float(np.log(positive / (n - positive))))
    cuts = quantile_cuts(labelled, feature_cols, params.max_bins)
    n_bins = max(len(c) for c in cuts) + 2
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-n // TASK_ROWS), max(cores, -(-n // FULL_TASK_ROWS)))
    packed = to_blocks(labelled, feature_cols, target, id_col, cuts, model.base)
    files, path = _stored(packed.repartition(tasks), tasks)  # as many blocks to each task: every pass waits for the last
    parts = _Parts(f"crease-rows-{uuid.uuid4().hex}", files, len(cuts), n_bins)
    sc = train.sparkSession.sparkContext
    held = sc.parallelize(range(tasks), tasks).persist()  # a task goes where its part is kept, so it finds its rows there
    held.count()
    older, newest = None, []
    for number in range(params.rounds):
        model.trees.append(grow_tree(lambda tree, opened, features: _all_sums(
            held, parts, older, newest, tree, opened, features, number, params), number, cuts, params))
        newest.append(model.trees[-1])
        if len(newest) == REFRESH:
            if older is not None:
                older.unpersist()
            older, newest = sc.broadcast(list(model.trees)), []
    held.foreach(parts.forget)
    held.unpersist()
    remove_path(train.sparkSession, path)
    return model


def with_margins(df: DataFrame, model: BoostedTrees, out: str = "margin") -> DataFrame:
    """``df`` with the model's log-odds; null features are missing values."""
    if not model.trees:
        return df.withColumn(out, F.lit(model.base))
    ship_package(df.sparkSession)
    source = df.sparkSession.sparkContext.broadcast(model)  # at most rounds × 2^(depth + 1) nodes

    @F.pandas_udf("double")
    def margins(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        score = source.value.scorer()
        for columns in batches:
            values = np.stack([np.asarray(c, float) for c in columns], axis=1)
            yield pd.Series(score(values))

    return df.withColumn(out, margins(*[F.col(c).cast("double") for c in model.feature_cols]))
