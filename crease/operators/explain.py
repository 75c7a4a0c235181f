"""Path-dependent TreeSHAP for boosted trees.

The node table (at most rounds × 2^(depth+1) rows) is compiled once to arrays per tree and broadcast; rows are explained
in Arrow batches, all of them unless the caller asks for a sample.

Per tree, the cover-weighted expectation E[f | x_S] is a sum over leaves of
``value × Π_{j∈S} o_j(x) × Π_{j∉S} z_j``, where for the features j on the
leaf's path o_j says whether x follows the path at every node testing j and
z_j is the product of the cover ratios of those nodes. Each leaf is therefore
a product game over its (at most depth) path features, whose Shapley value
is ``(o_i − z_i) · Σ_k e_k · k!(m−k−1)!/m!`` with e_k the coefficients of
``Π_{j≠i}(z_j + o_j·t)``. All leaves of a tree are worked out together: paths with fewer features are filled up with
players that change nothing (o = z = 1). Values are in log-odds; a node's cover is its sum of Hessians.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crease.functions.expressions import with_portable_uniform
from crease.operators.boosting import BoostedTrees, Tree, bin_values, bins_of, cuts_of, missing_bin
from crease.session import ship_package

#: Rows that are explained together, a multiple of those of an Arrow batch: kinds of rows are worked out once in them.
ROWS = 65_536
#: Tests of a tree up to which rows are told apart by one whole number, and up to which there is a table of these numbers.
CODE_BITS, TABLE_BITS = 62, 16


@dataclass
class TreePaths:
    """The paths of a tree's leaves as arrays.

    ``test`` holds the inner nodes' (feature, cut, missing goes left).  ``follow[l, d, t]`` is 1 if player d of leaf l needs
    test t to go left, -1 if right, 0 if it does not care; ``feature[l, d]`` is -1 for a player that fills up.
    """

    value: np.ndarray
    feature: np.ndarray
    ratio: np.ndarray
    follow: np.ndarray
    test_feature: np.ndarray
    test_cut: np.ndarray
    test_missing_left: np.ndarray


def tree_paths(tree: Tree) -> TreePaths:
    inner = np.flatnonzero(tree.feature >= 0)
    test_of = {int(node): t for t, node in enumerate(inner)}
    leaves: list[tuple[float, dict[int, list]]] = []
    waiting: list[tuple[int, list]] = [(0, [])]
    while waiting:
        node, path = waiting.pop()
        if tree.feature[node] < 0:
            players: dict[int, list] = {}
            for feature, test, side, ratio in path:
                player = players.setdefault(feature, [1.0, []])
                player[0] *= ratio
                player[1].append((test, side))
            leaves.append((float(tree.value[node]), players))
            continue
        for child, side in ((int(tree.left[node]), 1), (int(tree.right[node]), -1)):
            ratio = float(tree.cover[child] / tree.cover[node])
            waiting.append((child, [*path, (int(tree.feature[node]), test_of[node], side, ratio)]))
    depth = max(1, max(len(players) for _, players in leaves))
    out = TreePaths(np.array([v for v, _ in leaves]), np.full((len(leaves), depth), -1), np.ones((len(leaves), depth)),
                    np.zeros((len(leaves), depth, len(inner)), np.int8), tree.feature[inner], tree.cut[inner],
                    tree.missing_left[inner])
    for leaf, (_, players) in enumerate(leaves):
        for d, (feature, (ratio, tests)) in enumerate(players.items()):
            out.feature[leaf, d], out.ratio[leaf, d] = feature, ratio
            for test, side in tests:
                out.follow[leaf, d, test] = side
    return out


def expected_value(model: BoostedTrees, paths: Sequence[TreePaths]) -> float:
    return model.base + float(sum((p.value * p.ratio.prod(axis=1)).sum() for p in paths))


def shap_matrix(values: np.ndarray, paths: Sequence[TreePaths]) -> np.ndarray:
    """SHAP values (rows × features) of rows of raw values."""
    n, n_features = values.shape
    out = np.zeros((n_features, n))
    cuts = cuts_of(((p.test_feature, p.test_cut) for p in paths), n_features)
    bins, missing = np.ascontiguousarray(bin_values(values, cuts).T), missing_bin(cuts)
    for p in paths:
        n_leaves, depth = p.feature.shape
        n_tests = len(p.test_feature)
        if not n_tests:
            continue

        def goes_left(rows: slice | np.ndarray = slice(None)) -> Iterator[np.ndarray]:
            for f, under, also in zip(p.test_feature, bins_of(p.test_feature, p.test_cut, cuts), p.test_missing_left):
                column = bins[f][rows]
                yield (column < under) | (column == missing) if also else column < under

        # rows that agree in all tests have the same values: each kind of row is worked out once
        of_row = None
        if n_tests <= TABLE_BITS:
            code = np.zeros(n, np.uint16)
            for t, side in enumerate(goes_left()):
                code |= side.astype(np.uint16) << np.uint16(t)
            found = np.zeros(1 << n_tests, bool)
            found[code] = True
            kind_codes = np.flatnonzero(found)
            kind_of = np.zeros(1 << n_tests, np.int32)
            kind_of[kind_codes] = np.arange(len(kind_codes))
            of_row = kind_of[code]
            left = (kind_codes >> np.arange(n_tests)[:, None] & 1).astype(bool)
        elif n_tests <= CODE_BITS:
            code = sum(side.astype(np.int64) << np.int64(t) for t, side in enumerate(goes_left()))
            _, first, of_row = np.unique(code, return_index=True, return_inverse=True)
            left = np.stack(list(goes_left(first)))
        else:
            left = np.stack(list(goes_left()))
        kinds = left.shape[1]
        # o[l, d] of each row: no test of the player goes the other way
        follow = p.follow.reshape(-1, len(left)).astype(np.float32)
        against = np.maximum(follow, 0) @ (~left).astype(np.float32) + np.maximum(-follow, 0) @ left.astype(np.float32)
        o = (against == 0).reshape(n_leaves, depth, kinds).astype(float)
        z = p.ratio[:, :, None]
        shares = [factorial(k) * factorial(depth - k - 1) / factorial(depth) for k in range(depth)]
        of_kind = np.zeros((n_features, kinds))
        for i in range(depth):
            terms = [np.ones((n_leaves, kinds))]  # coefficients of the product over the other players
            for j in range(depth):
                if j != i:
                    taken = [term * o[:, j] for term in terms]
                    passed = [term * z[:, j] for term in terms]
                    terms = [passed[0], *(a + b for a, b in zip(passed[1:], taken)), taken[-1]]
            game = (o[:, i] - z[:, i]) * sum(term * share for term, share in zip(terms, shares))
            to = np.zeros((n_features, n_leaves))
            own = p.feature[:, i] >= 0
            to[p.feature[own, i], np.flatnonzero(own)] = p.value[own]
            of_kind += to @ game
        for f in np.unique(p.feature[p.feature >= 0]):
            out[f] += of_kind[f] if of_row is None else of_kind[f].take(of_row)
    return out.T


def together(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together until they have ``rows`` rows or there are no more."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield pd.concat(waiting, ignore_index=True)
            waiting = []
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def shap_values(model_df: DataFrame, model: BoostedTrees, feature_cols: Sequence[str] | None = None,
                sample_size: int | None = None, id_col: str = "rid", seed: int = 42,
                keep: Sequence[str] = ()) -> DataFrame:
    """Per explained row: one SHAP column per feature (log-odds units), the
    base value and the model margin (log-odds). Every row is explained, in the
    partitions it comes in; a caller may ask for ``sample_size`` rows, drawn by a
    seeded hash order. A missing feature goes to the side the model chose for it."""
    feature_cols = list(feature_cols or model.feature_cols)
    if feature_cols != model.feature_cols:
        raise ValueError("the features must be the model's, in its order")
    d = model_df
    ship_package(d.sparkSession)
    if sample_size is not None:
        parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = with_portable_uniform(d, id_col, 0, seed, "_s").orderBy("_s", id_col).limit(sample_size).drop("_s") \
            .repartition(parts)
    paths = [tree_paths(tree) for tree in model.trees]
    base = expected_value(model, paths)
    source = d.sparkSession.sparkContext.broadcast(paths)
    keep = [c for c in keep if c in d.columns]
    schema = T.StructType([d.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in feature_cols]
                          + [T.StructField("base_value", T.DoubleType()), T.StructField("margin", T.DoubleType())])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in together(batches, ROWS):
            for at in range(0, len(whole), ROWS):
                part = whole.iloc[at:at + ROWS]
                contributions = shap_matrix(part[feature_cols].to_numpy(float), source.value)
                out = pd.DataFrame(contributions, columns=feature_cols)
                for c in keep:
                    out.insert(keep.index(c), c, part[c].to_numpy())
                out["base_value"] = base
                out["margin"] = base + contributions.sum(axis=1)
                yield out

    return d.select(*keep, *[F.col(c).cast("double") for c in feature_cols]).mapInPandas(explain, schema)


def importance_summary(contrib: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Mean absolute contribution per feature, descending (unpivot + grouped mean)."""
    long = contrib.unpivot([], list(feature_cols), "feature", "value")
    return long.groupBy("feature").agg(F.avg(F.abs(F.col("value").cast("double"))).alias("mean_abs_shap")) \
        .orderBy(F.col("mean_abs_shap").desc(), F.col("feature").asc())
