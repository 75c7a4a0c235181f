"""Second-order boosting against a plain version, any partitioning, missing values, and SHAP by brute force."""

import os
from itertools import combinations
from math import factorial

import numpy as np
import pyspark.sql.functions as F
import pytest

from crease.operators import boosting as B
from crease.operators.explain import expected_value, shap_matrix, tree_paths

PARAMS = B.BoostingParams(rounds=12, max_depth=3, learning_rate=0.3, max_bins=16, seed=5)


def data(n=900, missing=0.1):
    rng = np.random.default_rng(2)
    values = np.stack([rng.normal(size=n), rng.integers(0, 4, n), np.exp(rng.normal(size=n)), np.zeros(n)], axis=1)
    labels = (values[:, 0] + 0.5 * values[:, 1] - 0.3 * values[:, 2] + rng.normal(size=n) > 0.3).astype(int)
    values[rng.random(values.shape) < missing] = np.nan
    return values, labels


def frame(spark, values, labels, parts=1):
    rows = [(i, int(y), *[None if np.isnan(v) else float(v) for v in x], "clash") for i, (x, y) in enumerate(zip(values, labels))]
    columns = ", ".join(f"f{j} double" for j in range(values.shape[1]))
    return spark.createDataFrame(rows, f"rid long, won int, {columns}, margin string").repartition(parts)


def plain_tree(values, labels, margins, rows, features, cuts, params):
    """One tree by trying every cut on the raw values, node by node."""
    p = 1 / (1 + np.exp(-margins))
    g, h = np.rint((p - labels) / B.UNIT) * B.UNIT, np.rint(p * (1 - p) / B.UNIT) * B.UNIT

    def gain_of(mask):
        return g[mask].sum() ** 2 / (h[mask].sum() + params.l2)

    def grow(mask, depth):
        best = None
        for missing_left in (False, True):
            for f in features if depth < params.max_depth else ():
                for cut in cuts[f]:
                    left = mask & ((values[:, f] < cut) | (np.isnan(values[:, f]) & missing_left))
                    right = mask & ~left
                    if min(h[left].sum(), h[right].sum()) < params.min_child_weight:
                        continue
                    gain = gain_of(left) + gain_of(right) - gain_of(mask)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, cut, missing_left, left, right
        leaf = -params.learning_rate * g[mask].sum() / (h[mask].sum() + params.l2)
        if best is None:
            return lambda x: leaf
        _, f, cut, missing_left, left, right = best
        below = grow(left, depth + 1), grow(right, depth + 1)
        return lambda x: below[0 if x[f] < cut or (np.isnan(x[f]) and missing_left) else 1](x)

    return grow(rows, 0)


@pytest.fixture(scope="module")
def fitted(spark):
    values, labels = data()
    cols = [f"f{j}" for j in range(4)]
    return values, labels, cols, B.fit_boosted_trees(frame(spark, values, labels), cols, "won", params=PARAMS)


def test_trees_equal_a_plain_version(spark, fitted):
    values, labels, cols, model = fitted
    cuts = B.quantile_cuts(frame(spark, values, labels), cols, PARAMS.max_bins)
    assert [len(c) for c in cuts] == [15, 3, 15, 0]
    ids = np.array([r.h for r in spark.range(len(labels)).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    block = B.Block.__new__(B.Block)
    block.ids = ids.view(np.uint64)
    margins = np.full(len(labels), np.log(labels.mean() / (1 - labels.mean())))
    assert np.isclose(model.base, margins[0])
    for number in range(PARAMS.rounds):
        rows = block.sampled(number, PARAMS.subsample, PARAMS.seed)
        assert 0.7 < rows.mean() < 0.9
        tree = plain_tree(values, labels, margins, rows, B.chosen_features(4, number, PARAMS), cuts, PARAMS)
        margins = margins + np.array([tree(x) for x in values])
        so_far = B.BoostedTrees(cols, model.base, model.trees[:number + 1])
        assert np.allclose(so_far.margins(values), margins, atol=1e-12), number


def test_any_partitioning_gives_the_same_model(spark, fitted, monkeypatch):
    values, labels, cols, model = fitted
    monkeypatch.setattr(B, "REFRESH", 3)
    for parts, driver_bytes in ((5, B.DRIVER_BYTES), (3, 0)):  # partial sums by way of the driver, or added up before
        monkeypatch.setattr(B, "DRIVER_BYTES", driver_bytes)
        monkeypatch.setattr(B, "quantile_cuts", lambda *a, cuts=[np.array(sorted({t.cut[n] for t in model.trees for n in range(
            len(t.feature)) if t.feature[n] == f})) for f in range(4)]: cuts)
        first = B.fit_boosted_trees(frame(spark, values, labels, 1), cols, "won", params=PARAMS)
        again = B.fit_boosted_trees(frame(spark, values, labels, parts), cols, "won", params=PARAMS)
        for a, b in zip(first.trees, again.trees):
            assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in B.NODE_COLUMNS)


def test_bins_and_values_agree_and_the_node_table_round_trips(spark, fitted):
    values, labels, cols, model = fitted
    again = B.BoostedTrees.from_nodes(model.nodes(spark), cols, model.base)
    assert np.array_equal(again.margins(values), model.margins(values))
    scored = B.with_margins(frame(spark, values, labels, 3), model, "m").orderBy("rid").select("m").toPandas()["m"]
    assert np.allclose(scored, model.margins(values), atol=1e-12)


def test_held_out_quality(spark):
    values, labels = data(3000, 0.02)
    cols = [f"f{j}" for j in range(4)]
    df = frame(spark, values, labels, 3)
    model = B.fit_boosted_trees(df.where("rid % 4 <> 0"), cols, "won", params=B.BoostingParams(rounds=60))
    margins, y = model.margins(values)[::4], labels[::4]
    auc = (margins[y == 1][:, None] > margins[y == 0][None]).mean()
    assert auc > 0.8
    # the loss on the training rows falls with the trees
    losses = [np.log1p(np.exp(-(2 * labels - 1) * B.BoostedTrees(cols, model.base, model.trees[:k]).margins(values))).mean()
              for k in (0, 20, 60)]
    assert losses[0] > losses[1] > losses[2]


def test_defined_cases(spark):
    values, labels = data(50)
    cols = [f"f{j}" for j in range(4)]
    df = frame(spark, values, labels)
    assert B.fit_boosted_trees(df.limit(0), cols, "won").trees == []
    assert B.fit_boosted_trees(df.where("won = 1"), cols, "won").trees == []
    same = B.fit_boosted_trees(df, ["f3"], "won", params=B.BoostingParams(rounds=2))
    assert [len(t.feature) for t in same.trees] == [1, 1] or all(t.feature[0] <= 0 for t in same.trees)
    assert B.with_margins(df, B.BoostedTrees(cols, 0.5)).where("margin <> 0.5").count() == 0


def brute_shap(tree, x):
    """Shapley values over all subsets of features, of the cover-weighted expectation."""
    def expect(node, known):
        if tree.feature[node] < 0:
            return tree.value[node]
        f, left, right = tree.feature[node], tree.left[node], tree.right[node]
        if f in known:
            goes_left = x[f] < tree.cut[node] or (np.isnan(x[f]) and tree.missing_left[node])
            return expect(left if goes_left else right, known)
        share = tree.cover[left] / tree.cover[node]
        return share * expect(left, known) + (1 - share) * expect(right, known)

    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for subset in combinations(others, size):
                weight = factorial(size) * factorial(n - size - 1) / factorial(n)
                out[i] += weight * (expect(0, {*subset, i}) - expect(0, set(subset)))
    return out


def test_contributions_equal_brute_force_over_subsets(fitted):
    values, _, _, model = fitted
    paths = [tree_paths(tree) for tree in model.trees]
    found = shap_matrix(values[:25], paths)
    told = np.array([sum(brute_shap(tree, x) for tree in model.trees) for x in values[:25]])
    assert np.allclose(found, told, atol=1e-10)
    assert np.allclose(found.sum(axis=1) + expected_value(model, paths), model.margins(values[:25]), atol=1e-10)


def test_only_the_smaller_child_is_added_up():
    rng = np.random.default_rng(4)
    n, params = 3_000, B.BoostingParams(rounds=1, max_depth=4, subsample=1.0, colsample=1.0, max_bins=16)
    cuts = [np.arange(1.0, 8.0)] * 3
    block = B.Block.__new__(B.Block)
    block.bins = rng.integers(0, 9, (3, n)).astype(np.uint16)
    block.missing_bin, block.margins = 8, np.zeros(n)
    block.labels = (rng.random(n) < 0.2 + 0.1 * (block.bins[0] % 5)).astype(np.uint8)
    asked = []

    def sums(tree, nodes, features):
        asked.append(len(nodes))
        return B.histogram(block, tree, nodes, features, 9, np.ones(n, bool))

    tree = B.grow_tree(sums, 0, cuts, params)
    assert asked == [1, 1, 2, 4]  # of 1, 2, 4 and 8 open nodes
    # covers made by subtraction are those of the rows themselves, and leaves found by columns those found row by row
    leaf = block.leaf(tree)
    assert np.array_equal(leaf, tree.apply(block.bins.T, tree.bin, lambda bins: bins == 8))
    for node in np.flatnonzero(tree.feature < 0):
        assert tree.cover[node] == (leaf == node).sum() * 0.25


def test_passes_do_not_have_a_task_per_20000_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 2)
    seen = []
    stored = B._stored
    monkeypatch.setattr(B, "_stored", lambda df, tasks: seen.append(tasks) or stored(df, tasks))
    rng = np.random.default_rng(5)
    values = rng.normal(size=(400, 2))
    labels = (values[:, 0] > 0).astype(int)
    B.fit_boosted_trees(frame(spark, values, labels), ["f0", "f1"], "won", params=B.BoostingParams(rounds=1))
    assert seen == [spark.sparkContext.defaultParallelism]


def test_rows_alike_in_all_tests_are_explained_once():
    from crease.operators import explain as E
    rng = np.random.default_rng(6)
    tree = B.Tree(np.array([0, 1, -1, -1, -1], np.int32), np.array([1, 1, 0, 0, 0], np.int32), np.array([0.0, 0.5, 0, 0, 0]),
                  np.array([True, False, False, False, False]), np.array([1, 2, -1, -1, -1], np.int32),
                  np.array([4, 3, -1, -1, -1], np.int32), np.array([10.0, 6, 2, 4, 4]), np.array([0, 0, 1.0, -2, 3]), np.zeros(5))
    values = rng.normal(size=(500, 2))
    values[::7, 0] = np.nan
    many = E.shap_matrix(values, [E.tree_paths(tree)])
    one = np.concatenate([E.shap_matrix(values[i:i + 1], [E.tree_paths(tree)]) for i in range(len(values))])
    assert np.allclose(many, one, atol=1e-12)
    assert len(np.unique(many.round(9), axis=0)) <= 4
    import tracemalloc
    tracemalloc.start()
    E.shap_matrix(np.tile(values, (40, 1)), [E.tree_paths(tree)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000 * 8 * 16  # the product over the players is not held for every row


def test_blocks_are_written_once_and_lost_rows_are_made_again(spark, fitted, monkeypatch, tmp_path):
    values, labels, cols, model = fitted
    written, stored, sums = [], B._stored, B._all_sums
    monkeypatch.setattr(B, "REFRESH", 3)
    monkeypatch.setattr(B, "TASK_ROWS", 300)
    monkeypatch.setattr(B, "_stored", lambda df, tasks: written.append(tasks) or stored(df, tasks))
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))  # the driver's; the workers have their own
    folders = []

    def some_lost(held, parts, older, newest, tree, opened, features, number, params):
        if number in (4, 8) and len(opened) == 1:
            folders.append(held.map(lambda part: (parts.folder(part), parts.forget(part))[0]).collect())
        return sums(held, parts, older, newest, tree, opened, features, number, params)

    monkeypatch.setattr(B, "_all_sums", some_lost)
    cuts = B.quantile_cuts(frame(spark, values, labels), cols, PARAMS.max_bins)
    monkeypatch.setattr(B, "quantile_cuts", lambda *a: cuts)
    again = B.fit_boosted_trees(frame(spark, values, labels, 7), cols, "won", params=PARAMS)
    assert written == [3]
    assert len(again.trees) == len(model.trees)
    for a, b in zip(model.trees, again.trees):
        assert all(np.array_equal(getattr(a, c), getattr(b, c)) for c in B.NODE_COLUMNS)
    assert folders and not any(os.path.exists(folder) for found in folders for folder in found)


def test_rows_on_disk_are_made_once_for_a_tree(spark, fitted, monkeypatch, tmp_path):
    values, labels, cols, model = fitted
    cuts = B.quantile_cuts(frame(spark, values, labels), cols, PARAMS.max_bins)
    n_bins = max(len(c) for c in cuts) + 2
    monkeypatch.setattr(B, "CHUNK_ROWS", 100)
    files, _ = B._stored(B.to_blocks(frame(spark, values, labels, 6), cols, "won", "rid", cuts, model.base), 1)
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    parts = B._Parts("rows", files, 4, n_bins)
    asked = []

    def trees(known):
        asked.append(known)
        return model.trees[known:2]

    for number, known in ((0, [0]), (0, []), (2, [0]), (2, [])):
        asked.clear()
        blocks = list(parts.rows(0).before(number, trees if number else lambda known: asked.append(known) or [], PARAMS))
        assert asked == known  # scores and gradients are worked out once a tree, not in each pass
        assert len(blocks) > 1 and sum(b.bins.shape[1] for b in blocks) == len(values)
    plain = B.Rows(parts.folder(0), [], 4, n_bins - 1)
    margins = np.concatenate([b.margins for b in plain._blocks(2, ["margins"])])
    assert np.allclose(np.sort(margins), np.sort(B.BoostedTrees(cols, model.base, model.trees[:2]).margins(values)), atol=1e-12)
    assert sorted(plain._numbers()) == [2]


def test_scores_take_one_pass_over_a_column_for_each_test(fitted, monkeypatch):
    _, _, cols, model = fitted
    rng = np.random.default_rng(7)
    values = rng.normal(size=(4_000, 4))
    values[rng.random(values.shape) < 0.1] = np.nan
    values[rng.random(values.shape) < 0.02] = np.inf
    values[rng.random(values.shape) < 0.02] = -np.inf
    values[::3, 0] = rng.choice([t.cut[0] for t in model.trees], len(values[::3]))  # values that are a cut
    told = np.full(len(values), model.base)
    for tree in model.trees:
        told += tree.value[tree.apply(values, tree.cut, np.isnan)]
    monkeypatch.setattr(B, "TESTS", 0)
    assert np.array_equal(model.margins(values), told)  # trees with many tests: row by row
    monkeypatch.setattr(B, "TESTS", 64)
    monkeypatch.setattr(B.Tree, "apply", None)
    assert np.array_equal(model.margins(values), told)
    assert len(model.margins(values[:0])) == 0


def test_rows_alike_are_found_by_table_by_number_or_not_at_all(fitted, monkeypatch):
    from crease.operators import explain as E
    values, _, _, model = fitted
    paths = [tree_paths(tree) for tree in model.trees]
    by_table = shap_matrix(values, paths)
    monkeypatch.setattr(E, "TABLE_BITS", 0)
    assert np.allclose(shap_matrix(values, paths), by_table, rtol=0, atol=1e-13)
    monkeypatch.setattr(E, "CODE_BITS", 0)
    assert np.allclose(shap_matrix(values, paths), by_table, rtol=0, atol=1e-13)
    assert shap_matrix(values[:0], paths).shape == (0, 4)


def test_arrow_batches_are_explained_together():
    import pandas as pd
    from crease.operators import explain as E
    batches = [pd.DataFrame({"a": np.arange(10 * i, 10 * i + 10)}) for i in range(8)]
    found = list(E.together(iter(batches), 30))
    assert [len(part) for part in found] == [30, 30, 20]
    assert np.array_equal(pd.concat(found)["a"], np.arange(80))
    assert list(E.together(iter([]), 30)) == []
