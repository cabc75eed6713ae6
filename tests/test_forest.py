"""Trees of many models grown together, against plain best-first growth over rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forest as T
from tidemark.operators import rules as RU


def frame(spark, n=400, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = ((x[:, 0] > 0.3) & (np.nan_to_num(x[:, 1], nan=-9) < 0.5) | (rng.random(n) < 0.1)).astype(int)
    df = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(n), y=y, w=1 + rng.integers(0, 3, n).astype(float), part=np.arange(n) % 5)
    out = spark.createDataFrame(df).repartition(parts)
    return df, out.withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b")))


def plain_tree(x, g, h, cfg, edges, used):
    """Best-first growth over row sets; bins as in the table."""
    binned = np.stack([T.bin_bytes(x[:, i], e) for i, e in enumerate(edges)], axis=1)

    def best(rows):
        found = (-math.inf, None, None)
        for f in used:
            for b in range(len(edges[f]) + 1):
                left = binned[rows, f] <= b
                nl, nr = left.sum(), (~left).sum()
                if min(nl, nr) < cfg.min_rows:
                    continue
                worth = [g[k].sum() ** 2 / (h[k].sum() + cfg.ridge) for k in (rows[left], rows[~left], rows)]
                gain = worth[0] + worth[1] - worth[2]
                if gain > 1e-9 and gain > found[0] + 1e-7:
                    found = (gain, f, b)
        return found

    leaves = {"": np.arange(len(x))}
    splits = {}
    while len(leaves) < cfg.leaves:
        options = {p: best(r) for p, r in leaves.items() if cfg.depth is None or len(p) < cfg.depth}
        options = {p: o for p, o in options.items() if o[1] is not None}
        if not options:
            break
        path = max(sorted(options), key=lambda p: options[p][0])
        _, f, b = options[path]
        rows = leaves.pop(path)
        splits[path] = (f, b)
        left = binned[rows, f] <= b
        leaves[path + "0"], leaves[path + "1"] = rows[left], rows[~left]
    value = {p: -g[r].sum() / (h[r].sum() + cfg.ridge) * cfg.step for p, r in leaves.items()}
    return splits, leaves, value


def paths(tree):
    splits, leaves = {}, {}

    def visit(i, path):
        if tree.feature[i] < 0:
            leaves[path] = i
        else:
            splits[path] = (int(tree.feature[i]), int(tree.bin[i]))
            visit(tree.left[i], path + "0")
            visit(tree.right[i], path + "1")

    visit(0, "")
    return splits, leaves


@pytest.mark.parametrize(("depth", "leaves"), [(3, 8), (None, 6), (5, 5), (2, 16)])
def test_single_tree_with_a_budget_of_leaves(spark, depth, leaves):
    df, rows = frame(spark)
    cfg = T.Growth(rounds=1, leaves=leaves, depth=depth, step=1.0, min_rows=7, ridge=0.0, bins=16, columns=1.0, balance=False, loss="squared")
    found = T.grow(rows, ["id"], list("abcd"), [T.Target("one", F.col("y"), F.col("w"))], cfg)
    x, y, w = df[list("abcd")].to_numpy(), df.y.to_numpy(float), df.w.to_numpy()
    splits, left, value = plain_tree(x, -w * y, w, cfg, found.edges, range(4))
    tree = found.trees[0][0]
    got, at = paths(tree)
    assert got == splits and len(at) <= leaves
    for p, r in left.items():
        assert tree.rows[at[p]] == len(r) and abs(tree.share[at[p]] - value[p]) < 1e-4
    # the rules recount every leaf: rows and weights by SQL
    nodes = RU.collect_nodes(T.nodes(spark, found, "one"))
    leaf = RU.tree_sql([n | {"value": float(n["node_id"])} for n in nodes], "value")
    counted = {int(r.leaf): (r.n, r.w, r.wy) for r in rows.withColumn("leaf", F.expr(leaf)).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).collect()}
    for n in nodes:
        if n["is_leaf"]:
            c = counted[n["node_id"]]
            assert c[0] == n["n_samples"] and abs(c[2] / c[1] - n["pos_proba"]) < 1e-4 and n["predict"] == int(n["pos_proba"] >= 0.5)
    assert RU.depth_and_leaves(nodes)[1] == len(left)


def test_models_grown_together_are_those_grown_alone(spark):
    df, rows = frame(spark, seed=1)
    cfg = T.Growth(rounds=6, leaves=5, step=0.3, min_rows=9, bins=12, columns=0.6)
    targets = [T.Target(f"f{k}", F.col("y"), F.when(F.col("part") != k, F.col("w"))) for k in range(3)]
    edges = T.bin_edges(rows, list("abcd"), 12)
    together = T.grow(rows, ["id"], list("abcd"), targets, cfg, edges)
    scores = {r.id: r.margins for r in T.margins(together).collect()}
    passes = []
    for t in targets:
        alone = T.grow(rows.repartition(7), ["id"], list("abcd"), [t], cfg, edges)
        passes.append(alone.passes)
        assert T.node_rows(alone, t.name) == T.node_rows(together, t.name)
        assert all(abs(r.margins[t.name] - scores[r.id][t.name]) < 1e-12 for r in T.margins(alone).collect())
    assert together.passes <= sum(passes) / 2  # a pass serves all of them


def test_boosting_is_plain_boosting(spark):
    df, rows = frame(spark, seed=2)
    cfg = T.Growth(rounds=12, leaves=4, depth=2, step=0.2, min_rows=10, bins=10, columns=0.5, balance=True)
    found = T.grow(rows, ["id"], list("abcd"), [T.Target("m", F.col("y"), F.col("w"))], cfg)
    x, y = df[list("abcd")].to_numpy(), df.y.to_numpy(float)
    ratio = (y == 0).sum() / (y == 1).sum()
    w = df.w.to_numpy() * np.where(y == 1, ratio, 1)
    margin = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum()))
    for stage in range(cfg.rounds):
        p = 1 / (1 + np.exp(-margin))
        splits, leaves, value = plain_tree(x, w * (p - y), w * p * (1 - p), cfg, found.edges, T._columns(cfg, 4, stage))
        assert paths(found.trees[0][stage])[0] == splits, stage
        for path, r in leaves.items():
            margin[r] += value[path]
    got = {r.id: r.margins["m"] for r in T.margins(found).collect()}
    assert max(abs(got[i] - m) for i, m in enumerate(margin)) < 1e-3
    assert np.mean((margin > 0) == (y > 0)) > 0.85
    # masks and expressions give the fitted margin on every row
    nodes = [dict(zip([c.split()[0] for c in RU.NODE_SCHEMA.split(", ")], r, strict=True)) for r in T.node_rows(found, "m")]
    by_mask = {r.id: r for r in RU.score_masks(rows, nodes, float(found.start[0]), 1.0).collect()}
    by_case = {r.id: r for r in RU.score_ensemble(rows, nodes, float(found.start[0]), 1.0).collect()}
    for i, m in got.items():
        assert abs(by_mask[i].rule_score - m) < 1e-9 and abs(by_case[i].rule_score - m) < 1e-9
        assert by_mask[i].rule_label == by_case[i].rule_label == int(m >= 0)
    gain = {r.feature: r for r in T.importance(spark, found, "m").collect()}
    assert abs(sum(r.share for r in gain.values()) - 100) < 1e-9 and {r.rank for r in gain.values()} == {1, 2, 3, 4}


def test_masks_of_deep_uneven_trees(spark):
    """Masks against a walk through the nodes, with undefined values and values on thresholds."""
    rng = np.random.default_rng(0)
    nodes = []
    for stage in range(20):
        count = 0

        def build(budget, stage=stage):
            nonlocal count
            me, count = count, count + 1
            at = len(nodes)
            nodes.append(None)
            if budget == 1:
                nodes[at] = dict(stage=stage, node_id=me, is_leaf=True, feature=None, threshold=None, left=None, right=None, pos_proba=None, predict=None, value=float(rng.normal()), n_samples=1)
                return me
            k = int(rng.integers(1, budget))
            f, t = "abcd"[rng.integers(4)], float(np.round(rng.normal(), 1))
            left, right = build(k), build(budget - k)
            nodes[at] = dict(stage=stage, node_id=me, is_leaf=False, feature=f, threshold=t, left=left, right=right, pos_proba=None, predict=None, value=0.0, n_samples=1)
            return me

        build(int(rng.integers(1, 65)))
    df, rows = frame(spark, 300, 3)
    rows = rows.withColumns({c: F.round(c, 1) for c in "ab"})
    want = {r.id: 0.0 for r in rows.collect()}
    for r in rows.collect():
        for stage in range(20):
            by = {n["node_id"]: n for n in nodes if n["stage"] == stage}
            n = by[0]
            while not n["is_leaf"]:
                v = r[n["feature"]]
                n = by[n["left"] if v is None or v <= n["threshold"] else n["right"]]
            want[r.id] += n["value"]
    out = RU.score_masks(rows, nodes, 0.25, 0.5, 0.4)
    assert out.columns == [*rows.columns, "rule_score", "rule_label"]
    for r in out.collect():
        assert abs(r.rule_score - (0.25 + 0.5 * want[r.id])) < 1e-12 and r.rule_label == int(r.rule_score >= math.log(0.4 / 0.6))
    with pytest.raises(ValueError, match="leaves"):
        RU.leaf_masks([dict(stage=0, node_id=2 * i, is_leaf=False, feature="a", threshold=0.0, left=2 * i + 1, right=2 * i + 2) for i in range(65)] + [dict(stage=0, node_id=k, is_leaf=True, value=0.0) for k in [*range(1, 131, 2), 130]])


def test_targets_without_both_classes(spark):
    _, rows = frame(spark, 120, 4)
    zero = F.lit(0)
    cfg = T.Growth(rounds=2, leaves=3, min_rows=5, bins=8)
    targets = [T.Target("none", F.col("y"), F.lit(None)), T.Target("no", zero, F.col("w")), T.Target("yes", F.lit(1), F.col("w")), T.Target("both", F.col("y"), F.col("w"))]
    found = T.grow(rows, ["id"], list("abcd"), targets, cfg)
    m = T.margins(found).first().margins
    assert (m["none"], m["no"], m["yes"]) == (-math.inf, -math.inf, math.inf) and math.isfinite(m["both"])
    assert found.trees[0] == found.trees[1] == found.trees[2] == [] and len(found.trees[3]) == 2
    empty = T.grow(rows.limit(0), ["id"], list("abcd"), targets, cfg)
    assert T.margins(empty).count() == 0 and not any(empty.trees)


@pytest.mark.parametrize("bad", [{"rounds": 0}, {"leaves": 1}, {"depth": 0}, {"loss": "x"}, {"bins": 300}, {"columns": 0}, {"loss": "squared"}])
def test_growth_refuses(bad):
    with pytest.raises(ValueError):
        T.Growth(**bad)


@pytest.mark.parametrize(("ratio", "digits"), [(1, 1), (3, 1), (3, 4), (1000, 4)])
@pytest.mark.parametrize("by", [(), ("symbol",), ("kind",)])
def test_negatives_are_those_with_the_smallest_hashes(spark, monkeypatch, ratio, digits, by):
    import hashlib

    from tidemark.operators import models as M

    monkeypatch.setattr(M, "PREFIX_DIGITS", digits)
    rng = np.random.default_rng(0)
    rows = [("ABC"[i % 3], i, int(rng.random() < 0.1 and i % 3 != 2), "xy"[i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "symbol string, bar long, y int, kind string").repartition(6)
    want = []
    for group in {(r[0] if by == ("symbol",) else r[3] if by else None) for r in rows}:
        here = [r for r in rows if group is None or group in (r[0], r[3])]
        yes = [r for r in here if r[2]]
        no = sorted((r for r in here if not r[2]), key=lambda r: (hashlib.md5(f"{r[0]}|{r[1]}|42".encode()).hexdigest(), r))
        want += yes + (no[: ratio * len(yes)] if yes else no)
    assert sorted(map(tuple, M.subsample_negatives(df, "y", ratio, by=by).collect())) == sorted(want)
    assert M.subsample_negatives(df.limit(0), "y", ratio, by=by).count() == 0


def test_rows_lie_in_blocks_and_old_margins_go(spark):
    """A pass moves blocks, not rows, and of the tables that a fit writes only the last stays."""
    import pathlib

    from tidemark.session import scratch_folder

    df, rows = frame(spark, seed=5)
    folder = pathlib.Path(scratch_folder(spark))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = T.grow(rows, ["id"], list("abcd"), [T.Target("m", F.col("y"), F.col("w"))], T.Growth(rounds=9, leaves=4, min_rows=9, bins=8))
    assert found.data.count() <= 3 and len(found.trees[0]) == 9
    assert len(set(folder.iterdir()) - before) == 1
    assert sorted(r.id for r in T.margins(found).collect()) == df.id.tolist()


def test_what_models_share_is_held_once(spark):
    """Labels, weights and training sets of many models lie once in small blocks; of siblings only the smaller is summed."""
    df, rows = frame(spark, n=5000, seed=3, parts=1)
    y, w, on = F.col("y"), F.col("w"), [F.col("part") != k for k in range(3)]
    cfg = T.Growth(rounds=3, leaves=6, step=0.3, min_rows=9, bins=12)
    edges = T.bin_edges(rows, list("abcd"), 12)
    shared = T.grow(rows, ["id"], list("abcd"), [T.Target(f"f{k}", y, w, on[k]) for k in range(3)], cfg, edges)
    apart = T.grow(rows, ["id"], list("abcd"), [T.Target(f"f{k}", F.col("y"), F.when(F.col("part") != k, F.col("w"))) for k in range(3)], cfg, edges)
    assert all(T.node_rows(shared, f"f{k}") == T.node_rows(apart, f"f{k}") for k in range(3))
    blocks = shared.data.select("bins", "y", "w", "on", "margin").collect()
    assert len(blocks) >= 3 and all(len(b.y) * 4 == len(b.bins) and len(b.w) == 8 * len(b.y) and len(b.on) == 3 * len(b.y) and b.margin is None for b in blocks)
    growing = T._Growing(cfg)
    n = np.zeros((1, 12), np.int64)
    n[0, [1, 5]] = 30, 10
    g, h = n * int(T.EXACT), n * int(T.EXACT)
    g[0, 5] *= -1
    growing.summed({0: np.stack([g, h, n])}, np.array([0]), 1)
    assert len(growing.open) == 1 and growing.to_sum() == growing.open  # the other has too few rows for a split
