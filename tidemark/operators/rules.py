"""Rule tables: fitted trees as nodes, nodes as SQL expressions, scoring and parity."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "stage int, node_id int, is_leaf boolean, feature string, threshold double, left int, right int, "
    "pos_proba double, predict int, value double, n_samples long"
)
MAX_NODES = 100_000  # a rule table is a model, not data; larger ones are refused before they reach the driver


class ParityError(RuntimeError):
    """Rules and model disagree."""


def _walk(root, names: Sequence[str], stage: int, weight: float, cut: float) -> list[tuple]:
    """Rows of one fitted tree, in pre-order."""
    rows: list[tuple] = []

    def visit(node) -> int:
        at = len(rows)
        rows.append(())
        stats = [float(x) for x in node.impurityStats().stats()]
        total = sum(stats)
        proba = stats[1] / total if len(stats) > 1 and total > 0 else None
        n = int(node.impurityStats().count())
        value = float(node.prediction()) * weight
        if node.numDescendants() == 0:
            pred = None if proba is None else int(proba >= cut)
            rows[at] = (stage, at, True, None, None, None, None, proba, pred, value, n)
            return at
        split = node.split()
        left, right = visit(node.leftChild()), visit(node.rightChild())
        rows[at] = (
            stage, at, False, names[split.featureIndex()], float(split.threshold()), left, right, proba, None, value, n,
        )
        return at

    visit(root)
    return rows


def node_table(spark: SparkSession, model, names: Sequence[str], cut: float = 0.5) -> DataFrame:
    """Nodes of a fitted decision tree (one stage) or of a boosted ensemble (one stage per tree, values weighted)."""
    if hasattr(model, "treeWeights"):
        trees = zip(model.trees, model.treeWeights)
    else:
        trees = [(model, 1.0)]
    rows = [r for i, (t, w) in enumerate(trees) for r in _walk(t._java_obj.rootNode(), names, i, float(w), cut)]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def collect_nodes(nodes: DataFrame) -> list[dict]:
    """Node rows on the driver, refused beyond MAX_NODES."""
    rows = nodes.orderBy("stage", "node_id").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"rule table has more than {MAX_NODES} nodes")
    return [r.asDict() for r in rows]


def used_features(nodes: DataFrame) -> DataFrame:
    """(feature, first_use) in order of first use."""
    order = F.col("stage").cast("long") * F.lit(1 << 32) + F.col("node_id")
    used = nodes.filter("not is_leaf").groupBy("feature").agg(F.min(order).alias("_o"))
    from pyspark.sql import Window

    # one row per feature of a rule table
    return used.withColumn("first_use", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_o"))).drop("_o")


def union_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of two rule tables: those of the first in its order, then new ones of the second."""
    both = used_features(a).withColumn("side", F.lit(0)).unionByName(used_features(b).withColumn("side", F.lit(1)))
    return both.groupBy("feature").agg(F.min(F.struct("side", "first_use")).alias("_m")).select(
        "feature", F.col("_m.side").alias("side"), F.col("_m.first_use").alias("first_use")
    )


def depth_and_leaves(nodes: Sequence[dict]) -> tuple[int, int]:
    """Depth and number of leaves of a single tree."""
    by = {n["node_id"]: n for n in nodes}

    def deep(i: int) -> int:
        n = by[i]
        return 0 if n["is_leaf"] else 1 + max(deep(n["left"]), deep(n["right"]))

    return deep(0), sum(n["is_leaf"] for n in nodes)


# --------------------------------------------------------------------------- nodes -> SQL


def tree_sql(nodes: Sequence[dict], leaf: str) -> str:
    """Nested CASE over one tree; values up to the threshold, and undefined ones, go left."""
    by = {n["node_id"]: n for n in nodes}

    def text(i: int) -> str:
        n = by[i]
        if n["is_leaf"]:
            return f"CAST({n[leaf]!r} AS DOUBLE)"
        f = n["feature"]
        left = f"{f} IS NULL OR isnan({f}) OR {f} <= CAST({n['threshold']!r} AS DOUBLE)"
        return f"CASE WHEN {left} THEN {text(n['left'])} ELSE {text(n['right'])} END"

    return text(0)


def rules_to_sql(nodes: Sequence[dict], threshold: float = 0.5, init: float = 0.0, lr: float = 1.0) -> dict[str, str]:
    """SQL of the score and of the label; runs as it is in Spark and in other engines.

    One stage with probabilities: score is the leaf probability. Otherwise the score is init + lr * sum of leaf
    values, compared with logit(threshold).
    """
    stages = sorted({n["stage"] for n in nodes})
    leaves = [n for n in nodes if n["is_leaf"]]
    if len(stages) == 1 and all(n["pos_proba"] is not None for n in leaves):
        score = tree_sql(nodes, "pos_proba")
        return {"score": score, "label": f"CASE WHEN {score} >= CAST({threshold!r} AS DOUBLE) THEN 1 ELSE 0 END"}
    parts = [tree_sql([n for n in nodes if n["stage"] == s], "value") for s in stages]
    score = f"CAST({init!r} AS DOUBLE) + CAST({lr!r} AS DOUBLE) * (" + " + ".join(f"({p})" for p in parts) + ")"
    p = min(max(threshold, 1e-12), 1 - 1e-12)
    cut = math.log(p / (1 - p))
    return {"score": score, "label": f"CASE WHEN {score} >= CAST({cut!r} AS DOUBLE) THEN 1 ELSE 0 END"}


def rules_to_column(nodes: Sequence[dict], threshold: float = 0.5, init: float = 0.0, lr: float = 1.0) -> dict[str, Column]:
    return {k: F.expr(v) for k, v in rules_to_sql(nodes, threshold, init, lr).items()}


def score_tree(df: DataFrame, nodes: Sequence[dict], threshold: float = 0.5) -> DataFrame:
    """Add rule_score and rule_label of a single tree."""
    c = rules_to_column(nodes, threshold)
    return df.withColumn("rule_score", c["score"]).withColumn("rule_label", c["label"])


def score_ensemble(df: DataFrame, nodes: Sequence[dict], init: float, lr: float, threshold: float = 0.5) -> DataFrame:
    """Add rule_score (additive margin) and rule_label."""
    c = rules_to_column(nodes, threshold, init, lr)
    return df.withColumn("rule_score", c["score"]).withColumn("rule_label", c["label"])


LEAF_BITS = 64


def leaf_masks(nodes: Sequence[dict]) -> list[tuple[list[tuple[str, float, int]], list[float]]]:
    """Each stage as (feature, threshold, mask) tests and the values of its leaves from left to right.

    A value above the threshold rules out the leaves of the left branch: the mask has a bit for every other leaf. The
    first leaf that no test rules out is the row's.
    """
    out = []
    for stage in sorted({n["stage"] for n in nodes}):
        by = {n["node_id"]: n for n in nodes if n["stage"] == stage}
        tests, values = [], []

        def visit(i: int) -> None:
            n = by[i]
            if n["is_leaf"]:
                values.append(float(n["value"]))
                return
            first = len(values)
            visit(n["left"])
            tests.append((n["feature"], float(n["threshold"]), first, len(values)))
            visit(n["right"])

        visit(0)
        if len(values) > LEAF_BITS:
            raise ValueError(f"a stage has {len(values)} leaves; masks hold {LEAF_BITS}")
        every = (1 << LEAF_BITS) - 1
        out.append(([(f, t, every & ~((1 << b) - (1 << a))) for f, t, a, b in tests], values))
    return out


def score_masks(df: DataFrame, nodes: Sequence[dict], init: float = 0.0, lr: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """`score_ensemble` for rules of hundreds of trees, with bit masks of leaves instead of expressions.

    A batch is compared with each threshold once, and masks are combined by AND. The rule table is refused beyond
    MAX_NODES and travels with the function. Undefined values pass no test, so they go left at every split.
    """
    import numpy as np
    import pyarrow as pa

    if len(nodes) > MAX_NODES:
        raise ValueError(f"rule table has more than {MAX_NODES} nodes")
    stages = leaf_masks(nodes)
    feats = sorted({f for tests, _ in stages for f, _, _ in tests})
    p = min(max(threshold, 1e-12), 1 - 1e-12)
    cut = math.log(p / (1 - p))
    names = [*df.columns, "rule_score", "rule_label"]

    def run(batches):
        for batch in batches:
            x = {f: batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in feats}
            total = np.zeros(batch.num_rows)
            for tests, values in stages:
                alive = np.full(batch.num_rows, (1 << LEAF_BITS) - 1, np.uint64)
                for f, t, mask in tests:
                    alive &= np.where(x[f] > t, np.uint64(mask), np.uint64((1 << LEAF_BITS) - 1))
                lowest = alive & (~alive + np.uint64(1))
                total += np.array(values)[np.bitwise_count(lowest - np.uint64(1))]
            score = init + lr * total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= cut).astype(np.int32))], names)

    schema = df.select("*", F.lit(0.0).alias("rule_score"), F.lit(0).alias("rule_label")).schema
    return df.mapInArrow(run, schema)


def walk_nodes(df: DataFrame, nodes: DataFrame, features: Sequence[str], depth: int) -> DataFrame:
    """Leaf id per row by walking the node table: one broadcast join per level (node count checked)."""
    if nodes.limit(MAX_NODES + 1).count() > MAX_NODES:
        raise ValueError("rule table too large to walk")
    table = nodes.select(
        F.col("node_id").alias("_at"), F.col("is_leaf").alias("_leaf"), F.col("feature").alias("_f"),
        F.col("threshold").alias("_t"), F.col("left").alias("_l"), F.col("right").alias("_r"),
    )
    pairs = [x for f in features for x in (F.lit(f), F.col(f))]
    out = df.withColumn("_at", F.lit(0))
    for _ in range(depth):
        step = out.join(F.broadcast(table), "_at")
        v = F.create_map(*pairs)[F.col("_f")]
        left = v.isNull() | F.isnan(v) | (v <= F.col("_t"))
        nxt = F.when(F.col("_leaf"), F.col("_at")).when(left, F.col("_l")).otherwise(F.col("_r"))
        out = step.withColumn("_nxt", nxt).drop("_at", "_leaf", "_f", "_t", "_l", "_r").withColumnRenamed("_nxt", "_at")
    return out.withColumnRenamed("_at", "leaf_id")


# --------------------------------------------------------------------------- parity


def rule_parity(df: DataFrame, model_col: str, rule_col: str, model_score: str | None = None, rule_score: str | None = None) -> DataFrame:
    """One row: rows, agree, disagree, exact, positives of both, largest score difference."""
    same = F.col(model_col) == F.col(rule_col)
    gap = F.lit(0.0) if model_score is None else F.abs(F.col(model_score) - F.col(rule_score))
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(same.cast("long")).alias("n_agree"),
        F.sum((~same).cast("long")).alias("n_disagree"),
        F.sum((F.col(model_col) == 1).cast("long")).alias("model_positives"),
        F.sum((F.col(rule_col) == 1).cast("long")).alias("rule_positives"),
        F.max(gap).alias("max_score_error"),
    )
    return out.withColumn("exact", F.col("n_disagree") == 0)


def assert_parity(df: DataFrame, model_col: str, rule_col: str, keys: Sequence[str]) -> None:
    """Raise with up to five sample rows if any row disagrees."""
    bad = df.filter(F.col(model_col) != F.col(rule_col)).select(*keys, model_col, rule_col).limit(5).collect()
    if bad:
        raise ParityError(f"rules and model disagree, for example: {[tuple(r) for r in bad]}")


def feature_parity(
    a: DataFrame, b: DataFrame, features: Sequence[str], thresholds: dict[str, float], keys: Sequence[str] = ("symbol", "time")
) -> DataFrame:
    """Per feature over rows defined on both sides: n, largest difference and its key, correlation, threshold flips."""
    keys = list(keys)
    j = a.select(*keys, *[F.col(f).alias(f"a_{f}") for f in features]).join(
        b.select(*keys, *[F.col(f).alias(f"b_{f}") for f in features]), keys
    )
    items = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b"),
                F.lit(float(thresholds.get(f, 0.0))).alias("thr"),
            )
            for f in features
        ]
    )
    long = j.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.*")
    long = long.filter("a is not null and b is not null and not isnan(a) and not isnan(b)")
    diff = F.abs(F.col("a") - F.col("b"))
    flip = (F.col("a") > F.col("thr")) != (F.col("b") > F.col("thr"))
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(diff).alias("max_abs_diff"),
        F.corr("a", "b").alias("corr"),
        F.sum(flip.cast("long")).alias("n_flips"),
    )
