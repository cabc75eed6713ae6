"""Links between members of groups without all pairs of a group, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise

TILE = 128


def _follow(parents: DataFrame) -> DataFrame:
    """Each node's last ancestor, by doubling; `parents` has x and a smaller p."""
    while True:
        up = parents.select(F.col("x").alias("p"), F.col("p").alias("up"))
        parents = materialise(parents.join(up, "p", "left").select("x", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")))
        moved = not parents.where("moved").isEmpty()
        parents = parents.select("x", "p")
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """Smallest node of the component of each linked node but that node itself: columns node, label. `links` has a and b.

    Each node hooks on to its smallest smaller neighbour, chains are followed to their end, and links are redrawn
    between what is left, until none are; at least half of the nodes that have links vanish each time.
    """
    labels = None
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while labels is None or not edges.isEmpty():
        parents = _follow(edges.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("p")))
        a, b = (parents.select(F.col("x").alias(k), F.col("p").alias(f"{k}_p")) for k in ("a", "b"))
        moved = edges.join(b, "b").join(a, "a", "left").select(F.coalesce("a_p", "a").alias("a"), F.col("b_p").alias("b"))
        edges = materialise(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        if labels is None:
            labels = parents.select(F.col("x").alias("node"), F.col("p").alias("label"))
        else:
            # what hooked on before follows; what was a root until now is added
            up = parents.select(F.col("x").alias("label"), "p")
            labels = labels.join(up, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            labels = materialise(labels.unionByName(parents.select(F.col("x").alias("node"), F.col("p").alias("label"))))
    return labels


class Forest:
    """Links that connect what no earlier link did."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while x in self.up:
            x = self.up[x]
        return x

    def add(self, a, b) -> bool:
        """Whether the link was needed."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[a] = b
        return a != b


def link_groups(
    entries: DataFrame,
    contents: DataFrame,
    bounds: dict[str, Column],
    may: Callable[[str, str], Column],
    tile: Callable[[pa.Table, pa.Table, Forest], Iterator[tuple]],
) -> DataFrame:
    """Labels of nodes, equal for nodes that links connect: columns node, label; a node that lacks is its own.

    `entries` has g (group), node, rank, band and columns for `bounds`; nodes that link share a group. `contents` has
    node and what a link needs to be verified. Nodes gather round the highest ranked member of their groups, and those
    of one band there make blocks of about TILE nodes. `bounds` are sums over a block's entries of one group, and
    `may(prefix, prefix)` tells from those of two blocks whether a link between them is possible. Pairs of blocks
    that share such a group are compared in whole: `tile` gets both contents and yields the links that connect
    something new. So a large group of near copies costs blocks squared, never rows for its pairs, and yields
    a forest; every pair that shares a group and may link is looked at.
    """
    kind = entries.schema["node"].dataType.simpleString()
    best = F.max(F.struct("rank", "node")).alias("lead")
    leads = entries.groupBy("g").agg(best, F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialise(entries.join(materialise(leads.select("g", "lead")), "g"))
    homes = materialise(met.groupBy("node").agg(F.max("lead").alias("lead"), F.min("band").alias("band")).select("node", "band", F.col("lead.node").alias("home")))
    sizes = materialise(homes.groupBy("home", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = materialise(homes.join(sizes, ["home", "band"]).select("node", F.xxhash64("home", "band", part).alias("block")))

    seen = met.drop("lead").join(placed, "node").groupBy("g", "block")
    seen = materialise(seen.agg(F.count(F.lit(1)).alias("members"), *(c.alias(k) for k, c in bounds.items())))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("g", *(F.col(c).alias(f"{name}_{c}") for c in ("block", *bounds)))

    across = side(seen, "a").join(side(seen, "b"), "g").where((F.col("a_block") < F.col("b_block")) & may("a", "b"))
    within = side(seen.where("members > 1"), "a").join(side(seen.where("members > 1"), "b"), "g").where((F.col("a_block") == F.col("b_block")) & may("a", "b"))
    tiles = materialise(across.unionByName(within).select(F.col("a_block").alias("a"), F.col("b_block").alias("b")).distinct())

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = rows.drop_columns(["block"])
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    used = tiles.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    wanted = materialise(placed.join(used, "block", "left_semi"))
    packs = materialise(contents.join(wanted, "node").groupBy("block").applyInArrow(pack, "block long, data binary"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        data = dict(zip(rows["side"].to_pylist(), rows["data"], strict=True))
        a, b = (pa.ipc.open_stream(data[k if k in data else 0].as_py()).read_all() for k in (0, 1))
        found = list(tile(a, b, Forest()))
        return pa.table([pa.array([x[k] for x in found], a.schema.field("node").type) for k in (0, 1)], names=["a", "b"])

    # one pair of blocks at a time is in a task's memory
    sides = [tiles.where(f"a <> b or {k} = 0").join(packs.withColumnRenamed("block", c), c).select("a", "b", F.lit(k).alias("side"), "data") for k, c in enumerate("ab")]
    links = sides[0].unionByName(sides[1]).groupBy("a", "b").applyInArrow(compare, f"a {kind}, b {kind}")
    return components(links)
