"""Hard-negative mining by a multiway hyperplane tree with distance ranges.

Vectors become whole numbers. An extra coordinate gives all indexed vectors one length, so that an inner product with an
anchor is a distance and a window of scores is an annulus around the anchor.

1. A bounded sample fits the tree: each node has split points, and a vector belongs to the nearest one (hyperplanes between
   them). Every vector of the table walks down to its leaf.
2. Each node keeps, for each split point and each child, the smallest and largest distance from the point to the child's
   vectors: one aggregate over the table, as many numbers as the tree has.
3. An anchor walks down for a window of scores. A child goes if the range of some split point cannot meet the annulus.
4. Leaves that remain are searched exactly, in cells of a block of the leaf and a slice of anchors. The best of the
   anchor's home leaf bound its positives; the positives' scores give the windows of the negatives."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, stash

#: Sums up to here are exact in doubles.
EXACT = float(1 << 53)


@dataclass
class Node:
    points: np.ndarray  #: (children, dimensions), whole numbers
    extra: np.ndarray  #: (children,), the extra coordinate of each point
    children: list[int]  #: numbers of nodes, or -1 - number of leaves
    low: np.ndarray = field(default=None)  #: (points, children): smallest distance from a point to a child's vectors
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    """Nodes (the first is the root) and the number of leaves; length2 is the squared length of all indexed vectors."""

    nodes: list[Node]
    leaves: int
    length2: float

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.length2 - (x * x).sum(1), 0))

    def distances(self, node: Node, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.length2 - 2 * (x @ node.points.T + extra[:, None] * node.extra), 0))

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """The leaf of each indexed vector; by (node, point, child): smallest and largest distance met on the way."""
        leaf, ranges, extra = np.zeros(len(x), np.int64), {}, self.extra(x)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            d = self.distances(node, x[rows], extra[rows])
            near = d.argmin(1)
            for child in np.unique(near):
                mine = near == child
                for point in range(d.shape[1]):
                    ranges[at, point, int(child)] = (float(d[mine, point].min()), float(d[mine, point].max()))
                goal = node.children[child]
                if goal < 0:
                    leaf[rows[mine]] = -1 - goal
                else:
                    todo.append((goal, rows[mine]))
        return leaf, ranges

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector itself belongs to."""
        return self.walk(x)[0]

    def reach(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) of every leaf that may hold a vector whose inner product with the anchor x lies between least and most."""
        own2 = (x * x).sum(1)
        inner = np.sqrt(np.maximum(own2 + self.length2 - 2 * most, 0))
        outer = np.sqrt(np.maximum(own2 + self.length2 - 2 * least, 0))
        slack = 1e-6 * (1 + np.sqrt(self.length2) + np.sqrt(own2))
        if not self.nodes:
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        found_x, found_leaf, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            d = np.sqrt(np.maximum(own2[rows, None] + self.length2 - 2 * (x[rows] @ node.points.T), 0))[:, :, None]
            low = np.maximum(d - node.high, node.low - d).max(1)
            high = (d + node.high).min(1)
            for child, goal in enumerate(node.children):
                mine = rows[(low[:, child] <= outer[rows] + slack[rows]) & (high[:, child] >= inner[rows] - slack[rows])]
                if not len(mine):
                    continue
                if goal < 0:
                    found_x.append(mine)
                    found_leaf.append(np.full(len(mine), -1 - goal))
                else:
                    todo.append((goal, mine))
        none = [np.empty(0, np.int64)]
        return np.concatenate(found_x or none), np.concatenate(found_leaf or none)


def fit_tree(sample: np.ndarray, length2: float, fanout: int, leaf: int, seed: int = 1) -> Tree:
    """A tree over sampled vectors: nodes of at most `fanout` split points, far from each other, until `leaf` vectors are left."""
    rng, tree = np.random.default_rng(seed), Tree([], 0, length2)

    def grow(rows: np.ndarray) -> int:
        x = sample[rows]
        points = None
        if len(rows) > leaf:
            tried = x[rng.choice(len(x), min(len(x), 8 * fanout), replace=False)]
            chosen = [0]
            apart = ((tried - tried[0]) ** 2).sum(1)
            while len(chosen) < fanout and apart.max() > 0:
                chosen.append(int(apart.argmax()))
                apart = np.minimum(apart, ((tried - tried[chosen[-1]]) ** 2).sum(1))
            points = tried[chosen]
        if points is None or len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        at = len(tree.nodes)
        node = Node(points, tree.extra(points), [])
        tree.nodes.append(node)
        near = tree.distances(node, x, tree.extra(x)).argmin(1)
        node.children = [grow(rows[near == c]) if (near == c).sum() < len(rows) else grow(rows[:0]) for c in range(len(points))]
        return at

    grow(np.arange(len(sample)))
    return tree


def whole_numbers(vectors: DataFrame, scale: float, relabel: int, classes: int) -> DataFrame:
    """vec_id, label, x (array of double, whole numbers) of the rows that take part; see mine."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("embedding") > 0)
    label = F.when(F.pmod("vec_id", F.lit(relabel)) == 0, (F.col("label") + 1) % classes).otherwise(F.col("label")) if relabel else F.col("label")
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    again = cut(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if not again.isEmpty():
        one = rows.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
        rows = rows.join(again, "vec_id", "left_anti").unionByName(one)
    rows = stash(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("x") == sizes[0]["d"]) if sizes else rows


def array_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one size as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cells(rows: DataFrame, asked: DataFrame, leaf_counts: dict[int, int], most: int, per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with leaf, block, slice. Blocks of a leaf hold about `most` vectors, slices about `per_slice` anchors of
    neighbouring home leaves; a block is sent to the slices that ask for its leaf, an anchor to the blocks of its leaf."""
    spark = rows.sparkSession
    blocks = spark.createDataFrame([(k, -(-n // most)) for k, n in leaf_counts.items()], "leaf long, blocks int")  # a row a leaf, bounded by the tree
    wanted = asked.select(F.col("leaf").alias("goal"), F.col("slice").alias("part")).distinct()
    dealt = rows.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    left = dealt.join(wanted, F.col("leaf") == F.col("goal")).select(F.col("leaf").alias("leaf"), F.col("block").alias("block"), F.col("part").alias("slice"), "vec_id", "label", "x")
    right = asked.join(F.broadcast(blocks), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return left, right


ASKED = "anchor_id long, label long, slice int, windows array<struct<least: double, most: double>>, x array<double>"


def ask(anchors: DataFrame, tree: Tree) -> DataFrame:
    """Anchors (ASKED) with each leaf that may meet one of their windows."""
    tree = anchors.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = array_of(batch.column(4))
            windows = batch.column(3).to_pylist()
            leaves = max(tree.value.leaves, 1)
            pairs = [np.empty(0, np.int64)]
            for w in range(max(map(len, windows))):
                rows = np.array([i for i, own in enumerate(windows) if len(own) > w])
                who, leaf = tree.value.reach(x[rows], np.array([windows[i][w]["least"] for i in rows]), np.array([windows[i][w]["most"] for i in rows]))
                pairs.append(rows[who] * leaves + leaf)
            pair = np.unique(np.concatenate(pairs))
            for at in range(0, len(pair), 10_000):
                part = pair[at : at + 10_000]
                taken = batch.take(pa.array(part // leaves))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part % leaves)], names=[*batch.schema.names, "leaf"])

    return anchors.mapInArrow(run, ASKED + ", leaf long")


def scan(rows: DataFrame, asked: DataFrame, same: bool, most: int) -> DataFrame:
    """anchor_id, window, vec_id, score: of each cell, the `most` best vectors of each of an anchor's windows whose label equals
    the anchor's (same) or does not. Score first, then the smaller identifier."""
    shape = pa.schema([("anchor_id", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(block: pa.Table, anchors: pa.Table) -> pa.Table:
        if not block.num_rows or not anchors.num_rows:
            return shape.empty_table()
        ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        by_id = np.argsort(ids)
        ids, labels, x = ids[by_id], labels[by_id], array_of(block.column("x"))[by_id]
        whose, own, windows = anchors.column("anchor_id").to_numpy(), anchors.column("label").to_numpy(), anchors.column("windows").to_pylist()
        q = array_of(anchors.column("x"))
        out = []
        for at in range(0, len(q), 256):
            scores = q[at : at + 256] @ x.T
            for i, row in enumerate(scores, start=at):
                able = (labels == own[i]) == same
                if same:
                    able &= ids != whose[i]
                for w, window in enumerate(windows[i]):
                    fit = np.flatnonzero(able & (row >= window["least"]) & (row <= window["most"]))
                    if len(fit) > most:
                        edge = np.partition(row[fit], len(fit) - most)[len(fit) - most]
                        fit = fit[row[fit] >= edge]
                    best = fit[np.argsort(-row[fit], kind="stable")][:most]
                    out.append((np.full(len(best), whose[i]), np.full(len(best), w, np.int32), ids[best], row[best].astype(np.int64)))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=shape)

    found = rows.groupBy("leaf", "block", "slice").cogroup(asked.groupBy("leaf", "block", "slice")).applyInArrow(cell, "anchor_id long, window int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95, scale: float = 256.0, relabel: int = 7, classes: int = 10,
    sample: int = 4096, fanout: int = 8, leaf: int = 64, block: int = 8192, per_slice: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows take part if they have vec_id, label and a vector of finite numbers of the commonest dimension (ties: the smaller);
    of rows that repeat a vec_id one does, of the smallest label and then the smallest vector. Components become
    floor(scale * x), and where relabel divides vec_id the label is (label + 1) % classes (relabel 0: never). Anchors are rows
    whose vec_id is divisible by `every`. Scores are inner products of whole numbers; ties go to the smaller vec_id. Positives
    are the best rows of the same label; each has the best rows of other labels whose score lies between least_percent and
    most_percent of its own. An empty table gives no rows. Squared lengths must stay below 2^53, else ValueError.

    The tree is fitted on at most `sample` vectors (so it has a bounded number of nodes, which are broadcast); every vector
    is indexed, and the search is exact."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale, relabel, classes)
    length2 = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
    if length2 is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if length2 >= EXACT:
        raise ValueError("vectors are too long for exact scores: lower the scale")
    points = np.array([r["x"] for r in bounded_sample(rows, "vec_id", sample).select("x").collect()])
    tree = fit_tree(points, length2, fanout, leaf)

    # Every vector to its leaf, and the ranges of distances at each node.
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.walk(array_of(batch.column(2)))[0])], names=["vec_id", "label", "x", "leaf"])

    def ranges(batches):
        total: dict = {}
        for batch in batches:
            if batch.num_rows:
                for k, (a, b) in shared.value.walk(array_of(batch.column(0)))[1].items():
                    old = total.get(k, (a, b))
                    total[k] = (min(a, old[0]), max(b, old[1]))
        yield pa.RecordBatch.from_pydict({"node": [k[0] for k in total], "point": [k[1] for k in total], "child": [k[2] for k in total], "low": [v[0] for v in total.values()], "high": [v[1] for v in total.values()]}, schema=pa.schema([("node", pa.int32()), ("point", pa.int32()), ("child", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    index = stash(rows.select("vec_id", "label", "x").mapInArrow(place, "vec_id long, label long, x array<double>, leaf long"), "leaves")
    # At most fanout^2 rows a node.
    met = rows.select("x").mapInArrow(ranges, "node int, point int, child int, low double, high double").groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    for node in tree.nodes:
        node.low, node.high = (np.full((len(node.points), len(node.points)), v) for v in (np.inf, -np.inf))
    for r in met:
        tree.nodes[r["node"]].low[r["point"], r["child"]] = r["low"]
        tree.nodes[r["node"]].high[r["point"], r["child"]] = r["high"]
    leaf_counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}

    # Anchors in slices of neighbouring home leaves; the number of anchors of a leaf is known, so large ones take several.
    mine_ = index.where(F.pmod("vec_id", F.lit(every)) == 0)
    upto, before = [], 0
    for r in sorted(mine_.groupBy("leaf").count().collect(), key=lambda r: r["leaf"]):
        upto.append((r["leaf"], before // per_slice, (before + r["count"] - 1) // per_slice - before // per_slice + 1))
        before += r["count"]
    if not before:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    slices = spark.createDataFrame(upto, "leaf long, low int, many int")
    anchors = mine_.join(F.broadcast(slices), "leaf").select(F.col("vec_id").alias("anchor_id"), "label", (F.col("low") + F.pmod(F.xxhash64("vec_id"), F.col("many"))).cast("int").alias("slice"), "x", F.col("leaf").alias("home"))
    anchors = stash(anchors, "anchors")
    far = float(EXACT)
    window = lambda low, high: F.struct(low.cast("double").alias("least"), high.cast("double").alias("most"))
    columns = ["anchor_id", "label", "slice", "windows", "x"]

    everything = F.array(window(F.lit(-far), F.lit(far)))
    at_home = scan(*cells(index, anchors.withColumn("windows", everything).select(*columns, F.col("home").alias("leaf")), leaf_counts, block, per_slice), True, positives)
    bound = at_home.groupBy("anchor_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= positives).select("anchor_id", "s")
    bounded = anchors.join(bound, "anchor_id", "left").withColumn("windows", F.array(window(F.coalesce("s", F.lit(-far)), F.lit(far))))
    best = stash(scan(*cells(index, ask(bounded.select(*columns), tree), leaf_counts, block, per_slice), True, positives), "positives")

    # 50 * positive <= 100 * negative <= 95 * positive, in whole numbers.
    score = F.col("score")
    low = F.ceil(F.expr(f"({least_percent} * score) / 100.0D"))
    high = F.floor(F.expr(f"({most_percent} * score) / 100.0D"))
    low = F.when(100 * low < least_percent * score, low + 1).when(100 * (low - 1) >= least_percent * score, low - 1).otherwise(low)
    high = F.when(100 * high > most_percent * score, high - 1).when(100 * (high + 1) <= most_percent * score, high + 1).otherwise(high)
    wanted = best.withColumns({"low": low, "high": high}).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    ready = anchors.join(wanted, "anchor_id").withColumn("windows", F.transform("w", lambda w: window(w["low"], w["high"])))
    against = scan(*cells(index, ask(ready.select(*columns), tree), leaf_counts, block, per_slice), False, negatives)
    chosen = best.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return against.join(chosen, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
