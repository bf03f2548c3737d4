"""Operator 12, centroid clustering: a vantage-point tree over the centroids, rebuilt and broadcast each round."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package, cut_lineage

LEAF = 2
ROWS = 4096
#: Beyond it a squared distance of 64 components may not fit a long.
MOST = 1 << 27
#: Share of the distances by which a bound in floating point is lowered, far more than rounding can make of it.
SLACK = 2.0 ** -40


@dataclass
class Node:
    members: np.ndarray                 # centroid numbers whose distances are taken here
    children: list[int] = field(default_factory=list)
    near: list[float] = field(default_factory=list)   # least and greatest distance of a child's centroids from members[0]
    far: list[float] = field(default_factory=list)


class VantageTree:
    """Centroids (rows of an integer matrix) halved by their distance from a vantage point, down to leaves."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes: list[Node] = []
        if len(centroids):
            self._grow(np.arange(len(centroids)))

    def _grow(self, numbers: np.ndarray) -> int:
        at = len(self.nodes)
        if len(numbers) <= LEAF:
            self.nodes.append(Node(numbers))
            return at
        # a point far from the others parts them best
        from_first = squared(self.centroids[numbers], self.centroids[numbers[0]])
        pick = int(from_first.argmax())
        vantage, rest = numbers[pick], np.delete(numbers, pick)
        node = Node(np.array([vantage]))
        self.nodes.append(node)
        distance = np.sqrt(squared(self.centroids[rest], self.centroids[vantage]).astype(float))
        order = distance.argsort(kind="stable")
        for half in np.array_split(order, 2):
            node.near.append(float(distance[half].min()))
            node.far.append(float(distance[half].max()))
            node.children.append(self._grow(rest[half]))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of every vector, the smaller number among equals.

        Each vector goes on with its own node of the least bound, until that bound is greater than its best distance; a
        node at exactly the best distance is still entered, as it may hold a smaller number.  Bounds are floating point,
        lowered by more than their rounding; distances that decide are integers.  Vectors that stand at one node are
        worked off together.
        """
        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, len(self.centroids))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0.0
        active = np.arange(n)
        while len(active):
            node = bound[active].argmin(axis=1)
            going = bound[active, node] <= np.sqrt(best[active].astype(float))
            active, node = active[going], node[going]
            for at in np.unique(node):
                rows = active[node == at]
                here = self.nodes[at]
                own, mine = bound[rows, at], vectors[rows]
                bound[rows, at] = np.inf
                for centroid in here.members:
                    reach = squared(mine, self.centroids[centroid])
                    better = (reach < best[rows]) | ((reach == best[rows]) & (centroid < number[rows]))
                    best[rows[better]] = reach[better]
                    number[rows[better]] = centroid
                if here.children:
                    d = np.sqrt(reach.astype(float))
                    for child, near, far in zip(here.children, here.near, here.far):
                        bound[rows, child] = np.maximum(own, np.maximum(d - far, near - d) - SLACK * (d + far))
        return number, best


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def integers(batch: pa.RecordBatch, dimensions: int, scale: float) -> np.ndarray:
    """Vectors of a batch as integer rows: floor(scale * x)."""
    values = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimensions)
    if len(values) and np.abs(values).max() > MOST:
        raise ValueError(f"a component times {scale:g} is beyond {MOST}; its squared distance may not fit a long")
    return values.astype(np.int64)


def usable(vectors: DataFrame, dimensions: int, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, vector)`` of the vectors with so many components, all of them finite."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter((F.size("vector") == dimensions) & F.coalesce(finite, F.lit(False)))


def round_sums(rows: DataFrame, tree, dimensions: int, scale: float) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of every non-empty cluster; a task sends one row for each of its clusters."""
    def run(batches):
        counts, sums = {}, {}
        for batch in batches:
            values = integers(batch, dimensions, scale)
            for part in range(0, len(values), ROWS):
                block = values[part:part + ROWS]
                number, _ = tree.value.nearest(block)
                for c in np.unique(number):
                    mine = block[number == c]
                    counts[c] = counts.get(c, 0) + len(mine)
                    sums[c] = sums.get(c, 0) + mine.sum(axis=0)
        yield pa.record_batch([pa.array([int(c) for c in counts], pa.int32()), pa.array(list(counts.values()), pa.int64()),
                               pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.select("vector").mapInArrow(run, "cluster int, n long, sums array<long>")
    flat = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    total = flat.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    made: dict[int, list[int]] = {}
    for row in total.collect():         # clusters times components
        made.setdefault(row.cluster, [0] * (dimensions + 1))[row["at"]] = int(row.x)
    return {c: (values[0], values[1:]) for c, values in made.items()}


def cluster(vectors: DataFrame, k: int, seed_order: Column, rounds: int = 10, dimensions: int = 64, scale: float = 1024.0,
            vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``((vec_id, cluster, distance), centroids)``: integer k-means by exact nearest neighbours.

    Vectors with another number of components than ``dimensions``, or with a null or non-finite one, are left out; the
    rest become integers floor(scale * x).  Centroids start as the ``k`` vectors first in ``seed_order`` (an expression on
    ``vec_id``; a null comes last, then the smaller vector is first).  A round assigns every vector to the nearest
    centroid (squared distance; of equals the smaller number) and puts the floor of the mean in place of every non-empty
    one.  Then vectors are assigned once more.  With fewer than ``k`` vectors there are fewer centroids; with none, no
    rows.  Repeated rows count each, a null id stays null, other columns are not read.

    A round is one scan and no shuffle of vectors: tasks search the broadcast tree and send sums, and clusters times
    components numbers reach the driver.  A component beyond 2^27 after scaling is an error.
    """
    spark = ship_package(vectors.sparkSession)
    rows = usable(vectors, dimensions, vec_id, vector)
    first = rows.select(seed_order.alias("seed"), "vector").orderBy(F.col("seed").asc_nulls_last(), "vector").limit(k).collect()
    centroids = np.floor(scale * np.array([r["vector"] for r in first], float).reshape(-1, dimensions))
    if len(centroids) and np.abs(centroids).max() > MOST:
        raise ValueError("a component is beyond the range of exact distances")
    centroids = centroids.astype(np.int64)
    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(VantageTree(centroids))
        sums = round_sums(rows, tree, dimensions, scale)
        tree.destroy()
        moved = np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else old.tolist() for c, old in enumerate(centroids)], np.int64)
        if np.array_equal(moved, centroids):
            break       # further rounds would change nothing
        centroids = moved
    last = VantageTree(centroids)

    def assign(batches):
        for batch in batches:
            values = integers(batch, dimensions, scale)
            for part in range(0, len(values), ROWS):
                number, distance = last.nearest(values[part:part + ROWS])
                yield pa.record_batch([batch.column("vec_id").slice(part, ROWS), pa.array(number.astype(np.int32)), pa.array(distance)],
                                      names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    return rows.mapInArrow(assign, schema), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to assigned vectors."""
    spark = assigned.sparkSession
    assigned = cut_lineage(assigned)
    per = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(per.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(c, d, whole, digests[c]) for c, d in per.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
