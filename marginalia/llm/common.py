"""What the operators of this folder share: batches of texts, words, hashes and connected components."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, ship_package

SLICE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def slices(batch: pa.RecordBatch, text: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``budget`` bytes of text (a longer text is a part of its own),
    so that the Python objects made of it stay few."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start, held = np.cumsum(sizes), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, held + budget, "right")))
        yield batch.slice(start, stop - start)
        start, held = stop, int(ends[stop - 1])


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``work`` on bounded slices of the rows, in Arrow."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = work(part)
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(schema: str, **columns) -> pa.RecordBatch:
    """A batch whose types follow a short schema string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
             "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "float": pa.float32()}
    fields = [x.strip().split(" ") for x in schema.split(",")]
    return pa.record_batch([c if isinstance(c := columns[name], pa.Array) else pa.array(c, kinds[kind]) for name, kind in fields],
                           names=[name for name, _ in fields])


class Numbering(defaultdict):
    """A number for every distinct key, in order of appearance."""

    def __init__(self):
        super().__init__()
        self.default_factory = self.__len__

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, the same in every process; each distinct word is hashed once."""
    import xxhash
    seen = Numbering()
    at = seen.of(words)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))[at]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` word hashes."""
    n = len(words) - width + 1
    made = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        made = mixed(made * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n] + np.uint64(k + 1))
    return made


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Every round gives a node the smallest label among its neighbours' and then jumps along labels, so that chains
    halve.  Each round is one combining aggregate (a hub sends one row from each task) and joins on node, and is
    checkpointed; only the number of changed rows reaches the driver.
    """
    both = (edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
            .union(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct())
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")))
    for _ in range(most_rounds):
        near = (both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near")))
        moved = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        at = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut_lineage(moved.join(at, "component", "left").select("node", "old", F.least("component", "further").alias("component")))
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
