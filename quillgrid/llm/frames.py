"""Small DataFrame helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, ship


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: other columns, clashing ones too, play no part."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Give free memory back to the system: idle workers stay alive and would keep their task's peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (id, component) per linked id, component the smallest id.

    Each partition first reduces its links to a forest by union-find, which keeps at
    most one link per id and partition.  Then each round hangs the ids below an id
    under the smallest id that it is linked with (large star), and links an id's
    other smaller ids to its smallest (small star), until all links are stars.  Only
    larger ends are keys of an aggregation, so a hub, which is a smaller end, is
    never collected.  Every round is checkpointed.  Null ends are ignored.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(map_arrow(pairs, _forest, "a long, b long").distinct())
    while True:
        ends = edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        low = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = edges.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.filter("a <> b").distinct())


#: Links that a partition reduces at once.
LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def forest() -> pa.RecordBatch:
        found = [(x, find(x)) for x in parent if find(x) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LINKS:
            yield forest()
    yield forest()
