"""Packing token ids into fixed-length rows by best-fit decreasing, with a segment tree over free capacities.

Documents are encoded where they are read and packed shard by shard: a shard is the
next ``shard_tokens`` tokens of a partition, so packing needs no shuffle, holds one
shard in memory, and wastes at most the open rows at a shard's end.  A document longer
than a row is cut into full rows and a rest, without loss.  Pieces are placed longest
first, each into the row with the least free capacity that still fits it, which the
segment tree finds in log(length) steps.

A packed row holds its ids (little-endian unsigned 32-bit integers, padded), the
cumulative lengths of its pieces, positions that restart at 0 with each piece, and
which part of which document each piece is, so documents can be put together again.

Defined cases: null and empty texts take no room and stand in no row; a row without
id is packed with a null id; repeated rows are packed each; an empty table gives no
rows; columns other than the named ones play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LocalEncoder
from .frames import map_arrow, narrow

LENGTH, SHARD_TOKENS = 2048, 2_000_000
#: Characters that are encoded at once.
_PIECE = 4_000_000


class Capacities:
    """A segment tree over free capacities 0..length: how many open rows have each."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def push(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """An open row with the least free capacity of at least ``need``, and that capacity; it is taken out."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up, until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:  # down, to the left as far as there are rows
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.size
        self._add(free, -1)
        return self.rows[free].pop(), free

    def _add(self, free: int, n: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += n
            i >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; pieces are placed by falling size, equal sizes in their order."""
    tree, rows = Capacities(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.pop(sizes[piece])
        row, free = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(piece)
        if free > sizes[piece]:
            tree.push(free - sizes[piece], row)
    return rows


def _packed(shard: list[tuple[int | None, np.ndarray]], length: int, pad: int, first: int) -> Iterator[tuple]:
    pieces = [(doc, at, ids[at : at + length]) for doc, ids in shard for at in range(0, len(ids), length)]
    for number, row in enumerate(best_fit([len(p[2]) for p in pieces], length)):
        some = [pieces[i] for i in row]
        size = [len(p[2]) for p in some]
        ids = np.full(length, pad, dtype="<u4")
        ids[: sum(size)] = np.concatenate([p[2] for p in some])
        positions = np.concatenate([*(np.arange(n, dtype="<u4") for n in size), np.zeros(length - sum(size), "<u4")])
        yield first + number, [p[0] for p in some], [p[1] for p in some], [0, *np.cumsum(size).tolist()], sum(size), ids.tobytes(), positions.tobytes()


_KINDS = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
_NAMES = ["pack_id", "doc_ids", "doc_starts", "cu_seqlens", "n_tokens", "ids", "positions"]
SCHEMA = "pack_id long, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, positions binary"


def _pack(path: str, length: int, shard_tokens: int, pad: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = LocalEncoder(path)
        shard: list[tuple[int | None, np.ndarray]] = []
        size = number = base = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, size, number
            rows = list(_packed(shard, length, pad, base + number))
            number += len(rows)
            shard, size = [], 0
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a : a + 256], strict=True), _KINDS, strict=True)], _NAMES)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                base = part.column(2)[0].as_py() << 33
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, chars = lo + 1, len(texts[lo])
                    while hi < len(texts) and chars + len(texts[hi]) <= _PIECE:
                        chars += len(texts[hi])
                        hi += 1
                    for doc, tokens in zip(ids[lo:hi], encode(texts[lo:hi]), strict=True):
                        shard.append((doc, tokens))
                        size += len(tokens)
                        if size >= shard_tokens:
                            yield from close()
                    lo = hi
        yield from close()

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, pad: int = 0) -> DataFrame:
    """Packed rows of ``length`` ids (SCHEMA).  ``pack_id`` is unique; which documents share a row follows the input's partitions."""
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.spark_partition_id().alias("part"))
    return map_arrow(base, _pack(path, length, shard_tokens, pad), SCHEMA)


def write(packed: DataFrame, folder: str) -> None:
    """Write packed rows as Parquet: the id matrix row by row in ``ids``, cumulative lengths and positions beside it."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def unpack(packed: DataFrame) -> DataFrame:
    """One row (doc_id, ids) per packed id: its pieces put together by their starts.  Ids must be unique."""
    sized = packed.select("ids", F.explode(F.arrays_zip("doc_ids", "doc_starts", F.expr("slice(cu_seqlens, 1, size(cu_seqlens) - 1)").alias("a"), F.expr("slice(cu_seqlens, 2, size(cu_seqlens) - 1)").alias("b"))).alias("p"))
    piece = sized.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.doc_starts").alias("at"), F.expr("substring(ids, 4 * p.a + 1, 4 * (p.b - p.a))").alias("part")).filter("doc_id is not null")
    joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: F.hex(x["part"]))
    return piece.groupBy("doc_id").agg(F.unhex(F.array_join(joined, "")).alias("ids"))
