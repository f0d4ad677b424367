"""Benchmark decontamination by a prefix-filtered join of document words with item windows.

Every item is cut into windows of 10 consecutive words (an item of fewer words is
one window).  A window's tokens are its 3-word shingles, ordered by how rare they are
in the documents; as a window must be contained whole, its rarest shingle alone is
the necessary prefix.  Documents are joined with the prefixes; a shared shingle
proposes the one window start that its offset in the window allows, which must lie
inside the document (length and positional bounds), and is verified word by word.

The window index is broadcast in blocks of at most ``BLOCK_WINDOWS`` distinct windows
(about 150 bytes each): one pass over the documents for one block, and one more pass
for every further block, so that no broadcast grows with the benchmark.

Defined cases: a null or empty document has no words and no hits; null and empty
items have no windows, rows without item id mark words but are not listed; repeated
items count once; repeated documents each get their row; an empty table on either
side gives rows without hits, or no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import textblocks as tb
from .frames import map_arrow, narrow

U = np.uint64
WINDOW, SHINGLE = 10, 3
#: Distinct windows of an index that is broadcast at once.
BLOCK_WINDOWS = 500_000


def _words(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tb.raw(batch.column(column))
    for a, b in tb.runs(offsets):
        h, _, _, at = tb.words(tb.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], "alnum", False)
        yield a, b, h, at


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every item its windows: word hashes, and shingles."""
    for batch in batches:
        items = batch.column(0).to_pylist()
        rows = []
        for a, b, h, at in _words(batch, 1):
            for i in range(a, b):
                w = h[at[i - a] : at[i - a + 1]]
                size = min(WINDOW, len(w))
                for k in range(len(w) - size + 1 if size else 0):
                    one = w[k : k + size]
                    rows.append((items[i], tb.signed(one).tolist(), tb.signed(tb.windows(one, min(SHINGLE, size))).tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item_id", "words", "shingles"])


def _count(tokens: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each token (sorted hashes by shingle width) stands in the documents; one row for each token and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for batch in batches:
            for _, _, h, at in _words(batch, 0):
                for k, known in tokens.items():
                    found, _ = _matches(h, at, k, known)
                    total[k] += np.bincount(found, minlength=len(known))
        for k, known in tokens.items():
            some = np.flatnonzero(total[k])
            yield pa.RecordBatch.from_arrays([pa.array(tb.signed(known[some])), pa.array(total[k][some])], ["token", "n"])

    return run


def _matches(h: np.ndarray, at: np.ndarray, width: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known tokens that documents hold, and where."""
    s = tb.windows(h, width)
    if not len(s) or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a small table over the hashes' low bits drops almost all positions before the search
    bits = 20
    mask = U((1 << bits) - 1)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(known & mask).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(s & mask).astype(np.int64)])
    place = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
    hit = known[place] == s[maybe]
    maybe, place = maybe[hit], place[hit]
    inside = maybe + width <= at[np.searchsorted(at, maybe, "right")]
    return place[inside], maybe[inside]


class Index:
    """Distinct windows by prefix token: all arrays, so it is small and quick to send."""

    def __init__(self, rows: list) -> None:
        # rows: words, width, token, offset, items
        rows = sorted(rows, key=lambda r: (r[1], r[2] & (1 << 64) - 1))
        self.words = [np.array(r[0], dtype=np.int64).view(U) for r in rows]
        self.length = np.array([len(r[0]) for r in rows], dtype=np.int64)
        self.flat = np.zeros((len(rows), WINDOW), dtype=U)
        for i, w in enumerate(self.words):
            self.flat[i, : len(w)] = w
        del self.words
        self.shift = np.array([r[3] for r in rows], dtype=np.int64)
        self.items = [tuple(r[4]) for r in rows]
        width = np.array([r[1] for r in rows], dtype=np.int64)
        token = np.array([r[2] for r in rows], dtype=np.int64).view(U)
        self.by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(width).tolist():
            part = np.flatnonzero(width == k)
            known, first = np.unique(token[part], return_index=True)
            self.by[k] = (known, np.append(part[first], part[-1] + 1))

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Verified (window, start) pairs over documents laid end to end."""
        windows, starts = [], []
        doc = tb.owner(at)
        for k, (known, first) in self.by.items():
            token, where = _matches(h, at, k, known)
            size = first[token + 1] - first[token]
            window = np.repeat(first[token], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            start = np.repeat(where, size) - self.shift[window]
            own = doc[np.repeat(where, size)]
            fits = (start >= at[own]) & (start + self.length[window] <= at[own + 1])
            window, start = window[fits], start[fits]
            same = np.ones(len(window), dtype=bool)
            for t in range(WINDOW):
                inside = self.length[window] > t
                same &= ~inside | (h[np.minimum(start + t, len(h) - 1)] == self.flat[window, t])
            windows.append(window[same])
            starts.append(start[same])
        return np.concatenate(windows), np.concatenate(starts)


def _search(index, by_document: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Result rows, or for one of several blocks the positions and items of each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch in batches:
            rows = batch.column(2).to_pylist() if not by_document else []
            for a, b, h, at in _words(batch, 1):
                window, start = table.hits(h, at) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                mark = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + table.length[window], -1)
                covered = np.cumsum(mark[:-1]) > 0
                sums = np.append(0, np.cumsum(covered))
                n_hit = sums[at[1:]] - sums[at[:-1]]
                items: dict[int, set] = {}
                for w, d in zip(window.tolist(), (np.searchsorted(at, start, "right") - 1).tolist(), strict=True):
                    items.setdefault(d, set()).update(table.items[w])
                if by_document:
                    listed = [sorted(map(str, items.get(i, ()))) for i in range(b - a)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(n_hit), pa.array([len(x) for x in listed], pa.int64()), pa.array([_digest(x) for x in listed])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
                    )
                else:
                    some = np.flatnonzero(n_hit).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[a + i] for i in some], pa.int64()), pa.array([np.flatnonzero(covered[at[i] : at[i + 1]]) for i in some], pa.list_(pa.int64())), pa.array([sorted(items.get(i, ())) for i in some], pa.list_(pa.int64()))],
                        ["row", "places", "items"],
                    )

    return run


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, at in _words(batch, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(at))], ["doc_id", "row", "n_words"])


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``; no shuffle of documents."""
    spark = docs.sparkSession
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    items = narrow(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("long"), "text")
    cut_up = map_arrow(items, _windows, "item_id long, words array<long>, shingles array<long>")
    windows = cut(cut_up.groupBy("words", "shingles").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("width", F.least(F.lit(SHINGLE), F.size("words"))))
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    block = lambda i: windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == i) if blocks > 1 else windows
    parts = []
    for i in range(blocks):
        some = block(i)
        tokens: dict[int, set] = {}
        for r in some.select("width", F.explode("shingles").alias("token")).distinct().collect():  # bounded by the block
            tokens.setdefault(r.width, set()).add(r.token)
        known = {k: np.sort(np.array(list(t), dtype=np.int64).view(U)) for k, t in tokens.items()}
        rare = dict(map(tuple, map_arrow(base.select("text"), _count(known), "token long, n long").groupBy("token").agg(F.sum("n")).collect())) if known else {}
        rows = []
        for r in some.collect():
            offset = min(range(len(r.shingles)), key=lambda j: (rare.get(r.shingles[j], 0), r.shingles[j]))
            if r.shingles[offset] in rare:  # a window whose rarest shingle is nowhere is nowhere
                rows.append((r.words, r.width, r.shingles[offset], offset, r["items"]))
        parts.append(spark.sparkContext.broadcast(Index(rows) if rows else Index0()))
    if blocks == 1:
        out = map_arrow(base, _search(parts[0], True), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    else:
        numbered = base.withColumn("row", F.monotonically_increasing_id())
        hits = [map_arrow(numbered, _search(p, False), "row long, places array<long>, items array<long>") for p in parts]
        union = hits[0]
        for h in hits[1:]:
            union = union.unionByName(h)
        merged = union.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
        empty: list[str] = []
        sized = map_arrow(numbered, _lengths, "doc_id long, row long, n_words long").join(merged, "row", "left")
        zero = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        out = sized.select("doc_id", "n_words", F.when(F.col("places").isNull(), F.lit(0)).otherwise(zero("places")).cast("long").alias("n_hit"), F.when(F.col("items").isNull(), F.lit(0)).otherwise(zero("items")).cast("long").alias("n_items"), F.when(F.col("items").isNull(), F.lit(_digest(empty))).otherwise(F.sha2(F.array_join(listed, ","), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


class Index0:
    """The index without windows."""

    length = np.zeros(0, np.int64)
    items: list = []  # noqa: RUF012

    def hits(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window occurs; rows without id are judged by id too, and stay."""
    from ..runtime import bounded

    out = cut(find(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("__hit")).distinct())
    return docs.join(bounded(out), docs[id_col] == F.col("__hit"), "left_anti")
