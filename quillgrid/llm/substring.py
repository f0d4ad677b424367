"""Duplicate passages by relative Lempel-Ziv parsing against an index of every reference block.

The reference of a document is all text of documents with a smaller id.  Its blocks are
indexed by fingerprints of their 50-word windows; an entry keeps where the reference
holds the window first: the smallest id, and the place in its text.

1. One pass hashes each text as a whole and selects anchors: the least 10-word hash of
   every window (about one word in twenty).  Equal windows have equal anchors.
2. A text that equals one with a smaller id is one factor; it is no reference either,
   as the smaller one holds the same windows.
3. Only windows whose anchor stands in several ids are looked up: their fingerprints
   meet the index, and the places in smaller ids come back to the document.
4. The document is parsed greedily from left to right: a factor starts at the first
   window that the reference holds, at that place of that reference text, and is
   extended word by word while the next window stands at the next place of the same
   text.  A factor is thus one stretch of one reference text.  After its end the windows
   that straddle the boundary are looked at before a literal is accepted: one that the
   reference holds elsewhere starts the next factor, which overlaps the one before, so
   no repeated window is lost between two factors.

Fingerprints are aggregated map-side before they are shuffled; a passage that a third
of all documents share costs each document one row per window, never pairs.

Defined cases: null and empty texts have no words; texts of fewer than 50 words are
kept; a row without id is neither reference nor parsed; repeated ids are not smaller
than each other, so equal rows stay; a factor's source that is a repeated id is its
least place; an empty table gives an empty result; columns other than the named ones
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut
from . import textblocks as tb
from .frames import map_arrow, narrow

U = np.uint64
WINDOW, ANCHOR = 50, 10
_SALT = U(0x8EBC6AF09C88C6E3)


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values, by doubling."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every window of a run of words."""
    return least(tb.windows(h, ANCHOR), WINDOW - ANCHOR + 1)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = tb.raw(batch.column(column))
    for a, b in tb.runs(offsets):
        part = data[offsets[a] : offsets[b]]
        h, _, _, at = tb.words(part, offsets[a : b + 1] - offsets[a], "space", False)
        yield a, b, part, h, at


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, h, at in _texts(batch, 2):
            n = np.diff(at)
            whole, found, sizes = [], [], []
            position = np.arange(len(h)) - at[:-1][tb.owner(at)] if len(h) else np.zeros(0, np.int64)
            sums = [np.append(U(0), np.cumsum(tb.mix(h + tb.mix(position.astype(U) ^ salt)))) for salt in (_SALT, ~_SALT)]
            whole = [s[at[1:]] - s[at[:-1]] for s in sums]
            if len(h) >= WINDOW:
                least_ = anchors(h)
                inside = tb.whole(at, WINDOW, len(least_))
                own = tb.owner(at)[: len(least_)]
                change = np.ones(len(least_), dtype=bool)
                change[1:] = (least_[1:] != least_[:-1]) | (own[1:] != own[:-1]) | ~inside[:-1]
                some = np.flatnonzero(inside & change)
                found, owners = least_[some], own[some]
                sizes = np.bincount(owners, minlength=b - a)
            else:
                found, sizes = np.zeros(0, U), np.zeros(b - a, np.int64)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(tb.signed(whole[0])), pa.array(tb.signed(whole[1])), tb.lists(tb.signed(found), np.append(0, np.cumsum(sizes)), pa.int64())], ["doc_id", "text_key", "n_words", "w1", "w2", "anchors"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows whose anchor is shared: one row (doc_id, fp, place) for each that the text holds, with its first place."""
    for batch in batches:
        shared = batch.column(3)
        for a, b, _, h, at in _texts(batch, 2):
            ids, prints, places = [], [], []
            for i in range(a, b):
                w = h[at[i - a] : at[i - a + 1]]
                if len(w) < WINDOW:
                    continue
                known = np.asarray(shared[i].values).view(U)
                some = np.flatnonzero(np.isin(anchors(w), known))
                fp, first = np.unique(tb.windows(w, WINDOW)[some], return_index=True)
                prints.append(fp)
                places.append(some[first].astype(np.int32))
                ids.append(np.full(len(fp), batch.column(0)[i].as_py(), dtype=np.int64))
            flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ids, np.int64), (prints, U), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(tb.signed(flat[1])), pa.array(flat[2])], ["doc_id", "fp", "place"])


def factor(source: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, source, its place) of a text, from each window's first place in the reference (place -1: none).

    A factor goes on while the next window stands at the next place of the same source.
    Its successor may overlap it: windows that straddle its end are looked at before
    words count as literals.
    """
    held = place >= 0
    goes_on = np.zeros(len(held) + 1, dtype=bool)
    goes_on[1:-1] = held[1:] & held[:-1] & (source[1:] == source[:-1]) & (place[1:] == place[:-1] + 1)
    first, last = np.flatnonzero(held & ~goes_on[:-1]), np.flatnonzero(held & ~goes_on[1:])
    return [(a, b - a + WINDOW, s, p) for a, b, s, p in zip(first.tolist(), last.tolist(), source[first].tolist(), place[first].tolist(), strict=True)]


def _places(w: np.ndarray, hits: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Source and place of every window, from those of each held window's first place in the text."""
    at, source, place = (np.asarray(x) for x in hits.values.flatten())
    fp = tb.windows(w, WINDOW)
    known = fp[at]
    order = np.argsort(known)
    near = order[np.minimum(np.searchsorted(known[order], fp), len(known) - 1)]
    held = known[near] == fp
    return np.where(held, source[near], 0), np.where(held, place[near], -1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the places of their held windows (null: none)."""
    for batch in batches:
        hits = batch.column(3)
        for a, b, part, h, at in _texts(batch, 2):
            data = part.tobytes()
            rows = []
            offsets = tb.raw(batch.column(2).slice(a, b - a))[1]
            for i in range(b - a):
                w = h[at[i] : at[i + 1]]
                words = data[offsets[i] : offsets[i + 1]].split()
                found: list[tuple[int, int, int, int]] = []
                left = words
                if hits[a + i].is_valid and len(w) >= WINDOW:
                    keep = np.ones(len(w), dtype=bool)
                    found = factor(*_places(w, hits[a + i]))
                    for s, n, _, _ in found:
                        keep[s : s + n] = False
                    left = list(compress(words, keep.tolist()))
                rows.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), *(list(x) for x in (zip(*found, strict=True) if found else ((),) * 4))))
            columns = [batch.column(0).slice(a, b - a)]
            columns += [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "starts", "sizes", "sources", "places"])


_PARSED = "doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<int>, sizes array<int>, sources array<long>, places array<int>"
_HELD = "array<struct<at:int,source:bigint,place:int>>"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and the duplicate factors: starts and sizes (words) in the text, sources (ids) and places (words) there."""
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    sketch = cut(map_arrow(base, _sketch, "doc_id long, text_key long, n_words long, w1 long, w2 long, anchors array<long>"))
    long_ = sketch.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW))
    classes = long_.groupBy("w1", "w2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep <> last").select("w1", "w2", "rep")
    copies = cut(long_.join(bounded(cut(classes)), ["w1", "w2"]).filter("doc_id > rep").select("doc_id", "text_key", "n_words", "rep"))
    copied = bounded(copies.select("doc_id", "text_key").distinct())
    leaders = long_.join(copied, ["doc_id", "text_key"], "left_anti")

    marks = leaders.select("doc_id", F.explode("anchors").alias("anchor")).distinct()
    shared = marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("anchor")
    asked = cut(marks.join(shared, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared")))
    some = base.join(bounded(asked.select("doc_id")), "doc_id", "left_semi").join(copied, ["doc_id", "text_key"], "left_anti")
    prints = map_arrow(some.join(asked, "doc_id").select("doc_id", "text_key", "text", "shared"), _prints, "doc_id long, fp long, place int")
    index = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id <> last").select("fp", F.col("first.doc_id").alias("source"), F.col("first.place").alias("source_place"))
    hits = prints.join(index, "fp").filter("doc_id > source")
    held = cut(hits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("place").alias("at"), "source", F.col("source_place").alias("place"))).alias("held")))
    touched = bounded(held.select("doc_id"))

    rest = base.join(copied, ["doc_id", "text_key"], "left_anti")
    parsed = rest.join(touched, "doc_id", "left_semi").join(held, "doc_id").select("doc_id", "text_key", "text", "held")
    plain = rest.join(touched, "doc_id", "left_anti").select("doc_id", "text_key", "text", F.lit(None).cast(_HELD).alias("held"))
    all_ = F.array(F.lit(0))
    of_copies = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), all_.alias("starts"), F.array(F.col("n_words").cast("int")).alias("sizes"), F.array("rep").alias("sources"), all_.alias("places"))
    return map_arrow(parsed, _parse, _PARSED).unionByName(map_arrow(plain, _parse, _PARSED)).unionByName(of_copies)
