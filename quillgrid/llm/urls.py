"""URL filter: rules first, then the likelihood ratio of two character language models.

Rules judge what they fit.  The URLs that they accept and reject train two smoothed
variable-order Markov models over bytes (digits count as one symbol): the probability
of a byte after its longest known context of up to ``ORDER`` bytes, interpolated with
all shorter ones.  A byte and its longest context are a window, which fits a long, so
counts are exact and keyed by the window itself; they stand in a DataFrame that grows
with the corpus, and shorter contexts are sums over it.  The difference of the models
at each window is joined to the windows of the URLs, of which a block of URLs looks up
each once.  A URL that no rule fits is blocked if its log-likelihood difference,
divided by its length, is under a threshold that held-out judged URLs (a quarter, by
hash) calibrate: it rejects at most ``LOSS`` of accepted ones and otherwise separates
the two best.

Defined cases: null URLs and URLs without ``://`` have an empty host and path, fit no
rule and are judged by their text (null: empty, allowed); without accepted or rejected
training URLs all differences are 0 and nothing is blocked by the models; repeated rows
each get their row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from . import textblocks as tb
from .frames import map_arrow, narrow

ORDER = 5
#: URLs and bytes of a block, which looks up each of its windows once; a longer URL is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 1000, 1 << 18
#: Pseudo-counts that a shorter context's estimate gets.
STRENGTH = 4.0
#: Share of accepted held-out URLs that the threshold may block, and the width of a score bin.
LOSS, BIN = 0.01, 0.01
HELD_OUT = 4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` (page_id, url) with host, path, and the longest fitting rule and its verdict."""
    host, path = parts(F.col("url"))
    frame = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):  # the longest stands outermost
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return frame.withColumn("rule", rule).withColumn("ruled", verdict)


_FOLD = tb.LOWER.copy()
_FOLD[0x30:0x3A] = 0x30


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte itself and the ``ORDER`` bytes before it, from the lowest byte up; 0xFF, which no text has, stands before a URL's start."""
    data = _FOLD[data].astype(np.int64)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(len(data))
    out = data.copy()
    for k in range(1, ORDER + 1):
        back = place - k
        out |= np.where(back >= start, data[np.maximum(back, 0)], 0xFF) << (8 * k)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns, the text last, and the row's block after them."""
    block = TaskContext.get().partitionId() << 33
    for batch in batches:
        _, offsets = tb.raw(batch.column(batch.num_columns - 1))
        for a, b in tb.runs(offsets, BLOCK_BYTES):
            for i in range(a, b, BLOCK_ROWS):
                part = batch.slice(i, min(BLOCK_ROWS, b - i))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, block))], [*batch.schema.names, "block"])
                block += 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, ok): one row (w, good, bad) for each window that a piece of the batch has."""
    for batch in batches:
        allowed = np.asarray(batch.column(1).to_pylist(), dtype=bool)
        data, offsets = tb.raw(batch.column(0))
        for a, b in tb.runs(offsets):
            at = offsets[a : b + 1] - offsets[a]
            w, place = np.unique(windows(data[offsets[a] : offsets[b]], at), return_inverse=True)
            good = np.bincount(place, np.repeat(allowed[a:b], np.diff(at)), len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(good), pa.array(np.bincount(place, minlength=len(w)) - good)], ["w", "good", "bad"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, text): one row (block, w) for each window that a block's rows in the batch have."""
    for batch in batches:
        block = np.asarray(batch.column(0))
        data, offsets = tb.raw(batch.column(1))
        edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            w = np.unique(windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), block[a])), pa.array(w)], ["block", "w"])


def model(counts: DataFrame) -> DataFrame:
    """From (w, good, bad), one row for each window: (w, d), the difference of its byte's log-likelihoods, accepted against rejected.

    No key of a join stands in more than 256 rows of a side, as rows are distinct and differ from the key by one byte.
    """
    level, levels = counts.select(F.col("w").alias("key"), "good", "bad"), []
    for k in range(ORDER, -1, -1):
        levels.append(level)
        level = level.groupBy(F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    known = None
    for k, level in enumerate(reversed(levels)):
        context = F.shiftright("key", 8)
        seen = level.groupBy(context.alias("context")).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        made = level.withColumn("context", context).join(seen, "context")
        if known is None:
            made = made.withColumns({"p_good": F.lit(1 / 256), "p_bad": F.lit(1 / 256), "trained": (F.col("all_good") > 0) & (F.col("all_bad") > 0)})
        else:
            made = made.withColumn("shorter", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(known.withColumnRenamed("key", "shorter"), "shorter")
        p = lambda c: ((F.col(c) + STRENGTH * F.col(f"p_{c}")) / (F.col(f"all_{c}") + STRENGTH)).alias(f"p_{c}")
        known = made.select("key", p("good"), p("bad"), "trained")
    return known.select(F.col("key").alias("w"), F.when(F.col("trained"), F.log("p_good") - F.log("p_bad")).otherwise(0.0).alias("d"))


def _scored(rows: pa.Table, found: pa.Table) -> pa.Table:
    """A block's rows and the differences at its windows: the rows without block and text, and the score, the mean difference of a byte; 0 for an empty text."""
    data, offsets = tb.raw(rows.column("text"))
    score = np.zeros(rows.num_rows)
    if len(data):
        w, d = np.asarray(found.column("w")), np.asarray(found.column("d"))
        order = np.argsort(w)
        size = np.diff(offsets)
        each = d[order][np.searchsorted(w[order], windows(data, offsets))]
        score = np.bincount(np.repeat(np.arange(len(size)), size), each, len(size)) / np.maximum(size, 1)
    return rows.drop_columns(["block", "text"]).append_column("score", pa.array(np.round(score, 6)))


def threshold(bins: list[tuple[bool, int, int]]) -> float:
    """From (accepted, bin, count) of held-out URLs: scores under it are blocked."""
    good, bad = (sum(n for ok, _, n in bins if ok is want) for want in (True, False))
    if not good or not bad:
        return -np.inf
    best, first, last = 0.0, -np.inf, -np.inf
    for edge in sorted({b for _, b, _ in bins} | {b + 1 for _, b, _ in bins}):
        lost = sum(n for ok, b, n in bins if ok and b < edge)
        caught = sum(n for ok, b, n in bins if not ok and b < edge)
        gain = caught / bad - lost / good
        if lost <= LOSS * good and gain > best:
            best, first = gain, edge
        if lost <= LOSS * good and gain == best and best > 0:
            last = edge
    return (first + last) / 2 * BIN  # the middle of the edges that separate equally well


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (page_id, host, path, rule, verdict, score) per row of ``pages``."""
    frame = ruled(narrow(pages, page_id=id_col, url=url_col), rules)
    text = F.coalesce(F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.col("url")), F.lit(""))
    frame = frame.select("page_id", "host", "path", "rule", "ruled", (F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0).alias("held"), text.alias("text"))
    kept = f"page_id {dict(frame.dtypes)['page_id']}, host string, path string, rule string, ruled string, held boolean"
    frame = cut(map_arrow(frame, _blocks, f"{kept}, text string, block long"))  # blocks stay as they are
    counts = map_arrow(frame.filter("ruled is not null and not held").select("text", (F.col("ruled") == "allow").alias("ok")), _counted, "w long, good long, bad long")
    met = map_arrow(frame.select("block", "text"), _met, "block long, w long").distinct()
    unseen = met.select("w", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("bad"))
    known = model(cut(counts.union(unseen).groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))))
    scored = frame.groupBy("block").cogroup(met.join(known, "w").select("block", "w", "d").groupBy("block")).applyInArrow(_scored, f"{kept}, score double")
    scored = cut(scored)
    bins = scored.filter("ruled is not null and held").groupBy((F.col("ruled") == "allow").alias("ok"), F.greatest(F.lit(-10_000), F.least(F.lit(10_000), F.floor(F.col("score") / BIN))).cast("int").alias("bin")).count()  # at most 40,000 rows
    limit = threshold([(r.ok, r.bin, r["count"]) for r in bins.collect()])
    verdict = F.coalesce("ruled", F.when(F.col("score") < F.lit(float(limit)), "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
