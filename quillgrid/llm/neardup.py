"""Near-duplicate grouping: SuperMinHash signatures, banding, verification on full sets, union-find.

1. One pass over the texts gives each row its set size, a 128-bit fingerprint of
   its shingle set, and band keys of its SuperMinHash signature.
2. Rows with equal sets form a class; only its smallest id goes on, so exact
   copies, however many, never meet as pairs.
3. Band buckets with several ids propose links: first each id with one centre of
   its buckets, then, between components that are still apart, with the centres of
   all its buckets, and last the pairs of a bucket that lie in different components,
   were not compared yet and pass a bound on what they can share.  A large group of
   near copies is connected by the first two steps, and texts that drifted too far
   from it fail the bound, so its pairs are never listed.
4. Links are confirmed on the full sets, after a bound on the set sizes; the
   connected components of confirmed links are the groups.

With 32 bands of 4 ranks a pair of similarity 0.75 shares a band with probability
1 - (1 - 0.75**4)**32 > 0.99999; a simulation of 400,000 pairs with 3 of 4 shingles
in common, the shortest at that limit, missed none.

Defined cases: a null or empty text has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle of its own; repeated ids are one
node with several sets; a row without id is a group of its own that is kept
(component_id null); an empty table gives an empty result; columns other than the
named ones play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut
from . import textblocks as tb
from .frames import components, map_arrow, narrow

U = np.uint64
WIDTH, RANKS, BANDS = 5, 128, 32
#: A fixed shuffle of the slots, taken between the affine steps of an element's permutation.
_SHUFFLE = np.random.default_rng(20240229).permutation(RANKS).astype(np.uint8)
#: Hash cells of the bound on shared shingles.
CELLS = 128
#: Links are confirmed at this percentage.
PERCENT = 75


def shingles(h: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and their n+1 offsets."""
    n = np.diff(offsets)
    all_ = tb.windows(h, width)
    at = tb.whole(offsets, width, len(all_)) if len(all_) else np.zeros(0, bool)
    doc = tb.owner(offsets)
    keys, owners = [all_[at]], [doc[: len(all_)][at]]
    for k in range(1, width):  # short documents: their whole sequence
        some = np.flatnonzero(n == k)
        if len(some):
            value = np.zeros(len(some), dtype=U)
            for t in range(k):
                value = value * U(tb._SEQ) + h[offsets[some] + t]
            keys.append(tb.mix(value ^ U(k << 40)))
            owners.append(some)
    key, own = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.searchsorted(own, np.arange(len(n) + 1))


def superminhash(key: np.ndarray, offsets: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """A signature of ``ranks`` values for each document (rows), from its distinct elements.

    Element e takes slot pi_e(j) with the value j + r_ej, r_ej uniform in [0, 1), for
    j = 0, 1, ...; a slot holds the least value it was offered.  pi_e is a permutation
    of the slots drawn for the element, so one element's values are spread over the
    integer parts: the ranks are correlated, and estimates vary less than MinHash's.
    A document stops as soon as its largest value is below the next j, when no later
    offer can change a slot.  ``ranks`` is a power of two up to 128.

    pi_e is two rounds of an affine step and a fixed shuffle, and a last affine step:
    2**39 draws, so slots that share a band are not tied to each other as they are
    in a single affine step.
    """
    docs = len(offsets) - 1
    sig = np.full(docs * ranks, np.iinfo(U).max, dtype=U)
    doc = tb.owner(offsets)
    row = doc * ranks
    seed = tb.mix(key ^ U(0xA0761D6478BD642F))
    low = np.uint8(ranks - 1)
    shuffle = _SHUFFLE[_SHUFFLE < ranks]
    # slots are counted in single bytes: ``ranks`` divides 256, so their overflow is harmless
    steps = [((seed >> U(k)).astype(np.uint8) & low | np.uint8(1), (seed >> U(k + 7)).astype(np.uint8) & low) for k in (0, 14, 28)]
    for j in range(ranks):
        slot = np.full(len(seed), j, dtype=np.uint8)
        for nth, (a, b) in enumerate(steps):
            slot = (a * (shuffle[slot] if nth else slot) + b) & low
        value = (tb.mix(seed + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U(8)) | (U(j) << U(56))
        np.minimum.at(sig, row + slot, value)
        if j > 7 and j % 4:  # looking whether documents can stop costs more than a few offers too many
            continue
        alive = (sig.reshape(docs, ranks).max(axis=1) >> U(56) > U(j))[doc]
        if not alive.any():
            break
        if not alive.all():
            doc, row, seed, steps = doc[alive], row[alive], seed[alive], [(a[alive], b[alive]) for a, b in steps]
    return sig.reshape(docs, ranks)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    docs, ranks = sig.shape
    rows = ranks // bands
    cells = sig.reshape(docs, bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xE7037ED1A0B428DB), (docs, bands)).copy()
    for r in range(rows):
        out = tb.mix(out ^ cells[:, :, r])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.raw(batch.column(1))
        for a, b in tb.runs(offsets):
            part = tb.LOWER[data[offsets[a] : offsets[b]]]
            h, _, _, word_at = tb.words(part, offsets[a : b + 1] - offsets[a], "space", False)
            key, at = shingles(h, word_at)
            n = np.diff(at)
            some = np.flatnonzero(n > 0)
            bands = np.zeros((b - a, BANDS), dtype=U)
            if len(some):
                bands[some] = band_keys(superminhash(key, np.append(at[:-1][some], at[-1])))
            sums = [np.append(U(0), np.cumsum(tb.mix(key ^ U(salt)))) for salt in (0x51ED270B, 0x2545F491)]
            f1, f2 = (s[at[1:]] - s[at[:-1]] for s in sums)
            width = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(tb.signed(f1)), pa.array(tb.signed(f2)), tb.lists(tb.signed(bands[some]).ravel(), np.append(0, np.cumsum(width)), pa.int64())],
                ["doc_id", "n", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tb.raw(batch.column(1))
        for a, b in tb.runs(offsets):
            part = tb.LOWER[data[offsets[a] : offsets[b]]]
            h, _, _, word_at = tb.words(part, offsets[a : b + 1] - offsets[a], "space", False)
            key, at = shingles(h, word_at)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), tb.lists(tb.signed(key), at, pa.int64())], ["doc_id", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: the first set travels to the second."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb")
    counted = both.select("a", "b", common.cast("long").alias("i"), whole.cast("long").alias("s"))
    return counted.filter(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select("a", "b")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    base = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    sketched = cut(map_arrow(base, _sketch, "doc_id long, n long, f1 long, f2 long, bands array<long>"))
    named = sketched.filter("doc_id is not null and n > 0")
    classes = named.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    several = cut(classes.filter("rep <> last").select("f1", "f2", "rep"))
    copies = named.select("doc_id", "f1", "f2").join(bounded(several), ["f1", "f2"])
    same = cut(copies.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    copied = same.select(F.col("a").alias("doc_id")).distinct()
    # an id whose sets are all copies of smaller ids' needs no candidates of its own; repeated ids keep theirs
    repeated = named.groupBy("doc_id").agg(F.count_distinct("f1", "f2").alias("sets")).filter("sets > 1").select("doc_id")
    leaders = named.join(bounded(copied.join(repeated, "doc_id", "left_anti"), 2_000_000), "doc_id", "left_anti")
    buckets = leaders.select("doc_id", "n", F.explode("bands").alias("bucket")).distinct()
    wide = buckets.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.max("doc_id").alias("high")).filter("low.doc_id <> high")
    members = cut(buckets.join(wide.select("bucket", F.col("low.doc_id").alias("centre"), F.col("low.n").alias("centre_n")), "bucket"))
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sets of other sizes can't be similar enough
    stars = cut(members.filter("doc_id <> centre").filter(near(F.col("n"), F.col("centre_n"))).select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct())

    wanted = bounded(cut(members.select("doc_id").distinct()))
    sets = map_arrow(base.join(wanted, "doc_id", "left_semi"), _sets, "doc_id long, shingles array<long>")

    first = stars.groupBy("a").agg(F.min("b").alias("b"))
    links = cut(_confirm(first, sets, percent))
    found = cut(components(links))
    apart = _between(stars.join(first, ["a", "b"], "left_anti"), found)
    links = links.union(cut(_confirm(apart, sets, percent)))
    found = cut(components(links))
    open_ = cut(_open_members(members, found))
    some = bounded(open_.select("doc_id").distinct())
    open_sets = cut(map_arrow(base.join(some, "doc_id", "left_semi"), _sets, "doc_id long, shingles array<long>"))
    rest = cut(_apart_in_buckets(open_, open_sets, percent).join(stars, ["a", "b"], "left_anti"))
    links = links.union(cut(_confirm(rest, open_sets, percent)))
    groups = components(links.union(same))
    joined = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(groups, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ids lie in different components."""
    a = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    tagged = pairs.join(a, "a", "left").join(b, "b", "left")
    return tagged.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, doc_id, n, c) of the buckets that still hold several components."""
    tagged = members.select("bucket", "doc_id", "n").join(found, F.col("doc_id") == F.col("id"), "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
    open_ = tagged.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo <> hi and size > 2").select("bucket")
    return tagged.join(open_, "bucket")


def _histograms(sets: DataFrame) -> DataFrame:
    """(id, h): per hash cell, how many shingles of a set stand in another of the sets too.  Ids with several sets get full cells."""
    flat = sets.select("doc_id", F.explode("shingles").alias("s"))
    lone = flat.groupBy("s").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).filter("k = 1")
    cell = F.pmod(F.xxhash64("s"), F.lit(CELLS)).cast("int").alias("g")
    counted = flat.select("doc_id", cell, F.lit(1).alias("v")).union(lone.select("doc_id", cell, F.lit(-1).alias("v"))).groupBy("doc_id", "g").agg(F.sum("v").cast("int").alias("v"))
    cells = counted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("g", "v"))).alias("cells"))
    several = sets.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("sets"))
    array = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda g: F.coalesce(F.try_element_at("cells", g), F.lit(0)))
    return several.join(cells, F.col("id") == F.col("doc_id"), "left").select("id", F.when(F.col("sets") > 1, F.array_repeat(F.lit(1 << 20), CELLS)).when(F.col("cells").isNotNull(), array).otherwise(F.array_repeat(F.lit(0), CELLS)).alias("h"))


def _apart_in_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that may be similar enough.

    Only shingles that several open members hold can be shared.  With m of them in a
    set, similarity needs (100 + percent) * min(m) >= percent * (n + k), and a member
    asks only the sizes k of its bucket for which that can hold: a text that has drifted
    too far from its group asks none, however large the group is.  A pair must also pass
    the bound with the sum over hash cells of the smaller count, which adds up what
    either text lacks.  Both are upper bounds of the intersection, so no link is lost.
    """
    known = members.join(_histograms(sets), F.col("doc_id") == F.col("id"), "left")
    known = cut(known.select("bucket", "doc_id", "n", "c", "h", F.aggregate("h", F.lit(0), lambda a, x: a + x).alias("m")))
    fits = lambda m, n, k: ((100 + percent) * m >= percent * (n + k)) & (100 * F.least(n, k) >= percent * F.greatest(n, k))
    sizes = known.groupBy("bucket", F.col("n").alias("k")).agg(F.max("m").alias("most"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    asked = known.join(sizes, "bucket").filter("c <> lo or c <> hi").filter(fits(F.least("m", "most"), F.col("n"), F.col("k"))).select("bucket", "k", F.col("doc_id").alias("a"), "n", "m", "c", "h")
    right = known.select(F.col("bucket").alias("in"), F.col("n").alias("bn"), F.col("doc_id").alias("b"), F.col("m").alias("bm"), F.col("c").alias("bc"), F.col("h").alias("bh"))
    both = F.aggregate(F.zip_with("h", "bh", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    apart = (F.col("a") > F.col("b")) & (F.col("c") != F.col("bc")) & fits(F.least("m", "bm"), F.col("n"), F.col("k"))
    pairs = asked.join(right, (F.col("bucket") == F.col("in")) & (F.col("k") == F.col("bn")) & apart & fits(both, F.col("n"), F.col("k")))
    return pairs.select("a", "b").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the group members that have a smaller one; a repeated id keeps one row.

    Rows without id stay.  Dropped ids are broadcast if they are few, else joined by shuffle.
    """
    out = cut(group(docs, id_col, text_col, percent).filter("not kept").select(F.col("doc_id").alias("__dropped")).distinct())
    left = docs.join(bounded(out), docs[id_col] == F.col("__dropped"), "left_anti")
    repeated = cut(left.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(F.col(id_col).alias("__again")))
    if repeated.isEmpty():
        return left
    once = left.join(bounded(repeated), left[id_col] == F.col("__again"), "left_anti")
    several = left.join(bounded(repeated), left[id_col] == F.col("__again"), "left_semi")
    one = several.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(text_col), F.xxhash64(*docs.columns))).alias("__row"))
    return once.unionByName(one.select("__row.*"))
