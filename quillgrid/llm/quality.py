"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Each rule is a score that grows as a text gets worse.  For every stratum (by
default the language) labelled good documents are counted per score bucket, and
cutoffs are tested from the most lenient to the strictest: a cutoff is certified
if the exact binomial test rejects "it rejects more than ``alpha`` / rules of the
good documents" at level ``delta`` / (rules x strata), and testing stops at the
first that fails (fixed-sequence testing; Bonferroni over rules and strata).
Among certified cutoffs the one that rejects most bad documents wins, where a
good one counts ``GOOD_WEIGHT`` times.  A stratum with too few labels to certify
anything rejects nothing beyond the base rules.

Defined cases: a null or empty text has no words and fails the base rules; a null
stratum is a stratum of its own; labels that are null, or of documents that don't
exist, are ignored, several labels of one document count as their minimum; an
empty table gives an empty result; repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, cut
from .frames import narrow

#: Share of good documents that all rules together may reject, and the chance that this fails.
ALPHA, DELTA = 0.02, 0.05
#: Weight of a rejected good document against a rejected bad one.
GOOD_WEIGHT = 10
#: Score, width of a bucket, number of buckets.
RULES: dict[str, tuple[str, float, int]] = {
    "symbols": ("n_symbols / n_words", 0.05, 40),
    "dup_lines": ("n_dup_lines / n_lines", 0.025, 40),
    "repeats": ("n_repeat_words / n_words", 0.025, 40),
    "long_words": ("word_chars / n_words - 4", 0.5, 60),
    "short_words": ("4 - word_chars / n_words", 0.1, 40),
    "capitals": ("n_capitals / word_chars", 0.025, 40),
}
_SPACE = r"[\x20\x09-\x0D]"
#: Terms of the binomial tail that are summed one by one; a geometric series bounds the rest from above.
_TERMS = 512


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: repeated windows found by sorting their hashes."""
    triples = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1)))

    def covered(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return let(ordered, lambda s: F.size(F.array_distinct(F.flatten(F.transform(same(s), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(triples(h), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), 0).otherwise(covered(t))))
    return F.when(F.size(words) < 3, 0).otherwise(found)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: id, stratum, text key, and the counts that rules use; no shuffle."""
    named = {"doc_id": id_col, "text": text_col} | ({"stratum": stratum_col} if stratum_col else {})
    base = narrow(docs, **named).withColumn("stratum", F.coalesce(F.col("stratum").cast("string"), F.lit("")) if stratum_col else F.lit(""))
    text = F.coalesce("text", F.lit(""))
    split = base.select("doc_id", "stratum", F.xxhash64("text").alias("text_key"), text.alias("t"), F.array_remove(F.split(text, f"{_SPACE}+"), "").alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    long = lambda c: c.cast("long")
    return split.select(
        "doc_id", "stratum", "text_key",
        long(F.size("w")).alias("n_words"),
        long(F.length(F.array_join("w", ""))).alias("word_chars"),
        long(F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(_repeated_words(F.col("w"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_capitals"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def buckets() -> Column:
    """Map from rule to score bucket; a score that isn't defined counts as 0."""
    out = []
    for name, (score, width, n) in RULES.items():
        safe = score
        for part in ("n_words", "n_lines", "word_chars"):
            safe = safe.replace(f"/ {part}", f"/ nullif({part}, 0)")
        out += [F.lit(name), F.expr(f"cast(least(greatest(floor(coalesce({safe}, 0) / {width}), 0), {n}) as int)")]
    return F.create_map(*out)


def _lgamma(x: Column) -> Column:
    """ln gamma for x >= 1: Stirling's series at x + 8, shifted back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed downwards from k; never below the true value; 1 where k >= n p."""
    k, n = k.cast("double"), n.cast("double")
    top = _lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    step = lambda i: i / (n - i + 1) * ((1 - p) / p)
    start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"), k.alias("i"))

    def add(a: Column, _: Column) -> Column:
        t = a["t"] * step(a["i"])
        return F.struct((a["s"] + t).alias("s"), t.alias("t"), F.greatest(a["i"] - 1, F.lit(0.0)).alias("i"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, add, lambda a: a["s"] + a["t"] * step(a["i"]) / (1 - step(a["i"])))
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum that has a certified cutoff: stratum, map from rule to the lowest bucket that is rejected."""
    truth = narrow(labels, label_id=id_col, quality=quality_col).filter("label_id is not null and quality is not null").groupBy("label_id").agg(F.min("quality").alias("quality"))
    held = measured.filter("not base_failed").join(truth, F.col("doc_id") == F.col("label_id")).select("stratum", (F.col("quality") > 0).alias("good"), F.explode(buckets()).alias("rule", "bucket"))
    cells = cut(held.groupBy("stratum", "rule", "bucket").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")))
    strict = Window.partitionBy("stratum", "rule").orderBy(F.desc("bucket"))
    group = Window.partitionBy("stratum", "rule")
    strata = max(1, cells.select("stratum").distinct().count())
    tested = cells.select("*", F.sum("good").over(strict).alias("k"), F.sum("bad").over(strict).alias("hits"), F.sum("good").over(group).alias("n"))
    level = delta / (len(RULES) * strata)
    tested = tested.withColumn("fails", (binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) > level).cast("int"))
    certified = tested.withColumn("failed", F.max("fails").over(strict)).filter("failed = 0 and bucket > 0 and hits > 0").withColumn("gain", F.col("hits") - GOOD_WEIGHT * F.col("k")).filter("gain > 0")
    best = certified.groupBy("stratum", "rule").agg(F.max_by("bucket", F.struct("gain", "bucket")).alias("bucket"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "bucket"))).alias("cut"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures with ``base_failed``, ``rejected_by`` (array of rule names) and ``kept``, one row per row of ``docs``."""
    measured = cut(measures(docs, id_col, text_col, stratum_col))
    chosen = bounded(cutoffs(measured, labels, alpha=alpha, delta=delta).withColumnRenamed("stratum", "of"), 100_000)
    judged = measured.join(chosen, F.col("stratum") == F.col("of"), "left").withColumn("b", buckets())
    broken = F.filter(F.array(*[F.lit(r) for r in RULES]), lambda r: F.coalesce(F.element_at("b", r) >= F.element_at("cut", r), F.lit(False)))
    return judged.withColumn("rejected_by", broken).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("b", "cut", "of")


def keep_good(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep.

    The rejected rows' keys (id and text hash) are broadcast if they are few, else joined by shuffle.
    """
    id_col, text_col = names.get("id_col", "doc_id"), names.get("text_col", "text")
    out = judge(docs, labels, **names).filter("not kept").select(F.col("doc_id").alias("__rejected_id"), F.col("text_key").alias("__rejected_key")).distinct()
    return docs.join(bounded(cut(out)), docs[id_col].eqNullSafe(F.col("__rejected_id")) & (F.xxhash64(docs[text_col]) == F.col("__rejected_key")), "left_anti")
