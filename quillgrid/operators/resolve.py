"""Duplicates and conflicts among candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, text
from ..runtime import ship

WORD_SHARE, BOX_SHARE, MARGIN = 0.60, 0.65, 0.08
#: Types of which an overlapping group can hold only one.
EXCLUSIVE = (("bin", "iin", "inn"), ("iban", "bank_account"), ("bik", "bic_swift"), ("organization", "bank_name"))
_GOOD = ("valid", "shape_valid", "dictionary_match", "context_match")


def quality() -> Column:
    """Confidence, confirmation, validation and size, compared in this order."""
    return F.struct("confidence", F.col("ocr_confirmed").cast("int"), F.coalesce(F.col("validation")["status"].isin(*_GOOD), F.lit(False)).cast("int"), F.size("word_ids"))


def exact_duplicates(candidates: DataFrame) -> DataFrame:
    """Adds ``copy``: every candidate after the best of its type, value, page and words; ties go to the earlier one."""
    key = ("doc_id", "entity_type", text.dedup_key(F.col("value")), "page", F.array_sort("word_ids"))
    best = Window.partitionBy(*key).orderBy(quality().desc(), "ordinal")
    return candidates.withColumn("copy", F.row_number().over(best) > 1)


def _bits(ids: Column) -> Column:
    """64 bits in which some words leave their marks: two sets without a common mark have no common word."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def overlaps(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a["word_ids"], b["word_ids"])) / F.least(F.size(a["word_ids"]), F.size(b["word_ids"]))
    return (a["bits"].bitwiseAND(b["bits"]) != 0) & (shared >= WORD_SHARE) | (geometry.iou(a["bbox"], b["bbox"]) >= BOX_SHARE)


def components(candidates: DataFrame) -> DataFrame:
    """Adds ``component``: the smallest ordinal of a page's candidates that overlap directly or through others.

    Pairs meet by an equi-join on (document, page); only pages that have an overlapping
    pair go through the grouped union-find, and a page bounds its group.
    """
    ship(candidates.sparkSession)
    slim = candidates.select("doc_id", "page", F.struct("ordinal", "word_ids", "bbox", _bits(F.col("word_ids")).alias("bits")).alias("x"))
    pairs = slim.join(slim.withColumnRenamed("x", "y"), ["doc_id", "page"]).filter("x.ordinal < y.ordinal").filter(overlaps(F.col("x"), F.col("y"))).select("doc_id", "page", F.col("x.ordinal").alias("a"), F.col("y.ordinal").alias("b"))
    kind = dict(candidates.dtypes)["doc_id"]

    def of_page(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pdf[["a", "b"]].itertuples(index=False):
            x, y = find(int(a)), find(int(b))
            parent[max(x, y)] = min(x, y)
        return pd.DataFrame([(key[0], x, find(x)) for x in parent], columns=["d", "o", "component"])

    found = pairs.groupBy("doc_id", "page").applyInPandas(of_page, f"d {kind}, o int, component int")
    joined = candidates.join(found, (F.col("doc_id") == F.col("d")) & (F.col("ordinal") == F.col("o")), "left")
    return joined.withColumn("component", F.coalesce("component", "ordinal")).drop("d", "o")


def _rivals(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for group in EXCLUSIVE:
        out = out | a.isin(*group) & b.isin(*group) & (a != b)
    return out


def resolve(candidates: DataFrame, keep_ambiguous: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, rejected candidates and issues."""
    marked = exact_duplicates(candidates)
    grouped = components(marked.filter("not copy"))
    whole = Window.partitionBy("doc_id", "component")
    ranked = Window.partitionBy("doc_id", "component").orderBy(quality().desc(), "ordinal")
    by_confidence = F.reverse(F.array_sort(F.collect_list("confidence").over(whole)))
    judged = grouped.withColumn("rank", F.row_number().over(ranked)).withColumn("size", F.count("*").over(whole)).withColumn("types", F.collect_set("entity_type").over(whole))
    judged = judged.withColumn("best", F.max(F.when(F.col("rank") == 1, F.col("entity_type"))).over(whole)).withColumn("margin", F.get(by_confidence, F.lit(0)) - F.get(by_confidence, F.lit(1)))
    clash = F.lit(False)
    for group in EXCLUSIVE:
        clash = clash | (F.size(F.array_intersect("types", F.array(*map(F.lit, group)))) > 1)
    case = F.when(F.col("size") == 1, "single").when(F.size("types") == 1, "same_type").when(~clash, "compatible").when(F.col("margin") >= MARGIN, "conflict_resolved_by_confidence").otherwise("ambiguous_entity_type")
    judged = judged.withColumn("case", case)
    first = F.col("rank") == 1
    kept = F.when(F.col("case").isin("single", "compatible"), True).when(F.col("case") == "same_type", first).when(F.col("case") == "conflict_resolved_by_confidence", ~_rivals(F.col("entity_type"), F.col("best"))).otherwise(F.lit(keep_ambiguous) | first)
    judged = judged.withColumn("kept", kept)
    extra = ("copy", "component", "rank", "size", "types", "best", "margin", "case", "kept")
    entities = judged.filter("kept").drop(*extra)
    rejected = judged.filter("not kept").drop(*extra).unionByName(marked.filter("copy").drop("copy"))
    issues = judged.filter(F.col("case").isin("conflict_resolved_by_confidence", "ambiguous_entity_type")).groupBy("doc_id", "component", F.col("case").alias("code")).agg(F.array_sort(F.collect_list("id")).alias("candidate_ids")).drop("component")
    return entities, rejected, issues
