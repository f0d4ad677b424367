"""Recognised documents as JSON: schema, reading, validation and the canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators.layout import word_struct

SCHEMA = """
document_text string,
meta struct<schema:string,file:string,pages:int,engine:string,engine_version:string,lang:string,dpi:int,workers:int,coordinates:string>,
quality struct<avg:double,words:int,lines:int,low:int,very_low:int,suspicious:int,values:int,corrected:int,invalid:int,unverified:int>,
timing struct<setup:double,pages_wall:double,page_time_sum:double,ocr_sum:double,serialize:double,write:double,total:double>,
values array<struct<type:string,value:string,validation:struct<format:string,status:string,shape:boolean,checksum:boolean,strict:boolean>,page:int,bbox:array<double>,words:array<int>,raw:string,source_bbox:array<double>,confidence:double,corrections:array<string>,region:string>>,
pages array<struct<page:int,text_span:array<int>,order:string,pdf_size:array<double>,regions:array<struct<type:string,words:array<int>,bbox:array<double>>>,words:array<struct<t:string,c:double,b:array<double>,r:string,n:string,v:array<int>>>>>
"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: doc_id (the path) and the document's columns; ``errors`` says why a file can't be used."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("json"))
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    """``raw`` (doc_id, json) with the parsed columns and all ``errors``; nothing is thrown away."""
    variant = F.try_parse_json("json")
    parsed = raw.withColumn("d", F.from_json("json", SCHEMA)).withColumn("v", variant)
    shape = F.array(F.when(F.col("v").isNull(), F.lit("$: not JSON")), F.when(F.schema_of_variant("v").startswith("OBJECT") == F.lit(False), F.lit("$: not an object")))
    typed = lambda p, kind: F.schema_of_variant(F.try_variant_get("v", p, "variant")).startswith(kind)
    fields = F.array(
        F.when(~F.coalesce(typed("$.document_text", "STRING"), F.lit(False)), F.lit("$.document_text: a string is needed")),
        F.when(~F.coalesce(typed("$.pages", "ARRAY"), F.lit(False)), F.lit("$.pages: an array is needed")),
        *[F.when(~F.coalesce(typed(f"$.{k}", "OBJECT"), F.lit(True)), F.lit(f"$.{k}: not an object")) for k in ("meta", "quality", "timing")],
    )
    errors = F.when(F.col("v").isNull(), shape).otherwise(F.concat(fields, validate(F.col("d"))))
    return parsed.withColumn("errors", F.filter(errors, lambda e: e.isNotNull())).select("doc_id", "d.*", "errors")


def _box_error(b: Column, path: Column, needed: bool = True) -> Column:
    bad = (F.size(b) != 4) | F.exists(b, lambda x: x.isNull()) | (F.get(b, F.lit(0)) > F.get(b, F.lit(2))) | (F.get(b, F.lit(1)) > F.get(b, F.lit(3)))
    return F.when(b.isNull(), F.concat(path, F.lit(": missing")) if needed else F.lit(None).cast("string")).when(bad, F.concat(path, F.lit(": four ordered numbers are needed")))


def _say(bad: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.concat(path, F.lit(f": {message}")))


def validate(d: Column) -> Column:
    """Every fault of a parsed document as ``path: message``; null entries stand for checks that hold."""
    pages, values = F.coalesce(d["pages"], F.array().cast("array<struct<page:int,text_span:array<int>,order:string,pdf_size:array<double>,regions:array<struct<type:string,words:array<int>,bbox:array<double>>>,words:array<struct<t:string,c:double,b:array<double>,r:string,n:string,v:array<int>>>>>")), d["values"]
    n_values = F.coalesce(F.size(values), F.lit(0))
    n_values = F.greatest(n_values, F.lit(0))

    def of_word(path: Column, w: Column, i: Column) -> Column:
        at = F.concat(path, F.lit(".words["), i, F.lit("]"))
        refs = F.coalesce(w["v"], F.array().cast("array<int>"))
        return F.array(
            _say(F.btrim(w["t"]) == "", F.concat(at, F.lit(".t")), "blank"), _say(~w["c"].between(0, 1), F.concat(at, F.lit(".c")), "not between 0 and 1"), _box_error(w["b"], F.concat(at, F.lit(".b"))),
            F.when(F.exists(refs, lambda r: r.isNull() | (r < 0) | (r >= n_values)), F.concat(at, F.lit(".v: no such value"))),
        )

    def of_region(path: Column, r: Column, i: Column, n: Column) -> Column:
        at = F.concat(path, F.lit(".regions["), i, F.lit("]"))
        a, b = F.get(r["words"], F.lit(0)), F.get(r["words"], F.lit(1))
        return F.array(_say(F.btrim(r["type"]) == "", F.concat(at, F.lit(".type")), "blank"), _say((F.size(r["words"]) != 2) | (a < 0) | (a > b) | (b > n), F.concat(at, F.lit(".words")), "not a range of the page's words"), _box_error(r["bbox"], F.concat(at, F.lit(".bbox")), needed=False))

    def of_page(p: Column, i: Column) -> Column:
        path = F.concat(F.lit("$.pages["), i, F.lit("]"))
        n = F.greatest(F.coalesce(F.size(p["words"]), F.lit(0)), F.lit(0))
        words = F.flatten(F.transform(F.coalesce(p["words"], F.array().cast("array<struct<t:string,c:double,b:array<double>,r:string,n:string,v:array<int>>>")), lambda w, k: of_word(path, w, k)))
        areas = F.flatten(F.transform(F.coalesce(p["regions"], F.array().cast("array<struct<type:string,words:array<int>,bbox:array<double>>>")), lambda r, k: of_region(path, r, k, n)))
        return F.concat(F.array(_say(p["page"] != i + 1, F.concat(path, F.lit(".page")), "pages are numbered from 1 without gaps")), words, areas)

    def of_value(v: Column, i: Column) -> Column:
        at = F.concat(F.lit("$.values["), i, F.lit("]"))
        n = F.greatest(F.coalesce(F.size(F.get(pages, v["page"] - 1)["words"]), F.lit(-1)), F.lit(-1))
        return F.array(
            _say(F.btrim(v["type"]) == "", F.concat(at, F.lit(".type")), "blank"), _say(F.btrim(v["value"]) == "", F.concat(at, F.lit(".value")), "blank"), _say(n < 0, F.concat(at, F.lit(".page")), "no such page"), _box_error(v["bbox"], F.concat(at, F.lit(".bbox"))),
            F.when(F.exists(F.coalesce(v["words"], F.array().cast("array<int>")), lambda w: w.isNull() | (w < 0) | (w >= n)), F.concat(at, F.lit(".words: no such word"))), F.when(~v["confidence"].between(0, 1), F.concat(at, F.lit(".confidence: not between 0 and 1"))),
        )

    none = F.array().cast("array<string>")
    checks = F.concat(F.array(F.when(F.size(pages) == 0, F.lit("$.pages: empty"))), F.flatten(F.transform(pages, of_page)), F.when(values.isNotNull(), F.flatten(F.transform(values, of_value))).otherwise(none))
    return F.filter(checks, lambda e: e.isNotNull())


def good(documents: DataFrame) -> DataFrame:
    return documents.filter(F.size("errors") == 0)


def quarantined(documents: DataFrame) -> DataFrame:
    return documents.filter(F.size("errors") > 0).select("doc_id", "errors")


def region_of(regions: Column, index: Column) -> Column:
    """Type of the smallest region that holds a word's index; of equals the first; null for none."""
    held = F.filter(F.transform(regions, lambda r, i: F.struct((F.get(r["words"], F.lit(1)) - F.get(r["words"], F.lit(0))).alias("n"), i.alias("i"), r["type"].alias("type"), F.get(r["words"], F.lit(0)).alias("a"), F.get(r["words"], F.lit(1)).alias("b"))), lambda r: (index >= r["a"]) & (index < r["b"]))
    return F.array_min(held)["type"]


def words(documents: DataFrame) -> DataFrame:
    """(doc_id, page, region, word) of usable documents, recognised values standing in their words; no shuffle."""
    pages = good(documents).select("doc_id", "values", F.explode("pages").alias("p"))
    flat = pages.select("doc_id", "values", F.col("p.page").alias("page"), F.col("p.regions").alias("regions"), F.posexplode("p.words").alias("i", "w"))
    named = F.transform(F.coalesce("w.v", F.array().cast("array<int>")), lambda r: F.struct(F.get("values", r)["type"].alias("type"), F.get("values", r)["value"].alias("value")))
    return flat.select("doc_id", "page", region_of(F.col("regions"), F.col("i")).alias("region"), word_struct(F.col("i"), F.col("w.t"), F.col("w.n"), F.col("w.c"), geometry.from_array(F.col("w.b")), named).alias("word"))


def counts(documents: DataFrame) -> DataFrame:
    """(doc_id, pages, words, regions, values) of parsed documents; no shuffle."""
    total = lambda part: F.aggregate("pages", F.lit(0), lambda a, p: a + F.coalesce(F.greatest(F.size(p[part]), F.lit(0)), F.lit(0)))
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return documents.select("doc_id", n("pages").alias("pages"), F.coalesce(total("words"), F.lit(0)).alias("words"), F.coalesce(total("regions"), F.lit(0)).alias("regions"), n("values").alias("values"))


def values_of_words(documents: DataFrame) -> DataFrame:
    """(doc_id, page, i, value_index, type, value): the values that each word refers to; no shuffle."""
    flat = documents.select("doc_id", "values", F.explode("pages").alias("p")).select("doc_id", "values", F.col("p.page").alias("page"), F.posexplode("p.words").alias("i", "w"))
    named = flat.select("doc_id", "values", "page", "i", F.explode("w.v").alias("value_index"))
    return named.select("doc_id", "page", "i", "value_index", F.get("values", F.col("value_index"))["type"].alias("type"), F.get("values", F.col("value_index"))["value"].alias("value"))


def words_of_values(documents: DataFrame) -> DataFrame:
    """(doc_id, value_index, type, value, page, i, t): the words that each value names, in its order; no shuffle."""
    flat = documents.select("doc_id", "pages", F.posexplode("values").alias("value_index", "x"))
    named = flat.select("doc_id", "pages", "value_index", "x", F.explode("x.words").alias("i"))
    word = F.get(F.get("pages", F.col("x.page") - 1)["words"], F.col("i"))
    return named.select("doc_id", "value_index", "x.type", "x.value", "x.page", "i", word["t"].alias("t"))


def words_in_region(documents: DataFrame, kind: str) -> DataFrame:
    """(doc_id, page, i, t): words of each page's first region of the type, whatever its case; no shuffle."""
    pages = documents.select("doc_id", F.explode("pages").alias("p"))
    first = F.get(F.filter("p.regions", lambda r: F.lower(r["type"]) == kind.lower()), F.lit(0))
    held = pages.withColumn("r", first).filter("r is not null")
    a, b = F.get("r.words", F.lit(0)), F.get("r.words", F.lit(1))
    flat = held.select("doc_id", F.col("p.page").alias("page"), a.alias("a"), F.posexplode(F.slice("p.words", a + 1, F.greatest(b - a, F.lit(0)))).alias("at", "w"))
    return flat.select("doc_id", "page", (F.col("a") + F.col("at")).alias("i"), "w.t")


#: Types that an upload may state.
MIME_TYPES = ("application/pdf", "application/octet-stream")


def uploads(files: DataFrame, max_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """``files`` (path, length, content, and content_type if known) with a safe name and the code of what is wrong with an upload, null if nothing is.

    One file's fault says nothing about the others; no type stated is no fault.
    """
    from ..functions.text import safe_file_name

    name = safe_file_name(F.col("path"))
    stated = F.lower(F.btrim(F.substring_index("content_type", ";", 1))) if "content_type" in files.columns else F.lit("")
    code = F.when(~F.lower("path").endswith(".pdf"), "UNSUPPORTED_FORMAT").when((stated != "") & ~stated.isin(*MIME_TYPES), "INVALID_MIME_TYPE").when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > max_bytes, "FILE_TOO_LARGE").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "INVALID_PDF")
    return files.select("path", name.alias("file_name"), "length", code.alias("error_code"))


def too_many(files: DataFrame, most: int = 10) -> DataFrame:
    """(job_id, files): the uploads (job_id, ...) that hold more files than one may."""
    return files.groupBy("job_id").agg(F.count("*").alias("files")).filter(F.col("files") > most)
