"""From recognised boxes to pages: lines, columns, regions, document text, and bank values with their places."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, recognition
from ..functions.text import folded
from ..runtime import ship

MIDDLE, LEAST_GAP, LEAST_WORDS = 0.5, 0.035, 6
#: Headings above two columns of party details.
HEADINGS = ("реквизиты сторон", "адреса и реквизиты", "реквизиты и подписи", "банковские реквизиты", "подписи сторон")
_VALUE = r"[a-zа-яё0-9$§@€£|!®©._/-]"
#: Kinds of bank values, the pattern in front of them, and the lengths they may have, in the order of search.
VALUE_PATTERNS = (("bin", r"(?:б\s*[иі]\s*н|b\s*i\s*n|b\s*ин)", 8, 24), ("inn", r"(?:инн|inn)", 8, 24), ("okpo", r"(?:окпо|okpo)", 6, 16), ("bic_swift", r"(?:бик\s*/\s*swift|bic\s*/\s*swift|swift)", 6, 15), ("bik", r"(?:бик|bic)", 5, 15), ("account", r"(?:р\s*/\s*с(?:чет)?|расч[её]тный\s+сч[её]т|сч[её]т|account|iban)", 6, 40))


def lines_of_blocks(words: DataFrame) -> DataFrame:
    """Lines from (doc_id, page, block, par, line, n, text, confidence, box): words by (x1, n), lines by (y1, x1)."""
    grouped = words.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct(F.col("box.x1").alias("x"), "n", "text", "confidence", "box"))).alias("words"))
    boxed = grouped.withColumn("box", geometry.union_all(F.transform("words", lambda w: w["box"]))).withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))
    order = Window.partitionBy("doc_id", "page").orderBy("box.y1", "box.x1", "block", "par", "line")
    return boxed.withColumn("nth", F.row_number().over(order)).withColumn("line_id", F.concat(F.lit("p"), "page", F.lit("_l"), "nth"))


def column_split(words: Column, page_width: Column) -> Column:
    """How a line's words lie to the page's middle: split, full_width, left, right or empty."""
    centre = lambda w: geometry.center_x(w["box"])
    left, right = F.filter(words, lambda w: centre(w) < page_width * MIDDLE), F.filter(words, lambda w: centre(w) >= page_width * MIDDLE)
    gap = F.array_min(F.transform(right, lambda w: w["box"]["x1"])) - F.array_max(F.transform(left, lambda w: w["box"]["x2"]))
    return F.when(F.size(words) == 0, "empty").when(F.size(right) == 0, "left").when(F.size(left) == 0, "right").when(gap >= page_width * LEAST_GAP, "split").otherwise("full_width")


def page_layout(lines: DataFrame) -> DataFrame:
    """Adds ``split`` and ``region``: body, or before_columns, left_column, right_column and after_columns below a heading.

    ``lines`` have doc_id, page, nth, text, words and page_width.  The first full-width
    line after both columns hold at least six words starts the suffix.
    """
    whole = Window.partitionBy("doc_id", "page")
    before = whole.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.lit(False)
    for h in HEADINGS:
        heading = heading | folded(F.col("text")).contains(h)
    marked = lines.withColumn("split", column_split(F.col("words"), F.col("page_width"))).withColumn("head", F.min(F.when(heading, F.col("nth"))).over(whole))
    after = F.col("nth") > F.col("head")
    centre = lambda w: geometry.center_x(w["box"])
    n_left = F.when(after & F.col("split").isin("left", "split"), F.size(F.filter("words", lambda w: centre(w) < F.col("page_width") * MIDDLE))).otherwise(0)
    n_right = F.when(after & F.col("split").isin("right", "split"), F.size(F.filter("words", lambda w: centre(w) >= F.col("page_width") * MIDDLE))).otherwise(0)
    counted = marked.withColumn("l", F.coalesce(F.sum(n_left).over(before), F.lit(0))).withColumn("r", F.coalesce(F.sum(n_right).over(before), F.lit(0)))
    suffix = F.min(F.when(after & (F.col("split") == "full_width") & (F.col("l") >= LEAST_WORDS) & (F.col("r") >= LEAST_WORDS), F.col("nth"))).over(whole)
    total = counted.withColumn("suffix", suffix).withColumn("tl", F.sum(n_left).over(whole)).withColumn("tr", F.sum(n_right).over(whole))
    columns = F.col("head").isNotNull() & (F.col("tl") >= LEAST_WORDS) & (F.col("tr") >= LEAST_WORDS)
    region = F.when(~columns, "body").when(F.col("nth") <= F.col("head"), "before_columns").when(F.col("nth") >= F.col("suffix"), "after_columns").when(F.col("split") == "full_width", "before_columns").when(F.col("split") == "split", "both_columns").otherwise(F.concat("split", F.lit("_column")))
    return total.withColumn("region", F.coalesce(region, F.lit("body"))).drop("head", "l", "r", "suffix", "tl", "tr")


def regions(lines: DataFrame) -> DataFrame:
    """Fragments joined to regions: text by line, box; a line that is split gives a fragment to either column."""
    centre = lambda w: geometry.center_x(w["box"])
    part = lambda keep, name: F.struct(F.lit(name).alias("region"), F.filter("words", keep).alias("words"))
    halves = F.array(part(lambda w: centre(w) < F.col("page_width") * MIDDLE, "left_column"), part(lambda w: centre(w) >= F.col("page_width") * MIDDLE, "right_column"))
    whole = F.array(F.struct(F.col("region").alias("region"), F.col("words").alias("words")))
    flat = lines.select("doc_id", "page", "nth", F.inline(F.when(F.col("region") == "both_columns", halves).otherwise(whole)))
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    shaped = flat.select("doc_id", "page", "region", F.struct("nth", text.alias("text"), geometry.union_all(F.transform("words", lambda w: w["box"])).alias("box"), F.size("words").alias("n")).alias("f"))
    grouped = shaped.groupBy("doc_id", "page", "region").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return grouped.select("doc_id", "page", "region", F.array_join(F.transform("f", lambda x: x["text"]), "\n").alias("text"), geometry.union_all(F.transform("f", lambda x: x["box"])).alias("box"), F.aggregate("f", F.lit(0), lambda a, x: a + x["n"]).alias("words"))


def text_spans(pages: DataFrame) -> DataFrame:
    """Where each page's text stands in the document's text, pages being joined by an empty line."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", start + F.length("text"))


def scan_values(texts: DataFrame) -> DataFrame:
    """Bank values in texts (doc_id, page, text): (doc_id, page, type, start, end, raw, value, format, format_valid, corrections).

    A value that overlaps one of an earlier pattern is left out, and one of which
    nothing is left when it is put right does not count.  Spans of groups are needed,
    which the built-in functions do not give, so this is an Arrow-batched map.
    """
    ship(texts.sparkSession)
    patterns = [(kind, re.compile(rf"(?i)(?<![\w]){front}\s*[:№#-]?\s*({_VALUE}{{{low},{high}}})")) for kind, front, low, high in VALUE_PATTERNS]
    numeric = re.compile(rf"[0-9{re.escape(recognition.DIGIT_LOOKALIKES[0])}]")
    letters = re.compile(rf"[0-9A-Za-z{re.escape(recognition.SIGNS[0])}{recognition.LOOKALIKES[0]}]")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc_id, page, text in pdf.itertuples(index=False):
                taken: list[tuple[int, int]] = []
                for kind, pattern in patterns:
                    for m in pattern.finditer(text or ""):
                        a, b = m.span(1)
                        raw = m.group(1).strip(".,;:()[]{}")
                        holds = numeric if kind in ("bin", "inn", "okpo") else letters
                        if holds.search(unicodedata.normalize("NFKC", raw)) and not any(a < y and x < b for x, y in taken):
                            taken.append((a, b))
                            rows.append((doc_id, page, kind, a, b, raw))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "type", "start", "end", "raw"])

    kind = dict(texts.dtypes)["doc_id"]
    found = texts.select("doc_id", "page", "text").mapInPandas(run, f"doc_id {kind}, page int, type string, start int, end int, raw string")
    return found.withColumn("x", recognition.bank_value(F.col("type"), F.col("raw"))).select("doc_id", "page", "type", "start", "end", "raw", "x.value", "x.format", "x.format_valid", "x.corrections")


def first_values(values: DataFrame) -> DataFrame:
    """One row per document, page, type and value: the first place."""
    order = Window.partitionBy("doc_id", "page", "type", "value").orderBy("start", "end")
    return values.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def linked_words(values: DataFrame, words: DataFrame, most: int = 8) -> DataFrame:
    """``values`` with ``word_ids``: the first run of a page's words (doc_id, page, i, t) whose identifiers, joined, are the value's; words without one are passed over."""
    coded = words.withColumn("code", recognition.compact(F.col("t"))).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("i", "code"))).alias("ws"))
    target = recognition.compact(F.col("raw"))

    def at(s: Column) -> Column:
        some = F.filter(F.slice("ws", s, F.lit(most)), lambda w: w["code"] != "")
        ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(some), F.lit(1))), lambda k: F.array_join(F.transform(F.slice(some, F.lit(1), k), lambda w: w["code"]), "") == F.col("target"))
        return F.when(F.size(ends) > 0, F.transform(F.slice(some, F.lit(1), F.get(ends, F.lit(0))), lambda w: w["i"]))

    joined = values.withColumn("target", target).join(coded, ["doc_id", "page"], "left")
    none = F.array().cast("array<int>")
    found = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.size("ws")), at), lambda x: x.isNotNull()), F.lit(0))
    return joined.withColumn("word_ids", F.when((F.col("target") != "") & (F.size("ws") > 0), F.coalesce(found.cast("array<int>"), none)).otherwise(none)).drop("ws", "target")


def with_values(texts: DataFrame, values: DataFrame) -> DataFrame:
    """``texts`` (doc_id, page, text) with ``normal``: the values put right in place, from right to left, then the text's normal form."""
    some = values.groupBy("doc_id", "page").agg(F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", F.lower("value").alias("v"))))).alias("vs"))
    put = lambda t, x: F.concat(t.substr(F.lit(1), x["start"]), x["v"], t.substr(x["end"] + 1, F.length(t)))
    replaced = texts.join(some, ["doc_id", "page"], "left").withColumn("put", F.when(F.col("vs").isNull(), F.col("text")).otherwise(F.aggregate("vs", F.col("text"), put)))
    return replaced.withColumn("normal", recognition.normal_text(F.col("put"))).drop("vs", "put")


def reordered(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, words, regions) with words in the order of their regions.

    ``words`` are structs with an id, ``regions`` structs of type and word_ids.  A word
    that several regions name belongs to the first, ids without a word are passed over,
    and words outside all regions come last.  Gives words, regions as (type, start, end)
    of the new order, and word_index (id to place); no shuffle.
    """
    ids = F.transform("words", lambda w: w["id"])

    def take(got: Column, r: Column) -> Column:
        fresh = F.array_except(F.array_intersect(r["word_ids"], F.col("known")), got["ids"])
        span = F.struct(r["type"].alias("type"), F.size(got["ids"]).alias("start"), (F.size(got["ids"]) + F.size(fresh)).alias("end"))
        return F.struct(F.concat(got["ids"], fresh).alias("ids"), F.concat(got["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<struct<type:string,start:int,end:int>>").alias("spans"))
    taken = pages.withColumn("known", ids).withColumn("got", F.aggregate("regions", start, take))
    ordered = taken.withColumn("order", F.concat("got.ids", F.array_except("known", "got.ids")))
    words = F.transform("order", lambda k: F.get(F.col("words"), F.array_position("known", k).cast("int") - 1))
    index = F.map_from_entries(F.transform("order", lambda k, i: F.struct(k, i)))
    return ordered.select("doc_id", "page", words.alias("words"), F.col("got.spans").alias("regions"), index.alias("word_index"))


def global_values(pages: DataFrame) -> DataFrame:
    """Values of pages (doc_id, page, values) with their place in the whole document: (doc_id, page, place, index, value)."""
    sized = pages.withColumn("before", F.coalesce(F.sum(F.size("values")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    flat = sized.select("doc_id", "page", "before", F.posexplode("values").alias("place", "value"))
    return flat.select("doc_id", "page", "place", (F.col("before") + F.col("place")).cast("int").alias("index"), "value")
