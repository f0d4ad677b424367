"""Searches over words and lines of a page.

Words: (doc_id, page, region, line_id, word).  Lines: as layout makes them.  Searches
join on (document, page), so a page bounds every product; limits are ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry


def check(limit: int | None = None, distance: float | None = None) -> None:
    if limit is not None and limit < 0:
        raise ValueError("a limit can't be negative")
    if distance is not None and distance < 0:
        raise ValueError("a distance can't be negative")


def explode_words(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", "page", "region", "line_id", "line_index", F.explode("words").alias("word"))


def index_errors(lines: DataFrame) -> DataFrame:
    """Words that stand in several lines, and line ids given twice: (doc_id, page, kind, id, n)."""
    words = explode_words(lines).groupBy("doc_id", "page", F.lit("word").alias("kind"), F.concat(F.lit("p"), "page", F.lit("-w"), "word.i").alias("id")).agg(F.count("*").alias("n"))
    ids = lines.groupBy("doc_id", "page", F.lit("line").alias("kind"), F.col("line_id").alias("id")).agg(F.count("*").alias("n"))
    return words.unionByName(ids).filter("n > 1")


def get_words(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, page, i) with line_id, region and word, null for a word that no line holds."""
    some = explode_words(lines).select("doc_id", "page", F.col("word.i").alias("i"), "line_id", "region", "word")
    return wanted.join(some, ["doc_id", "page", "i"], "left")


def get_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, line_id) with the lines' columns, null for a line that is not there."""
    return wanted.join(lines, ["doc_id", "line_id"], "left")


def lines_on_page(lines: DataFrame, page: int) -> DataFrame:
    return lines.filter(F.col("page") == page)


def lines_in_region(lines: DataFrame, region: str | None, page: int | None = None) -> DataFrame:
    """Lines of a region; None asks for lines outside all regions."""
    held = lines.filter(F.col("region").eqNullSafe(F.lit(region)))
    return held if page is None else lines_on_page(held, page)


def words_on_same_line(lines: DataFrame, include_self: bool = False) -> DataFrame:
    """For every word the words of its line: (doc_id, page, line_id, i, other); no shuffle."""
    flat = lines.select("doc_id", "page", "line_id", F.explode(F.transform("words", lambda w: w["i"])).alias("i"), F.transform("words", lambda w: w["i"]).alias("others"))
    pairs = flat.select("doc_id", "page", "line_id", "i", F.explode("others").alias("other"))
    return pairs if include_self else pairs.filter("i <> other")


def _limited(found: DataFrame, keys: list[str], order: list[Column], limit: int | None) -> DataFrame:
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("nth") <= limit) if limit is not None else ranked


def words_beside(lines: DataFrame, right: bool = True, max_gap: float | None = None, limit: int | None = None) -> DataFrame:
    """For every word the words to its right (or left) on the line, nearest first: (doc_id, page, line_id, i, other, nth); no shuffle.

    Words are compared by centres; gaps by edges.
    """
    check(limit, max_gap)
    cx = lambda w: geometry.center_x(w["b"])

    def of(w: Column) -> Column:
        far = F.filter("words", lambda o: (cx(o) > cx(w) if right else cx(o) < cx(w)) & (geometry.horizontal_gap(w["b"], o["b"]) <= max_gap if max_gap is not None else F.lit(True)))
        keyed = F.array_sort(F.transform(far, lambda o: F.struct((o["b"]["x1"] if right else -o["b"]["x2"]).alias("k"), (o["i"] if right else -o["i"]).alias("n"), o["i"].alias("i"))))
        some = F.slice(keyed, F.lit(1), F.lit(limit)) if limit is not None else keyed
        return F.struct(w["i"].alias("i"), F.transform(some, lambda x: x["i"]).alias("others"))

    flat = lines.select("doc_id", "page", "line_id", F.inline(F.transform("words", of)))
    return flat.select("doc_id", "page", "line_id", "i", F.posexplode("others").alias("nth", "other")).withColumn("nth", F.col("nth") + 1)


def lines_beside(lines: DataFrame, below: bool = True, same_region: bool = True, max_gap: float | None = None, limit: int | None = None) -> DataFrame:
    """For every line the lines below (or above) it on the page: (doc_id, page, line_id, other, nth)."""
    check(limit, max_gap)
    a = lines.select("doc_id", "page", "line_id", "region", "bbox")
    b = lines.select("doc_id", "page", F.col("line_id").alias("other"), F.col("region").alias("other_region"), F.col("bbox").alias("other_box"))
    cy, cx, cyo, cxo = geometry.center_y(F.col("bbox")), geometry.center_x(F.col("bbox")), geometry.center_y(F.col("other_box")), geometry.center_x(F.col("other_box"))
    gap = geometry.vertical_gap(F.col("bbox"), F.col("other_box"))
    found = a.join(b, ["doc_id", "page"]).filter("line_id <> other").filter(cyo > cy if below else cyo < cy)
    found = found.filter(F.col("region").eqNullSafe(F.col("other_region"))) if same_region else found
    found = found.filter(gap <= max_gap) if max_gap is not None else found
    return _limited(found, ["doc_id", "page", "line_id"], [gap, F.abs(cxo - cx), F.col("other_box.x1"), F.col("other")], limit).select("doc_id", "page", "line_id", "other", "nth")


def nearest_words(lines: DataFrame, same_region: bool = True, max_distance: float | None = None, limit: int = 10) -> DataFrame:
    """For every word its nearest words by the distance of centres: (doc_id, page, i, other, distance, nth)."""
    check(limit, max_distance)
    words = explode_words(lines)
    a = words.select("doc_id", "page", "region", F.col("word.i").alias("i"), F.col("word.b").alias("box"))
    b = words.select("doc_id", "page", F.col("region").alias("other_region"), F.col("word.i").alias("other"), F.col("word.b").alias("other_box"))
    distance = F.hypot(geometry.center_x(F.col("box")) - geometry.center_x(F.col("other_box")), geometry.center_y(F.col("box")) - geometry.center_y(F.col("other_box")))
    found = a.join(b, ["doc_id", "page"]).filter("i <> other").withColumn("distance", distance)
    found = found.filter(F.col("region").eqNullSafe(F.col("other_region"))) if same_region else found
    found = found.filter(F.col("distance") <= max_distance) if max_distance is not None else found
    return _limited(found, ["doc_id", "page", "i"], [F.col("distance"), geometry.center_y(F.col("other_box")), F.col("other_box.x1"), F.col("other")], limit).select("doc_id", "page", "i", "other", "distance", "nth")


def _query(text: str) -> str:
    if not text.strip():
        raise ValueError("an empty query finds nothing")
    return text.strip().lower()


def find_words(lines: DataFrame, text: str, exact: bool = False) -> DataFrame:
    query = _query(text)
    word = F.lower(F.btrim("word.q"))
    return explode_words(lines).filter(word == query if exact else word.contains(query))


def find_lines(lines: DataFrame, text: str) -> DataFrame:
    return lines.filter(F.lower(F.array_join(F.transform("words", lambda w: w["q"]), " ")).contains(_query(text)))
