"""The rule registry and its execution: candidates and issues as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import layout, rules


class RuleError(RuntimeError):
    """A rule raised or does not fit the lines."""


_DEFAULT = {rule_id: rule for rule_id, rule, _ in rules.RULES}


class Registry:
    """Rules by id, in the order in which they were registered."""

    def __init__(self, default: bool = True) -> None:
        self._rules: dict[str, tuple[Callable[[], Column], float, bool]] = {}
        for rule_id, rule, least in rules.RULES if default else ():
            self.register(rule_id, rule, least, cross_line=rule_id in rules.CROSS_LINE)

    def register(self, rule_id: str, rule: Callable[[], Column], least: float = 0.45, *, cross_line: bool = False) -> None:
        """``rule()`` gives an array of ``rules.CANDIDATE`` from a line's columns; ``cross_line`` if it reads ``above`` or ``below``."""
        if not rule_id or not callable(rule):
            raise ValueError("a rule needs an id and a function")
        if rule_id in self._rules:
            raise ValueError(f"rule {rule_id} is registered already")
        if not 0 <= least <= 1:
            raise ValueError("the least confidence lies between 0 and 1")
        self._rules[rule_id] = (rule, least, cross_line)

    def unregister(self, rule_id: str) -> None:
        del self._rules[rule_id]

    def __contains__(self, rule_id: str) -> bool:
        return rule_id in self._rules

    def ids(self) -> list[str]:
        return list(self._rules)

    def run(self, lines: DataFrame, only: list[str] | None = None, continue_on_error: bool = True, keep: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Candidates and issues of all rules (or of ``only``) over lines, as rows or as arrays of ``layout.page_lines``.

        All rules share one pass over the lines; a window over a region's lines (in arrays, a
        look at the places beside) is added only if a rule looks at neighbours.  Of candidates with the same value and words
        the first counts, before the least confidence is applied.  A rule that gives one
        id twice in a document loses its output there, and an issue says so.  A rule that
        raises, or whose expression does not fit the lines, gives an issue in every
        document and spares the other rules, or else ends the run with ``RuleError``.
        ``keep`` holds what both results start from, so that rules run once for both.
        """
        frame, found, failed = self._started(lines, only, continue_on_error)
        lines = layout.flat(lines) if "lines" in lines.columns else lines
        tagged = [F.transform(c, _tag(k, least)) for k, least, c in found]
        tagged = tagged or [F.transform(F.array().cast(rules.NONE), _tag("", 0.0))]
        flat = frame.select("doc_id", "page", "region", "line_id", F.col("bbox").alias("line_box"), F.posexplode(F.concat(*tagged)).alias("place", "x"))
        flat = flat.select("doc_id", "page", "region", "line_id", "line_box", "place", "x.rule", "x.least", "x.c.*")
        seen = Window.partitionBy("doc_id", "rule", "page", "value", "word_ids").orderBy("line_box.y1", "line_box.x1", "line_id", "place")
        unique = flat.withColumn("nth", F.row_number().over(seen)).filter("nth = 1 and confidence >= least")
        by_id = Window.partitionBy("doc_id", "rule", "id")
        by_rule = Window.partitionBy("doc_id", "rule")
        checked = unique.withColumn("same", F.count("*").over(by_id)).withColumn("twice", F.max("same").over(by_rule) > 1)
        checked = keep(checked) if keep else checked
        order = Window.partitionBy("doc_id").orderBy("page", "bbox.y1", "bbox.x1", "entity_type", "value", "id")
        candidates = checked.filter("not twice").drop("nth", "same", "twice", "rule", "least", "place", "line_box").withColumn("ordinal", F.row_number().over(order))
        issues = checked.filter("twice").groupBy("doc_id", "rule").agg(F.min(F.when(F.col("same") > 1, F.col("id"))).alias("id")).select("doc_id", F.col("rule").alias("rule_id"), F.lit("duplicate_candidate_id").alias("error_type"), F.concat(F.lit("candidate id given twice: "), "id").alias("message"))
        if failed:
            broken = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.lit(kind).alias("error_type"), F.lit(message).alias("message")) for k, kind, message in failed])
            issues = issues.unionByName(lines.select("doc_id").distinct().select("doc_id", F.inline(broken)))
        return candidates, issues

    def documents(self, lines: DataFrame, marks: Column, continue_on_error: bool = True) -> DataFrame:
        """(doc_id, lines): each document in one row, its lines with ``marks`` (of a line's columns) and ``found``, what each rule finds in them.

        Nothing is compared yet, so that a step can do all it has to do with a document in
        its row.  Of pages that are dealt out by document, nothing is shuffled.
        """
        frame, found, _ = self._started(lines, None, continue_on_error, whole=True)
        narrow = lambda i, least: lambda c: F.struct(F.lit(i).alias("rule"), F.lit(least).alias("least"), *[c[k].alias(k) for k in ("id", "entity_type", "value", "word_ids", "confidence", "bbox", "role_hint", "party_role_hint", "ocr_confirmed")], c["validation"]["status"].alias("status"))
        some = F.concat(*[F.transform(c, narrow(i, least)) for i, (_, least, c) in enumerate(found)]) if found else F.transform(F.array().cast(rules.NONE), narrow(0, 0.0))
        line = F.struct("page", "region", "line_id", "line_index", "bbox", marks.alias("marks"), some.alias("found"))
        return frame.groupBy("doc_id").agg(F.collect_list(line).alias("lines"))

    def _started(self, lines: DataFrame, only: list[str] | None, continue_on_error: bool, whole: bool = False) -> tuple[DataFrame, list[tuple[str, float, Column]], list[tuple[str, str, str]]]:
        """Lines as rows, as rules read them; (rule, least confidence, what it finds in a line); rules that failed.  ``whole`` keeps lines without a trigger."""
        chosen = {k: v for k, v in self._rules.items() if only is None or k in only}
        if not chosen:
            raise ValueError("no rule to run")
        neighbours = any(v[2] for v in chosen.values())
        if "lines" in lines.columns:
            frame = self._page_frame(lines, chosen, neighbours, whole)
        else:
            frame = (rules.with_neighbours(lines) if neighbours else lines).withColumn("__hay", rules.hay())
        tagged, failed = [], []
        for k, (rule, least, _) in chosen.items():
            try:
                found = rule()
                if rule is _DEFAULT.get(k):
                    found = F.when(rules.fits(k), found).otherwise(F.array().cast(rules.NONE))
                else:
                    found = found.cast(rules.NONE)
                    frame.select(found)  # fails here, and not with all the others, if it does not fit the lines
                tagged.append((k, least, found))
            except Exception as error:
                if not continue_on_error:
                    raise RuleError(f"rule {k} failed: {error}") from error
                failed.append((k, type(error).__name__, str(error).split("\n")[0]))
        return frame, tagged, failed

    @staticmethod
    def _page_frame(pages: DataFrame, chosen: dict, neighbours: bool, whole: bool = False) -> DataFrame:
        """Lines as rows, of pages that hold them as arrays; those that no default rule's trigger fits are left out if there are only default rules, but not of ``whole`` pages."""
        wanted = None
        if not whole and all(rule is _DEFAULT.get(k) for k, (rule, _, _) in chosen.items()):
            wanted = lambda words: rules.triggered(words, list(chosen))
        if neighbours:
            pages, wanted = layout.neighbourhood(pages, rules.BEFORE, rules.AFTER, wanted), None
        return layout.flat(pages, wanted).withColumn("__hay", rules.hay())


def _tag(rule_id: str, least: float) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(rule_id).alias("rule"), F.lit(least).alias("least"), c.alias("c"))


def extract(lines: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Candidates of the default rules."""
    return Registry().run(lines, only)[0]
