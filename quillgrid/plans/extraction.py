"""The whole extraction: recognised words to entities, parties and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import engine, layout, link, resolve, summary
from ..runtime import cut
from ..sources import recognised


def from_lines(lines: DataFrame, keep_ambiguous: bool = True, registry: engine.Registry | None = None) -> dict[str, DataFrame]:
    """All tables of a run.  Candidates are written once to the shared folder, as several tables start from them."""
    candidates, rule_issues = (registry or engine.Registry()).run(lines, keep=cut)
    entities, rejected, issues = resolve.resolve(candidates, keep_ambiguous)
    entities = cut(entities)
    linked = link.link(entities, lines)
    described = summary.document_summary(entities)
    left = linked["unassigned"].groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.concat(F.lit("осталось непривязанных сущностей: "), "n").alias("message"))
    party = linked["parties"].select("doc_id", F.explode("warnings").alias("message"))
    warnings = linked["warnings"].unionByName(party).unionByName(summary.checksum_warnings(entities)).unionByName(left)
    all_issues = issues.select("doc_id", F.col("code").alias("message")).unionByName(rule_issues.select("doc_id", "message"))
    results = summary.results(lines.select("doc_id"), entities, warnings, all_issues)
    return {"candidates": candidates, "entities": entities, "rejected": rejected, "issues": issues, "rule_issues": rule_issues, "summary": described, "warnings": warnings, "results": results, **{k: v for k, v in linked.items() if k != "warnings"}}


def from_documents(documents: DataFrame) -> dict[str, DataFrame]:
    """From parsed documents; those with faults are in ``quarantined``."""
    tables = from_lines(layout.build_lines(recognised.words(documents)))
    return tables | {"quarantined": recognised.quarantined(documents)}
