"""What a run hands out as JSON: production and debug documents, the final payload, the public view of a job.

Parts of a document are made into JSON row by row and gathered per document, so one
document bounds every group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .summary import SUMMARY_ROLES

#: What production JSON keeps of an entity's metadata.
KEPT_METADATA = ("role_hint", "party_role_hint", "currency", "period", "display_name", "corrections")
#: Fields of a job and of its documents that stay inside.
PRIVATE_JOB, PRIVATE_DOCUMENT = ("archive_path",), ("source_path", "output_files")
_NULLS = {"ignoreNullFields": "false"}


def _json(c: Column) -> Column:
    return F.to_json(c, _NULLS)


def _gathered(df: DataFrame, name: str, order: list[Column | str], json: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, name): the rows' JSON as one JSON array, in ``order``."""
    one = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)], json.alias("j"))
    return df.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("]")).alias(name))


def _key(c: Column | str) -> Column:
    """A value as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _object(**parts: Column) -> Column:
    """A JSON object of parts that are JSON already."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}"))


def _kept_metadata() -> Column:
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    hints = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("role_hint", "party_role_hint")]), lambda x: x["v"].isNotNull()))
    kept = lambda k, v: k.isin(*KEPT_METADATA[2:]) & (v != "")
    return F.map_concat(F.map_filter(hints, lambda _, v: v != ""), F.map_filter(own, kept))


def compact_entity() -> Column:
    """An entity as production JSON shows it."""
    return F.struct("id", F.col("entity_type").alias("type"), "value", "raw_value", "page", geometry.to_array(F.col("bbox")).alias("bbox"), "word_ids", "anchor_word_ids", F.round("confidence", 6).alias("confidence"), "validation", _kept_metadata().alias("metadata"))


def registry(entities: DataFrame) -> DataFrame:
    """(doc_id, entity_registry): every entity once, by id, in order."""
    one = F.struct("ordinal", "id", F.concat(_key("id"), F.lit(":"), _json(compact_entity())).alias("j"))
    return entities.groupBy("doc_id").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ","), F.lit("}")).alias("entity_registry"))


def _sides(found: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, parties): parties with their representatives and bank details, ids standing for entities."""
    by = ("doc_id", "name_key")
    person = F.struct(F.col("name_id").alias("name_entity_id"), F.col("position_id").alias("position_entity_id"), F.col("name_ids").alias("name_occurrence_ids"), F.col("position_ids").alias("position_occurrence_ids"), F.round("confidence", 6).alias("confidence"))
    bank = F.struct(F.col("bank_id").alias("bank_name_entity_id"), F.concat("iban_ids", "bank_account_ids").alias("account_entity_ids"), F.col("bik_ids").alias("bik_entity_ids"), F.col("bic_swift_ids").alias("swift_entity_ids"), F.round("confidence", 6).alias("confidence"))
    people = _gathered(found["representatives"], "people", ["name_id", "position_id"], _json(person), by)
    banks = _gathered(found["bank_blocks"], "banks", ["page", "region", "bank_id"], _json(bank), by)
    joined = found["parties"].join(people, list(by), "left").join(banks, list(by), "left")
    head = _json(F.struct(F.col("party_id").alias("id"), "role", F.col("organization_id").alias("organization_entity_id"), F.col("identifier_ids").alias("identifier_entity_ids"), F.col("address_ids").alias("address_entity_ids")))
    tail = _json(F.struct(F.round("confidence", 6).alias("confidence"), "warnings"))
    inner = _object(representatives=F.coalesce("people", F.lit("[]")), bank_details=F.coalesce("banks", F.lit("[]")))
    merged = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(","), F.expr("substring(inner, 2, length(inner) - 2)"), F.lit(","), F.expr("substring(tail, 2)"))
    shaped = joined.withColumns({"head": head, "tail": tail, "inner": inner})
    return _gathered(shaped, "parties", ["place", "party_id"], merged)


def _head(counted: list[str]) -> Column:
    return _json(F.struct("status", (F.col("status") != "failed").alias("successful"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted]))


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count("*").alias(name))


def _source(results: DataFrame, source: DataFrame | None) -> DataFrame:
    if source is None:
        return results.withColumn("source", F.lit("{}"))
    some = source.select("doc_id", _json(F.struct(*[c for c in source.columns if c != "doc_id"])).alias("source"))
    return results.join(some, "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("{}")))


def production(found: dict[str, DataFrame], source: DataFrame | None = None, seconds: DataFrame | None = None) -> DataFrame:
    """(doc_id, result): production JSON of every document of a run, also of those without entities.

    ``found`` are the tables of ``extraction.from_lines``; ``source`` (doc_id, ...) says
    where a document is from; ``seconds`` (doc_id, processing_seconds) what its steps took.
    """
    unassigned = _gathered(found["unassigned"], "unassigned_entity_ids", ["ordinal", "id"], _key("id"))
    document = F.struct("type", *[F.col(k)["id"].alias(f"{k}_entity_id") for k in SUMMARY_ROLES])
    described = found["summary"].select("doc_id", _json(document).alias("document"))
    base = _source(found["results"], source)
    for part in (_count(found["parties"], "party_count"), _count(found["unassigned"], "unassigned_entity_count"), described, _sides(found), registry(found["entities"]), unassigned):
        base = base.join(part, "doc_id", "left")
    base = base.withColumn("warning_count", F.size("warnings"))
    took = F.lit("{}")
    if seconds is not None:
        base = base.join(seconds.select("doc_id", _json("processing_seconds").alias("took")), "doc_id", "left")
        took = F.coalesce("took", F.lit("{}"))
    none = F.lit("[]")
    result = _object(
        summary=_head(["party_count", "entity_count", "unassigned_entity_count", "warning_count"]), source=F.col("source"), document=F.coalesce("document", F.lit('{"type":"contract"}')), parties=F.coalesce("parties", none),
        entity_registry=F.coalesce("entity_registry", F.lit("{}")), unassigned_entity_ids=F.coalesce("unassigned_entity_ids", none), warnings=F.to_json("warnings"), metadata=_object(processing_seconds=took),
    )
    return base.select("doc_id", result.alias("result"))


def debug(found: dict[str, DataFrame], source: DataFrame | None = None) -> DataFrame:
    """(doc_id, result): everything that a run found, entities in full wherever they stand."""
    full = _json(F.struct("id", "entity_type", "rule_id", "value", "raw_value", "page", geometry.to_array(F.col("bbox")).alias("bbox"), "word_ids", "anchor_word_ids", F.round("confidence", 6).alias("confidence"), "validation", "metadata", "role_hint", "party_role_hint"))
    listed = {"entities": found["entities"], "unassigned_entities": found["unassigned"], "rejected_candidates": found["rejected"]}
    base = _source(found["results"], source).join(_sides(found), "doc_id", "left").join(_count(found["parties"], "party_count"), "doc_id", "left")
    for name, df in listed.items():
        base = base.join(_gathered(df, name, ["ordinal", "id"], full), "doc_id", "left")
    base = base.join(_count(found["unassigned"], "unassigned_entity_count"), "doc_id", "left").join(_count(found["rejected"], "rejected_candidate_count"), "doc_id", "left")
    issue = _json(F.struct("code", "candidate_ids"))
    base = base.join(_gathered(found["issues"], "issues", ["code", "candidate_ids"], issue), "doc_id", "left").join(_gathered(found["rule_issues"], "rule_issues", ["rule_id", "error_type", "message"], _json(F.struct("rule_id", "error_type", "message"))), "doc_id", "left")
    described = found["summary"].select("doc_id", _json(F.struct("type", *SUMMARY_ROLES)).alias("document"))
    base = base.join(described, "doc_id", "left").withColumn("warning_count", F.size("warnings"))
    none = F.lit("[]")
    result = _object(
        summary=_head(["party_count", "entity_count", "unassigned_entity_count", "rejected_candidate_count", "warning_count", "issue_count"]), source=F.col("source"), document=F.coalesce("document", F.lit('{"type":"contract"}')), parties=F.coalesce("parties", none),
        **{k: F.coalesce(k, none) for k in listed}, warnings=F.to_json("warnings"), issues=F.coalesce("issues", none), rule_issues=F.coalesce("rule_issues", none),
    )
    return base.select("doc_id", result.alias("result"))


def entity_summaries(entities: DataFrame) -> DataFrame:
    """(doc_id, extracted_entities): type, value, confidence and place of each entity, in order."""
    place = F.array(F.struct("page", geometry.to_array(F.col("bbox")).alias("bbox")))
    one = F.struct(F.col("entity_type").alias("type"), "value", F.round("confidence", 6).alias("confidence"), place.alias("locations"))
    return _gathered(entities, "extracted_entities", ["ordinal", "id"], _json(one))


def final(documents: DataFrame, recognised: DataFrame, found: dict[str, DataFrame], extraction: DataFrame) -> DataFrame:
    """(doc_id, payload): the whole answer for each of ``documents``.

    ``documents``: doc_id, source_file_name, status, page_count, output_files (map),
    errors (array), timing (map).  ``recognised``: (doc_id, json).  ``extraction``: what
    ``production`` gives; null in the payload for documents that have none.
    """
    joined = documents.join(recognised.select("doc_id", F.col("json").alias("recognised")), "doc_id", "left").join(extraction.select("doc_id", "result"), "doc_id", "left")
    joined = joined.join(entity_summaries(found["entities"]), "doc_id", "left").join(found["results"].select("doc_id", "warnings"), "doc_id", "left")
    null, none = F.lit("null"), F.lit("[]")
    plain = lambda c: F.coalesce(_key(c), null)
    payload = _object(
        document_id=plain("doc_id"), source_file_name=plain("source_file_name"), status=plain("status"), page_count=plain("page_count"), ocr_result=F.coalesce("recognised", null), extracted_entities=F.coalesce("extracted_entities", none),
        extraction_result=F.coalesce("result", null), output_files=F.coalesce(F.to_json("output_files"), F.lit("{}")), warnings=F.coalesce(F.to_json("warnings"), none), errors=F.coalesce(F.to_json("errors"), none), timing=F.coalesce(F.to_json("timing"), F.lit("{}")),
    )
    return joined.select("doc_id", payload.alias("payload"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_id, archive_path, documents, ...) without what stays inside, with links for downloads.

    ``documents`` is an array of structs with document_id and output_files (a map).
    """
    kind = jobs.schema["documents"].dataType.elementType

    def shown(d: Column) -> Column:
        def link(name: str, path: str) -> Column:
            return F.when(F.coalesce(F.try_element_at(d["output_files"], F.lit(name)), F.lit("")) != "", F.concat(F.lit("/api/documents/"), d["document_id"], F.lit(path))).alias(name)

        return F.struct(*[d[c].alias(c) for c in kind.names if c not in PRIVATE_DOCUMENT], F.struct(link("annotated_document", "/download"), link("result_json", "/json")).alias("downloads"))

    url = F.when(F.coalesce("archive_path", F.lit("")) != "", F.concat(F.lit("/api/jobs/"), "job_id", F.lit("/download")))
    return jobs.select(*[c for c in jobs.columns if c not in PRIVATE_JOB and c != "documents"], F.transform("documents", shown).alias("documents"), url.alias("download_url"))


def find_documents(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(document_id, job_id, document) for each of ``wanted`` (document_id) that a job holds; the first job by id counts."""
    flat = jobs.select("job_id", F.explode("documents").alias("document")).withColumn("document_id", F.col("document.document_id"))
    held = flat.join(wanted.select("document_id").distinct(), "document_id")
    return held.groupBy("document_id").agg(F.min_by(F.struct("job_id", "document"), "job_id").alias("x")).select("document_id", "x.job_id", "x.document")


def of_type(entities: DataFrame, kind: str) -> DataFrame:
    return entities.filter(F.lower("entity_type") == kind.lower())


def filtered(entities: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, pages: list[int] | None = None) -> DataFrame:
    """Entities of the types and pages asked for; an empty choice asks for all."""
    kind = F.lower("entity_type")
    for some, keep in ((include, True), (exclude, False)):
        if some:
            named = kind.isin(*[x.lower() for x in some])
            entities = entities.filter(named if keep else ~named)
    return entities.filter(F.col("page").isin(*pages)) if pages else entities


def engine_summary(documents: DataFrame, candidates: DataFrame, issues: DataFrame, rules: list[str]) -> DataFrame:
    """Counts of a rule run per document, and its entity types in the order of their first candidates."""
    firsts = candidates.groupBy("doc_id", "entity_type").agg(F.min("ordinal").alias("at"), F.count("*").alias("n"))
    kinds = firsts.groupBy("doc_id").agg(F.sum("n").alias("candidate_count"), F.transform(F.array_sort(F.collect_list(F.struct("at", "entity_type"))), lambda x: x["entity_type"]).alias("entity_types"))
    joined = documents.select("doc_id").distinct().join(kinds, "doc_id", "left").join(_count(issues, "issue_count"), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", n("candidate_count"), n("issue_count"), (F.coalesce("issue_count", F.lit(0)) == 0).alias("successful"), F.lit(len(rules)).alias("executed_rule_count"), F.coalesce("entity_types", F.array().cast("array<string>")).alias("entity_types"))
