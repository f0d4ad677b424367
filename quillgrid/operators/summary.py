"""Document summaries, quality, warnings, statuses, and the data behind annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry

SUMMARY_ROLES = {"contract_date": ("date", "contract_date"), "principal_amount": ("money_amount", "principal_amount"), "annual_interest_rate": ("percentage", "annual_interest_rate"), "repayment_due_date": ("date", "repayment_due_date"), "interest_start_date": ("date", "interest_start_date")}
#: Which roles make which agreement, the first fitting one counts.
AGREEMENTS = ((("lender", "borrower"), "loan_agreement"), (("supplier", "buyer"), "supply_agreement"), (("lessor", "lessee"), "lease_agreement"), (("customer", "contractor"), "service_agreement"))
LOW, VERY_LOW = 0.80, 0.60


def document_summary(entities: DataFrame) -> DataFrame:
    """One row per document: type, and id and value of the most confident entity of each role; of equals the earlier one."""
    def best(field: str, kind: str, role: str) -> Column:
        mine = (F.col("entity_type") == kind) & (F.col("role_hint") == role)
        return F.max_by(F.struct("id", "value"), F.when(mine, F.struct(F.col("confidence"), -F.col("ordinal")))).alias(field)

    roles = F.collect_set("role_hint").alias("roles")
    chosen = [best(field, kind, role) for field, (kind, role) in SUMMARY_ROLES.items()]
    kind = F.lit("contract")
    for some, name in reversed(AGREEMENTS):
        kind = F.when(F.arrays_overlap("roles", F.array(*map(F.lit, some))), name).otherwise(kind)
    return entities.groupBy("doc_id").agg(roles, *chosen).withColumn("type", kind).drop("roles")


def grade(average: Column) -> Column:
    return F.when(average >= 0.95, "excellent").when(average >= 0.90, "good").when(average >= 0.80, "review").otherwise("poor")


def page_quality(words: DataFrame) -> DataFrame:
    """Quality per page of words (doc_id, page, line_no, word); the twenty least confident words are kept by a bounded aggregate."""
    c = F.col("word.c")
    odd = F.col("word.t").rlike(r"[$§@€£|!®©]")
    ranked = words.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(c, "word.i")))
    stats = ranked.groupBy("doc_id", "page").agg(
        F.count("*").alias("words"), F.count_distinct("line_no").alias("lines"), F.round(F.avg(c), 4).alias("average"), F.round(F.median(c), 4).alias("median"), F.round(F.min(c), 4).alias("minimum"),
        F.count_if(c < LOW).alias("low"), F.count_if(c < VERY_LOW).alias("very_low"), F.count_if(odd).alias("suspicious"), F.array_sort(F.collect_list(F.when((c < LOW) & (F.col("nth") <= 20), F.struct(c.alias("c"), F.col("word.i").alias("i"))))).alias("lowest"), F.avg(c).alias("raw"),
    )
    return stats.withColumn("grade", grade(F.col("raw"))).drop("raw")


def document_quality(pages: DataFrame) -> DataFrame:
    """Pages to documents: averages weighted by words."""
    sums = [F.sum(k).alias(k) for k in ("lines", "low", "very_low", "suspicious")]
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("words").alias("words"), F.round(F.sum(F.col("average") * F.col("words")) / F.sum("words"), 4).alias("average"), *sums)


def checksum_warnings(entities: DataFrame) -> DataFrame:
    bad = entities.filter("entity_type = 'iban' and validation['status'] = 'checksum_invalid'")
    return bad.select("doc_id", F.concat(F.lit("IBAN "), "value", F.lit(" имеет корректную форму, но не прошёл проверку MOD 97")).alias("message"))


def results(documents: DataFrame, entities: DataFrame, warnings: DataFrame, issues: DataFrame) -> DataFrame:
    """Status and counts of every document, also of those without entities."""
    counted = entities.groupBy("doc_id").agg(F.count("*").alias("entity_count"))
    warned = warnings.groupBy("doc_id").agg(F.array_sort(F.collect_set("message")).alias("warnings"))
    broken = issues.groupBy("doc_id").agg(F.count("*").alias("issue_count"))
    joined = documents.select("doc_id").distinct().join(counted, "doc_id", "left").join(warned, "doc_id", "left").join(broken, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    status = F.when(n("entity_count") == 0, "failed").when((F.coalesce(F.size("warnings"), F.lit(0)) > 0) | (n("issue_count") > 0), "success_with_warnings").otherwise("success")
    return joined.select("doc_id", n("entity_count").alias("entity_count"), n("issue_count").alias("issue_count"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), status.alias("status"))


def owners(parties: DataFrame) -> DataFrame:
    """(doc_id, id, owner): an entity that several parties name belongs to the last one."""
    named = parties.select("doc_id", "role", "place", "party_id", F.explode(F.array_distinct(F.concat("organization_ids", "assigned_ids"))).alias("id"))
    return named.groupBy("doc_id", "id").agg(F.max_by("role", F.struct("place", "party_id")).alias("owner"))


def annotation(entities: DataFrame, parties: DataFrame) -> DataFrame:
    """What is drawn: entities with owner and a number on their page, from top to bottom."""
    order = Window.partitionBy("doc_id", "page").orderBy("bbox.y1", "bbox.x1", "entity_type", "id")
    return entities.join(owners(parties), ["doc_id", "id"], "left").select("doc_id", "page", "id", F.col("entity_type").alias("type"), "value", "bbox", "confidence", F.coalesce("owner", F.lit("none")).alias("owner"), F.row_number().over(order).alias("number"))


def annotation_counts(drawn: DataFrame) -> DataFrame:
    """Counts by type, by page and by owner in one pass (three grouping sets)."""
    sets = drawn.groupingSets([[F.col("type")], [F.col("page")], [F.col("owner")]], "type", "page", "owner")
    return sets.agg(F.count("*").alias("n"))


def job_status(documents: DataFrame) -> DataFrame:
    """Status of a job from the statuses of its documents."""
    s = F.collect_set("status")
    status = F.when((F.size(s) == 1) & F.array_contains(s, "completed"), "completed").when((F.size(s) == 1) & F.array_contains(s, "failed"), "failed").when(F.array_contains(s, "completed") | F.array_contains(s, "partially_completed"), "partially_completed").otherwise("failed")
    return documents.groupBy("job_id").agg(status.alias("status"), F.count("*").alias("documents"))


def expired(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    return jobs.filter(F.col("updated_at") < now - F.expr(f"interval {hours} hours"))
