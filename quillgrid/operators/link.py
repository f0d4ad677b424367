"""Entities to the parties of an agreement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry, text
from ..runtime import cut, ship
from . import layout, rules

MINIMUM, AMBIGUITY = 0.45, 0.06
SAME_REGION, SAME_PAGE, SAME_LINE, VERTICAL, ROLE = 0.55, 0.15, 0.10, 0.30, 0.35
IDENTIFIERS = ("bin", "iin", "inn")
BANK_DETAILS = ("bank_name", "bik", "bic_swift", "iban", "bank_account")
DETAILS = (*IDENTIFIERS, "address", *BANK_DETAILS, "person_name", "position")
ROLES = tuple(r for r, _ in rules.ROLES)


def _party_role(c: Column | None = None) -> Column:
    """A detail's role: its party hint, else its role hint, if it is one."""
    known = lambda x: F.when(x.isin(*ROLES), x)
    return F.coalesce(known(F.col("party_role_hint")), known(F.col("role_hint")))


def groups(entities: DataFrame, lines: DataFrame) -> DataFrame:
    """Organizations by folded name: doc_id, name_key, role, primary (struct), occurrences (array of structs)."""
    organizations = entities.filter("entity_type = 'organization'").withColumn("name_key", text.organization_key(F.col("value")))
    nearby = entities.filter(F.col("entity_type").isin(*DETAILS)).groupBy("doc_id", "page", F.coalesce("region", F.lit("")).alias("r")).agg(F.count("*").alias("nearby"))
    contexts = layout.contexts_of(lines, organizations, 4, 3).select(F.col("doc_id").alias("d"), F.col("line_id").alias("l"), text.folded(F.col("context")).alias("context"))
    found = organizations.withColumn("r", F.coalesce("region", F.lit(""))).join(nearby, ["doc_id", "page", "r"], "left").join(contexts, (F.col("doc_id") == F.col("d")) & (F.col("line_id") == F.col("l")), "left")
    score = F.col("confidence") + F.when(F.coalesce(F.col("region").isin("left_column", "right_column"), F.lit(False)), 0.35).otherwise(0.0) + F.when(F.coalesce("role_hint", F.lit("unknown")).isin("", "unknown"), 0.0).otherwise(0.20) + F.least(F.lit(0.25), F.coalesce("nearby", F.lit(0)) * 0.03)
    votes = F.array(*[F.when(F.col("role_hint") == role, 3.0).otherwise(0.0) + sum((F.coalesce(F.col("context").contains(p), F.lit(False)).cast("double") for p in patterns), F.lit(0.0)) for role, patterns in rules.ROLES])
    occurrence = F.struct("id", "page", "region", "line_id", "bbox", "confidence", "value", "ordinal")
    best = F.struct(score.alias("score"), F.col("confidence"), (-F.col("page")).alias("page"), (-F.col("ordinal")).alias("ordinal"))
    sums = [F.sum(F.get(F.col("votes"), F.lit(i))).alias(f"v{i}") for i in range(len(ROLES))]
    grouped = found.withColumn("votes", votes).groupBy("doc_id", "name_key").agg(F.max_by(occurrence, best).alias("primary"), F.sort_array(F.collect_list(F.struct(F.col("ordinal"), occurrence.alias("o")))).alias("some"), *sums)
    # the role with most votes; of equals the one listed first
    ranked = F.array_max(F.array(*[F.struct(F.col(f"v{i}").alias("n"), F.lit(-i).alias("i"), F.lit(role).alias("role")) for i, role in enumerate(ROLES)]))
    role = F.when(ranked["n"] > 0, ranked["role"]).otherwise("unknown")
    return grouped.select("doc_id", "name_key", role.alias("role"), "primary", F.transform("some", lambda x: x["o"]).alias("occurrences"))


def scores(entities: DataFrame, grouped: DataFrame) -> DataFrame:
    """(doc_id, id, name_key, role, score) for details and groups of their page: an equi-join on (document, page)."""
    details = entities.filter(F.col("entity_type").isin(*DETAILS)).select("doc_id", "page", "id", "region", "line_id", "bbox", _party_role().alias("own"))
    mentions = grouped.select("doc_id", "name_key", "role", F.explode("occurrences").alias("o")).withColumn("page", F.col("o.page"))
    pairs = details.join(mentions, ["doc_id", "page"])
    region = F.when(F.col("region").eqNullSafe(F.col("o.region")), SAME_REGION).when(F.col("region").isNull() | F.col("o.region").isNull(), 0.05).otherwise(0.0)
    vertical = F.greatest(F.lit(0.0), VERTICAL - F.abs(geometry.center_y(F.col("bbox")) - geometry.center_y(F.col("o.bbox"))))
    role = F.when(F.col("own").isNull() | (F.col("role") == "unknown"), 0.0).when(F.col("own") == F.col("role"), ROLE).otherwise(-ROLE)
    score = SAME_PAGE + region + F.when(F.col("line_id") == F.col("o.line_id"), SAME_LINE).otherwise(0.0) + vertical + role
    return pairs.groupBy("doc_id", "id", "name_key", "role").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(score))).alias("score"))


def assign(entities: DataFrame, grouped: DataFrame) -> DataFrame:
    """The best group of each detail: (doc_id, id, name_key, role, score, ambiguous); details under the least score have no row."""
    best = Window.partitionBy("doc_id", "id").orderBy(F.desc("score"), "name_key")
    ranked = scores(entities, grouped).withColumn("second", F.lead("score").over(best)).withColumn("nth", F.row_number().over(best))
    close = F.coalesce(F.col("score") - F.col("second") < AMBIGUITY, F.lit(False))
    return ranked.filter("nth = 1").filter(F.col("score") >= MINIMUM).select("doc_id", "id", "name_key", "role", "score", close.alias("ambiguous"))


def bank_blocks(details: DataFrame, keys: tuple[str, ...] = ("doc_id", "name_key")) -> DataFrame:
    """As-of join: every code or account goes to the last bank name above it in its region, else to the region's first.

    ``details`` have the keys, page, region, id, entity_type, bbox and confidence.  Returns one row per block.
    """
    some = details.filter(F.col("entity_type").isin(*BANK_DETAILS))
    y = F.when(F.col("entity_type") == "bank_name", F.col("bbox.y1")).otherwise(geometry.center_y(F.col("bbox")))
    bank = F.when(F.col("entity_type") == "bank_name", F.col("id"))
    region = Window.partitionBy(*keys, "page", "region")
    above = region.orderBy("at", (F.col("entity_type") != "bank_name").cast("int"), "id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by(bank, F.when(bank.isNotNull(), F.struct("at", "id"))).over(region)
    placed = some.withColumn("at", y).withColumn("bank_id", F.coalesce(F.last(bank, ignorenulls=True).over(above), first))
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("entity_type") == kind, F.col("id")))).alias(f"{kind}_ids")
    return placed.groupBy(*keys, "page", "region", "bank_id").agg(ids("iban"), ids("bank_account"), ids("bik"), ids("bic_swift"), F.avg("confidence").alias("confidence"))


_REPRESENTATIVE = "doc_id {0}, name_key string, name_id string, position_id string, name_ids array<string>, position_ids array<string>, confidence double"


def representatives(details: DataFrame) -> DataFrame:
    """Persons with the nearest positions of their party, greedily one to one; leftover positions stand alone at three quarters of their confidence.

    Order decides, so each party is one small Python group; ties go to the position that sorts first.
    """
    ship(details.sparkSession)
    kind = dict(details.dtypes)["doc_id"]
    flat = details.filter("entity_type in ('person_name', 'position')").select("doc_id", "name_key", "id", "entity_type", "value", "page", "region", "bbox.*", "confidence", "ordinal", F.size("word_ids").alias("n_words"), F.when(F.col("entity_type") == "person_name", text.person_key(F.col("value"))).otherwise(F.lower("value")).alias("key"))

    def distance(a: dict, b: dict) -> float:
        centre = lambda x, k: (x[f"{k}1"] + x[f"{k}2"]) / 2
        return 2.0 * abs(a["page"] - b["page"]) + 0.5 * (a["region"] != b["region"]) + abs(centre(a, "y") - centre(b, "y")) + 0.25 * abs(centre(a, "x") - centre(b, "x"))

    def of_party(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("ordinal").to_dict("records")
        people: dict[str, list[dict]] = {}
        posts: dict[str, list[dict]] = {}
        for r in rows:
            (people if r["entity_type"] == "person_name" else posts).setdefault(r["key"], []).append(r)
        out = []
        for some in people.values():
            name = max(some, key=lambda r: (r["n_words"], r["confidence"]))
            near = min(posts, key=lambda k: (min(distance(name, p) for p in posts[k]), k)) if posts else None
            taken = posts.pop(near) if near is not None else []
            post = min(taken, key=lambda p: distance(name, p)) if taken else None
            confidence = (name["confidence"] + post["confidence"]) / 2 if post else name["confidence"]
            out.append((key[0], key[1], name["id"], post and post["id"], [r["id"] for r in some], [r["id"] for r in taken], confidence))
        for k in sorted(posts):
            post = max(posts[k], key=lambda r: r["confidence"])
            out.append((key[0], key[1], None, post["id"], [], [r["id"] for r in posts[k]], post["confidence"] * 0.75))
        return pd.DataFrame(out, columns=["doc_id", "name_key", "name_id", "position_id", "name_ids", "position_ids", "confidence"])

    return flat.groupBy("doc_id", "name_key").applyInPandas(of_party, _REPRESENTATIVE.format(kind))


def link(entities: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """Parties, representatives, bank blocks, unassigned entities and warnings.  Groups and assignments are written once to the shared folder, as all tables start from them."""
    grouped = cut(groups(entities, lines))
    assigned = cut(assign(entities, grouped))
    sure = assigned.filter("not ambiguous").select("doc_id", "id", "name_key")
    details = entities.join(sure, ["doc_id", "id"])
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("page", "bbox.x1", "bbox.y1", "id"))))
    members = details.groupBy("doc_id", "name_key").agg(ids(F.col("entity_type").isin(*IDENTIFIERS)).alias("identifiers"), ids(F.col("entity_type") == "address").alias("addresses"), F.array_sort(F.collect_list("id")).alias("assigned_ids"), F.sum("confidence").alias("total"), F.count("*").alias("n"))
    joined = grouped.join(members, ["doc_id", "name_key"], "left")
    none = F.array().cast("array<string>")
    plain = lambda c: F.coalesce(F.transform(c, lambda x: x["id"]), none)
    mean = (F.col("primary.confidence") + F.coalesce("total", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
    known = F.col("role") != "unknown"
    warnings = F.filter(F.array(F.when(~known, F.lit("не удалось надёжно определить роль стороны")), F.when(F.size(plain("identifiers")) == 0, F.lit("к стороне не привязан ни один регистрационный идентификатор"))), lambda w: w.isNotNull())
    parties = joined.select(
        "doc_id", F.concat(F.lit("party-"), F.when(known, F.col("role")).otherwise("party"), F.lit("-"), "primary.id").alias("party_id"), "name_key", "role", F.col("primary.id").alias("organization_id"), F.col("primary.value").alias("organization"),
        plain("identifiers").alias("identifier_ids"), plain("addresses").alias("address_ids"), F.coalesce("assigned_ids", none).alias("assigned_ids"), F.transform("occurrences", lambda o: o["id"]).alias("organization_ids"),
        F.when(known, F.least(F.lit(1.0), mean + 0.05)).otherwise(mean).alias("confidence"), warnings.alias("warnings"), F.struct("primary.page", "primary.bbox.x1", "primary.bbox.y1").alias("place"),
    )
    used = sure.select("doc_id", "id").union(grouped.select("doc_id", F.explode("occurrences.id").alias("id")))
    candidates = entities.filter(F.col("entity_type").isin(*DETAILS, "organization"))
    unassigned = candidates.join(used, ["doc_id", "id"], "left_anti")
    close = assigned.filter("ambiguous").select("doc_id", F.concat(F.lit("неоднозначная привязка: "), "id").alias("message"))
    missing = entities.select("doc_id").distinct().join(grouped.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("организации не найдены").alias("message"))
    return {"parties": parties, "representatives": representatives(details), "bank_blocks": bank_blocks(details), "unassigned": unassigned, "warnings": close.unionByName(missing), "details": details}
