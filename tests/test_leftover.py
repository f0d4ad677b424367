"""Unassigned entities found in a document's row: the same as by the tables of the whole extraction."""

import random

from pyspark.sql import functions as F

from quillgrid import catalogue
from quillgrid.functions import geometry
from quillgrid.operators import layout, leftover, rules
from quillgrid.plans import extraction

LINES = [
    "Займодавец ТОО «Альфа», БИН 000000000001", "ООО «Бета», ИНН 1234567890", "Поставщик АО «Гамма»", "ТОО «Альфа»", "БИН ИНН 123456789012", "ИИН 123456789012", "счет № 1234567890123456", "IBAN KZ86125KZT5004100100",
    "Банк: Народный БИК HSBKKZKX", "р/с БИК 12345678", "SWIFT BIC DEMIKG22", "Директор Иванов И.И.", "в лице директора", "Петров Пётр Петрович действующего", "Юридический адрес: 050000, г. Алматы, ул. Абая д. 5", "от 05.06.2021 года 100 тенге", "пустая строка", "заемщик",
]


def pages(spark):
    """Pages of random lines; boxes of neighbouring lines may lie on each other, and a document has two pages."""
    some = random.Random(5)
    rows = []
    for d in range(60):
        for page in (1, 2):
            for n in range(some.randint(1, 12)):
                region, y = some.choice(["left_column", "right_column", "body", None]), some.randint(0, 12) * 0.04
                rows += [(d, page, region, n, n * 20 + i, t, 0.02 + i * some.choice([0.0, 0.05, 0.055]), y, some.choice([0.5, 0.9, 1.0])) for i, t in enumerate(some.choice(LINES).split())]
    flat = spark.createDataFrame(rows, "doc_id int, page int, region string, cluster int, i int, t string, x double, y double, c double")
    word = layout.word_struct(F.col("i"), F.col("t"), F.lit(""), F.col("c"), geometry.box(F.col("x"), F.col("y"), F.col("x") + 0.05, F.col("y") + 0.02))
    return flat.groupBy("doc_id", "page").agg(F.collect_list(layout.page_word(F.col("region"), F.col("cluster"), word)).alias("words"))


def test_the_same_as_by_tables(spark):
    lines = layout.page_lines(pages(spark)).cache()
    told = lambda df: sorted(map(str, df.select("doc_id", "id", "entity_type", "value", "confidence").collect()))
    want = told(extraction.from_lines(lines)["unassigned"])
    assert len(want) > 100 and told(leftover.unassigned(lines)) == want


def test_a_document_is_judged_in_its_row(spark, data):
    """Only the agreements' own rows are dealt out, and nothing is written in between."""
    plan = catalogue.QUERIES["unassigned"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in line for line in plan.splitlines()) == 1 and "Join" not in plan and "Scan ExistingRDD" not in plan


def test_a_look_for_bytes_loses_no_trigger(spark):
    words = {w for k in ("CURRENCIES", "LEGAL_FORMS", "POSITIONS", "IBAN_ANCHORS", "ACCOUNT_ANCHORS") for a in getattr(rules, k) for w in (a[0][0] if isinstance(a[0], tuple) else a[0],)}
    words |= {*rules.PERSON_CONTEXT, *rules.BIK_ANCHORS, *rules.SWIFT_ANCHORS, *rules.PERCENT_WORDS, *rules.BANK_WORDS, "бин", "бсн", "иин", "жсн", "инн", "Расчётный", "Р\\\\С", "", "а", "12.05.2021", "x1234", "12345", "050000"}
    hay = rules.hay(F.array(F.struct(F.col("t").alias("q"))))
    lines = spark.createDataFrame([(f"{before}{w}",) for w in sorted(words) for before in ("", "№ ", "х")], "t string").select(hay.alias("__hay"))
    wrong = [F.count_if(~rules.fits(k).eqNullSafe(F.col("__hay").rlike(pattern))).alias(str(n)) for n, (k, pattern) in enumerate(rules.TRIGGERS.items())]
    assert set(lines.select(*wrong).first()) == {0}
    hits = [F.count_if(rules.fits(k)).alias(str(n)) for n, k in enumerate(rules.TRIGGERS)]
    assert min(lines.select(*hits).first()) > 0


def test_words_of_a_list_are_found_whole(spark):
    some = ["бин", "би", "бин,иин", ",", "", "иин", "р/с", "инн ", None, "м.п", "мзп"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "i int, t string").select("i", rules._in(F.col("t"), ("бин", "иин", "р/с", "м.п")).alias("x"))
    assert [r.x for r in got.orderBy("i").collect()] == [True, False, False, False, False, True, True, False, None, True, False]
