"""Rules on hand-written lines: positive, negative and boundary cases."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import geometry
from quillgrid.operators import engine, layout, rules
from quillgrid.operators.rules import RULES


def lines(spark, texts, region="body"):
    rows = [(1, i, region, j, t) for i, text in enumerate(texts) for j, t in enumerate(text.split())]
    flat = spark.createDataFrame(rows, "doc_id int, cluster int, region string, j int, t string")
    x = F.col("j") * 0.05
    y = F.lit(0.05) + F.col("cluster") * 0.05
    word = layout.word_struct(F.col("cluster") * 20 + F.col("j"), F.col("t"), F.lit(""), F.lit(1.0), geometry.box(x, y, x + 0.045, y + 0.02))
    return layout.assemble(flat.select("doc_id", F.lit(1).alias("page"), "region", "cluster", word.alias("word")))


def found(spark, kind, *texts, region="body"):
    rule = {r[0].split(".")[1]: r[0] for r in RULES}
    return [r.value for r in engine.extract(lines(spark, texts, region), [rule[kind]]).orderBy("ordinal").select("value").collect()]


@pytest.mark.parametrize(
    ("kind", "texts", "values"),
    [
        ("date", ["от 30.02.2026 и 07/06/2026г. и 5 мая 2024"], ["2026-06-07", "2024-05-05"]),
        ("money_amount", ["1 234 567,89 тенге и 5 долларов США"], ["1234567.89", "5"]),
        ("money_amount", ["$ 100 и 100$ и сумма тенге"], []),
        ("percentage", ["4%, и 4 % и 4,50%"], ["4", "4.5"]),
        ("bin", ["БИН: 123456 789012"], ["123456789012"]),
        ("bin", ["БИН: 12345678901"], []),
        ("inn", ["ИНН 1234567890 12"], ["123456789012"]),
        ("bik", ["БИК 000000 SWIFT"], ["000000SWIFT"]),
        ("account", ["счет № 1234 5678 9012"], ["12345678"]),
        ("organization", ["ТОО «Банк Развития» БИН"], []),
        ("organization", ["ТОО БИН 1"], []),
        ("bank_name", ["Банк:"], []),
        ("person_name", ["директор казахстан"], ["казахстан"]),
    ],
)
def test_rule(spark, kind, texts, values):
    assert found(spark, kind, *texts) == values


def test_person_on_the_next_line(spark):
    assert found(spark, "person_name", "в лице директора", "Иванов Иван Иванович действующего") == ["Иванов Иван Иванович"]


def test_registry_guards(spark):
    registry = engine.Registry()
    with pytest.raises(ValueError):
        registry.register(RULES[0][0], RULES[0][1])
    registry.unregister(RULES[0][0])
    assert RULES[0][0] not in registry


def test_rows_in_any_order_give_the_same_lines(spark):
    some = lines(spark, ["а б в", "г д"])
    again = lines(spark, ["а б в", "г д"]).repartition(3)
    assert sorted(r.text for r in some.collect()) == sorted(r.text for r in again.collect())


def test_long_numbers_trigger_neither_dates_nor_addresses():
    import re

    fits = lambda rule, line: bool(re.search(rules.TRIGGERS[rule].replace(r"\p{L}\p{N}", r"\w"), line))
    for rule, kept in (("document.date.patterns.v1", ("срок до 31.12.2021г.", "«5» марта (2020)")), ("legal.address.context.v1", ("050000, алматы", "ул. абая", "адрес"))):
        assert all(fits(rule, line) for line in kept)
        assert not fits(rule, "р/с 1234567890123456")


def test_a_rule_states_the_search_for_a_role_once(spark):
    assert str(rules.persons()._jc.toString()).count("instr(") <= 7 * sum(len(p) for _, p in rules.ROLES)
