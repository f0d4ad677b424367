"""Lines made inside a page's row: the same as those that a shuffle of the words makes."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid import catalogue
from quillgrid.functions import geometry
from quillgrid.operators import engine, layout, rules
from quillgrid.runtime import cut


@pytest.fixture(scope="module")
def words(spark):
    some = random.Random(7)
    rows = [(d, 1, some.choice(["a", "b", None]), some.randint(0, 3), i, some.choice(["x", "Банк:", "7"]), some.randint(0, 4) / 8, some.randint(0, 4) / 8) for d in range(12) for i in range(d * 3)]
    flat = spark.createDataFrame(rows, "doc_id int, page int, region string, cluster int, i int, t string, x double, y double")
    word = layout.word_struct(F.col("i"), F.col("t"), F.lit(""), F.lit(0.9), geometry.box(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.1))
    return flat.select("doc_id", "page", "region", "cluster", word.alias("word")).cache()


@pytest.fixture(scope="module")
def pages(words):
    return words.groupBy("doc_id", "page").agg(F.collect_list(layout.page_word(F.col("region"), F.col("cluster"), F.col("word"))).alias("words"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_lines_of_pages(words, pages):
    assert rows(layout.flat(layout.page_lines(pages))) == rows(layout.assemble(words))


def test_context_of_pages(words, pages):
    assert rows(layout.context(layout.page_lines(pages), 1, 2)) == rows(layout.context(layout.assemble(words), 1, 2))


def test_neighbours_in_pages(words, pages):
    got = layout.flat(layout.neighbourhood(layout.page_lines(pages), rules.BEFORE, rules.AFTER))
    assert rows(got) == rows(rules.with_neighbours(layout.assemble(words)))


def test_a_page_without_words_has_no_lines(pages):
    empty = pages.limit(1).withColumn("words", F.slice("words", 1, 0))
    assert layout.flat(layout.page_lines(empty)).count() == 0


@pytest.mark.parametrize(("name", "most"), [("line_assembly", 0), ("line_context", 0), ("words_right", 0), ("same_line_words", 0), ("find_lines", 0), ("find_words", 1), ("bik_entities", 1), ("address_entities", 1), ("all_entities", 2)])
def test_words_and_lines_are_not_shuffled(spark, data, name, most):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange " in line for line in plan.splitlines()) <= most


def test_contexts_of_some_lines(words, pages):
    lines = layout.page_lines(pages)
    whole = layout.context(lines, 4, 3).select("doc_id", "line_id", "context")
    wanted = layout.flat(lines).filter("line_index % 3 = 1").select("doc_id", "line_id")
    assert rows(layout.contexts_of(lines, wanted, 4, 3)) == rows(whole.join(wanted, ["doc_id", "line_id"]))
    assert rows(layout.contexts_of(layout.assemble(words), wanted, 4, 3)) == rows(whole)


def test_only_wanted_lines_leave_a_page(pages):
    bank = lambda words: F.exists(words, lambda w: w["t"] == "Банк:")
    lines = layout.page_lines(pages)
    assert rows(layout.flat(lines, bank)) == rows(layout.flat(lines).filter(bank(F.col("words"))))


def test_rules_run_once_for_candidates_and_issues(pages):
    candidates, issues = engine.Registry().run(layout.page_lines(pages), keep=cut)
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (candidates, issues)]
    assert not any("Generate" in plan for plan in plans)


def test_clusters_are_found_in_the_page(spark, data):
    plan = catalogue.QUERIES["line_clustering"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Join" not in plan


def test_an_index_may_stand_in_two_regions(spark):
    word = layout.word_struct(F.lit(0), F.col("t"), F.lit(""), F.lit(0.9), geometry.box(F.lit(0.1), F.col("y"), F.lit(0.2), F.col("y") + 0.1))
    words = spark.createDataFrame([(1, 1, "a", "A", 0.1), (1, 1, "b", "B", 0.1), (1, 1, None, "C", 0.5)], "doc_id int, page int, region string, t string, y double")
    lines = layout.build_lines(words.select("doc_id", "page", "region", word.alias("word")))
    assert sorted((x["text"], x["region"]) for x in lines.collect()) == [("A", "a"), ("B", "b"), ("C", None)]


def test_lines_of_words_without_clusters(spark):
    at = [("b", 0.30, 0.105), ("a", 0.10, 0.100), ("c", 0.10, 0.150), ("d", 0.30, 0.148), ("e", 0.50, 0.111)]
    words = spark.createDataFrame([(1, 1, i, *x) for i, x in enumerate(at)], "doc_id int, page int, i int, t string, x double, y double")
    word = layout.word_struct(F.col("i"), F.col("t"), F.lit(""), F.lit(0.9), geometry.box(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.02))
    lines = layout.build_lines(words.select("doc_id", "page", F.lit("body").alias("region"), word.alias("word")))
    assert [x["text"] for x in lines.orderBy("line_index").collect()] == ["a b e", "c d"]


def test_found_words_are_counted_where_their_agreement_is(spark, data):
    """Only the orders' own rows are dealt out: no task counts the documents of a whole file split before a shuffle."""
    plan = catalogue.QUERIES["find_words"](spark, data)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]


@pytest.mark.parametrize("name", ["iin_entities", "inn_entities", "account_entities"])
def test_lines_without_a_trigger_are_left_out_where_lines_are_made(spark, data, name):
    """The row of a page holds only the lines that a rule may find something in, and no other leaves the step that makes them."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline(lines" in plan and "Generate inline(filter" not in plan


@pytest.mark.parametrize("name", ["line_assembly", "line_context", "same_line_words", "bank_name_entities"])
def test_a_value_used_twice_is_not_copied(spark, data, name):
    """``transform`` copies all that its function gives, down to each word's text."""
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan


def test_a_look_at_the_plain_line_loses_no_trigger(spark):
    texts = ["ИИН 1", "хИИН 1", "иин1", "Р\\\\/С 12", "р//с", "РАСЧЁТНЫЙ СЧЁТ", "расчЕтный счет №", "İиин 5", "Жсн", "БАНК", "bAnK", "ﬀbank", "Kz swift", "адрес: 050000", "1050000", "в 1999 г", "19990", "25 %", "Процент", "", "$ 5", "5 ₸", "тенге", "BIK\\SWIFT x", "ДИРЕКТОР", "именуемый", "Ё"]
    lines = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array(F.struct(F.col("t").alias("q"))).alias("words"))
    for k, pattern in rules.TRIGGERS.items():
        full = F.regexp_replace(F.translate(F.lower(F.array_join(F.col("words")["q"], " ")), "ё\\", "е/"), "/+", "/").rlike(pattern)
        assert lines.filter(~rules.triggered(F.col("words"), [k]).eqNullSafe(full)).count() == 0, k
