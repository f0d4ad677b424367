"""The registered queries of the library and their SQL oracles.

Agreements are rendered from the order and customer tables; the oracles state the
expected facts straight from base columns, so they share no rule with the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synth
from .functions import checks, geometry, recognition, text
from .operators import engine, labels, layout, leftover, link, ocrpost, payloads, resolve, spatial, summary
from .operators.rules import candidate
from .plans import extraction
from .runtime import cut
from .sources import recognised

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its oracle if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentage_entities(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _found(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return engine.extract(synth.page_lines(spark, sf_dir, together=True), [rule])


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


# --- extraction rules -------------------------------------------------------------------------------


@query("select o_orderkey as doc_id, cast(o_orderkey % 20 + 1 as varchar) as value, 'annual_interest_rate' as role_hint, 'annual' as period, round(0.25 + 0.40 + 0.15 + 0.092, 6) as confidence from orders")
def percentage_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "document.percentage.patterns.v1").select("doc_id", "value", "role_hint", F.col("metadata")["period"].alias("period"), _six("confidence"))


@query("""select o_orderkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as value, 'contract_date' as role_hint, 'textual' as date_format, round(0.20 + 0.35 + 0.30 + 0.05 + 0.09, 6) as confidence from orders
union all select o_orderkey, strftime(cast(o_orderdate as date) + 365, '%Y-%m-%d'), 'repayment_due_date', 'numeric', round(0.20 + 0.35 + 0.30 + 0.05 + 0.093, 6) from orders""")
def date_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "document.date.patterns.v1").select("doc_id", "value", "role_hint", F.col("validation")["date_format"].alias("date_format"), _six("confidence"))


@query("select o_orderkey as doc_id, printf('%.2f', o_totalprice) as value, 'KZT' as currency, 'principal_amount' as role_hint, round(0.20 + 0.30 + 0.25 + 0.05 + 0.091, 6) as confidence from orders")
def money_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "document.money_amount.currency.v1").select("doc_id", "value", F.col("metadata")["currency"].alias("currency"), "role_hint", _six("confidence"))


@query("""select o_orderkey as doc_id, 'ТОО «Альфа' || (o_orderkey % 100) || '»' as value, 'ТОО' as legal_form, 'lender' as role_hint, round(0.20 + 0.40 + 0.20 + 0.10 + 0.094, 6) as confidence from orders
union all select o_orderkey, 'ООО «Бета' || o_custkey || '»', 'ООО', 'borrower', round(0.20 + 0.40 + 0.20 + 0.10 + 0.099, 6) from orders""")
def organization_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "legal.organization.legal_form.v2").select("doc_id", "value", F.col("metadata")["legal_form"].alias("legal_form"), "role_hint", _six("confidence"))


@query("""select o_orderkey as doc_id, 'Народный' as value, 'left_column' as region, round(0.15 + 0.40 + 0.25 + 0.10 + 0.096, 6) as confidence from orders
union all select o_orderkey, 'Демир', 'right_column', round(0.15 + 0.40 + 0.25 + 0.10 + 0.091, 6) from orders""")
def bank_name_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "legal.bank_name.context.v2").select("doc_id", "value", "region", _six("confidence"))


@query("""select o_orderkey as doc_id, 'директор' as value, 'left_column' as region, round(0.25 + 0.50 + 0.098, 6) as confidence from orders
union all select o_orderkey, 'директор', 'right_column', round(0.25 + 0.50 + 0.093, 6) from orders""")
def position_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "legal.position.dictionary.v2").select("doc_id", "value", "region", _six("confidence"))


@query("""select o_orderkey as doc_id, 'Иванов И.И' as value, 'left_column' as region, round(0.20 + 0.40 + 0.25 + 0.098, 6) as confidence from orders
union all select o_orderkey, 'Асанов Б.К', 'right_column', round(0.20 + 0.40 + 0.25 + 0.093, 6) from orders""")
def person_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "legal.person_name.context.v2").select("doc_id", "value", "region", _six("confidence"))


@query("""select o_orderkey as doc_id, '050000, г. Алматы, ул. Абая д. ' || (o_orderkey % 300 + 1) as value, '050000' as postal_code, 'legal_address' as role_hint, round(0.20 + 0.35 + 0.30 + 0.095, 6) as confidence from orders
union all select o_orderkey, '720000, г. Бишкек, ул. Чуй д. ' || (o_custkey % 300 + 1), '720000', 'postal_address', round(0.20 + 0.35 + 0.30 + 0.09, 6) from orders""")
def address_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "legal.address.context.v1").select("doc_id", "value", F.col("validation")["postal_code"].alias("postal_code"), "role_hint", _six("confidence"))


def _number(rule: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _found(spark, sf_dir, rule).select("doc_id", "value", F.array_join("anchor_word_ids", ",").alias("anchor"), _six("confidence"))


# anchor and value stand side by side, 0.005 apart: the gap scores 0.10 * (1 - 0.005 / most)
for _name, _rule, _value, _anchor, _confidence in (
    ("bin_entities", "tax_id.bin.anchor_right.v2", "lpad(cast(o_orderkey as varchar), 12, '0')", "p1-w67", "0.20 + 0.30 + 0.25 + 0.09 + 0.094 + 0.05"),
    ("inn_entities", "tax_id.inn.anchor_right.v1", "lpad(cast(o_custkey as varchar), 10, '0')", "p1-w147", "0.20 + 0.30 + 0.25 + 0.09 + 0.099 + 0.05"),
    ("iin_entities", "tax_id.iin.anchor_right.v1", "lpad(cast(o_custkey + 7 as varchar), 12, '0')", "p1-w224", "0.20 + 0.30 + 0.25 + 0.09 + 0.094 + 0.05"),
    ("bik_entities", "bank.bik.anchor_right.v1", "'HSBKKZ' || lpad(cast(o_orderkey % 100 as varchar), 2, '0')", "p1-w98", "0.20 + 0.30 + 0.25 + 0.10 * (1 - 0.005 / 0.06) + 0.096 + 0.05"),
    ("swift_entities", "bank.bic_swift.anchor_right.v1", "'DEMIKG22'", "p1-w178", "0.20 + 0.30 + 0.25 + 0.10 * (1 - 0.005 / 0.06) + 0.091 + 0.05"),
    ("account_entities", "bank.account.anchor_right.v1", "'1' || lpad(cast(o_custkey as varchar), 15, '0')", "p1-w192", "0.15 + 0.30 + 0.25 + 0.10 * (1 - 0.005 / 0.12) + 0.092 + 0.05"),
):
    QUERIES[_name] = _number(_rule)
    ORACLES[_name] = f"select o_orderkey as doc_id, {_value} as value, '{_anchor}' as anchor, round({_confidence}, 6) as confidence from orders"


#: Remainder of an account's number with 00 as check digits; 00 is as good as 97, which is right for remainder 1.
_REST = "cast('125203529' || lpad(cast({0} as varchar), 10, '0') || '203500' as hugeint) % 97"
_GOOD = "({0} % 2 = 0 or " + _REST + " = 1)"


@query(f"""select o_orderkey as doc_id, 'KZ' || case when o_orderkey % 2 = 0 then lpad(cast(98 - {_REST.format("o_orderkey")} as varchar), 2, '0') else '00' end || '125KZT' || lpad(cast(o_orderkey as varchar), 10, '0') as value,
case when {_GOOD.format("o_orderkey")} then 'valid' else 'checksum_invalid' end as status, round(least(1.0, 0.15 + 0.30 + 0.25 + 0.10 * (1 - 0.005 / 0.12) + 0.097 + 0.05 + case when {_GOOD.format("o_orderkey")} then 0.10 else -0.08 end), 6) as confidence from orders""")
def iban_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, "bank.iban.kz.anchor_right.v1").select("doc_id", "value", F.col("validation")["status"].alias("status"), _six("confidence"))


@query("""select entity_type, n from (values ('date', 2), ('money_amount', 1), ('percentage', 1), ('organization', 2), ('bank_name', 2), ('position', 2), ('person_name', 2), ('address', 2), ('bin', 1), ('iin', 1), ('inn', 1), ('bik', 1), ('bic_swift', 1), ('iban', 1), ('bank_account', 1)) t(entity_type, k), lateral (select count(*) * k as n from customer) u""")
def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.extract(synth.page_lines(spark, sf_dir, per_customer=True, together=True)).groupBy("entity_type").agg(F.count("*").alias("n"))


# --- sources and scalars ----------------------------------------------------------------------------


@query("select doc_id, len(w) as n_words, len(list_distinct(w)) as n_distinct from (select doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') as w from documents)")
def words_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array_remove(F.split(F.coalesce("text", F.lit("")), " "), "")
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    a = geometry.box(c("l_discount"), c("l_tax"), c("l_discount") + c("l_quantity") / 100, c("l_tax") + 0.05)
    b = geometry.box(c("l_tax"), c("l_discount"), c("l_tax") + 0.1, c("l_discount") + c("l_quantity") / 200)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"))


@query("""with t as (select l_orderkey, l_linenumber, l_partkey, l_discount ax1, l_tax ay1, l_discount + l_quantity / 100 ax2, l_tax + 0.05 ay2, l_tax bx1, l_discount by1, l_tax + 0.1 bx2, l_discount + l_quantity / 200 by2 from lineitem),
u as (select *, case when greatest(ax1, bx1) < least(ax2, bx2) and greatest(ay1, by1) < least(ay2, by2) then (least(ax2, bx2) - greatest(ax1, bx1)) * (least(ay2, by2) - greatest(ay1, by1)) else 0 end as ov, (ax2 - ax1) * (ay2 - ay1) as aa, (bx2 - bx1) * (by2 - by1) as ab from t)
select l_orderkey, l_linenumber, l_partkey, round(aa, 6) as area, round(ov, 6) as shared, round(case when ov > 0 and aa + ab - ov > 0 then ov / (aa + ab - ov) else 0 end, 6) as iou,
round(greatest(bx1 - ax2, ax1 - bx2, 0), 6) as gap_x, round(greatest(by1 - ay2, ay1 - by2, 0), 6) as gap_y, round(greatest(0, least(ay2, by2) - greatest(ay1, by1)) / least(ay2 - ay1, by2 - by1), 6) as overlap_y, round(least(ax1, bx1), 6) as union_x1, round(greatest(ay2, by2), 6) as union_y2 from u""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    r = lambda c, name: F.round(c, 6).alias(name)
    whole = geometry.union(a, b)
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", r(geometry.area(a), "area"), r(geometry.intersection_area(a, b), "shared"), r(geometry.iou(a, b), "iou"), r(geometry.horizontal_gap(a, b), "gap_x"), r(geometry.vertical_gap(a, b), "gap_y"), r(geometry.vertical_overlap_ratio(a, b), "overlap_y"), r(whole["x1"], "union_x1"), r(whole["y2"], "union_y2"))


@query("""with t as (select o_orderkey, lpad(cast(o_orderkey as varchar), 10, '0') as d from orders), u as (select o_orderkey, d, cast('125203529' || d || '203500' as hugeint) as n from t)
select o_orderkey, o_orderkey % 2 = 0 or n % 97 = 1 as good, 'KZ' || case when o_orderkey % 2 = 0 then lpad(cast(98 - n % 97 as varchar), 2, '0') else '00' end || '125KZT' || d as value from u""")
def iban_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    value = F.concat(F.lit("KZ"), synth.check_digits(key), F.lit("125KZT"), synth.digits(key, 10))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.mod97(value).alias("good"), value.alias("value"))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then printf('%.2f', o_totalprice) when o_orderkey % 4 = 1 then cast(cast(floor(o_totalprice) as bigint) as varchar) || '.5' when o_orderkey % 4 = 2 then cast(cast(floor(o_totalprice) as bigint) as varchar) else '1234567' end as amount,
case when o_orderkey % 32 between 1 and 28 then strftime(make_date(1996, 2, cast(o_orderkey % 32 as int)), '%Y-%m-%d') when o_orderkey % 32 = 29 then '1996-02-29' end as day, cast(o_orderkey % 7 as varchar) || case when o_orderkey % 3 = 0 then '' else '.5' end as percent from orders""")
def written_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.floor(price).cast("string")
    shown = F.when(key % 4 == 0, F.format_number(price, 2)).when(key % 4 == 1, F.concat(whole, F.lit(",5"))).when(key % 4 == 2, F.concat(F.lit("0"), whole)).otherwise("1,234.567")
    percent = F.concat((key % 7).cast("string"), F.when(key % 3 == 0, ",00").otherwise(",50"))
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.amount(shown).alias("amount"), checks.calendar_date(F.lit(1996), F.lit(2), (key % 32).cast("int")).alias("day"), checks.percent(percent).alias("percent"))


@query("""select c_custkey, lower(c_name) as key, 'TOO ' || upper(c_mktsegment) as name, 'KZ' || lpad(cast(c_custkey as varchar), 6, '0') as identifier, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') as organization, regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g') || '.pdf' as file_name from customer""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    shown = F.concat(F.lit("«"), "c_name", F.lit("»,"))
    code = F.concat(F.lit("К-Z "), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return c.select("c_custkey", text.token(shown).alias("key"), F.concat(F.lit("TOO "), F.upper("c_mktsegment")).alias("name"), recognition.compact(code).alias("identifier"), text.organization_key(F.col("c_name")).alias("organization"), text.safe_file_name(F.concat(F.lit("../x/"), "c_name", F.lit(".PDF"))).alias("file_name"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document per customer with a fault that follows from its key."""
    key = F.col("c_custkey")
    word = lambda t, c, x: F.struct(t.alias("t"), c.alias("c"), F.array(x, F.lit(0.1), F.lit(0.5), F.lit(0.2)).alias("b"), F.array(F.when(key % 11 == 4, 3).otherwise(0)).alias("v"))
    words = F.array(word(F.when(key % 11 == 1, " ").otherwise("слово"), F.when(key % 11 == 2, 1.5).otherwise(0.9), F.when(key % 11 == 3, 0.9).otherwise(0.1)), word(F.lit("два"), F.lit(0.8), F.lit(0.2)))
    value = F.struct(F.lit("bin").alias("type"), F.when(key % 11 == 5, "").otherwise("1").alias("value"), F.when(key % 11 == 6, 9).otherwise(1).alias("page"), F.array(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2)).alias("bbox"), F.array(F.lit(0)).alias("words"))
    region = F.struct(F.lit("body").alias("type"), F.array(F.lit(0), F.when(key % 11 == 7, 5).otherwise(2)).alias("words"))
    page = F.struct(F.when(key % 11 == 8, 2).otherwise(1).alias("page"), words.alias("words"), F.array(region).alias("regions"))
    document = F.to_json(F.struct(F.lit("текст").alias("document_text"), F.array(value).alias("values"), F.array(page).alias("pages")))
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.when(key % 11 == 9, F.lit("{not json")).otherwise(document).alias("json"))


@query("""select c_custkey as doc_id, case c_custkey % 11 when 0 then 0 when 4 then 2 when 6 then 2 when 10 then 0 else 1 end as n_errors, case c_custkey % 11 when 1 then '$.pages[0].words[0].t: blank' when 2 then '$.pages[0].words[0].c: not between 0 and 1' when 3 then '$.pages[0].words[0].b: four ordered numbers are needed' when 4 then '$.pages[0].words[0].v: no such value'
when 5 then '$.values[0].value: blank' when 6 then '$.values[0].page: no such page' when 7 then '$.pages[0].regions[0].words: not a range of the page''s words' when 8 then '$.pages[0].page: pages are numbered from 1 without gaps' when 9 then '$: not JSON' end as first_error from customer""")
def payload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.parse(_payloads(spark, sf_dir)).select("doc_id", F.size("errors").alias("n_errors"), F.get("errors", F.lit(0)).alias("first_error"))


@query("""select c_custkey as doc_id, unnest(['слово', 'два']) as word, 'body' as region, unnest([0.9, 0.8]) as confidence from customer where c_custkey % 11 in (0, 10)""")
def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.words(recognised.parse(_payloads(spark, sf_dir))).select("doc_id", F.col("word.t").alias("word"), "region", F.col("word.c").alias("confidence"))


@query("select c_custkey as doc_id, case c_custkey % 11 when 9 then 0 else 1 end as pages, case c_custkey % 11 when 9 then 0 else 2 end as words, case c_custkey % 11 when 9 then 0 else 1 end as regions, case c_custkey % 11 when 9 then 0 else 1 end as n_values from customer")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.counts(recognised.parse(_payloads(spark, sf_dir))).withColumnRenamed("values", "n_values")


@query("""select c_custkey as doc_id, unnest(['word of value', 'value of word', 'value of word', 'word of region', 'word of region']) as kind, unnest([0, 0, 1, 0, 1]) as i, unnest(['слово', '1', '1', 'слово', 'два']) as shown from customer where c_custkey % 11 in (0, 10)""")
def document_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a value, the values of a word and the words of a region, of usable documents."""
    documents = recognised.good(recognised.parse(_payloads(spark, sf_dir)))
    rows = lambda df, kind, shown: df.select("doc_id", F.lit(kind).alias("kind"), "i", F.col(shown).alias("shown"))
    return rows(recognised.words_of_values(documents), "word of value", "t").unionByName(rows(recognised.values_of_words(documents), "value of word", "value")).unionByName(rows(recognised.words_in_region(documents, "BODY"), "word of region", "t"))


@query("""select c_custkey as doc_id, case c_custkey % 6 when 1 then 'UNSUPPORTED_FORMAT' when 2 then 'INVALID_MIME_TYPE' when 3 then 'EMPTY_FILE' when 4 then 'INVALID_PDF' when 5 then 'FILE_TOO_LARGE' end as error_code from customer""")
def checked_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    shown = F.when(k == 3, "").when(k == 4, "GIF89a").otherwise("%PDF-1.7")
    path = F.concat(F.col("c_custkey").cast("string"), F.when(k == 1, ".docx").otherwise(".PDF"))
    stated = F.when(k == 2, "image/png").when(k == 0, "Application/PDF; q=1")
    files = table(spark, sf_dir, "customer").select(path.alias("path"), F.when(k == 5, 2000).otherwise(F.length(shown)).alias("length"), F.encode(shown, "UTF-8").alias("content"), stated.alias("content_type"))
    return recognised.uploads(files, max_bytes=1000).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), "error_code")


@query("select l_orderkey as job_id, count(*) as files from lineitem group by l_orderkey having count(*) > 5")
def too_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognised.too_many(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id")), 5)


@query("""with w as (select o_orderkey, unnest(range(0, 6)) as i, cast(o_orderkey % 5 as bigint) as k from orders), r as (select w.*, r.* from w, lateral (values (0, 'page', 0, 6), (1, 'block', k, k + 3), (2, 'cell', k + 1, k + 2)) r(n, type, a, b) where i >= a and i < b)
select o_orderkey, i, type as region from (select *, row_number() over (partition by o_orderkey, i order by b - a, n) as nth from r) where nth = 1""")
def region_of_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") % 5).cast("int")
    region = lambda name, a, b: F.struct(F.lit(name).alias("type"), F.array(a, b).alias("words"))
    regions = F.array(region("page", F.lit(0), F.lit(6)), region("block", k, k + 3), region("cell", k + 1, k + 2))
    flat = table(spark, sf_dir, "orders").select("o_orderkey", regions.alias("regions"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return flat.select("o_orderkey", F.col("i").cast("long").alias("i"), recognised.region_of(F.col("regions"), F.col("i")).alias("region"))


# --- recognised text ----------------------------------------------------------------------------------


def _cases(spark: SparkSession, sf_dir: str, *made: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, t): a text per customer, of the form that its key picks."""
    key = F.col("c_custkey")
    shown = made[0](key)
    for i, one in enumerate(made[1:], 1):
        shown = F.when(key % len(made) == i, one(key)).otherwise(shown)
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), shown.alias("t"))


def _after(*parts: str) -> Callable[[Column], Column]:
    """A form with the key's six digits for ``{}``."""
    front, back = parts[0].split("{}")
    return lambda key: F.concat(F.lit(front), F.lpad(key.cast("string"), 6, "0"), F.lit(back))


@query("""select c_custkey as doc_id, ['KZ', 'SWIFT', 'BAZ', 'KZ', 'AB', 'REALI'][c_custkey % 6 + 1] || lpad(cast(c_custkey as varchar), 6, '0') as value from customer""")
def compact_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("КZ {}", "$W|FТ-{}", "ВАЗ№{}", "ＫＺ{}.", "a\u200bb\u00ad–{}", "®€@£!{}")
    return _cases(spark, sf_dir, *map(_after, forms)).select("doc_id", recognition.compact(F.col("t")).alias("value"))


@query("""select c_custkey as doc_id, ['0000', '111111', '2355', '68'][c_custkey % 4 + 1] || lpad(cast(c_custkey as varchar), 6, '0') as value from customer""")
def recognised_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir, *map(_after, ("OQDО {}", "IІlL|!{}", "Z З-S$ {}xy", "G/B № {}"))).select("doc_id", recognition.digits(F.col("t")).alias("value"))


@query("""select c_custkey as doc_id, case c_custkey % 3 when 0 then 'елка №5' || chr(10) || chr(10) || 'займодавец ' when 1 then 'fin - бик/swift ' else 'бик/swift x ' end || lpad(cast(c_custkey as varchar), 6, '0') as value from customer""")
def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ("  Ё\u00adлка\t №5 \r\n\r\n\r\n \r\nЗАИМОДАВЕЦ {}\n", "ﬁn — BIK / SWIFT {}", "Вик/Swift\u00a0 x  {}")
    return _cases(spark, sf_dir, *map(_after, forms)).select("doc_id", recognition.normal_text(F.col("t")).alias("value"))


@query(f"""with t as (select o_orderkey, lpad(cast(o_orderkey as varchar), 10, '0') as d, case when o_orderkey % 2 = 0 then lpad(cast(98 - {_REST.format("o_orderkey")} as varchar), 2, '0') else '00' end as k from orders)
select o_orderkey, 'KZ' || k || '125KZT' || d as value, {_GOOD.format("o_orderkey")} as valid, (length(k || d) - length(replace(k || d, '0', '')))::int as n_corrections from t""")
def recognised_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    shown = F.concat(F.lit("К2 "), F.translate(synth.check_digits(key), "0", "O"), F.lit(" 125КZТ"), F.translate(synth.digits(key, 10), "0", "Q"))
    return table(spark, sf_dir, "orders").select("o_orderkey", recognition.iban(shown).alias("x")).select("o_orderkey", "x.value", F.col("x.format_valid").alias("valid"), F.size("x.corrections").alias("n_corrections"))


@query("""with t as (select c_custkey, '37040044053201' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') as d from customer) select c_custkey as doc_id, 'DE89' || d as value, 'iban' as format, cast(d || '131489' as hugeint) % 97 = 1 as valid from t""")
def other_ibans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers of other countries are checked and never changed."""
    key = F.col("c_custkey")
    shown = F.concat(F.lit("dе89 37040044053201"), F.lpad((key % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "customer").select(key.alias("doc_id"), recognition.iban(shown).alias("x")).select("doc_id", "x.value", "x.format", F.col("x.format_valid").alias("valid"))


@query("""select c_custkey as doc_id, ['OABCIZ22', 'ZABCKZ2X', '6ABCKZKX', 'ABCDK'][c_custkey % 4 + 1] as value, c_custkey % 4 < 3 as valid, ['position_1:0→O,position_5:1→I', 'position_1:2→Z', '', ''][c_custkey % 4 + 1] as corrections from customer""")
def recognised_bank_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = [lambda key, t=t: F.lit(t) for t in ("0ABC 1Z22", "2АВСKZ2X", "6ABCKZKX", "abcdk")]
    return _cases(spark, sf_dir, *plain).select("doc_id", recognition.swift(F.col("t")).alias("x")).select("doc_id", "x.value", F.col("x.format_valid").alias("valid"), F.array_join("x.corrections", ",").alias("corrections"))


@query("""select c_custkey as doc_id, k.kind, k.value, k.format, k.status from customer, (values ('bin', '120340005678', 'kz_bin', 'valid'), ('inn', '1203400', 'tax_identifier', 'invalid'), ('okpo', '12345678', 'okpo', 'valid'), ('bik', '123456', 'numeric_bik', 'valid'), ('bic_swift', 'HSBKKZKX', 'swift_bic', 'valid'),
('account', '1234567890123456', 'kg_numeric_account', 'valid'), ('account', 'AB12CD', 'generic_bank_account', 'unverified'), ('account', 'KZ00125', 'kz_iban', 'invalid'), ('other', 'X1', 'unknown', 'invalid')) k(kind, value, format, status)""")
def bank_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (("bin", "12O34ООО5678"), ("inn", "1203400"), ("okpo", "I2З45б78".replace("б", "6")), ("bik", "I23456"), ("bic_swift", "нSВККZКХ"), ("account", "1234 5678 9012 3456"), ("account", "ав12сd".replace("d", "D")), ("account", "К2ОО1Z5".replace("Z", "2")), ("other", "x1"))
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("t")) for k, t in rows])))
    return flat.select("doc_id", "kind", recognition.bank_value(F.col("kind"), F.col("t")).alias("x")).select("doc_id", "kind", "x.value", "x.format", checks.status(F.col("x.format_valid")).alias("status"))


def _value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad(F.col("c_custkey").cast("string"), 12, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("БИН: "), F.translate(key, "0", "О"), F.lit(" SWIFT нSВККZКХ и БИН "), key, F.lit(".")).alias("text"))


@query("""select c_custkey as doc_id, type, case type when 'bin' then lpad(cast(c_custkey as varchar), 12, '0') else 'HSBKKZKX' end as value, case type when 'bin' then '1' else '3' end as words, 'бин: ' || lpad(cast(c_custkey as varchar), 12, '0') || ' swift hsbkkzkx и бин ' || lpad(cast(c_custkey as varchar), 12, '0') as normal from customer, (values ('bin'), ('bic_swift')) t(type)""")
def linked_bank_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values found, put right, counted once, linked with their words, and standing in the page's text."""
    texts = _value_texts(spark, sf_dir)
    words = texts.select("doc_id", "page", F.posexplode(F.split("text", " ")).alias("i", "t"))
    values = ocrpost.scan_values(texts)
    linked = ocrpost.linked_words(ocrpost.first_values(values), words)
    return linked.join(ocrpost.with_values(texts, values).select("doc_id", "normal"), "doc_id").select("doc_id", "type", "value", F.array_join("word_ids", ",").alias("words"), "normal")


# --- layout and searches ----------------------------------------------------------------------------

_TEXTS = """select o_orderkey as doc_id, unnest(range(0, 15)) as line_no, unnest([
'Договор займа от «' || day(o_orderdate) || '» ' || ['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря'][month(o_orderdate)] || ' ' || year(o_orderdate) || ' года',
'Сумма займа составляет ' || format('{:,.2f}', o_totalprice) || ' тенге', 'Процентная ставка ' || (o_orderkey % 20 + 1) || ' % годовых', 'Вернуть средства срок до ' || strftime(cast(o_orderdate as date) + 365, '%d.%m.%Y'),
'Займодавец ТОО «Альфа' || (o_orderkey % 100) || '», БИН ' || lpad(cast(o_orderkey as varchar), 12, '0'), 'Юридический адрес: 050000, г. Алматы, ул. Абая д. ' || (o_orderkey % 300 + 1), 'Банк: Народный БИК HSBKKZ' || lpad(cast(o_orderkey % 100 as varchar), 2, '0'),
'IBAN KZ' || case when o_orderkey % 2 = 0 then lpad(cast(98 - cast('125203529' || lpad(cast(o_orderkey as varchar), 10, '0') || '203500' as hugeint) % 97 as varchar), 2, '0') else '00' end || '125KZT' || lpad(cast(o_orderkey as varchar), 10, '0'), 'Директор Иванов И.И.',
'Заемщик ООО «Бета' || o_custkey || '», ИНН ' || lpad(cast(o_custkey as varchar), 10, '0'), 'Почтовый адрес: 720000, г. Бишкек, ул. Чуй д. ' || (o_custkey % 300 + 1), 'Банк: Демир SWIFT DEMIKG22', 'р/с 1' || lpad(cast(o_custkey as varchar), 15, '0'), 'Директор Асанов Б.К.', 'ИИН ' || lpad(cast(o_custkey + 7 as varchar), 12, '0')]) as text,
unnest(['body', 'body', 'body', 'body', 'left_column', 'left_column', 'left_column', 'left_column', 'left_column', 'right_column', 'right_column', 'right_column', 'right_column', 'right_column', 'body']) as region from orders"""


@query(f"select doc_id, text, region, len(string_split(text, ' ')) as n_words, round(0.90 + 0.01 * (line_no % 10), 6) as confidence from ({_TEXTS})")
def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.lines(spark, sf_dir).select("doc_id", "text", "region", F.size("words").cast("long").alias("n_words"), _six("confidence"))


@query(f"select doc_id, text, string_agg(text, chr(10)) over (partition by doc_id, region order by line_no rows between 1 preceding and 2 following) as context from ({_TEXTS})")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.context(synth.page_lines(spark, sf_dir), 1, 2).select("doc_id", "text", "context")


@query("select c_custkey as doc_id, cast(15 as bigint) as n_lines, cast(15 as bigint) as n_texts from customer")
def line_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = layout.clustered(synth.pages(synth.customers(spark, sf_dir)))
    return layout.flat(layout.page_lines(pages)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_distinct("region", "text").alias("n_texts"))


_WORDS = f"(select doc_id, line_no, region, pos, line_no * 16 + pos as i, string_split(text, ' ')[pos + 1] as word from (select *, unnest(range(0, len(string_split(text, ' ')))) as pos from ({_TEXTS})))"


@query(f"select a.doc_id, a.i, b.i as other, b.pos - a.pos as nth from {_WORDS} a join {_WORDS} b on a.doc_id = b.doc_id and a.line_no = b.line_no and b.pos > a.pos and b.pos <= a.pos + 2")
def words_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return spatial.words_beside(synth.lines(spark, sf_dir), right=True, limit=2).select("doc_id", long("i"), long("other"), long("nth"))


@query(f"select doc_id, text, lead(text) over (partition by doc_id, region order by line_no) as next_text from ({_TEXTS}) qualify next_text is not null")
def lines_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = synth.lines(spark, sf_dir)
    found = spatial.lines_beside(lines, below=True, limit=1)
    t = lines.select("doc_id", "line_id", "text")
    return found.join(t, ["doc_id", "line_id"]).join(t.select("doc_id", F.col("line_id").alias("other"), F.col("text").alias("next_text")), ["doc_id", "other"]).select("doc_id", "text", "next_text")


@query("""with w as (select c_custkey as doc_id, unnest(range(0, 12)) as i from customer), p as (select *, (i % 4) * 0.1 as x, (i // 4) * 0.07 + i * 0.001 as y from w),
d as (select a.doc_id, a.i, b.i as other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as distance, b.y as oy, b.x as ox from p a join p b on a.doc_id = b.doc_id and a.i <> b.i)
select doc_id, i, other, nth from (select *, row_number() over (partition by doc_id, i order by distance, oy, ox, other) as nth from d) where nth <= 3""")
def nearest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    x, y = (i % 4) * F.lit(0.1), F.floor(i / 4) * F.lit(0.07) + i * F.lit(0.001)
    word = layout.word_struct(i, F.lit("w"), F.lit(""), F.lit(1.0), geometry.box(x, y, x, y))
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i"))
    lines = flat.groupBy("doc_id", F.lit(1).alias("page"), F.lit("body").alias("region"), F.lit("l").alias("line_id"), F.lit(0).alias("line_index")).agg(F.collect_list(word).alias("words"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return spatial.nearest_words(lines, limit=3).select("doc_id", long("i"), long("other"), long("nth"))


@query(f"select doc_id, count(*) as n from {_WORDS} where lower(word) = 'директор' group by doc_id")
def find_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_words(synth.lines(spark, sf_dir, together=True), " Директор ", exact=True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"select doc_id, text from ({_TEXTS}) where contains(lower(text), 'адрес')")
def find_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.find_lines(synth.lines(spark, sf_dir), "АДРЕС").select("doc_id", "text")


@query("""select source, doc_id, coalesce(sum(length(coalesce(text, '')) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "start", (coalesce(sum(length(coalesce(text, '')) + 2) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) + length(coalesce(text, '')))::bigint as "end" from documents""")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return ocrpost.text_spans(pages).select(F.col("doc_id").alias("source"), F.col("page").alias("doc_id"), long("start"), long("end"))


@query("""select c_custkey as doc_id, unnest(['before_columns', 'left_column', 'right_column', 'after_columns']) as region, unnest(['Реквизиты сторон', 'a b c' || chr(10) || 'a b c', 'd e f' || chr(10) || 'd e f', 'one wide line across']) as text from customer""")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def words(line: str, xs: list[float]) -> Column:
        return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(j).alias("n"), F.lit(t).alias("text"), F.lit(0.9).alias("confidence"), geometry.box(F.lit(x), F.lit(0.0), F.lit(x + 0.05), F.lit(0.1)).alias("box")) for j, (t, x) in enumerate(zip(line.split(), xs, strict=True))])

    rows = [("Реквизиты сторон", [0.1, 0.2]), ("a b c d e f", [0.1, 0.2, 0.3, 0.6, 0.7, 0.8]), ("a b c d e f", [0.1, 0.2, 0.3, 0.6, 0.7, 0.8]), ("one wide line across", [0.3, 0.42, 0.48, 0.56])]
    lines = F.array(*[F.struct(F.lit(i + 1).alias("nth"), F.lit(t).alias("text"), words(t, xs).alias("words")) for i, (t, xs) in enumerate(rows)])
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1.0).alias("page_width"), F.inline(lines))
    return ocrpost.regions(ocrpost.page_layout(flat)).select("doc_id", "region", "text")


@query("""select c_custkey as doc_id, unnest(['bin', 'bic_swift', 'account']) as type, unnest([lpad(cast(c_custkey as varchar), 12, '0'), 'HSBKKZKX', 'KZ00125' || lpad(cast(c_custkey as varchar), 8, '0')]) as value from customer""")
def bank_value_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    shown = F.concat(F.lit("БИН: "), F.lpad(key, 12, "0"), F.lit(", SWIFT HSBKKZKX; счет № KZ00125"), F.lpad(key, 8, "0"), F.lit("."))
    return ocrpost.scan_values(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), shown.alias("text"))).select("doc_id", "type", "value")


@query(f"""select doc_id, count(*) as words, round(avg(c), 4) as average, round(median(c), 4) as median, min(c) as minimum, sum(cast(c < 0.8 as int))::bigint as low, case when avg(c) >= 0.95 then 'excellent' when avg(c) >= 0.90 then 'good' when avg(c) >= 0.80 then 'review' else 'poor' end as grade from (select doc_id, round(0.90 + 0.01 * (line_no % 10), 6) as c from {_WORDS}) group by doc_id""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(table(spark, sf_dir, "orders"))
    words = words.withColumn("word", F.col("word").withField("c", F.round("word.c", 6)))
    return summary.page_quality(words).select("doc_id", "words", "average", "median", "minimum", "low", "grade")


@query(f"""select doc_id, 1::bigint as pages, count(*) as words, round(avg(c), 4) as average from (select doc_id, round(0.90 + 0.01 * (line_no % 10), 6) as c from {_WORDS}) group by doc_id""")
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = synth.words(table(spark, sf_dir, "orders"))
    words = words.withColumn("word", F.col("word").withField("c", F.round("word.c", 6)))
    return summary.document_quality(summary.page_quality(words)).select("doc_id", "pages", "words", "average")


@query(f"select doc_id, w.i, t.word, t.region, t.text from (select o_orderkey as doc_id, unnest([33, 15]) as i from orders) w left join (select doc_id, i, word, region, text from (select doc_id, line_no, region, text, line_no * 16 + pos as i, string_split(text, ' ')[pos + 1] as word from (select *, unnest(range(0, len(string_split(text, ' ')))) as pos from ({_TEXTS})))) t using (doc_id, i)")
def looked_up_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by their places, with the text of their line; a place without a word finds none."""
    lines = synth.lines(spark, sf_dir)
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(F.lit(33), F.lit(15))).alias("i"))
    words = spatial.get_words(lines, wanted).select("doc_id", "i", "line_id", F.col("word.t").alias("word"))
    return spatial.get_lines(lines, words).select("doc_id", "i", "word", "region", "text")


@query(f"select doc_id, text from ({_TEXTS}) where region = 'left_column'")
def region_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = synth.lines(spark, sf_dir)
    return spatial.lines_in_region(lines, "left_column", 1).unionByName(spatial.lines_in_region(lines, None)).select("doc_id", "text")


@query(f"select a.doc_id, a.i, b.i as other from {_WORDS} a join {_WORDS} b on a.doc_id = b.doc_id and a.line_no = b.line_no and b.pos <> a.pos")
def same_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return spatial.words_on_same_line(synth.lines(spark, sf_dir)).select("doc_id", long("i"), long("other"))


@query("""with t as (select c_custkey as doc_id, c_custkey % 6 as k from customer) select doc_id, 'w' || k || case when k <> 0 then ',w0' else '' end || ',' || array_to_string(list_transform(list_filter(range(0, 6), lambda x: x <> k and x <> 0), lambda x: 'w' || x), ',') as words, 'A:0-1,B:1-' || case when k <> 0 then '2' else '1' end as regions, case when k = 5 then 0 else 5 end as at_5 from t""")
def reordered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (F.col("c_custkey") % 6).cast("string")
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")).alias("id")))
    mine = F.concat(F.lit("w"), key)
    regions = F.array(F.struct(F.lit("A").alias("type"), F.array(mine).alias("word_ids")), F.struct(F.lit("B").alias("type"), F.array(F.lit("w0"), mine, F.lit("w9")).alias("word_ids")))
    out = ocrpost.reordered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), words.alias("words"), regions.alias("regions")))
    spans = F.transform("regions", lambda r: F.concat(r["type"], F.lit(":"), r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))
    return out.select("doc_id", F.array_join(F.transform("words", lambda w: w["id"]), ",").alias("words"), F.array_join(spans, ",").alias("regions"), F.col("word_index")["w5"].alias("at_5"))


@query("""with p as (select c_custkey as doc_id, unnest([1, 2, 3]) as page from customer), s as (select *, (doc_id + page) % 3 as n from p), b as (select *, coalesce(sum(n) over (partition by doc_id order by page rows between unbounded preceding and 1 preceding), 0) as before from s)
select doc_id, page, place, cast(before + place as int) as idx from (select *, unnest(range(0, n)) as place from b)""")
def value_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ((F.col("doc_id") + F.col("page")) % 3).cast("int")
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    values = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), n)
    return ocrpost.global_values(pages.withColumn("values", values)).select("doc_id", "page", "place", F.col("index").alias("idx"))


# --- engine and resolution --------------------------------------------------------------------------


@query("select c_custkey as doc_id, 'own.first_word' as rule_id, 'duplicate_candidate_id' as error_type from customer where c_custkey % 5 = 0")
def engine_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = engine.Registry(default=False)
    one = lambda v: candidate("word", "own.first_word", F.slice("words", F.lit(1), F.lit(1)), F.lit(v), F.lit(0.9))
    registry.register("own.first_word", lambda: F.when(F.col("line_index") > 0, F.array().cast(engine.rules.NONE)).when(F.col("doc_id") % 5 == 0, F.array(one("a"), one("b"))).otherwise(F.array(one("a"))))
    return registry.run(synth.lines(spark, sf_dir, per_customer=True))[1].select("doc_id", "rule_id", "error_type")


@query("""select c_custkey as doc_id, r.rule_id, r.error_type from customer, (values ('own.raises', 'KeyError'), ('own.misfit', 'AnalysisException')) r(rule_id, error_type)""")
def broken_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that raise or don't fit the lines become issues of every document; the rule beside them still gives its candidates."""
    registry = engine.Registry(default=False)
    registry.register("own.raises", lambda: {}["missing"])
    registry.register("own.misfit", lambda: F.col("no_such_column"))
    registry.register("own.good", lambda: F.array(candidate("word", "own.good", F.slice("words", F.lit(1), F.lit(1)), F.lit("a"), F.lit(0.9))))
    lines = synth.lines(spark, sf_dir, per_customer=True)
    candidates, issues = registry.run(lines)
    return issues.join(candidates.select("doc_id").distinct(), "doc_id").select("doc_id", "rule_id", "error_type")


def _rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: a BIN, its exact copy with less confidence, an INN on the same words, and a chain of overlapping names."""
    key = F.col("o_orderkey")

    def one(i: int, kind: str, value: str, confidence: Column, words: list[int]) -> Column:
        ids = F.array(*[F.lit(f"p1-w{w}") for w in words])
        box = geometry.box(F.lit(words[0] / 100), F.lit(0.1 * (1 + (i > 3))), F.lit((words[-1] + 1) / 100), F.lit(0.1 * (1 + (i > 3)) + 0.05))
        return F.struct(F.lit(f"c{i}").alias("id"), F.lit(kind).alias("entity_type"), F.lit(value).alias("value"), ids.alias("word_ids"), confidence.alias("confidence"), box.alias("bbox"), F.lit(False).alias("ocr_confirmed"), F.create_map(F.lit("status"), F.lit("valid")).alias("validation"), F.lit(i).alias("ordinal"))

    rows = [one(1, "bin", "1 2", F.lit(0.9), [1, 2]), one(2, "bin", "12", F.lit(0.8), [1, 2]), one(3, "inn", "12", 0.9 - (key % 3) * 0.05, [1, 2])]
    rows += [one(4, "position", "a", F.lit(0.7), [21, 22, 23]), one(5, "person_name", "b", F.lit(0.7), [22, 23, 24]), one(6, "address", "c", F.lit(0.7), [23, 24, 25])]
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), F.lit(1).alias("page"), F.inline(F.array(*rows)))


@query("select o_orderkey as doc_id, unnest(['c1', 'c2', 'c3', 'c4', 'c5', 'c6']) as id, unnest([false, true, false, false, false, false]) as copy from orders")
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.exact_duplicates(_rivals(spark, sf_dir)).select("doc_id", "id", "copy")


@query("select o_orderkey as doc_id, unnest(['c1', 'c2', 'c3', 'c4', 'c5', 'c6']) as id, unnest([1, 1, 1, 4, 4, 4]) as component from orders")
def overlap_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.components(_rivals(spark, sf_dir)).select("doc_id", "id", F.col("component").cast("int").alias("component"))


@query("select o_orderkey as doc_id, unnest(['c1', 'c2', 'c3', 'c4', 'c5', 'c6']) as id, unnest(['kept', 'rejected', case when o_orderkey % 3 = 2 then 'rejected' else 'kept' end, 'kept', 'kept', 'kept']) as outcome from orders")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, rejected, _ = resolve.resolve(_rivals(spark, sf_dir))
    return entities.select("doc_id", "id", F.lit("kept").alias("outcome")).unionByName(rejected.select("doc_id", "id", F.lit("rejected").alias("outcome")))


@query("select o_orderkey as doc_id, case when o_orderkey % 3 = 2 then 'conflict_resolved_by_confidence' else 'ambiguous_entity_type' end as code, 'c1,c3' as ids from orders")
def resolution_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_rivals(spark, sf_dir))[2].select("doc_id", "code", F.array_join("candidate_ids", ",").alias("ids"))


# --- parties and results ----------------------------------------------------------------------------


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return extraction.from_lines(synth.page_lines(spark, sf_dir, per_customer=True, together=True))


@query("""select c_custkey as doc_id, 'lender' as role, 'ТОО «Альфа' || (c_custkey % 100) || '»' as organization, 1 as identifiers, 1 as addresses, 7 as assigned from customer
union all select c_custkey, 'borrower', 'ООО «Бета' || c_nationkey || '»', 1, 1, 7 from customer""")
def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["parties"].select("doc_id", "role", "organization", F.size("identifier_ids").alias("identifiers"), F.size("address_ids").alias("addresses"), F.size("assigned_ids").alias("assigned"))


@query("""select c_custkey as doc_id, unnest(['bin', 'address', 'bank_name', 'bik', 'iban', 'person_name', 'position', 'inn', 'address', 'bank_name', 'bic_swift', 'bank_account', 'person_name', 'position']) as entity_type,
unnest(['lender', 'lender', 'lender', 'lender', 'lender', 'lender', 'lender', 'borrower', 'borrower', 'borrower', 'borrower', 'borrower', 'borrower', 'borrower']) as role from customer""")
def party_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = synth.lines(spark, sf_dir, per_customer=True)
    entities = cut(resolve.resolve(cut(engine.extract(lines)))[0])
    grouped = cut(link.groups(entities, lines))
    return link.assign(entities, grouped).filter("not ambiguous").join(entities.select("doc_id", "id", "entity_type"), ["doc_id", "id"]).select("doc_id", "entity_type", "role")


@query("""select c_custkey as doc_id, 'left_column' as region, 1 as codes, 1 as accounts from customer union all select c_custkey, 'right_column', 1, 1 from customer""")
def party_bank_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["bank_blocks"].select("doc_id", "region", (F.size("bik_ids") + F.size("bic_swift_ids")).alias("codes"), (F.size("iban_ids") + F.size("bank_account_ids")).alias("accounts"))


@query("""with b as (select user_id, event_id, ts from events where event_type = (select min(event_type) from events)), d as (select user_id, event_id, ts from events where event_type <> (select min(event_type) from events))
select d.event_id, coalesce(b.event_id, f.event_id) as block from d asof left join (select user_id, ts, max(event_id) as event_id from b group by all) b on d.user_id = b.user_id and d.ts >= b.ts left join (select user_id, arg_min(event_id, (ts, event_id)) as event_id from b group by user_id) f on d.user_id = f.user_id""")
def blocks_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The as-of join of bank blocks on events: every event goes to the user's last event of the first kind before it, else to the first one."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("head"))
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    shaped = events.join(F.broadcast(first), events["event_type"] == first["head"], "left").select(
        F.col("user_id").alias("doc_id"), F.lit("").alias("name_key"), F.lit(1).alias("page"), F.lit("body").alias("region"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.when(F.col("head").isNotNull(), "bank_name").otherwise("iban").alias("entity_type"), geometry.box(F.lit(0.0), at, F.lit(0.0), at).alias("bbox"), F.lit(1.0).alias("confidence"),
    )
    return link.bank_blocks(shaped).select(F.explode("iban_ids").alias("event_id"), "bank_id").select(F.col("event_id").cast("long"), F.col("bank_id").cast("long").alias("block"))


@query("""select c_custkey as doc_id, 'Иванов И.И' as name, 'директор' as position, round((0.20 + 0.40 + 0.25 + 0.098 + 0.25 + 0.50 + 0.098) / 2, 6) as confidence from customer
union all select c_custkey, 'Асанов Б.К', 'директор', round((0.20 + 0.40 + 0.25 + 0.093 + 0.25 + 0.50 + 0.093) / 2, 6) from customer""")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir)
    value = lambda kind, name: found["entities"].filter(f"entity_type = '{kind}'").select("doc_id", F.col("id").alias(f"{name}_id"), F.col("value").alias(name))
    return found["representatives"].join(value("person_name", "name"), ["doc_id", "name_id"]).join(value("position", "position"), ["doc_id", "position_id"]).select("doc_id", "name", "position", _six("confidence"))


@query("select c_custkey as doc_id, 'iin' as entity_type, lpad(cast(c_nationkey + 7 as varchar), 12, '0') as value from customer")
def unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leftover.unassigned(synth.page_lines(spark, sf_dir, per_customer=True, together=True)).select("doc_id", "entity_type", "value")


@query("""select c_custkey as doc_id, 'loan_agreement' as type, strftime(date '1995-01-01' + cast(c_custkey % 2000 as int), '%Y-%m-%d') as contract_date, printf('%.2f', abs(c_acctbal)) as principal_amount, cast(c_custkey % 20 + 1 as varchar) as rate, strftime(date '1995-01-01' + cast(c_custkey % 2000 as int) + 365, '%Y-%m-%d') as due from customer""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = resolve.resolve(cut(engine.extract(synth.page_lines(spark, sf_dir, per_customer=True, together=True))))[0]
    v = lambda c, name: F.col(c)["value"].alias(name)
    return summary.document_summary(entities).select("doc_id", "type", v("contract_date", "contract_date"), v("principal_amount", "principal_amount"), v("annual_interest_rate", "rate"), v("repayment_due_date", "due"))


@query(f"select c_custkey as doc_id, 21::bigint as entity_count, 'success_with_warnings' as status, case when {_GOOD.format('c_custkey')} then 1 else 2 end as warnings from customer")
def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["results"].select("doc_id", "entity_count", "status", F.size("warnings").alias("warnings"))


@query(f"""select c_custkey as doc_id, 'success_with_warnings' as status, 'loan_agreement' as type, 21 as entities, '2' as parties, 'lender' as first_role, 1 as representatives, 1 as banks, 1 as codes, 0 as swifts, 1 as accounts, 1 as unassigned, case when {_GOOD.format('c_custkey')} then '1' else '2' end as warnings, true as dated, '12.5' as source_size, '{{}}' as seconds from customer""")
def production_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(12.5).alias("size"))
    out = payloads.production(_run(spark, sf_dir), source)
    get = lambda p: F.get_json_object("result", p)
    n = lambda p: F.json_array_length(get(p))
    date = F.get_json_object(get("$.entity_registry"), "$").contains(F.concat(F.lit('"'), get("$.document.contract_date_entity_id"), F.lit('":{')))
    return out.select(
        "doc_id", get("$.summary.status").alias("status"), get("$.document.type").alias("type"), F.size(F.map_keys(F.from_json(get("$.entity_registry"), "map<string,string>"))).alias("entities"), get("$.summary.party_count").alias("parties"), get("$.parties[0].role").alias("first_role"),
        n("$.parties[1].representatives").alias("representatives"), n("$.parties[0].bank_details").alias("banks"), n("$.parties[0].bank_details[0].bik_entity_ids").alias("codes"), n("$.parties[0].bank_details[0].swift_entity_ids").alias("swifts"), n("$.parties[0].bank_details[0].account_entity_ids").alias("accounts"),
        n("$.unassigned_entity_ids").alias("unassigned"), get("$.summary.warning_count").alias("warnings"), date.alias("dated"), get("$.source.size").alias("source_size"), get("$.metadata.processing_seconds").alias("seconds"),
    )


@query("""select c_custkey as doc_id, 21 as entities, 1 as unassigned, 0 as rejected, 0 as rule_issues, 'true' as successful, '21' as counted, strftime(date '1995-01-01' + cast(c_custkey % 2000 as int), '%Y-%m-%d') as first_value, 'document.date.patterns.v1' as first_rule from customer""")
def debug_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = payloads.debug(_run(spark, sf_dir))
    get = lambda p: F.get_json_object("result", p)
    n = lambda p: F.json_array_length(get(p))
    return out.select("doc_id", n("$.entities").alias("entities"), n("$.unassigned_entities").alias("unassigned"), n("$.rejected_candidates").alias("rejected"), n("$.rule_issues").alias("rule_issues"), get("$.summary.successful").alias("successful"), get("$.summary.entity_count").alias("counted"), get("$.entities[0].value").alias("first_value"), get("$.entities[0].rule_id").alias("first_rule"))


@query("""select c_custkey as doc_id, cast(c_custkey as varchar) as document_id, c_name || '.pdf' as name, 'completed' as status, '1' as pages, c_comment as recognised, 21 as entities, 'date' as first_type, 'lender' as first_role, 'out/' || c_custkey as saved, 0 as errors from (select *, c_mktsegment as c_comment from (select c_custkey, c_name, c_mktsegment from customer))""")
def final_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir)
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    documents = c.select(key.alias("doc_id"), F.concat("c_name", F.lit(".pdf")).alias("source_file_name"), F.lit("completed").alias("status"), F.lit(1).alias("page_count"), F.create_map(F.lit("result_json"), F.concat(F.lit("out/"), key)).alias("output_files"), F.array().cast("array<string>").alias("errors"), F.create_map(F.lit("total"), F.lit(0.5)).alias("timing"))
    recognised_json = c.select(key.alias("doc_id"), F.to_json(F.struct(F.col("c_mktsegment").alias("document_text"))).alias("json"))
    out = payloads.final(documents, recognised_json, found, payloads.production(found))
    get = lambda p: F.get_json_object("payload", p)
    return out.select("doc_id", get("$.document_id").alias("document_id"), get("$.source_file_name").alias("name"), get("$.status").alias("status"), get("$.page_count").alias("pages"), get("$.ocr_result.document_text").alias("recognised"), F.json_array_length(get("$.extracted_entities")).alias("entities"), get("$.extracted_entities[0].type").alias("first_type"), get("$.extraction_result.parties[0].role").alias("first_role"), get("$.output_files.result_json").alias("saved"), F.json_array_length(get("$.errors")).alias("errors"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per customer; its orders are the documents."""
    key = F.col("o_orderkey")
    saved = F.create_map(F.lit("result_json"), F.when(key % 2 == 0, F.lit("a.json")).otherwise(""))
    document = F.struct(key.cast("string").alias("document_id"), F.lit("completed").alias("status"), F.lit("secret/").alias("source_path"), saved.alias("output_files"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.collect_list(document).alias("documents")).withColumn("archive_path", F.when(F.col("job_id") % 3 == 0, F.lit("a.zip")))


@query("""select o_custkey as job_id, case when o_custkey % 3 = 0 then '/api/jobs/' || o_custkey || '/download' end as download_url, cast(o_orderkey as varchar) as document_id, cast(null as varchar) as annotated, case when o_orderkey % 2 = 0 then '/api/documents/' || o_orderkey || '/json' end as json, 'document_id,downloads,status' as fields from orders""")
def public_job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = payloads.public_jobs(_jobs(spark, sf_dir))
    fields = ",".join(sorted(shown.schema["documents"].dataType.elementType.names))
    flat = shown.select("job_id", "download_url", F.explode("documents").alias("d"))
    return flat.select("job_id", "download_url", "d.document_id", F.col("d.downloads.annotated_document").alias("annotated"), F.col("d.downloads.result_json").alias("json"), F.lit(fields).alias("fields"))


@query("select distinct cast(l_orderkey as varchar) as document_id, o_custkey as job_id, 'completed' as status from lineitem join orders on l_orderkey = o_orderkey")
def found_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    return payloads.find_documents(_jobs(spark, sf_dir), wanted).select("document_id", "job_id", F.col("document.status").alias("status"))


@query("select c_custkey as doc_id, unnest(['date', 'date', 'money_amount']) as entity_type from customer")
def filtered_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.extract(synth.lines(spark, sf_dir, per_customer=True), ["document.date.patterns.v1", "document.money_amount.currency.v1", "document.percentage.patterns.v1"])
    return payloads.filtered(found, include=["DATE", "money_amount", "percentage"], exclude=["Percentage"], pages=[1]).select("doc_id", "entity_type")


@query("select c_custkey as doc_id, 3 as candidate_count, 0 as issue_count, true as successful, 2 as executed_rule_count, 'date,percentage' as entity_types, 2 as dates from customer")
def engine_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, rules = synth.lines(spark, sf_dir, per_customer=True), ["document.date.patterns.v1", "document.percentage.patterns.v1"]
    candidates, issues = engine.Registry().run(lines, rules)
    candidates = cut(candidates)
    dates = payloads.of_type(candidates, "Date").groupBy("doc_id").agg(F.count("*").alias("dates"))
    return payloads.engine_summary(lines, candidates, issues, rules).withColumn("entity_types", F.array_join("entity_types", ",")).join(dates, "doc_id")


@query("""select c_custkey as doc_id, unnest([1, 2, 3]) as number, c_custkey % 500 + 100 as x1, unnest([88, 122, 100]) as y1, c_custkey % 500 + 140 as x2, unnest([98, 132, 110]) as y2 from customer""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels of one box: above it, below it, and inside."""
    x = (F.col("c_custkey") % 500 + 100).cast("int")
    i = lambda v, name: F.lit(v).cast("int").alias(name)
    boxes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), i(1, "page"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("number"), x.alias("x1"), i(100, "y1"), (x + 50).alias("x2"), i(120, "y2"), i(40, "width"), i(10, "height"), i(1000, "page_width"), i(1000, "page_height"))
    return labels.place(boxes).select("doc_id", "number", "x1", "y1", "x2", "y2")


@query("""select 'owner' as by, 'none' as key, count(*) * 5 as n from customer union all select 'owner', 'lender', count(*) * 8 from customer union all select 'owner', 'borrower', count(*) * 8 from customer union all select 'page', '1', count(*) * 21 from customer
union all select 'type', t, count(*) * k from customer, (values ('date', 2), ('money_amount', 1), ('percentage', 1), ('organization', 2), ('bank_name', 2), ('position', 2), ('person_name', 2), ('address', 2), ('bin', 1), ('iin', 1), ('inn', 1), ('bik', 1), ('bic_swift', 1), ('iban', 1), ('bank_account', 1)) v(t, k) group by t, k""")
def annotation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir)
    counted = summary.annotation_counts(summary.annotation(found["entities"], found["parties"]))
    by = F.when(F.col("type").isNotNull(), "type").when(F.col("page").isNotNull(), "page").otherwise("owner")
    return counted.select(by.alias("by"), F.coalesce("type", F.col("page").cast("string"), "owner").alias("key"), "n")


@query("select c_custkey as doc_id, 1 as lowest, 21 as highest, 'date' as first_type from customer")
def annotation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(spark, sf_dir)
    drawn = summary.annotation(found["entities"], found["parties"])
    return drawn.groupBy("doc_id").agg(F.min("number").alias("lowest"), F.max("number").alias("highest"), F.min_by("type", "number").alias("first_type"))


@query("""with d as (select o_custkey as job_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'partially_completed' end as status from orders)
select job_id, case when bool_and(status = 'completed') then 'completed' when bool_and(status = 'failed') then 'failed' else 'partially_completed' end as status, count(*) as documents from d group by job_id""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("partially_completed")
    return summary.job_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), status.alias("status")))


@query("select o_orderkey as job_id from orders where o_orderdate < timestamp '1998-01-02 00:00:00' - interval 24 hours")
def job_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("updated_at"))
    return summary.expired(jobs, F.to_timestamp(F.lit("1998-01-02 00:00:00")), 24).select("job_id")
