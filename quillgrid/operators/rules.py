"""The fifteen extraction rules as column expressions over lines.

A rule is an expression from a line to an array of candidates, so all rules run in one
pass over the lines, in the JVM, without a shuffle of their own.  Rules that look at
neighbouring lines read them from columns that ``with_neighbours`` adds with one window
per (document, page, region).

A line has: doc_id, page, region, line_index, line_id, words, and a word is
struct<i:int, t:string, q:string, c:double, b:box, v:array<struct<type, value>>>: its
index on the page, text, text for searching, confidence, box and recognised values.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import checks, geometry, text
from ..functions.text import let

WORD = f"struct<i:int,t:string,q:string,c:double,b:{geometry.BOX},v:array<struct<type:string,value:string>>>"
CANDIDATE = f"struct<id:string,entity_type:string,rule_id:string,value:string,raw_value:string,first:int,last:int,word_ids:array<string>,anchor_word_ids:array<string>,confidence:double,bbox:{geometry.BOX},role_hint:string,party_role_hint:string,ocr_confirmed:boolean,validation:map<string,string>,metadata:map<string,string>>"
NONE = f"array<{CANDIDATE}>"

#: Words that tell a party's role, in the order in which ties are decided.
ROLES = (
    ("lender", ("займодав", "кредитор")), ("borrower", ("заемщик", "должник")), ("supplier", ("поставщик",)), ("buyer", ("покупатель",)), ("seller", ("продавец",)),
    ("customer", ("заказчик",)), ("contractor", ("исполнитель", "подрядчик")), ("lessor", ("арендодатель",)), ("lessee", ("арендатор",)), ("guarantor", ("гарант", "поручитель")),
)
#: Currency words and their codes.
CURRENCIES = (
    (("долларов", "сша"), "USD"), (("доллары", "сша"), "USD"), (("доллар", "сша"), "USD"), (("usd",), "USD"), (("$",), "USD"), (("долларов",), "USD"), (("доллара",), "USD"), (("доллар",), "USD"),
    (("kzt",), "KZT"), (("₸",), "KZT"), (("тенге",), "KZT"), (("kgs",), "KGS"), (("сомов",), "KGS"), (("сома",), "KGS"), (("сом",), "KGS"),
    (("rub",), "RUB"), (("рублей",), "RUB"), (("рубля",), "RUB"), (("руб",), "RUB"), (("₽",), "RUB"), (("eur",), "EUR"), (("евро",), "EUR"), (("€",), "EUR"),
)
PERCENT_WORDS = ("%", "процент", "процента", "процентов", "percent", "percents")
#: Legal forms and their short names.
LEGAL_FORMS = (
    (("общество", "с", "ограниченной", "ответственностью"), "ООО"), (("товарищество", "с", "ограниченной", "ответственностью"), "ТОО"), (("акционерное", "общество"), "АО"),
    (("индивидуальный", "предприниматель"), "ИП"), (("частная", "компания"), "ЧК"), (("тоо",), "ТОО"), (("ооо",), "ООО"), (("ао",), "АО"), (("ип",), "ИП"),
    (("llp",), "LLP"), (("llc",), "LLC"), (("ltd",), "LTD"), (("jsc",), "JSC"), (("inc",), "INC"),
)
ORGANIZATION_STOPS = "бин иин инн бик bik swift bic iban иик р/с к/с счет account адрес телефон тел email e-mail именуемый именуемая именуемое именуемые далее в".split()
BANK_WORDS = ("банк", "bank", "banking")
BANK_ANCHORS = ((("банк", "корреспондент"), "correspondent_bank"), (("банк-корреспондент",), "correspondent_bank"), (("корреспондентский", "банк"), "correspondent_bank"), (("correspondent", "bank"), "correspondent_bank"), (("банк",), "bank"), (("bank",), "bank"))
BANK_FORMS = "ао ооо тоо jsc llc llp ltd inc".split()
BANK_DETAILS = "бик bik swift bic бик/swift swift/bic iban иик р/с р/счет account счет бин иин инн адрес телефон email".split()
BANK_ENDINGS = "of the and de la имени".split()
#: Positions and their dictionary form.
POSITIONS = (
    (("генеральный", "директор"), "генеральный директор"), (("генерального", "директора"), "генеральный директор"), (("исполнительный", "директор"), "исполнительный директор"), (("исполнительного", "директора"), "исполнительный директор"),
    (("председатель", "правления"), "председатель правления"), (("председателя", "правления"), "председатель правления"), (("директор",), "директор"), (("директора",), "директор"), (("руководитель",), "руководитель"), (("руководителя",), "руководитель"),
    (("представитель",), "представитель"), (("представителя",), "представитель"), (("президент",), "президент"), (("управляющий",), "управляющий"), (("бухгалтер",), "бухгалтер"),
)
PERSON_CONTEXT = "лице директор директора руководитель руководителя представитель представителя председатель председателя президент управляющий подписант фио".split()
PERSON_SKIPS = "в лице генеральный генерального исполнительный исполнительного директор директора руководитель руководителя представитель представителя председатель председателя правления президент управляющий господин господина г-н".split()
PERSON_STOPS = "действующий действующего действующая действующей действующие действующих действует на основании устава доверенности именуемый именуемая именуемое далее бин инн иин подпись м.п".split()
NOT_NAMES = "республика казахстан кыргызстан россия сторона стороны договор общество товарищество компания банк заемщик займодавец поставщик покупатель заказчик исполнитель тест".split()
_NAME_LETTERS = "A-Za-zА-Яа-яЁёҚқҒғҢңҮүҰұІіҺһӘәӨө"
ADDRESS_ANCHORS = (("юридический", "адрес"), ("почтовый", "адрес"), ("фактический", "адрес"), ("адрес", "местонахождения"), ("место", "нахождения"), ("registered", "address"), ("legal", "address"), ("address",), ("адрес",), ("местонахождение",))
ADDRESS_WORDS = "республика область район город г улица ул проспект пр переулок пер шоссе набережная дом д корпус корп строение стр квартира кв офис помещение микрорайон мкр село аул поселок city street avenue road building office district region".split()
COUNTRY_WORDS = "казахстан россия кыргызстан узбекистан республика kz ru kg".split()
ADDRESS_STOPS = "бин иин инн бик swift bic iban иик р/с к/с счет account банк bank телефон тел email e-mail директор подпись".split()
#: Fixed values (as all lists of words from here and above): anchors and lengths of tax numbers.
TAX_IDS = {"bin": ("tax_id.bin.anchor_right.v2", ("бин", "бсн"), (12,)), "iin": ("tax_id.iin.anchor_right.v1", ("иин", "жсн"), (12,)), "inn": ("tax_id.inn.anchor_right.v1", ("инн",), (10, 12, 14))}
BIK_ANCHORS = ("бик", "bik", "мфо")
SWIFT_ANCHORS = ("swift", "bic", "бик/swift", "swift/бик", "bik/swift", "swift/bik", "bic/swift", "swift/bic")
IBAN_ANCHORS = (("иик",), ("iban",), ("р/с",), ("р/счет",), ("р/счёт",), ("расчетный", "счет"), ("расчётный", "счёт"), ("банковский", "счет"), ("банковский", "счёт"))
ACCOUNT_ANCHORS = (("р/с",), ("р/счет",), ("р/счёт",), ("account",), ("счет",), ("счёт",), ("расчетный", "счет"), ("расчётный", "счёт"), ("банковский", "счет"), ("банковский", "счёт"), ("корреспондентский", "счет"), ("корреспондентский", "счёт"), ("корр", "счет"), ("корр", "счёт"), ("к/с",))
NUMBER_SIGNS = ("№", "n", "no")


def _in(c: Column, words: Sequence[str]) -> Column:
    """Membership by one look at a list without commas: a list of literals would make the plan long, and a pattern reads the text anew."""
    return F.find_in_set(c, F.lit(",".join(words))) > 0


def _tokens(normalise: Callable[[Column], Column], words: Column | str = "words") -> Column:
    return F.transform(words, lambda w: normalise(w["q"]))


def _part(words: Column, s: Column, e: Column) -> Column:
    """words[s..e], both ends included; empty if e < s."""
    return F.slice(words, s + 1, F.greatest(e - s + 1, F.lit(0)))


def _joined(words: Column) -> Column:
    return F.btrim(F.array_join(words["q"], " "))


def mean_confidence(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.aggregate(words["c"], F.lit(0.0), lambda a, c: a + c) / F.size(words)).otherwise(0.0)


def _strings(**values: Column | str | None) -> Column:
    """A string map without the null entries."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def candidate(kind: str, rule: str, words: Column, value: Column, confidence: Column, *, anchors: Column | None = None, role: Column | None = None, party: Column | None = None, confirmed: Column | None = None, validation: Column | None = None, metadata: Column | None = None) -> Column:
    """The one candidate constructor: id, union box, confidence between 0 and 1."""
    page = F.col("page")
    ids = lambda some: F.transform(some["i"], lambda i: F.concat(F.lit("p"), page, F.lit("-w"), i))
    label = "money" if kind == "money_amount" else kind
    return let(words, lambda words: _candidate(kind, rule, label, page, ids, words, value, confidence, anchors, role, party, confirmed, validation, metadata))


def _candidate(kind: str, rule: str, label: str, page: Column, ids: Callable[[Column], Column], words: Column, value: Column, confidence: Column, anchors: Column | None, role: Column | None, party: Column | None, confirmed: Column | None, validation: Column | None, metadata: Column | None) -> Column:
    first, last = F.get(words, F.lit(0))["i"], F.element_at(words, -1)["i"]
    text_ = F.array_join(words["t"], " ")
    return F.struct(
        F.concat(F.lit(f"candidate-{label}-p"), page, F.lit("-w"), first, F.lit("-"), last).alias("id"),
        F.lit(kind).alias("entity_type"), F.lit(rule).alias("rule_id"), value.alias("value"), text_.alias("raw_value"), first.alias("first"), last.alias("last"), ids(words).alias("word_ids"),
        (ids(anchors) if anchors is not None else F.array().cast("array<string>")).alias("anchor_word_ids"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"),
        geometry.union_all(words["b"]).alias("bbox"),
        (role if role is not None else F.lit(None).cast("string")).alias("role_hint"), (party if party is not None else F.lit(None).cast("string")).alias("party_role_hint"),
        (confirmed if confirmed is not None else F.lit(False)).alias("ocr_confirmed"),
        (validation if validation is not None else _strings()).alias("validation"), (metadata if metadata is not None else _strings()).alias("metadata"),
    )


def _positions(words: Column | str = "words") -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))


def _present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


# --- values -----------------------------------------------------------------------------------------


def _line_text(words: Column | str = "words") -> Column:
    return F.lower(F.array_join((F.col(words) if isinstance(words, str) else words)["q"], " "))


def date_role() -> Column:
    return let(_line_text(), lambda t: F.when(t.contains("доверенност"), "power_of_attorney_date").when(t.contains("срок до") | t.contains("вернуть") & t.contains("года") | t.contains("погашен"), "repayment_due_date").when(t.contains("начиная с") | t.contains("начисляются") | t.contains("начисление"), "interest_start_date").when((F.col("page") == 1) & (F.col("line_index") <= 5), "contract_date").otherwise("general_date"))


def dates() -> Column:
    rule = "document.date.patterns.v1"

    def made(words: Column, y: Column, m: Column, d: Column, form: str) -> Column:
        def build(value: Column, role: Column) -> Column:
            confidence = F.lit(0.20) + 0.35 + 0.30 + F.when(role != "general_date", 0.05).otherwise(0.0) + mean_confidence(words) * 0.10
            return candidate("date", rule, words, value, confidence, role=role, validation=_strings(format="iso_date", status="valid", date_format=form))

        return let(checks.calendar_date(y, m, d), lambda value: F.when(value.isNotNull(), let(date_role(), lambda role: build(value, role))))

    def numeric(i: Column) -> Column:
        w = F.get("words", i)
        pattern = r"(?iu)^([0-9]{1,2})[./\-]([0-9]{1,2})[./\-]([0-9]{4})(?:\s*г(?:ода)?\.?)?$"
        token = text.strip(w["q"])
        part = lambda n: F.regexp_extract(token, pattern, n).try_cast("int")
        return F.when(token.rlike(pattern), made(F.array(w), part(3), part(2), part(1), "numeric"))

    def written(i: Column) -> Column:
        words = F.slice("words", i + 1, F.lit(3))
        day, year = text.strip(F.get(words, F.lit(0))["q"]), text.strip(F.get(words, F.lit(2))["q"])
        m = checks.month(text.token(F.get(words, F.lit(1))["q"]))
        fits = (F.size(words) == 3) & day.rlike("^[0-9]{1,2}$") & year.rlike("^[0-9]{4}$") & m.isNotNull()
        return F.when(fits, made(words, year.try_cast("int"), m, day.try_cast("int"), "textual"))

    return _present(F.concat(F.transform(_positions(), numeric), F.transform(_positions(), written)))


def money(max_words: int = 6) -> Column:
    rule = "document.money_amount.currency.v1"
    known = let(_line_text(), lambda t: F.when(t.contains("сумма займа") | t.contains("размере") | t.contains("денежные средства"), "principal_amount").when(t.contains("пеня"), "penalty_amount").when(t.contains("процент") & t.contains("уплат"), "interest_amount").otherwise("general_money_amount"))

    def one(m: Column) -> Column:
        before = F.reverse(F.slice("words", F.greatest(m["s"] - max_words, F.lit(0)) + 1, F.least(m["s"], F.lit(max_words))))
        number = lambda w: F.btrim(w["q"]).rlike(r"^[0-9\s.,'’]+$") & w["q"].rlike("[0-9]")
        run = F.aggregate(before, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, w: F.struct((a["n"] + (a["go"] & number(w)).cast("int")).alias("n"), (a["go"] & number(w)).alias("go")))["n"]

        def made(words: Column, value: Column, role: Column) -> Column:
            confidence = F.lit(0.20) + 0.30 + 0.25 + F.when(role != "general_money_amount", 0.05).otherwise(0.0) + mean_confidence(words) * 0.10
            return candidate("money_amount", rule, words, value, confidence, role=role, validation=_strings(format="decimal_money", status="valid", currency=m["v"]), metadata=_strings(currency=m["v"]))

        def with_amount(n: Column) -> Column:
            words = _part(F.col("words"), m["s"] - n, m["e"])
            amount = checks.amount(F.array_join(_part(F.col("words"), m["s"] - n, m["s"] - 1)["q"], ""))
            return F.when(n > 0, let(amount, lambda value: F.when(value.isNotNull(), let(known, lambda role: made(words, value, role)))))

        return let(run, with_amount)

    return _present(F.transform(text.phrases(_tokens(text.token), CURRENCIES), one))


def percentages() -> Column:
    rule = "document.percentage.patterns.v1"

    def known(t: Column) -> Column:
        annual = (t.contains("годовых") | t.contains("годовая") | t.contains("годовой")) & (t.contains("ставк") | t.contains("процент") | t.contains("займ"))
        return F.when(annual, "annual_interest_rate").when(t.contains("пен"), "penalty_rate").when(t.contains("комисси"), "commission_rate").otherwise("general_percentage")

    def one(i: Column) -> Column:
        w, following = F.get("words", i), F.get("words", i + 1)
        whole = F.btrim(w["q"])
        number = text.strip(whole)
        glued = whole.rlike(r"^[0-9]+(?:[.,][0-9]+)?\s*%$")
        apart = ~glued & number.rlike(r"^[0-9]+(?:[.,][0-9]+)?$") & _in(F.coalesce(text.token(following["q"]), F.lit("")), PERCENT_WORDS)
        value = checks.percent(F.when(glued, F.regexp_extract(whole, "^([0-9.,]+)", 1)).otherwise(number))

        def made(words: Column, role: Column) -> Column:
            confidence = F.lit(0.25) + 0.40 + F.when(role != "general_percentage", 0.15).otherwise(0.0) + mean_confidence(words) * 0.10
            return candidate("percentage", rule, words, value, confidence, role=role, validation=_strings(format="percentage", status="valid", unit="percent"), metadata=_strings(period=F.when(role == "annual_interest_rate", "annual")))

        return F.when(glued | apart, let(F.when(glued, F.array(w)).otherwise(F.array(w, following)), lambda words: let(let(_line_text(), known), lambda role: made(words, role))))

    return _present(F.transform(_positions(), one))


# --- numbers right of an anchor ---------------------------------------------------------------------


def _prefix(start: Column, most: int, allowed: str, normalise: Callable[[Column], Column], valid: Callable[[Column], Column], *, longest: bool, limit: int | None = None) -> Column:
    """struct<n, v>: the words of a value that starts at a position: the longest valid prefix, or the first; the search ends at the first prefix that can't be one."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v"), F.lit(True).alias("go"))

    def step(acc: Column, k: Column) -> Column:
        def look(t: Column) -> Column:
            def judge(v: Column) -> Column:
                dead = (start + k > F.size("words")) | (t == "") | ~t.rlike(allowed) | (F.length(v) > limit if limit else F.lit(False))
                better = valid(v) & (acc["v"].isNull() | (F.length(v) >= F.length(acc["v"])))
                return F.when(~acc["go"] | dead, F.struct(acc["n"].alias("n"), acc["v"].alias("v"), F.lit(False).alias("go"))).when(better, F.struct(k.alias("n"), v.alias("v"), F.lit(longest).alias("go"))).otherwise(acc)

            return let(normalise(t), judge)

        return let(_joined(F.slice("words", start + 1, k)), look)

    return F.when(start < F.size("words"), F.aggregate(F.sequence(F.lit(1), F.lit(most)), begin, step))


def _confirmed(words: Column, kinds: Sequence[str], value: Column, normalise: Callable[[Column], Column]) -> Column:
    """Whether the recogniser read the same value of an allowed kind in these words."""
    return F.exists(words, lambda w: F.exists(F.coalesce(w["v"], F.array().cast("array<struct<type:string,value:string>>")), lambda x: F.lower(x["type"]).isin(list(kinds)) & (normalise(x["value"]) == value)))


def _anchored_words(kind: str, rule: str, anchors: Sequence[str], normalise_anchor: Callable[[Column], Column], most_gap: float, most_words: int, allowed: str, normalise: Callable[[Column], Column], valid: Callable[[Column], Column], kinds: Sequence[str], form: str, limit: int | None = None) -> Column:
    """A rule whose anchor is one word and whose value is the longest valid prefix right of it."""

    def one(i: Column) -> Column:
        anchor = F.get("words", i)
        gap = geometry.horizontal_gap(anchor["b"], F.get("words", i + 1)["b"])

        def with_value(p: Column) -> Column:
            words = F.slice("words", i + 2, p["n"])
            return F.when(p["v"].isNotNull(), let(_confirmed(words, kinds, p["v"], normalise), lambda sure: made(p, words, sure)))

        def made(p: Column, words: Column, sure: Column) -> Column:
            confidence = F.lit(0.20) + 0.30 + 0.25 + checks.gap_score(gap, most_gap) + mean_confidence(words) * 0.10 + F.when(p["n"] == 1, 0.05).otherwise(0.0) + F.when(sure, 0.10).otherwise(0.0)
            return candidate(kind, rule, words, p["v"], confidence, anchors=F.array(anchor), confirmed=sure, validation=_strings(format=form, status="shape_valid"), metadata=_strings(anchor_text=anchor["t"]))

        found = _in(normalise_anchor(anchor["q"]), anchors) & (i + 1 < F.size("words")) & (gap <= most_gap)
        return F.when(found, let(_prefix(i + 1, most_words, allowed, normalise, valid, longest=True, limit=limit), with_value))

    return _present(F.transform(_positions(), one))


def tax_ids(kind: str) -> Column:
    rule, anchors, lengths = TAX_IDS[kind]
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return _anchored_words(kind, rule, anchors, text.token, 0.05, 4, r"^[0-9\s.,\-]+$", digits, lambda v: F.length(v).isin(list(lengths)), (kind,), "kz_" + kind if kind != "inn" else "tax_identifier", limit=max(lengths))


def bik() -> Column:
    return _anchored_words("bik", "bank.bik.anchor_right.v1", BIK_ANCHORS, text.path_token, 0.06, 3, r"^[A-Za-z0-9\s.,\-]+$", text.compact, lambda v: v.rlike("^[A-Z0-9]{6,11}$"), ("bik",), "bank_identifier_code")


def swift() -> Column:
    return _anchored_words("bic_swift", "bank.bic_swift.anchor_right.v1", SWIFT_ANCHORS, text.path_token, 0.06, 3, r"^[A-Za-z0-9\s.,\-]+$", text.compact, lambda v: v.rlike("^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$"), ("bic_swift", "swift", "bic"), "swift_bic")


def _account_rule(kind: str, rule: str, anchors: Sequence[Sequence[str]], normalise: Callable[[Column], Column], valid: Callable[[Column], Column], kinds: Sequence[str], form: str, checksum: Callable[[Column], Column] | None, most_gap: float = 0.12, most_words: int = 5) -> Column:
    """A rule whose anchor is a phrase, perhaps with a number sign behind it, and whose value is the first valid prefix."""

    def one(m: Column) -> Column:
        sign = lambda i: _in(F.coalesce(text.token(F.get("words", i)["q"]), F.lit("")), NUMBER_SIGNS)
        start = F.aggregate(F.sequence(F.lit(1), F.lit(8)), m["e"] + 1, lambda s, _: F.when(sign(s), s + 1).otherwise(s))

        def at(s: Column) -> Column:
            gap = geometry.horizontal_gap(F.get("words", m["e"])["b"], F.get("words", s)["b"])

            def with_value(p: Column) -> Column:
                words = F.slice("words", s + 1, p["n"])
                judged = F.struct(_confirmed(words, kinds, p["v"], normalise).alias("sure"), (checksum(p["v"]) if checksum else F.lit(None).cast("boolean")).alias("good"))
                return F.when(p["v"].isNotNull(), let(judged, lambda x: made(p, words, x["sure"], x["good"])))

            def made(p: Column, words: Column, sure: Column, good: Column) -> Column:
                marks = _part(F.col("words"), m["s"], m["e"])
                confidence = F.lit(0.15) + 0.30 + 0.25 + checks.gap_score(gap, most_gap) + mean_confidence(words) * 0.10 + F.when(p["n"] == 1, 0.05).otherwise(0.0) + F.when(sure, 0.10).otherwise(0.0) + F.when(good, 0.10).when(~good, -0.08).otherwise(0.0)
                status = F.when(good.isNull(), "unverified").when(good, "valid").otherwise("checksum_invalid")
                return candidate(kind, rule, words, p["v"], confidence, anchors=marks, confirmed=sure, validation=_strings(format=form, status=status, checksum_valid=good), metadata=_strings(anchor_text=m["v"]))

            return F.when((s < F.size("words")) & (gap <= most_gap), let(_prefix(s, most_words, r"^[A-Za-zА-Яа-яЁё0-9\s.,\-_/]+$", normalise, valid, longest=False), with_value))

        return let(start, at)

    return _present(F.transform(text.phrases(_tokens(text.path_token), [(a, " ".join(a)) for a in anchors]), one))


def kz_iban() -> Column:
    def normalise(c: Column) -> Column:
        return let(text.compact(c), lambda v: F.concat(F.substring(v, 1, 2), F.translate(F.substring(v, 3, 2), "OILSB", "01158"), F.substring(v, 5, 200)))

    return _account_rule("iban", "bank.iban.kz.anchor_right.v1", IBAN_ANCHORS, normalise, lambda v: v.rlike("^KZ[0-9]{2}[A-Z0-9]{16}$"), ("account", "iban"), "kz_iban", checks.mod97)


def bank_accounts() -> Column:
    valid = lambda v: v.rlike("^[A-Z0-9]{6,34}$") & ~v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$") & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4)
    return _account_rule("bank_account", "bank.account.anchor_right.v1", ACCOUNT_ANCHORS, text.compact, valid, ("account", "bank_account"), "generic_bank_account", None)


# --- parties ----------------------------------------------------------------------------------------


#: Lines of a region that rules see above and below a line.
BEFORE, AFTER = 3, 2


def with_neighbours(lines: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Lines with ``above`` and ``below``: the words of neighbours in the region, nearest first, and ``context``: folded texts from before to after."""
    order = Window.partitionBy("doc_id", "page", "region").orderBy(F.col("bbox.y1"), F.col("bbox.x1"), "line_index")
    words = lambda frame: F.collect_list("words").over(frame)
    above = F.reverse(words(order.rowsBetween(-before, -1)))
    below = words(order.rowsBetween(1, after))
    return lines.withColumn("above", above).withColumn("below", below)


def _text_of(words: Column) -> Column:
    return text.folded(F.array_join(words["q"], " "))


def party_role(start: Column, end: Column) -> Column:
    """The role for a span: in the text after it, then the two lines below, the text before it, the two lines above; null if none tells."""
    role = lambda words: text.first_role(_text_of(words), ROLES)
    at = lambda column, i: role(F.get(column, F.lit(i)))
    return F.coalesce(role(F.slice("words", end + 2, F.size("words"))), at("below", 0), at("below", 1), role(F.slice("words", F.lit(1), F.greatest(start, F.lit(0)))), at("above", 0), at("above", 1))


def _take(words: Column, most: int, stop: Callable[[Column], Column], skip: Callable[[Column], Column], last: Callable[[Column], Column] | None = None) -> Column:
    """Words until one stops (excluded) or is a last one (included), without skipped ones, at most ``most``."""
    begin = F.struct(F.array().cast(f"array<{WORD}>").alias("o"), F.lit(True).alias("go"))

    def step(a: Column, w: Column) -> Column:
        ended = ~a["go"] | stop(w) | (F.size(a["o"]) >= most)
        return F.when(ended, F.struct(a["o"].alias("o"), F.lit(False).alias("go"))).when(skip(w), a).otherwise(F.struct(F.concat(a["o"], F.array(w)).alias("o"), (~last(w) if last else F.lit(True)).alias("go")))

    return F.aggregate(words, begin, step, lambda a: a["o"])


def organizations(max_words: int = 10) -> Column:
    rule = "legal.organization.legal_form.v2"

    def one(m: Column) -> Column:
        form = _part(F.col("words"), m["s"], m["e"])
        token = lambda w: text.party_token(w["q"])
        name = _take(F.slice("words", m["e"] + 2, F.size("words")), max_words, lambda w: _in(token(w), ORGANIZATION_STOPS), lambda w: token(w) == "", lambda w: w["t"].rlike(r"[,;]\s*$"))

        def build(n: Column) -> Column:
            return let(F.slice(F.concat(form, n), F.lit(1), F.greatest(F.lit(max_words), F.size(form))), lambda words: let(text.clean_value(words["t"]), lambda value: judge(words, value)))

        def judge(words: Column, value: Column) -> Column:
            bank = F.arrays_overlap(F.regexp_extract_all(text.folded(value), F.lit("[a-zа-я]+"), F.lit(0)), F.array(*map(F.lit, BANK_WORDS)))
            fine = (F.size(words) > F.size(form)) & F.exists(F.slice(words, F.size(form) + 1, F.lit(max_words)), lambda w: w["t"].rlike(r"\p{L}")) & ~bank
            return F.when(fine, let(party_role(m["e"], m["e"]), lambda role: made(words, value, role)))

        def made(words: Column, value: Column, role: Column) -> Column:
            confidence = F.lit(0.20) + 0.40 + 0.20 + F.when(role.isNotNull(), 0.10).otherwise(0.0) + mean_confidence(words) * 0.10
            return candidate("organization", rule, words, value, confidence, role=F.coalesce(role, F.lit("unknown")), validation=_strings(format="legal_entity_name", status="context_match", legal_form=m["v"]), metadata=_strings(legal_form=m["v"]))

        return let(name, build)

    return _present(F.transform(text.phrases(_tokens(text.party_token), [([text_.replace("ё", "е") for text_ in a], v) for a, v in LEGAL_FORMS]), one))


def bank_names(max_words: int = 12, max_lines: int = 3) -> Column:
    rule = "legal.bank_name.context.v2"
    token = lambda w: text.party_token(w["q"])
    collect = lambda words: _take(words, max_words, lambda w: _in(token(w), BANK_DETAILS), lambda w: token(w) == "")

    def anchor(words: Column) -> Column:
        """The first explicit anchor: of one word only at the line's start or before a colon."""

        def at(tokens: Column, i: Column) -> Column:
            found = F.lit(None).cast("struct<s:int,e:int,v:string>")
            for alias, role in sorted(BANK_ANCHORS, key=lambda a: len(a[0])):
                same = F.lit(True)
                for j, part in enumerate(alias):
                    same = same & (F.coalesce(F.get(tokens, i + j), F.lit("")) == part)
                if len(alias) == 1:
                    same = same & ((i == 0) | F.btrim(F.get(words, i)["t"]).endswith(":"))
                found = F.when(same, F.struct(i.alias("s"), (i + len(alias) - 1).alias("e"), F.lit(role).alias("v"))).otherwise(found)
            return found

        return let(F.transform(words, token), lambda tokens: F.get(_present(F.transform(_positions(words), lambda i: at(tokens, i))), F.lit(0)))

    def goes_on(words: Column) -> Column:

        def judge(value: Column) -> Column:
            count = lambda ch: F.length(value) - F.length(F.replace(value, F.lit(ch), F.lit("")))
            ending = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text.folded(value), F.lit("[a-zа-я]+"), F.lit(0))), -1)
            return _in(ending, BANK_ENDINGS) | (count("«") > count("»")) | (count('"') % 2 == 1)

        return let(text.clean_value(words["t"]), judge)

    def continued(first: Column, correspondent: Column) -> Column:
        """The first line's words and those of the lines below, as long as the name goes on."""

        def below(words: Column, go: Column, k: int) -> Column:
            if k == max_lines - 1:
                return words
            line = F.get("below", F.lit(k))
            fits = line.isNotNull() & ~_in(F.coalesce(token(F.get(line, F.lit(0))), F.lit("")), BANK_DETAILS) & anchor(line).isNull()
            more = lambda some: F.when(F.size(some) > 0, let(F.concat(words, some), lambda longer: below(longer, (F.size(longer) < max_words) & goes_on(longer), k + 1))).otherwise(words)
            return F.when(go & fits, let(collect(line), more)).otherwise(words)

        return below(first, correspondent | goes_on(first), 0)

    def made(words: Column, marks: Column, role: Column, explicit: bool) -> Column:
        return let(text.clean_value(words["t"]), lambda value: let(F.regexp_extract_all(text.folded(value), F.lit("[a-zа-я]+"), F.lit(0)), lambda named: judged(words, value, named, marks, role, explicit)))

    def judged(words: Column, value: Column, named: Column, marks: Column, role: Column, explicit: bool) -> Column:
        column = F.coalesce(F.col("region").isin("left_column", "right_column"), F.lit(False))
        confidence = F.lit(0.15) + (0.40 if explicit else 0.35) + 0.25 + F.when(column, 0.10).otherwise(0.0) + mean_confidence(words) * 0.10
        fine = F.size(named).between(1, max_words) & (F.lit(True) if explicit else F.arrays_overlap(named, F.array(*map(F.lit, BANK_WORDS))))
        return F.when(fine, candidate("bank_name", rule, words, value, confidence, anchors=marks, role=role, validation=_strings(format="bank_name", status="context_match")))

    def explicit(a: Column) -> Column:
        def build(first: Column) -> Column:
            return F.when(F.size(first) > 0, let(continued(first, a["v"] == "correspondent_bank"), lambda words: made(words, _part(F.col("words"), a["s"], a["e"]), a["v"], True)))

        return let(collect(F.slice("words", a["e"] + 2, F.size("words"))), build)

    forms = F.filter(F.transform("words", lambda w, i: F.when(_in(token(w), BANK_FORMS), i)), lambda i: i.isNotNull())
    empty = F.array().cast(f"array<{WORD}>")

    def formed(at: Column) -> Column:
        tail = F.slice("words", at + 1, F.size("words"))
        by_form = at.isNotNull() & F.exists(tail, lambda w: _in(token(w), BANK_WORDS)) & ~((F.coalesce(F.col("region"), F.lit("")) == "body") & (F.size("words") > 8))
        return F.when(by_form, let(collect(tail), lambda words: F.when(F.size(words) > 0, made(words, empty, F.lit("bank"), False))))

    implicit = let(F.get(forms, F.lit(0)), formed)
    return _present(F.array(let(anchor(F.col("words")), lambda a: F.when(a.isNotNull(), explicit(a)).otherwise(implicit))))


def positions() -> Column:
    rule = "legal.position.dictionary.v2"

    def one(m: Column) -> Column:
        words = _part(F.col("words"), m["s"], m["e"])
        role = party_role(m["e"], m["e"])
        return candidate("position", rule, words, m["v"], F.lit(0.25) + 0.50 + mean_confidence(words) * 0.10, party=role, role=F.lit("representative_position"), validation=_strings(format="position", status="dictionary_match"))

    return F.transform(text.phrases(_tokens(text.party_token), POSITIONS), one)


def persons(max_words: int = 4, strict: bool = False) -> Column:
    """``strict`` accepts a single word only if it holds initials written with dots."""
    rule = "legal.person_name.context.v2"
    token = lambda w: text.party_token(w["q"])
    bare = lambda w: text.strip(w["t"])
    name = lambda w: bare(w).rlike(f"^[{_NAME_LETTERS}-]{{2,}}$") & ~_in(text.party_token(bare(w)), NOT_NAMES)
    initials = lambda w: F.regexp_replace(bare(w), r"\s+", "").rlike(rf"^(?:[{_NAME_LETTERS}]\.?){{1,3}}$")
    surname = lambda w: F.regexp_replace(bare(w), r"[\s.]", "").rlike(rf"^[{_NAME_LETTERS}-]{{2,}}(?:[{_NAME_LETTERS}]\.?){{1,3}}$") & (bare(w).contains(".") if strict else F.lit(True))
    part = lambda w: name(w) | initials(w) | surname(w)
    begin = F.struct(F.array().cast(f"array<{WORD}>").alias("o"), F.lit(True).alias("go"))

    def collect(words: Column) -> Column:
        def step(a: Column, w: Column) -> Column:
            none = F.size(a["o"]) == 0
            stop = F.struct(a["o"].alias("o"), F.lit(False).alias("go"))

            def judge(t: Column) -> Column:
                ended = (F.size(a["o"]) >= max_words) | _in(t, PERSON_STOPS) & ~(none & _in(t, PERSON_SKIPS))
                return F.when(ended, stop).when(none & _in(t, PERSON_SKIPS), a).when(part(w), F.struct(F.concat(a["o"], F.array(w)).alias("o"), F.lit(True).alias("go"))).when(none, a).otherwise(stop)

            return F.when(a["go"], let(token(w), judge)).otherwise(a)

        return F.when(words.isNotNull(), F.aggregate(words, begin, step, lambda a: a["o"])).otherwise(F.array().cast(f"array<{WORD}>"))

    def valid(words: Column) -> Column:
        names, marks = F.size(F.filter(words, lambda w: name(w) & ~initials(w))), F.size(F.filter(words, initials))
        return F.when(F.size(words) == 0, False).when(F.size(words) == 1, surname(F.get(words, F.lit(0)))).otherwise((names >= 2) | (names >= 1) & (marks >= 1))

    def one(i: Column) -> Column:
        rest = F.slice("words", i + 2, F.size("words"))
        stopped = _in(F.coalesce(token(F.get(F.get("below", F.lit(0)), F.lit(0))), F.lit("")), PERSON_STOPS)

        def valid_or(words: Column, other: Column) -> Column:
            return let(collect(words), lambda some: F.when(valid(some), some).otherwise(other))

        def choose(words: Column) -> Column:
            return F.when(words.isNotNull(), let(F.coalesce(party_role(i, i), text.first_role(_text_of(F.get("above", F.lit(2))), ROLES)), lambda role: made(words, role)))

        def made(words: Column, role: Column) -> Column:
            confidence = F.lit(0.20) + 0.40 + 0.25 + F.when(role.isNotNull(), 0.05).otherwise(0.0) + mean_confidence(words) * 0.10
            return candidate("person_name", rule, words, text.clean_value(words["t"]), confidence, anchors=F.array(F.get("words", i)), role=F.lit("representative"), party=role, validation=_strings(format="person_name", status="context_match"))

        none = F.lit(None).cast(f"array<{WORD}>")
        last = F.when(~stopped, valid_or(F.get("below", F.lit(1)), none))
        return F.when(_in(token(F.get("words", i)), PERSON_CONTEXT), let(valid_or(rest, valid_or(F.get("below", F.lit(0)), last)), choose))

    return _present(F.transform(_positions(), one))


def address_score(words: Column) -> Column:
    """Signs of an address in a line: a postal code counts 2, markers up to 3, a country and a number with a slash 1 each."""
    some = lambda a, f: F.exists(a, f).cast("int")
    slashed = some(words["q"], lambda q: q.contains("/") & q.rlike("[0-9]"))
    return let(F.transform(words["q"], text.party_token), lambda t: 2 * some(t, lambda x: x.rlike("^[0-9]{5,6}$")) + F.least(F.lit(3), F.size(F.filter(t, lambda x: _in(x, ADDRESS_WORDS)))) + some(t, lambda x: _in(x, COUNTRY_WORDS))) + slashed


def addresses(max_lines: int = 3, least: int = 2) -> Column:
    rule = "legal.address.context.v1"
    token = lambda w: text.party_token(w["q"])

    def continued(first: Column) -> Column:
        def below(words: Column, k: int) -> Column:
            if k == max_lines - 1:
                return words
            line = F.get("below", F.lit(k))
            go = line.isNotNull() & ~F.exists(line, lambda w: _in(token(w), ADDRESS_STOPS)) & (address_score(line) >= 1)
            return F.when(go, let(F.concat(words, line), lambda longer: below(longer, k + 1))).otherwise(words)

        return below(first, 0)

    def made(words: Column, marks: Column, anchor: Column) -> Column:
        score = F.size(F.filter(words, lambda w: _in(token(w), ADDRESS_WORDS))) + 2 * F.exists(words, lambda w: token(w).rlike("^[0-9]{5,6}$")).cast("int")
        role = F.when(anchor.contains("юридический") | anchor.contains("registered") | anchor.contains("legal"), "legal_address").when(anchor.contains("почтовый"), "postal_address").when(anchor.contains("фактический"), "actual_address").otherwise("address")
        confidence = F.lit(0.20) + F.when(anchor.isNotNull(), 0.35).otherwise(0.0) + F.least(F.lit(0.30), score * 0.06) + mean_confidence(words) * 0.10
        value = text.clean_value(F.transform(words, lambda w: w["t"]), " \t\r\n,;:–—-")
        postal = F.get(F.filter(F.transform(words, token), lambda x: x.rlike("^[0-9]{5,6}$")), F.lit(0))
        return F.when((F.size(words) > 0) & (value != ""), candidate("address", rule, words, value, confidence, anchors=marks, role=role, validation=_strings(format="address", status="context_match", postal_code=postal)))

    first = F.get(text.phrases(_tokens(text.party_token), [(a, " ".join(a)) for a in ADDRESS_ANCHORS]), F.lit(0))
    empty = F.array().cast(f"array<{WORD}>")

    def by_anchor(a: Column) -> Column:
        anchored = let(continued(F.slice("words", a["e"] + 2, F.size("words"))), lambda words: made(words, _part(F.col("words"), a["s"], a["e"]), a["v"]))
        free = F.when(address_score(F.col("words")) >= least, let(continued(F.col("words")), lambda words: made(words, empty, F.lit(None).cast("string"))))
        return F.when(a.isNotNull(), anchored).otherwise(free)

    return _present(F.array(let(first, by_anchor)))


#: rule_id, expression, and the least confidence of its candidates, in the order in which rules run.
RULES: tuple[tuple[str, Callable[[], Column], float], ...] = (
    ("document.date.patterns.v1", dates, 0.45), ("document.money_amount.currency.v1", money, 0.45), ("document.percentage.patterns.v1", percentages, 0.45),
    ("legal.organization.legal_form.v2", organizations, 0.45), ("legal.bank_name.context.v2", bank_names, 0.45), ("legal.position.dictionary.v2", positions, 0.45), ("legal.person_name.context.v2", persons, 0.45), ("legal.address.context.v1", addresses, 0.45),
    ("tax_id.bin.anchor_right.v2", lambda: tax_ids("bin"), 0.40), ("tax_id.iin.anchor_right.v1", lambda: tax_ids("iin"), 0.40), ("tax_id.inn.anchor_right.v1", lambda: tax_ids("inn"), 0.40),
    ("bank.bik.anchor_right.v1", bik, 0.45), ("bank.bic_swift.anchor_right.v1", swift, 0.45), ("bank.iban.kz.anchor_right.v1", kz_iban, 0.45), ("bank.account.anchor_right.v1", bank_accounts, 0.45),
)


def hay(words: Column | str = "words") -> Column:
    """A line's text for triggers: lower case, ё as е, one slash for a run of slashes of either kind; texts without these signs are not rewritten."""
    plain = lambda t: F.when(t.contains("ё") | t.contains("\\"), F.translate(t, "ё\\", "е/")).otherwise(t)
    return let(let(_line_text(words), plain), lambda t: F.when(t.contains("//"), F.regexp_replace(t, "/+", "/")).otherwise(t))


_BEFORE, _AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _any(words: Sequence[str]) -> str:
    """A pattern for one of some words, each between characters that are no letters or digits; a look at the first character spares most places the look behind."""
    some = _folded(words)
    first = "".join(sorted({re.escape(w[0]) for w in some}))
    return f"(?=[{first}]){_BEFORE}(?:{'|'.join(map(re.escape, some))}){_AFTER}"


def _folded(words: Sequence[str]) -> list[str]:
    return sorted({w.replace("ё", "е") for w in words})


def _least(words: Sequence[str]) -> tuple[str, ...]:
    """Of some words those that hold no other: a text that holds one of all holds one of these."""
    some = _folded(words)
    return tuple(w for w in some if not any(v != w and v in w for v in some))


def fits(rule_id: str) -> Column:
    """Whether a line fits a default rule's trigger.  A look for its words' bytes spares most lines the pattern."""
    found = F.col("__hay").rlike(TRIGGERS[rule_id])
    some = [F.col("__hay").contains(w) for w in HOLDS.get(rule_id, ())]
    return reduce(or_, some) & found if some else found


def triggered(words: Column, rule_ids: Sequence[str]) -> Column:
    """Whether a line fits a trigger of these rules.

    A pattern that fits the line as it stands wherever a trigger fits its ``hay`` comes
    first, so that most lines are not folded: it takes letters of either case, ё for е,
    any slashes for one, and no heed of what stands before and after.
    """
    whole = "|".join(f"(?:{TRIGGERS[k]})" for k in rule_ids)
    loose = "(?iu)" + whole.replace(_BEFORE, "").replace(_AFTER, "").replace("е", "[её]").replace("/", r"[/\\]+")
    return F.array_join(words["q"], " ").rlike(loose) & hay(words).rlike(whole)


#: What a line must hold for a rule to find anything in it: a cheap test that spares most lines the rule.
TRIGGERS = {
    "document.date.patterns.v1": "(?=[0-9])(?<![0-9])[0-9]{4}(?![0-9])",
    "document.money_amount.currency.v1": _any([a[0] for a, _ in CURRENCIES]),
    "document.percentage.patterns.v1": "%|процент|percent",
    "legal.organization.legal_form.v2": _any([a[0] for a, _ in LEGAL_FORMS]),
    "legal.bank_name.context.v2": "банк|bank",
    "legal.position.dictionary.v2": _any([a[0] for a, _ in POSITIONS]),
    "legal.person_name.context.v2": _any(PERSON_CONTEXT),
    "legal.address.context.v1": "|".join(("(?=[0-9])(?<![0-9])[0-9]{5,6}(?![0-9])", _any([a[0] for a in ADDRESS_ANCHORS]), _any([*ADDRESS_WORDS, *COUNTRY_WORDS]))),
    "tax_id.bin.anchor_right.v2": _any(TAX_IDS["bin"][1]),
    "tax_id.iin.anchor_right.v1": _any(TAX_IDS["iin"][1]),
    "tax_id.inn.anchor_right.v1": _any(TAX_IDS["inn"][1]),
    "bank.bik.anchor_right.v1": _any(BIK_ANCHORS),
    "bank.bic_swift.anchor_right.v1": _any(SWIFT_ANCHORS),
    "bank.iban.kz.anchor_right.v1": _any([a[0] for a in IBAN_ANCHORS]),
    "bank.account.anchor_right.v1": _any([a[0] for a in ACCOUNT_ANCHORS]),
}
#: Texts of which a line that fits a trigger holds one, where they are not as short as a letter.
HOLDS = {
    "document.money_amount.currency.v1": _least([a[0] for a, _ in CURRENCIES]),
    "document.percentage.patterns.v1": _least(("%", "процент", "percent")),
    "legal.organization.legal_form.v2": _least([a[0] for a, _ in LEGAL_FORMS]),
    "legal.bank_name.context.v2": BANK_WORDS[:2],
    "legal.position.dictionary.v2": _least([a[0] for a, _ in POSITIONS]),
    "legal.person_name.context.v2": _least(PERSON_CONTEXT),
    "tax_id.bin.anchor_right.v2": _least(TAX_IDS["bin"][1]),
    "tax_id.iin.anchor_right.v1": _least(TAX_IDS["iin"][1]),
    "tax_id.inn.anchor_right.v1": _least(TAX_IDS["inn"][1]),
    "bank.bik.anchor_right.v1": _least(BIK_ANCHORS),
    "bank.bic_swift.anchor_right.v1": _least(SWIFT_ANCHORS),
    "bank.iban.kz.anchor_right.v1": _least([a[0] for a in IBAN_ANCHORS]),
    "bank.account.anchor_right.v1": _least([a[0] for a in ACCOUNT_ANCHORS]),
}
#: Rules that look at other lines.
CROSS_LINE = {"legal.organization.legal_form.v2", "legal.bank_name.context.v2", "legal.position.dictionary.v2", "legal.person_name.context.v2", "legal.address.context.v1"}
