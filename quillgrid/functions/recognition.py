"""Recognised text put right: Unicode forms, identifiers with look-alike characters, bank codes and account numbers.

Everything but the compatibility form (NFKC) is a column expression; that form has no
built-in function, so it is one Arrow-batched call per column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import mod97
from .text import let

#: Zero-width characters and the soft hyphen, dashes, and white space that may edge a line.
INVISIBLE, DASHES = "­​‌‍﻿", "‐‑‒–—―−"
_BLANK = r" \t\f\x0B\x1C-\x1F\x85   -     　"
#: Signs that stand for letters in recognised identifiers.
SIGNS = ("$§@€£|!®©", "SSAELIIRC")
#: Cyrillic letters that look like Latin ones.
LOOKALIKES = ("АВСЕНІКМОРТХУЗавсенікмортхуз", "ABCEHIKMOPTXYZABCEHIKMOPTXYZ")
#: Characters that stand for digits in recognised numbers.
DIGIT_LOOKALIKES = ("OОQDIІlL|!ZЗS$GB", "0000111111235568")
#: Words that recognition is known to get wrong.
KNOWN_WORDS = ((r"\bзаимодавец\b", "займодавец"), (r"\bbuk\s*/\s*swift\b", "бик/swift"), (r"\bbik\s*/\s*swift\b", "бик/swift"), (r"\bвик\s*/\s*swift\b", "бик/swift"))
_KEPT_SIGN = ""

VALUE = "struct<value:string,format:string,shape:boolean,checksum:boolean,format_valid:boolean,corrections:array<string>>"


def _compatible(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return nfkc(c)


def unified(c: Column) -> Column:
    """Compatibility form, but № stays; no invisible characters, plain spaces and hyphens."""
    return F.translate(_compatible(F.translate(c, "№", _KEPT_SIGN)), _KEPT_SIGN + " " + DASHES + INVISIBLE, "№ " + "-" * len(DASHES))


def normal_text(c: Column, lower: bool = True) -> Column:
    """Unified text with single spaces, trimmed lines, one empty line at most, ё as е and known words put right."""
    lines = F.regexp_replace(F.regexp_replace(unified(c), "\r\n?", "\n"), r"[ \t\f\x0B]+", " ")
    trimmed = F.regexp_replace(F.regexp_replace(lines, rf"(?dm)^[{_BLANK}]+|[{_BLANK}]+$", ""), "\n{3,}", "\n\n")
    out = F.translate(F.regexp_replace(trimmed, rf"^[\n{_BLANK}]+|[\n{_BLANK}]+\z", ""), "ёЁ", "еЕ")
    out = F.lower(out) if lower else out
    for pattern, word in KNOWN_WORDS:
        out = F.regexp_replace(out, f"(?iuU){pattern}", word)
    return out


def compact(c: Column) -> Column:
    """An identifier: signs and look-alikes as Latin letters, upper case, A-Z and digits only."""
    return F.regexp_replace(F.upper(F.translate(F.translate(unified(c), *SIGNS), *LOOKALIKES)), "[^A-Z0-9]", "")


def digits(c: Column) -> Column:
    """A number: look-alikes as digits, digits only."""
    return F.regexp_replace(F.translate(unified(c), *DIGIT_LOOKALIKES), r"[^\p{Nd}]", "")


def mod97_gated(v: Column) -> Column:
    """Whether an account number has an IBAN's shape and right check digits."""
    return F.coalesce(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & mod97(v), F.lit(False))


def changes(before: Column, after: Column) -> Column:
    """What was put right between two strings of one length, as ``position_<n>:<old>→<new>``."""
    at = F.when(F.length(before) > 0, F.sequence(F.lit(1), F.length(before))).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.when(F.substring(before, i, F.lit(1)) != F.substring(after, i, F.lit(1)), F.concat(F.lit("position_"), i, F.lit(":"), F.substring(before, i, F.lit(1)), F.lit("→"), F.substring(after, i, F.lit(1))))
    return F.filter(F.transform(at, one), lambda x: x.isNotNull())


def _value(value: Column, form: Column | str, shape: Column, checksum: Column | None, valid: Column, corrections: Column | None) -> Column:
    nothing = F.array().cast("array<string>")
    return F.struct(value.alias("value"), (F.lit(form) if isinstance(form, str) else form).alias("format"), shape.alias("shape"), (F.lit(None).cast("boolean") if checksum is None else checksum).alias("checksum"), valid.alias("format_valid"), (nothing if corrections is None else corrections).alias("corrections"))


def account_number(v: Column) -> Column:
    """VALUE of an account number given as a compact identifier.

    A Kazakh prefix is recognised through K2 and K3 and through 0 and 1 for O and I; then
    its check digits are read as digits, and O, Q and I, which its account part never
    holds, as 0, 0 and 1.  Other numbers are only checked.
    """

    def build(x: Column) -> Column:
        ours = x.startswith("KZ")
        rest = F.length(x)
        fixed = F.concat(F.substring(x, 1, 2), F.translate(F.substring(x, 3, 2), *DIGIT_LOOKALIKES), F.translate(x.substr(F.lit(5), rest), "OQI", "001"))

        def judge(y: Column) -> Column:
            shape = F.when(ours, y.rlike("^KZ[0-9]{2}[A-HJ-NP-Z0-9]{16}$")).otherwise(y.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"))
            good = shape & mod97_gated(y)
            return _value(y, F.when(ours, "kz_iban").when(shape, "iban").otherwise("generic_alphanumeric_account"), shape, good, good, changes(x, y))

        return let(F.when(ours, fixed).otherwise(x), judge)

    prefix = let(F.translate(F.substring(v, 1, 2), "01", "OI"), lambda p: F.when(p.isin("K2", "K3"), "KZ").otherwise(p))
    return let(F.when(F.length(v) >= 2, F.concat(prefix, v.substr(F.lit(3), F.length(v)))).otherwise(v), build)


def iban(c: Column) -> Column:
    return let(compact(c), account_number)


def bank_code(v: Column) -> Column:
    """VALUE of a SWIFT code given as a compact identifier: digits among the first six become the letters they look like."""
    fixed = F.concat(F.translate(F.substring(v, 1, 6), "01258", "OIZSB"), v.substr(F.lit(7), F.length(v)))

    def judge(y: Column) -> Column:
        shape = y.rlike("^[A-Z0-9]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")
        return _value(y, "swift_bic", shape, None, shape, changes(v, y))

    return let(fixed, judge)


def swift(c: Column) -> Column:
    return let(compact(c), bank_code)


def bank_value(kind: Column, c: Column) -> Column:
    """VALUE of a recognised value of a kind (bin, inn, okpo, bic_swift, bik, account); the check is null for an account of no known form."""
    unified_ = unified(c)
    plain = F.struct(F.regexp_replace(F.upper(F.translate(F.translate(unified_, *SIGNS), *LOOKALIKES)), "[^A-Z0-9]", "").alias("code"), F.regexp_replace(F.translate(unified_, *DIGIT_LOOKALIKES), r"[^\p{Nd}]", "").alias("digits"), (unified_ != F.translate(unified_, *SIGNS)).alias("signs"))

    def build(x: Column) -> Column:
        code, number = x["code"], x["digits"]
        n = F.length(number)
        sized = lambda form, *sizes: _value(number, form, n.isin(*sizes), None, n.isin(*sizes), None)
        numeric = _value(number, "numeric_bik", F.lit(True), None, F.lit(True), None)
        local = _value(number, "kg_numeric_account", F.lit(True), None, F.lit(True), None)
        other = _value(code, "generic_bank_account", F.length(code).between(6, 34), None, F.lit(None).cast("boolean"), None)
        account = F.when(code.rlike("^K[Z20O]"), account_number(code)).when((n == 16) & (F.length(code) == 16), local).otherwise(other)
        found = F.when(kind == "bin", sized("kz_bin", 12)).when(kind == "inn", sized("tax_identifier", 12, 14)).when(kind == "okpo", sized("okpo", 8)).when(kind == "bic_swift", bank_code(code))
        found = found.when(kind == "bik", F.when(n == 6, numeric).otherwise(bank_code(code))).when(kind == "account", account).otherwise(_value(code, "unknown", F.lit(False), None, F.lit(False), None))
        marked = lambda v: v.withField("corrections", F.when(x["signs"], F.concat(F.array(F.lit("special_symbols_replaced")), v["corrections"])).otherwise(v["corrections"]))
        return let(found.cast(VALUE), marked)

    return let(plain, build)


def keeps_raw(raw: Column, normal: Column) -> Column:
    """Whether a word's raw text must be kept beside its normal form."""
    return F.lower(raw) != normal
