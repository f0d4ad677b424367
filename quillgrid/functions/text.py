"""Text normalisation and phrase scanning over arrays of words, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are trimmed from words before they are compared.
TRIM = " \t\r\n:;,.!?()[]{}«»\"'"
_SEPARATOR = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; the fold over no element hands the result on, where ``transform`` would copy all that is nested in it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def strip(c: Column, characters: str = TRIM) -> Column:
    return F.btrim(c, F.lit(characters))


def token(c: Column) -> Column:
    """Lower case, trimmed."""
    return strip(F.lower(c))


def path_token(c: Column) -> Column:
    """A token in which runs of slashes of either kind are one slash."""
    return F.regexp_replace(F.translate(token(c), "\\", "/"), "/+", "/")


def party_token(c: Column) -> Column:
    """A token with ё read as е."""
    return F.translate(strip(F.translate(F.lower(c), "ё", "е")), "\\", "/")


def folded(c: Column) -> Column:
    """Lower case, ё as е, white space collapsed."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"\s+", " "))


def clean_value(words: Column, trim: str = " \t\r\n,;:.–—-") -> Column:
    """Words joined to a value."""
    return F.btrim(F.btrim(F.regexp_replace(F.array_join(words, " "), r"\s+", " ")), F.lit(trim))


def dedup_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s", "")


def organization_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), "ё", "е"), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def person_key(c: Column) -> Column:
    """Stem of the first name word and up to two initials, so that case endings and initials of one person agree."""
    words = F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit("[a-zа-я]+"), F.lit(0))
    glued = F.regexp_extract(F.get(words, F.lit(0)), r"^([a-zа-я]{5,}?)([a-zа-я]{0,3})$", 1)
    initials = F.array_join(F.transform(F.slice(words, F.lit(2), F.lit(2)), lambda w: F.substring(w, 1, 1)), "")
    first = F.get(words, F.lit(0))
    return F.when(F.size(words) == 0, F.lit("")).otherwise(F.concat(F.substring(F.when(F.size(words) == 1, F.coalesce(F.when(glued != "", glued), first)).otherwise(first), 1, 5), F.lit(":"), initials))


def safe_file_name(c: Column) -> Column:
    """Base name with unusual characters as underscores, at most 100 characters, extension in lower case."""
    base = F.regexp_extract(c, r"([^/\\]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    extension = F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1))
    fixed = F.btrim(F.regexp_replace(stem, r"(?U)[^\w.-]+", "_"), F.lit("._"))
    return F.concat(F.substring(fixed, 1, 100), extension)


def shorten(c: Column, n: int) -> Column:
    flat = F.btrim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def compact(c: Column) -> Column:
    """Upper case with everything but A-Z and digits removed."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def phrases(tokens: Column, aliases: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Leftmost-longest matches that don't overlap: array<struct<s, e, v>>, positions inclusive.

    For each length there is one map literal from joined tokens to the value; the scan
    keeps a pointer behind the last accepted match.
    """
    by_length: dict[int, dict[str, str]] = {}
    for words, value in aliases:
        by_length.setdefault(len(words), {}).setdefault(_SEPARATOR.join(words), value)
    tables = {n: F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) for n, table in by_length.items()}

    def at(t: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<s:int,e:int,v:string>")
        for n in sorted(tables):  # the longest stands outermost
            value = F.try_element_at(tables[n], F.array_join(F.slice(t, i + 1, F.lit(n)), _SEPARATOR))
            hit = (i + n <= F.size(t)) & value.isNotNull()
            found = F.when(hit, F.struct(i.alias("s"), (i + (n - 1)).alias("e"), value.alias("v"))).otherwise(found)
        return found

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<s:int,e:int,v:string>>").alias("o"))

    def add(acc: Column, x: Column) -> Column:
        return F.when(x["s"] >= acc["n"], F.struct((x["e"] + 1).alias("n"), F.concat(acc["o"], F.array(x)).alias("o"))).otherwise(acc)

    def scan(t: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda i: at(t, i)), lambda x: x.isNotNull())
        return F.aggregate(found, start, add, lambda a: a["o"])

    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(F.size(tokens) > 0, let(tokens, scan)).otherwise(empty)


def first_role(text: Column, roles: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The role whose pattern stands first in a folded text; ties go to the earlier role; null if none does."""
    def scan(t: Column) -> Column:
        found = F.array(*[F.struct(F.instr(t, p).alias("at"), F.lit(i).alias("i"), F.lit(role).alias("role")) for i, (role, p) in enumerate((r, p) for r, ps in roles for p in ps)])
        return F.array_min(F.filter(found, lambda x: x["at"] > 0))["role"]

    return let(text, scan)
