"""Personal data: exact base patterns, and candidates that boosted trees accept, in DataFrame expressions only.

Base spans (email, ip, card, phone) are pattern matches that pass their checks.  Beside
them high-recall generators propose spans, which may overlap: written-out email
addresses, as telephone or card numbers every stretch of whole digit groups of a run
that has their digits, however long the run is, and as secrets (keys, tokens, passwords)
every run of 12 or more letters, digits and joining signs that holds a digit.  A candidate's features are its
format (digits, groups, separators, brackets, Luhn sum) and its context (words in front
of its run, characters around it).  Gradient-boosted depth-2 trees, one model for each
kind, score them; the score is a CASE expression.  A candidate is accepted above the
threshold that keeps a precision of ``PRECISION`` on held-out examples, and if it does
not overlap a base span (or, if it is a secret, an accepted number); of accepted numbers that overlap, the one furthest above its
threshold stays.

The models are trained on ``EXAMPLES`` rendered examples per kind (a bounded sample,
half of it held out for calibration), which go through the same feature expressions as
documents; boosting itself runs over their distinct feature vectors.  Numbers stand in
the examples beside other numbers too, and of the stretches that the generator proposes
there only the whole numbers are positive.

Defined cases: null and empty texts have no spans; repeated rows and null ids each get
their row; an empty table gives an empty result; other columns play no part.  Patterns
are written so that no text makes them backtrack over more than 64 characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import narrow
from .quality import let

#: The base kinds, in the order of their spans, and the kind that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
EXAMPLES, ROUNDS, RATE, PRECISION = 2000, 20, 0.3, 0.99

#: The base patterns, with possessive repeats where giving back could not help a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates.
GENERATORS = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]\x20?at\x20?[)\]]\x20?[A-Za-z0-9-]{1,64}+\x20?(?:\.|[(\[]\x20?dot\x20?[)\]])\x20?[A-Za-z]{2,24}+",
    "number": r"[0-9][\x20().0-9/-]*+",  # a run, of which stretches of whole groups are proposed
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}",
}
#: Digits of a proposed number, by kind.
DIGITS = {"card": (13, 19), "phone": (9, 15)}
#: Words in front of a candidate that tell of its kind.
CONTEXT = {
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|telefon|téléphone|teléfono|appelez|anruf)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cb)\b",
    "email": r"(?i)\b(?:e-?mail|contact|write|mail|correo|courriel)\b",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credentials?)[\"']?\s*(?:[=:]|\bis\b)?\s*[\"']?$",
}
_FRONT, _CHUNK = 24, 256


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by 10."""
    d = F.reverse(digits)
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def find(text: Column, pattern: str) -> Column:
    """Matches as array<struct<s, e, v>>, from the matches and the gaps between them; offsets in code points, end exclusive.

    Offsets are summed in chunks, so many matches in one text do not copy a long array for each.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda v, g: F.struct(v.alias("v"), F.length(g).alias("g")))
    span = "array<struct<s:int,e:int,v:string>>"
    empty = F.array().cast(span)

    def one(acc: Column, x: Column) -> Column:
        start = acc["p"] + x["g"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("p"), F.concat(acc["o"], F.array(F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v")))).alias("o"))

    def some(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["p"].alias("p"), empty.alias("o")), one)
        return let(inner, lambda i: F.struct(i["p"].alias("p"), F.concat(acc["o"], F.array(i["o"])).alias("o")))

    chunks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")), lambda c: F.slice(p, c * _CHUNK + 1, F.lit(_CHUNK)))
    return let(pairs, lambda p: F.when(F.size(p) == 0, empty).otherwise(F.flatten(F.aggregate(chunks(p), F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{span}>").alias("o")), some, lambda a: a["o"]))))


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return n.between(14, 19) & luhn(_digits(v))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _where(text: Column, kind: str) -> Column:
    """A quick test that spares most texts the patterns of a kind."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e>> in the order of start, then kind as listed."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(find(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"]))
        shaped = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
        return F.when(_where(text, kind), shaped).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(BASE_KINDS)]))


def numbers(text: Column, base: Column | None = None) -> Column:
    """array<array<struct<s, e, v, front, left, back>>>: for each run of digit groups every stretch of whole groups with the digits of a number, but those that overlap ``base``.

    ``front`` stands before the run, ``left`` and ``back`` before and after the stretch, which takes a plus sign or bracket before it along.
    """
    least, most = min(a for a, _ in DIGITS.values()), max(b for _, b in DIGITS.values())
    before = lambda v, end: F.substring(v, F.greatest(end - _FRONT, F.lit(0)) + 1, F.least(end, F.lit(_FRONT)))
    kind = "array<struct<s:int,e:int,v:string,front:string,left:string,back:string>>"

    def of_run(r: Column) -> Column:
        front = before(text, r["s"])
        around = F.concat(front, r["v"], F.substring(text, r["e"] + 1, F.lit(2)))
        made = F.struct(front.alias("front"), around.alias("t"), F.length(front).alias("f"), r["s"].alias("s"), find(r["v"], "[0-9]++").alias("groups"))
        return let(made, lambda x: F.flatten(F.transform(x["groups"], lambda g, i: of_group(x, g, i))))

    def of_group(x: Column, g: Column, i: Column) -> Column:
        def step(acc: Column, y: Column) -> Column:
            n = acc["n"] + F.length(y["v"])
            return F.struct(n.alias("n"), F.when(n.between(least, most), F.concat(acc["o"], F.array(y["e"]))).otherwise(acc["o"]).alias("o"))

        ends = F.aggregate(F.slice(x["groups"], i + 1, F.lit(most)), F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("o")), step, lambda acc: acc["o"])
        left = before(x["t"], x["f"] + g["s"])
        signed = left.rlike(r"(?:^|[^0-9A-Za-z])[+(]$").cast("int")
        made = F.struct(ends.alias("ends"), (g["s"] - signed).alias("s"), left.rlike("[0-9A-Za-z]$").alias("inside"))
        return let(made, lambda m: F.when(m["inside"] | (F.size(m["ends"]) == 0), F.array().cast(kind)).otherwise(stretches(x, m)))

    def stretches(x: Column, m: Column) -> Column:
        def one(e: Column) -> Column:
            cut_ = lambda a, n: F.substring(x["t"], x["f"] + a + 1, n)
            return F.struct((x["s"] + m["s"]).alias("s"), (x["s"] + e).alias("e"), cut_(m["s"], e - m["s"]).alias("v"), x["front"].alias("front"), before(x["t"], x["f"] + m["s"]).alias("left"), cut_(e, F.lit(2)).alias("back"))

        free = lambda y: ~y["back"].rlike("^[0-9A-Za-z]") & (F.lit(True) if base is None else ~F.exists(base, lambda b: (y["s"] < b["e"]) & (b["s"] < y["e"])))
        return F.filter(F.transform(m["ends"], one), free)

    runs = F.filter(find(text, GENERATORS["number"]), lambda r: F.length(_digits(r["v"])) >= least)
    return F.transform(runs, of_run)


def features(v: Column, front: Column, left: Column, back: Column) -> dict[str, Column]:
    """Format and context of a candidate: its text, characters in front of it (of its run) and just before it, and some after it."""
    n = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, "")))
    groups = F.filter(F.split(v, "[^0-9]+"), lambda g: g != "")
    between = F.filter(F.split(v, "[0-9]+"), lambda g: ~g.isin("", "(", "+"))
    return {
        "digits": n("[0-9]"),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "first": F.length(F.coalesce(F.element_at(F.concat(groups, F.array(F.lit(""))), 1), F.lit(""))),
        "last": F.length(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), groups), -1), F.lit(""))),
        "spaces": n(r"\x20"),
        "dashes": n("-"),
        "dots": n(r"\."),
        "slashes": n("/"),
        "brackets": n(r"[()\[\]]"),
        "plus": n(r"\+"),
        "separators": F.size(F.array_distinct(between)),
        "luhn": F.when(n("[0-9]").between(14, 19), luhn(_digits(v)).cast("int")).otherwise(0),
        "issuer": _digits(v).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)").cast("int"),  # how card numbers begin
        "year": v.rlike(r"\b(?:19|20)[0-9]{2}\b").cast("int"),
        "odd_edge": (left.rlike(r"""[0-9A-Za-z"'=#$€._/-]$""") | back.rlike(r"""^[0-9A-Za-z"'%€$/-]""")).cast("int"),
        "number_before": left.rlike(r"[0-9][\x20()]$").cast("int"),
        "number_after": back.rlike(r"^[\x20()][0-9(]").cast("int"),
        "phone_word": front.rlike(CONTEXT["phone"]).cast("int"),
        "card_word": front.rlike(CONTEXT["card"]).cast("int"),
        "mail_word": front.rlike(CONTEXT["email"]).cast("int"),
    }


def secret_features(v: Column, front: Column, back: Column) -> dict[str, Column]:
    """Format and context of a run that may be a secret."""
    n = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, "")))
    return {
        "length": F.length(v),
        "digits": n("[0-9]"),
        "letters": n("[A-Za-z]"),
        "joins": n("[+/_-]"),
        "turns": F.length(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[A-Za-z]+", "a")),  # changes between letters and digits
        "kinds": F.size(F.array_distinct(F.split(F.substring(v, 1, 64), ""))),
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("int"),
        "mixed": (v.rlike("[a-z]") & v.rlike("[A-Z]")).cast("int"),
        "quoted": (front.rlike("[\"']$") & back.rlike("^[\"']")).cast("int"),
        "assigned": front.rlike("[=:]\\s*[\"']?$").cast("int"),
        "secret_word": front.rlike(CONTEXT["secret"]).cast("int"),
        "path": (front.rlike("[/.@#&?]$") | back.rlike("^[/.@&?][A-Za-z0-9]")).cast("int"),  # part of an address
    }


def _made(kind: str, v: Column, front: Column, left: Column, back: Column) -> dict[str, Column]:
    return secret_features(v, front, back) if kind == "secret" else features(v, front, left, back)


def _examples(spark: SparkSession, kind: str) -> DataFrame:
    """Rendered candidates: id, s, e, v, front, left, back, label, held; a fixed sample drawn by hashing row numbers."""
    rows = spark.range(EXAMPLES)
    pick = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(f"{kind}{salt}")), F.lit(n)).cast("int")
    one = lambda salt, options: F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), pick(salt, len(options)) + 1)
    check = lambda body: F.concat(body, F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: luhn(F.concat(body, x))), 1))
    grouped = lambda c, sep: F.concat_ws(sep, F.substring(c, 1, 4), F.substring(c, 5, 4), F.substring(c, 9, 4), c.substr(F.lit(13), F.lit(8)))
    word = one("w", ["the ", "order ", "of ", "no ", "ref: ", "and ", "id=", 'token = "', "total $", "version "])
    positive = pick("label", 2) == 1
    held = (pick("held", 2) == 1).alias("held")

    def framed(clue: Column) -> tuple[Column, Column]:
        front = F.when(positive, F.when(pick("clue", 10) < 8, clue).otherwise(word)).otherwise(F.when(pick("clue", 10) < 1, clue).otherwise(word))
        return front, F.when(front.endswith('"'), F.lit('"')).otherwise(one("b", [" ", ".", ",", " ", ""]))

    def made(place: str, formats: str) -> tuple[Column, Column, Column, Column]:
        """A card number, a telephone number, another number, and one of those that often stand beside numbers; formats are drawn by a salt of their own."""
        d = lambda salt, n: F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit(f"{kind}{place}d{salt}")), F.lit(10**n)).cast("string"), n, "0")
        good = check(F.concat(one(f"{place}bin", ["4", "51", "55", "37", d(9, 2)]), d(1, 7), d(2, 6)))
        card = one(f"{formats}cf", [good, grouped(good, " "), grouped(good, "-"), F.concat(good.substr(F.lit(1), F.lit(11)), d(3, 4)), grouped(good, ".")])
        phone = one(f"{formats}pf", [F.concat(F.lit("("), d(1, 3), F.lit(") "), d(2, 3), F.lit("-"), d(3, 4)), F.concat_ws("-", d(1, 3), d(2, 3), d(3, 4)), F.concat_ws(" ", F.concat(F.lit("0"), d(1, 2)), d(2, 2), d(3, 2), d(4, 2), d(5, 2)), F.concat_ws(".", d(1, 3), d(2, 3), d(3, 4))])
        other = one(
            f"{formats}nf",
            [
                F.concat_ws("-", F.concat(F.lit("20"), d(1, 2)), d(2, 2), d(3, 2)), F.concat_ws("/", d(1, 2), d(2, 2), F.concat(F.lit("19"), d(3, 2))), F.concat_ws(".", d(1, 1), d(2, 2), d(3, 1), d(4, 4)), d(1, 9), d(1, 12), d(1, 16),
                F.concat_ws(" ", d(1, 1), d(2, 3), d(3, 3)), F.concat_ws(".", d(1, 3), d(2, 3), d(3, 3), d(4, 3)), F.concat_ws("-", d(1, 4), d(2, 5)), F.concat_ws(" ", d(1, 4), d(2, 4), d(3, 4), d(4, 4)), F.concat_ws("-", d(1, 3), d(2, 1), d(3, 2), d(4, 6), d(5, 1)),
            ],
        )
        beside = one(f"{formats}bf", [F.concat_ws("-", F.concat(F.lit("20"), d(6, 2)), d(7, 2), d(8, 2)), F.concat_ws("/", d(6, 2), d(7, 2)), F.concat_ws("/", d(6, 2), d(7, 2), F.concat(F.lit("20"), d(8, 2))), d(6, 3), d(6, 1), F.concat(F.lit("20"), d(6, 2))])
        return card, phone, other, beside

    if kind == "email":
        digits = F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit("emaild1")), F.lit(100)).cast("string"), 2, "0")
        site = F.lpad(F.pmod(F.xxhash64(F.col("id"), F.lit("emaild2")), F.lit(100)).cast("string"), 2, "0")
        name = F.concat(one("n", ["jo", "ana", "k.lee", "info"]), F.when(pick("nd", 2) == 1, digits).otherwise(""))
        yes = one("ef", [F.concat(name, F.lit(" (at) site"), site, F.lit(" (dot) org")), F.concat(name, F.lit("[at]mail"), site, F.lit("[dot]com")), F.concat(name, F.lit(" (at) host.net"))])
        other = F.concat(one("x", ["look (at) this.", "meet (at) noon.", "is (at) home."]), one("y", ["the", "so", "we"]))
        front, back = framed(one("c", ["e-mail: ", "contact ", "write ", "mail "]))
        return rows.select("id", F.lit(0).alias("s"), F.lit(1).alias("e"), F.when(positive, yes).otherwise(other).alias("v"), front.alias("front"), front.alias("left"), back.alias("back"), positive.cast("int").alias("label"), held)

    if kind == "secret":
        code = F.sha2(F.concat(F.lit("secret"), F.col("id").cast("string")), 512)
        base64 = F.regexp_replace(F.base64(F.unhex(code)), "[\n\r=]", "")
        size = lambda c, salt, a, b: F.substring(c, 1, 200).substr(F.lit(1), pick(salt, b - a + 1) + a)
        key = one("kf", [F.substring(code, 1, 40), F.substring(code, 1, 32), F.substring(code, 1, 64), size(base64, "k1", 20, 60), F.concat(F.lit("sk-"), size(base64, "k2", 20, 48)), F.concat(F.lit("AKIA"), F.upper(F.substring(code, 1, 16)))])
        d = lambda salt, n: F.lpad(pick(salt, 10**n).cast("string"), n, "0")
        name = one("nf", ["section", "article-number", "some_long_name", "Chapter", "covid-vaccine", "version"])
        other = one("of", [F.concat(d("o1", 8), d("o2", 8)), F.concat_ws("-", F.concat(F.lit("20"), d("o3", 2)), d("o4", 2), d("o5", 2), d("o6", 4)), F.concat_ws("-", name, d("o7", 2), name), F.concat_ws("/", name, d("o8", 4), d("o9", 3)), F.concat(name, name, d("o10", 3)), F.concat_ws("_", name, name, d("o11", 1)), F.concat(F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 4), F.lit("-"), F.substring(code, 13, 4)), F.concat(d("o12", 6), d("o13", 7)), F.concat(F.repeat(one("of2", ["x", "ab", "Ha", "0a"]), pick("o14", 300) + 12), d("o15", 1)), F.concat(F.repeat(name, pick("o16", 8) + 2), d("o17", 2))])
        front = F.when(positive, one("c", ['token = "', "token: ", "api_key='", "password: ", 'secret="', "Bearer ", "access key is ", '"auth": "', "API-KEY = "]))
        front = F.when(front.isNotNull() & (pick("clue", 10) < 9), front).otherwise(one("w2", ["the ", "order ", "of ", "see ", "ref: ", "in ", "no = ", 'name = "', "(", "www.site.org/"]))
        back = F.when(front.rlike("\"$"), F.lit('"')).when(front.rlike("'$"), F.lit("'")).otherwise(one("b", [" ", ".", ",", " ", ""]))
        return rows.select("id", F.lit(0).alias("s"), F.lit(1).alias("e"), F.when(positive, key).otherwise(other).alias("v"), front.alias("front"), front.alias("left"), back.alias("back"), positive.cast("int").alias("label"), held)

    mine = ("card", "phone").index(kind)
    clue = one("c", ["card ", "visa ", "credit card: ", "debit "] if kind == "card" else ["tel ", "phone: ", "call ", "fax ", "mobile "])
    front, back = framed(clue)
    middle, twin, beside = made("", ""), made("second", ""), made("beside", "beside")
    number = F.when(positive, middle[mine]).when(pick("mixed", 4) == 0, middle[1 - mine]).otherwise(middle[2])
    # a third stands alone, a third after or before a number of the same form, a third after or before one that often stands beside numbers
    like = F.when(positive, twin[mine]).otherwise(twin[2])
    side = F.when(pick("side", 3) == 1, like).otherwise(beside[3])
    lead, tail = (pick("side", 3) > 0) & (pick("place", 3) == 0), (pick("side", 3) > 0) & (pick("place", 3) > 0)
    at = F.length(front) + F.when(lead, F.length(side) + 1).otherwise(0)
    text = F.concat(front, F.when(lead, F.concat(side, F.lit(" "))).otherwise(""), number, F.when(tail, F.concat(F.lit(" "), side)).otherwise(""), back)
    second = F.when(lead, F.length(front)).otherwise(at + F.length(number) + 1)
    truth = F.when(positive, F.array(F.struct(at.alias("s"), (at + F.length(number)).alias("e")), F.struct(F.when(pick("side", 3) == 1, second).otherwise(-1).alias("s"), (second + F.length(side)).alias("e")))).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    proposed = rows.select("id", text.alias("text"), truth.alias("truth"), held).select("id", F.explode(F.flatten(numbers(F.col("text")))).alias("x"), "truth", "held")
    label = F.exists("truth", lambda t: (t["s"] == F.col("x.s")) & (t["e"] == F.col("x.e"))).cast("int").alias("label")
    return proposed.select("id", "x.s", "x.e", "x.v", "x.front", "x.left", "x.back", label, "held").filter(F.length(_digits(F.col("v"))).between(*DIGITS[kind]))


def _boost(rows: list[tuple[tuple[int, ...], int, int]]) -> list[tuple]:
    """Depth-2 trees (feature, cut, feature, cut, feature, cut, four values) by Newton steps on the logistic loss; rows: vector, positives, negatives."""
    score = [0.0] * len(rows)
    trees = []
    width = len(rows[0][0])
    cuts = [sorted({r[0][f] for r in rows})[1:] for f in range(width)]

    def split(some: list[int], g: list[float], h: list[float]) -> tuple[float, int, int]:
        total_g, total_h = sum(g[i] for i in some), sum(h[i] for i in some)
        best = (0.0, 0, 1 << 30)
        for f in range(width):
            by: dict[int, list[float]] = {}
            for i in some:
                x = by.setdefault(rows[i][0][f], [0.0, 0.0])
                x[0] += g[i]
                x[1] += h[i]
            left_g = left_h = 0.0
            last = None
            for value in sorted(by):
                if last is not None:
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, value)
                left_g += by[value][0]
                left_h += by[value][1]
                last = value
        return best

    for _ in range(ROUNDS if any(cuts) else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [r[1] - (r[1] + r[2]) * q for r, q in zip(rows, p, strict=True)]
        h = [(r[1] + r[2]) * q * (1 - q) for r, q in zip(rows, p, strict=True)]
        _, f0, c0 = split(list(range(len(rows))), g, h)
        sides = [[i for i, r in enumerate(rows) if (r[0][f0] >= c0) is up] for up in (False, True)]
        tree: list = [f0, c0]
        leaves = []
        for side in sides:
            _, f, c = split(side, g, h)
            tree += [f, c]
            for up in (False, True):
                leaf = [i for i in side if (rows[i][0][f] >= c) is up]
                value = RATE * sum(g[i] for i in leaf) / (sum(h[i] for i in leaf) + 1)
                leaves.append(round(value, 6))
                for i in leaf:
                    score[i] += value
        trees.append((*tree, *leaves))
    return trees


def _apply(trees: list[tuple], vector: tuple[int, ...]) -> float:
    total = 0.0
    for f0, c0, f1, c1, f2, c2, a, b, c, d in trees:
        total += (d if vector[f2] >= c2 else c) if vector[f0] >= c0 else (b if vector[f1] >= c1 else a)
    return total


_MODELS: dict[str, tuple[list[str], list[tuple], float]] = {}


def model(spark: SparkSession, kind: str) -> tuple[list[str], list[tuple], float]:
    """Feature names, trees and threshold of a kind; trained once in a process, always alike."""
    if kind not in _MODELS:
        sample = _examples(spark, kind)
        made = _made(kind, F.col("v"), F.col("front"), F.col("left"), F.col("back"))
        names = list(made)
        rows = sample.select(*[c.cast("int").alias(n) for n, c in made.items()], "label", "held", "id", "s", "e").collect()  # the proposals of EXAMPLES short texts
        counts: dict[tuple[int, ...], list[int]] = {}
        for r in rows:
            if not r["held"]:
                counts.setdefault(tuple(r[n] for n in names), [0, 0])[1 - r["label"]] += 1
        trees = _boost([(v, *c) for v, c in sorted(counts.items())])
        ranked = sorted((-_apply(trees, tuple(r[n] for n in names)), r["s"] - r["e"], r["s"], r["id"], r["e"], r["label"]) for r in rows if r["held"])
        scored, taken = [], {}
        for m, _, s, i, e, label in ranked:  # of numbers that overlap only the chosen one counts, as in documents
            if all(e <= a or b <= s for a, b in taken.setdefault(i, [])):
                taken[i].append((s, e))
                scored.append((-m, label, 1 - label))
        yes = no = 0
        limit = math.inf
        for i, (score, a, b) in enumerate(scored):
            yes, no = yes + a, no + b
            if yes >= PRECISION * (yes + no) and (i + 1 == len(scored) or scored[i + 1][0] < score):
                limit = score
        _MODELS[kind] = (names, trees, limit)
    return _MODELS[kind]


def _margin(spark: SparkSession, kind: str, made: dict[str, Column]) -> Column:
    """How far a candidate's score is above the threshold; accepted from 0."""
    names, trees, limit = model(spark, kind)
    at = lambda f, c: made[names[f]] >= c
    score = F.lit(0.0)
    for f0, c0, f1, c1, f2, c2, a, b, c, d in trees:
        score = score + F.when(at(f0, c0), F.when(at(f2, c2), d).otherwise(c)).otherwise(F.when(at(f1, c1), b).otherwise(a))
    return score - F.lit(limit)


def _apart(found: Column) -> Column:
    """Of accepted candidates struct<m, s, k, e> those left when the one with the greatest margin (then length, then the first) is taken again and again, and what overlaps it goes."""
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-x["m"]).alias("m"), (x["s"] - x["e"]).alias("n"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        return F.when(F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))))

    return F.aggregate(ranked, F.array().cast("array<struct<s:int,k:int,e:int>>"), step)


def extra_spans(spark: SparkSession, text: Column, base: Column) -> Column:
    """Accepted candidates, as base_spans has them; a number may stand as several kinds, of which the first in the list wins."""

    def judged(x: Column, kinds: tuple[str, ...]) -> Column:
        made = _made(kinds[0], x["v"], x["front"], x["left"], x["back"])

        def which(m: Column) -> Column:
            shaped = lambda d, k: F.struct(d.alias("m"), x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
            either = lambda k, other: lambda d: F.when(d >= 0, shaped(d, k)).otherwise(other)
            got = shaped(F.lit(-1.0), -1)
            for kind in reversed(kinds):
                shape = m["digits"].between(*DIGITS[kind]) if kind in DIGITS else F.lit(True)
                margin = F.when(shape, _margin(spark, kind, {n: m[n] for n in made})).otherwise(-1.0)
                got = let(margin, either(KINDS.index(kind), got))
            return got

        return let(F.struct(*[c.cast("int").alias(n) for n, c in made.items()]), which)

    def accepted(some: Column, kinds: tuple[str, ...]) -> Column:
        return F.filter(F.transform(some, lambda x: judged(x, kinds)), lambda x: x["k"] >= 0)

    def beside(x: Column) -> Column:
        front = F.substring(text, F.greatest(x["s"] - _FRONT, F.lit(0)) + 1, F.least(x["s"], F.lit(_FRONT)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), front.alias("front"), front.alias("left"), F.substring(text, x["e"] + 1, F.lit(1)).alias("back"))

    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    alone = lambda kind: F.transform(accepted(F.transform(find(text, GENERATORS[kind]), beside), (kind,)), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    counted = F.flatten(F.transform(numbers(text, base), lambda run: _apart(accepted(run, ("card", "phone")))))
    numeric = F.when(text.rlike("[0-9]"), counted).otherwise(none)
    secrets = F.when(text.rlike(GENERATORS["secret"]), let(numeric, lambda n: F.filter(alone("secret"), lambda x: ~F.exists(n, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))))).otherwise(none)
    return F.concat(F.when(text.rlike(r"(?i)[(\[]\x20?at\x20?[)\]]"), alone("email")).otherwise(none), numeric, secrets)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, base, spans) per row of ``docs``: array<struct<s, k, e>>, k the kind's place in KINDS."""
    return _with_spans(narrow(docs, doc_id=id_col, text=text_col)).select("doc_id", "base", "spans")


def _with_spans(docs: DataFrame, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.withColumn(base, base_spans(text)).withColumn(spans, extra_spans(spark, text, F.col(base)))
    clear = F.filter(spans, lambda x: ~F.exists(base, lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"])))
    return found.withColumn(spans, F.array_sort(F.concat(F.col(base), clear)))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] < last["e"], joined).otherwise(F.concat(acc, F.array(x)))

    found = _with_spans(docs, text_col, "__base", "__spans").drop("__base").withColumn("__spans", F.aggregate("__spans", empty, merge))
    text = F.col(f"`{text_col}`")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    gap = lambda x, i: F.substring(text, F.coalesce(F.get("__spans", i - 1)["e"], F.lit(0)) + 1, x["s"] - F.coalesce(F.get("__spans", i - 1)["e"], F.lit(0)))
    pieces = F.transform("__spans", lambda x, i: F.concat(gap(x, i), F.get(names, x["k"])))
    tail = F.substring(text, F.element_at("__spans", -1)["e"] + 1, F.length(text))
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)).drop("__spans")

