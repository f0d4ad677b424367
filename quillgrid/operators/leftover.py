"""Entities without a party, found inside each document's row: what ``resolve`` and ``link`` give, without a shuffle or a table of candidates."""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..runtime import ship
from . import engine, link, resolve, rules

_PATTERNS = tuple((i, p) for i, (_, patterns) in enumerate(rules.ROLES) for p in patterns)
_DETAILS = frozenset(link.DETAILS)
_SEPARATOR = "\u0001"


def marks() -> Column:
    """Bits of the role patterns that stand in a line; as no pattern holds white space, one stands in a context if it stands in one of its lines."""
    t = text.folded(F.col("text"))
    return sum((F.when(t.contains(p), 1 << n).otherwise(0) for n, (_, p) in enumerate(_PATTERNS)), F.lit(0))


def _key(x: object) -> tuple:
    """Nulls before all others, as Spark sorts."""
    return (x is not None, x)


class _Candidate:
    __slots__ = ("place", "line", "page", "region", "line_id", "rule", "least", "id", "kind", "value", "ids", "confidence", "x1", "y1", "x2", "y2", "role", "party", "sure", "good", "plain", "name", "ordinal")

    def __init__(self, place: int, line: tuple, *rest: object) -> None:
        self.place, self.line = place, line
        self.page, self.region, self.line_id = line[:3]
        self.rule, self.least, self.id, self.kind, self.value, ids, self.confidence, self.x1, self.y1, self.x2, self.y2, self.role, self.party, self.sure, self.good, self.plain, self.name = rest
        self.ids = ids.split(_SEPARATOR) if ids else []

    def quality(self) -> tuple:
        """As ``resolve.quality``, the best first."""
        return (-self.confidence, not self.sure, not self.good, -len(self.ids), self.ordinal)


def _candidates(found: list[_Candidate]) -> list[_Candidate]:
    """As ``Registry.run``: the first of equal ones, those sure enough, no rule that gives an id twice; in order."""
    seen, some = set(), []
    for c in sorted(found, key=lambda c: (_key(c.line[4]), _key(c.line[3]), _key(c.line_id))):  # places of a line are in order
        key = (c.rule, c.page, c.value, *c.ids)
        if key not in seen:
            seen.add(key)
            if c.confidence >= c.least:
                some.append(c)
    ids, twice = set(), set()
    for c in some:
        twice.update({c.rule} if (c.rule, c.id) in ids else ())
        ids.add((c.rule, c.id))
    some = sorted((c for c in some if c.rule not in twice), key=lambda c: (c.page, _key(c.y1), _key(c.x1), _key(c.kind), _key(c.value), _key(c.id)))
    for n, c in enumerate(some, 1):
        c.ordinal = n
    return some


def _alike(a: _Candidate, b: _Candidate) -> bool:
    """As ``resolve.overlaps``."""
    shared = len(set(a.ids).intersection(b.ids))
    if shared and shared / min(len(a.ids), len(b.ids)) >= resolve.WORD_SHARE:
        return True
    if a.x1 is None or b.x1 is None:
        return False
    x1, y1, x2, y2 = max(a.x1, b.x1), max(a.y1, b.y1), min(a.x2, b.x2), min(a.y2, b.y2)
    both = (x2 - x1) * (y2 - y1) if x1 < x2 and y1 < y2 else 0.0
    whole = (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - both
    return both > 0 and whole > 0 and both / whole >= resolve.BOX_SHARE


def _components(some: list[_Candidate]) -> list[list[_Candidate]]:
    """As ``resolve.components``.  Only pairs with a common word, or with boxes that meet, are looked at."""
    parent = list(range(len(some)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    pairs, at = set(), defaultdict(list)
    for n, c in enumerate(some):
        for i in dict.fromkeys(c.ids):
            pairs.update((m, n) for m in at[c.page, i])
            at[c.page, i].append(n)
    by_top = sorted((n for n, c in enumerate(some) if c.x1 is not None), key=lambda n: (some[n].page, some[n].y1))
    low: list[int] = []
    for n in by_top:
        c = some[n]
        low = [m for m in low if some[m].page == c.page and some[m].y2 > c.y1]
        pairs.update((m, n) for m in low if some[m].x1 < c.x2 and c.x1 < some[m].x2)
        low.append(n)
    for a, b in pairs:
        if find(a) != find(b) and _alike(some[a], some[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    out = defaultdict(list)
    for n, c in enumerate(some):
        out[find(n)].append(c)
    return list(out.values())


def _kept(group: list[_Candidate], keep_ambiguous: bool) -> list[_Candidate]:
    """As ``resolve.resolve``, of one component."""
    if len(group) == 1:
        return group
    types = {c.kind for c in group}
    ranked = sorted(group, key=_Candidate.quality)
    if len(types) == 1:
        return ranked[:1]
    if not any(len(types.intersection(rivals)) > 1 for rivals in resolve.EXCLUSIVE):
        return group
    if ranked[0].confidence - ranked[1].confidence >= resolve.MARGIN:
        best = ranked[0].kind
        return [c for c in group if not any(c.kind in rivals and best in rivals and c.kind != best for rivals in resolve.EXCLUSIVE)]
    return group if keep_ambiguous else ranked[:1]


def _entities(some: list[_Candidate], keep_ambiguous: bool) -> list[_Candidate]:
    best: dict[tuple, _Candidate] = {}
    for c in some:
        key = (c.kind, c.plain, c.page, *sorted(c.ids))
        if key not in best or c.quality() < best[key].quality():
            best[key] = c
    return [c for group in _components([c for c in some if best[(c.kind, c.plain, c.page, *sorted(c.ids))] is c]) for c in _kept(group, keep_ambiguous)]


def _roles(organizations: list[_Candidate], lines: list[tuple]) -> dict[str, str]:
    """The role of each name, as ``link.groups``: votes of hints and of patterns in four lines above to three below."""
    beside: dict[tuple, int] = {}
    wanted = {c.line[:2] for c in organizations}
    for _, part in groupby(sorted((x for x in lines if x[:2] in wanted), key=lambda x: (x[0], _key(x[1]), _key(x[6]), _key(x[3]), x[5])), key=lambda x: x[:2]):
        part = list(part)
        for j, x in enumerate(part):
            found = 0
            for y in part[max(0, j - 4) : j + 4]:
                found |= y[7]
            beside[x[:3]] = found
    votes: dict[str, list[float]] = {}
    for c in organizations:
        own, found = votes.setdefault(c.name, [0.0] * len(rules.ROLES)), beside[c.line[:3]]
        for n, (i, _) in enumerate(_PATTERNS):
            own[i] += found >> n & 1
        if c.role in link.ROLES:
            own[link.ROLES.index(c.role)] += 3.0
    return {name: link.ROLES[own.index(max(own))] if max(own) > 0 else "unknown" for name, own in votes.items()}


def _score(c: _Candidate, o: _Candidate, own: str | None, role: str) -> float:
    """As ``link.scores``, added up in the same order."""
    region = link.SAME_REGION if c.region == o.region else 0.05 if c.region is None or o.region is None else 0.0
    vertical = 0.0 if c.y1 is None or o.y1 is None else max(0.0, link.VERTICAL - abs((c.y1 + c.y2) / 2 - (o.y1 + o.y2) / 2))
    hint = 0.0 if own is None or role == "unknown" else link.ROLE if own == role else -link.ROLE
    return link.SAME_PAGE + region + (link.SAME_LINE if c.line_id == o.line_id else 0.0) + vertical + hint


def _left(entities: list[_Candidate], lines: list[tuple]) -> list[int]:
    """Places of the candidates that ``link.link`` leaves unassigned."""
    organizations = [c for c in entities if c.kind == "organization"]
    roles = _roles(organizations, lines)
    scores: dict[str, dict[str, float]] = defaultdict(dict)
    for c in entities:
        if c.kind in _DETAILS:
            own = next((r for r in (c.party, c.role) if r in link.ROLES), None)
            of = scores[c.id]
            for o in organizations:
                if o.page == c.page:
                    score = _score(c, o, own, roles[o.name])
                    of[o.name] = max(score, of.get(o.name, score))
    used = {o.id for o in organizations}
    for i, of in scores.items():
        ranked = sorted((max(0.0, min(1.0, s)) for s in of.values()), reverse=True)
        if ranked and ranked[0] >= link.MINIMUM and not (len(ranked) > 1 and ranked[0] - ranked[1] < link.AMBIGUITY):
            used.add(i)
    return sorted(c.place for c in entities if (c.kind in _DETAILS or c.kind == "organization") and c.id not in used)


#: Columns of a line and of a candidate as the function below takes them.
_LINE = 9


def _of_documents(keep_ambiguous: bool):
    def of(*columns: pa.Array) -> pa.Array:
        def held(arrays: tuple[pa.Array, ...]) -> tuple[list[int], list[tuple]]:
            ends = [0]
            for n in arrays[0].value_lengths().to_pylist():
                ends.append(ends[-1] + n)
            return ends, list(zip(*(a.flatten().to_pylist() for a in arrays), strict=True))

        (of_lines, lines), (of_found, found) = held(columns[:_LINE]), held(columns[_LINE:])
        out = []
        for d in range(len(columns[0])):
            own, here, some = lines[of_lines[d] : of_lines[d + 1]], of_found[d], []
            for x in own:
                for _ in range(x[8]):
                    some.append(_Candidate(here - of_found[d], x, *found[here]))
                    here += 1
            out.append(_left(_entities(_candidates(some), keep_ambiguous), own))
        return pa.array(out, pa.list_(pa.int32()))

    return of


def unassigned(lines: DataFrame, keep_ambiguous: bool = True, registry: engine.Registry | None = None) -> DataFrame:
    """(doc_id, id, entity_type, value, confidence) of the entities that ``extraction.from_lines`` gives as ``unassigned``.

    A document's candidates meet in its row, so the step works on a batch of documents at
    a time, and holds no more than a document beside it.
    """
    ship(lines.sparkSession)
    documents = (registry or engine.Registry()).documents(lines, marks())
    documents = documents.select("doc_id", "lines", F.flatten(F.col("lines")["found"]).alias("found"))
    x, c = F.col("lines"), F.col("found")
    middle = F.transform(x["bbox"], lambda b: (b["y1"] + b["y2"]) / 2)
    ids = F.transform(c["word_ids"], lambda i: F.array_join(i, _SEPARATOR))
    of_line = (x["page"], x["region"], x["line_id"], x["bbox"]["x1"], x["bbox"]["y1"], x["line_index"], middle, x["marks"], F.transform(x["found"], F.size))
    good = F.transform(c["status"], lambda s: F.coalesce(s.isin(*resolve._GOOD), F.lit(False)))
    names = F.transform(c, lambda c: F.when(c["entity_type"] == "organization", text.organization_key(c["value"])))
    of_found = (c["rule"], c["least"], c["id"], c["entity_type"], c["value"], ids, c["confidence"], *[c["bbox"][k] for k in ("x1", "y1", "x2", "y2")], c["role_hint"], c["party_role_hint"], c["ocr_confirmed"], good, F.transform(c["value"], text.dedup_key), names)
    left = F.arrow_udf(_of_documents(keep_ambiguous), "array<int>")(*of_line, *of_found)
    told = F.transform(c, lambda c: F.struct(*[c[k].alias(k) for k in ("id", "entity_type", "value", "confidence")]))
    rows = documents.select("doc_id", told.alias("told"), left.alias("left")).select("doc_id", F.inline_outer(F.transform("left", lambda i: F.get("told", i))))
    return rows.filter("entity_type is not null")
