"""DuckDB SQL for the corpus queries that SQL can express: whole tables, exact comparisons, no library code.

op4's verdicts, op3's accepted spans and op7's text follow from fitted models, and op5, op6
and op9 need a tokenizer: SQL can't express them, and tests hold them against brute force.
"""

from __future__ import annotations

from . import decontam, neardup, quality, substring

_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') as w from documents),
s as (select distinct doc_id, array_to_string(w[i + 1 : i + {neardup.WIDTH}], ' ') as s from (select doc_id, w, unnest(range(0, greatest(len(w) - {neardup.WIDTH} + 1, 1))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {neardup.PERCENT} * (x.n + y.n - k)),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
low as (select a, least(a, min(b)) as m from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(m, doc_id) as component_id, coalesce(m, doc_id) = doc_id as kept from d left join n using (doc_id) left join low on a = doc_id"""

DECONTAMINATION = f"""with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
win as (select distinct item_id, k, array_to_string(w[i + 1 : i + k], ' ') as s from (select item_id, w, least({decontam.WINDOW}, len(w)) as k, unnest(range(0, len(w) - least({decontam.WINDOW}, len(w)) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct k from win),
starts as (select r, k, unnest(range(0, len(w) - k + 1)) as i, w from d, sizes where len(w) >= k),
hit as (select r, i, win.k, item_id from starts join win on win.k = starts.k and win.s = array_to_string(w[i + 1 : i + starts.k], ' ')),
places as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(i, i + k)) as p from hit) group by r),
items as (select r, count(*) as n_items, sha256(string_agg(x, ',' order by x)) as items_sha256 from (select distinct r, cast(item_id as varchar) as x from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join places using (r) left join items using (r)"""

SUBSTRING_DEDUP = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1 : i + {substring.WINDOW}], ' ')) as s from (select doc_id, w, unnest(range(0, len(w) - {substring.WINDOW} + 1)) as i from d where len(w) >= {substring.WINDOW})),
first as (select s, min(doc_id) as m from win group by s),
gone as (select distinct doc_id, unnest(range(i, i + {substring.WINDOW})) as p from win join first using (s) where doc_id > m),
kept as (select x.doc_id, string_agg(word, ' ' order by x.p) as t, count(*) as n from (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as p from d) x left join gone using (doc_id, p) where gone.p is null group by x.doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


def _bucket(rule: str) -> str:
    score, width, n = quality.RULES[rule]
    for part in ("n_words", "n_lines", "word_chars"):
        score = score.replace(f"/ {part}", f"/ nullif({part}, 0)")
    return f"least(greatest(floor(coalesce({score}, 0) / {width}), 0), {n})::int"


_P = quality.ALPHA / len(quality.RULES)
QUALITY = f"""with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) as lines from documents),
triples as (select r, i, hash(w[i + 1], w[i + 2], w[i + 3]) as h from (select r, w, unnest(range(0, len(w) - 2)) as i from d where len(w) >= 3)),
twice as (select r, h from triples group by r, h having count(*) > 1),
repeated as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 3)) as p from triples join twice using (r, h)) group by r),
m as (select r, doc_id, stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines, (length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')))::bigint as n_capitals from d left join repeated using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
b as (select r, unnest([{", ".join(f"'{rule}'" for rule in quality.RULES)}]) as rule, unnest([{", ".join(_bucket(rule) for rule in quality.RULES)}]) as bucket from f),
truth as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
cells as (select stratum, rule, bucket, count(*) filter (quality > 0) as good, count(*) filter (quality <= 0) as bad from f join truth using (doc_id) join b using (r) where not base_failed group by all),
tested as (select *, sum(good) over strict as k, sum(bad) over strict as hits, sum(good) over (partition by stratum, rule) as n from cells window strict as (partition by stratum, rule order by bucket desc)),
tails as (select *, case when n <= 0 or k >= n * {_P!r} then 1.0 else list_sum(list_transform(range(0, k::bigint + 1), lambda i: exp(lgamma(n::double + 1) - lgamma(i::double + 1) - lgamma(n::double - i + 1) + i * ln({_P!r}) + (n - i) * ln(1 - {_P!r})))) end as tail from tested),
failing as (select *, max((tail > {quality.DELTA!r} / ({len(quality.RULES)} * (select greatest(1, count(distinct stratum)) from cells)))::int) over (partition by stratum, rule order by bucket desc) as failed, hits - {quality.GOOD_WEIGHT} * k as gain from tails),
cut as (select stratum, rule, arg_max(bucket, (gain, bucket)) as least from failing where failed = 0 and bucket > 0 and hits > 0 and gain > 0 group by all),
rejected as (select distinct f.r from f join b using (r) join cut on cut.stratum = f.stratum and cut.rule = b.rule and b.bucket >= cut.least)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected.r is null as kept from f left join rejected on rejected.r = f.r"""

ORACLES: dict[str, str] = {
    "op1_near_duplicates": NEAR_DUPLICATES,
    "op2_decontamination": DECONTAMINATION,
    "op8_substring_dedup": SUBSTRING_DEDUP,
    "op10_quality": QUALITY,
}
