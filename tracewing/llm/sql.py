"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

URL_FILTER = r"""
with parts as (
  select page_id, url,
    case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select page_id, url, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' and split_part(p, '=', 1) not in
        ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))) as query
  from parts
), canon as (
  select *, case when instr(url, '://') > 0 then
      regexp_replace(host, ':(80|443)$', '') || (case when path = '' then '/' else path end)
      || (case when len(query) = 0 then '' else '?' || array_to_string(query, '&') end) end as canonical
  from split
), listed as (
  select distinct canonical from canon
  where regexp_matches(host, '(^|\.)(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)\.')
), rules(domain, start, what) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ruled as (
  select c.*, r.domain || r.start as rule, r.what,
    row_number() over (partition by c.page_id order by length(r.domain || r.start) desc nulls last) as n
  from canon c left join rules r
    on (c.host = r.domain or ends_with(c.host, '.' || r.domain)) and starts_with(c.path, r.start)
)
select page_id, host, path, rule,
  coalesce(what, case when canonical in (select canonical from listed where canonical is not null)
    then 'block' else 'allow' end) as verdict
from ruled where n = 1
"""

WARC_REVISITS = r"""
with hashed as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), fives as (
  select page_id, payload_bytes, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::int) as five
  from hashed
), digests as (
  select page_id, payload_bytes::bigint as payload_bytes,
    array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '')
      as payload_digest
  from fives
), firsts as (select *, max(page_id) over (partition by payload_digest) as original from digests)
select page_id, payload_bytes, payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id <> original then original end as refers_to
from firsts
"""

CHAT_FORMAT = r"""
with turns as (select distinct conv_id, turn, role, text from conversations),
placed as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n_turns,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') over w as head
  from turns window w as (partition by conv_id order by turn rows between unbounded preceding and current row)
), wholes as (select conv_id, n_turns, head from placed where pos = n_turns),
kept as (
  select min(conv_id) as conv_id, n_turns from wholes
  where head not in (select head from placed where pos < n_turns) group by head, n_turns
)
select conv_id, p.n_turns, (pos - 1) // 64 as part, string_agg('<|im_start|>'
    || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
    || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')
    || '<|im_end|>' || chr(10), '' order by pos) as text
from placed p join kept using (conv_id) group by conv_id, p.n_turns, (pos - 1) // 64
"""

NEAR_DUPLICATES = r"""
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as materialized (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
  from words
), classes as materialized (
  select hash(list_sort(s)) as class, min(doc_id) as rep, any_value(s) as s, len(any_value(s)) as n
  from sets where len(s) > 0 group by 1
), items as materialized (select class, n, unnest(s) as item from classes),
links as materialized (
  select a.class as x, b.class as y from items a join items b on a.item = b.item and a.class < b.class
  group by a.class, b.class, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges as materialized (select x, y from links union all select y, x from links),
reach as (
  select class as x, class as y from classes union select r.x, e.y from reach r join edges e on r.y = e.x
), least as (
  select r.x as class, min(c.rep) as component_id from reach r join classes c on c.class = r.y group by r.x
)
select doc_id, len(s) as n_shingles, coalesce(component_id, doc_id) as component_id,
  coalesce(component_id, doc_id) = doc_id as kept
from sets left join least on least.class = hash(list_sort(s)) and len(s) > 0
"""

EXACT_DEDUP = r"""
with texts as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from texts window same as (partition by norm)
"""

BENCHMARK_PASSAGES = r"""
with cut as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
  union all
  select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') from benchmark
), short as (select distinct len(w) as n from cut where side = 'i' and len(w) between 1 and 4
), shingles as materialized (
  select side, id, unnest(list_distinct(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end)) as s
  from cut where len(w) > 0
  union all
  select side, id, unnest(list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))))
  from cut, short where side = 'd' and len(w) > n
), sizes as (select id, count(*) as n from shingles where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, n as n_shingles, count(*) as n_shared
from shingles d join shingles i on d.s = i.s and d.side = 'd' and i.side = 'i' join sizes on sizes.id = i.id
group by d.id, i.id, n having count(*) * 100 >= n * 80
"""


def _spans(place: int, kind: str, pattern: str, valid: str) -> str:
    """Rows (doc_id, b, place, kind, e) of valid matches; a match begins after all texts and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""
  select doc_id, b, {place} as place, '{kind}' as kind, b + length(found) as e from (
    select doc_id, m[i] as found, {{inner}} as inner_part,
      list_sum(list_transform(p[1:i], lambda x: length(x)))::bigint
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::bigint as b
    from (select doc_id, regexp_extract_all(text, '{quoted}') as m, string_split_regex(text, '{quoted}') as p,
        {{inner_all}} as g from texts), unnest(range(1, len(m) + 1)) as u(i)
  ) where {valid}""".replace("{inner}", "g[i]").replace(
        "{inner_all}", f"regexp_extract_all(text, '{quoted}', 2)" if valid.startswith("length(inner_part)") else "m"
    )


def _span_query(spans: list[str], base: tuple[str, ...], setup: str = "") -> str:
    listed = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in base)
    joined = "string_agg(kind || ':' || b || ':' || e, ',' order by b, place, kind, e)"
    return f"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
found as materialized ({" union all ".join(spans)})
select doc_id, {counts},
  sha256(coalesce({joined} filter (kind in ({listed})), '')) as base_sha256, coalesce({joined}, '') as spans
from texts left join found using (doc_id) group by doc_id
"""


_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _KEYWORDS)

SECRET_SCAN = _span_query(
    [
        _spans(0, "assign", f"""({_EITHER_CASE})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(inner_part) >= 12"),
        _spans(1, "access", "AKIA[A-Z0-9]+", "length(found) >= 18"),
        _spans(2, "hex", "[0-9a-f]+", "length(found) >= 16"),
        _spans(3, "private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
        _spans(4, "chat_token", "xox[abprs]-[A-Za-z0-9-]+", "length(found) >= 15"),
        _spans(5, "web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(found) >= 40"),
    ],
    ("assign", "access", "hex"),
)

_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
#: Every second digit from the right doubled, nine taken off where that gives two digits.
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
  case when i % 2 = 1 then substr(reverse({_DIGITS}), i, 1)::int
    else 2 * substr(reverse({_DIGITS}), i, 1)::int - case when substr(reverse({_DIGITS}), i, 1)::int > 4 then 9 else 0 end
  end)) % 10 = 0"""
#: The base kinds; iban and ssn need look-around, which RE2 lacks, so on data with such numbers the column spans has
#: more than this. Tests hold those two against a brute-force search.
PERSONAL_DATA = _span_query(
    [
        _spans(1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans(2, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               "len(list_filter(string_split(found, '.'), lambda x: x::hugeint > 255)) = 0"),
        _spans(3, "card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}"),
        _spans(4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
    ],
    ("email", "ip", "card", "phone"),
)

HARD_NEGATIVES = """
with r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as materialized (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same,
    list_inner_product(a.v, c.v)::bigint as score
  from (select distinct * from r where vec_id % 100 = 0) a join r c on a.vec_id <> c.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, positive_id, row_number() over w as rank, n.other_id as negative_id, positive_score,
  n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 80 * positive_score <= 100 * n.score and n.score <= positive_score
window w as (partition by p.anchor_id, positive_id order by n.score desc, n.other_id)
qualify row_number() over w <= 5
"""

ORACLES = {
    "op3_url_filter": URL_FILTER,
    "op4_warc_revisits": WARC_REVISITS,
    "op5_secret_scan": SECRET_SCAN,
    "op6_chat_format": CHAT_FORMAT,
    "op7_near_duplicates": NEAR_DUPLICATES,
    "op8_exact_dedup": EXACT_DEDUP,
    "op9_benchmark_passages": BENCHMARK_PASSAGES,
    "op10_personal_data": PERSONAL_DATA,
    "op12_hard_negatives": HARD_NEGATIVES,
}
