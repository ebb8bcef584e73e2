"""The opN queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from groundloom.llm import pii, quality, secrets, urls

WORD = r"[^\x20\x09-\x0D]+"
# The contract's patterns as they stand: RE2 needs no possessive forms.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spans(table: str, key: str, text: str, kind: str, rank: int, pattern: str) -> str:
    """key, kind, rank, begin, stop, hit of each match, from what lies between matches and the matches."""
    p = quoted(pattern)
    return f"""(select {key}, '{kind}' as kind, {rank} as rank, sum(length(gap) + length(hit)) over w - length(hit) as begin, sum(length(gap) + length(hit)) over w as stop, hit
    from (select {key}, i, h[i] as hit, g[i] as gap from (select {key}, h, g, unnest(range(1, len(h) + 1)) as i
      from (select {key}, regexp_extract_all({text}, {p}) as h, string_split_regex({text}, {p}) as g from {table})))
    window w as (partition by {key} order by i))"""


def joined(rows: str, order: str) -> str:
    return f"(select doc_id, string_agg(kind || ':' || begin::bigint || ':' || stop::bigint, ',' order by {order}) as s from {rows} group by doc_id)"


DOCS = "d as (select doc_id, coalesce(text, '') as text, source from documents)"

_kinds = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "account": secrets.ACCOUNT, "token": secrets.TOKEN, "endpoint": secrets.ENDPOINT}
_parts = " union all ".join(f"select * from {spans('d', 'doc_id', 'text', k, secrets.RANKS[k], p)}" for k, p in _kinds.items())

OP3 = f"""with {DOCS}, found as ({_parts}),
 parts as (select *, case when kind in ('assign', 'hex', 'token') then 'secret' when kind = 'endpoint' then kind else 'identifier' end as role from found
  where (kind <> 'assign' or length(regexp_extract(hit, {quoted(secrets.ASSIGN)}, 2)) >= 6) and (kind <> 'access' or length(hit) >= 20)
  and (kind <> 'token' or (regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[0-9]')))),
 near as (select w.doc_id, w.kind, w.rank, w.begin, w.stop, bool_or(p.role = 'secret') as s, bool_or(p.role = 'identifier') as i
  from parts w join parts p on w.doc_id = p.doc_id and abs(w.begin - p.begin) <= {secrets.SCOPE} where w.rank > 2 group by all),
 base as (select doc_id, kind, rank, begin, stop from parts where rank <= 2),
 everything as (select * from base union all select doc_id, kind, rank, begin, stop from near where (kind = 'account' and s) or (kind = 'token' and i) or (s and i))
 select d.doc_id, (select count(*) from base b where b.doc_id = d.doc_id and kind = 'assign') as n_assign, (select count(*) from base b where b.doc_id = d.doc_id and kind = 'access') as n_access,
  (select count(*) from base b where b.doc_id = d.doc_id and kind = 'hex') as n_hex, sha256(coalesce(x.s, '')) as base_sha256, coalesce(y.s, '') as spans
 from d left join {joined('base', 'begin, rank')} x on x.doc_id = d.doc_id left join {joined('everything', 'begin, rank')} y on y.doc_id = d.doc_id"""

_digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
_luhn = "(list_sum([case when i % 2 = 0 then reverse(x)[i + 1]::int when reverse(x)[i + 1]::int > 4 then reverse(x)[i + 1]::int * 2 - 9 else reverse(x)[i + 1]::int * 2 end for i in range(length(x))]) % 10 = 0)"
_personal = " union all ".join(f"select * from {spans('d', 'doc_id', 'text', k, pii.RANKS[k], p)}" for k, p in {"email": EMAIL, "ip": IP, "card": CARD, "phone": pii.PHONE}.items())

OP4 = f"""with {DOCS}, found as (select *, {_digits} as x from ({_personal})),
 base as (select doc_id, kind, rank, begin::bigint as begin, stop::bigint as stop, hit from found where kind = 'email' or (kind = 'ip' and list_max([ltrim(p, '0') = '' or (length(ltrim(p, '0')) <= 3 and ltrim(p, '0')::int <= 255) for p in string_split(hit, '.')]) and list_min([ltrim(p, '0') = '' or (length(ltrim(p, '0')) <= 3 and try_cast(ltrim(p, '0') as int) <= 255) for p in string_split(hit, '.')]))
  or (kind = 'card' and length(x) between 13 and 19 and {_luhn}) or (kind = 'phone' and length(x) between 9 and 15)),
 ctx as (select (doc_id, rank, begin) as id, doc_id, text, kind || ':' || lower(hit) as entity, stop, greatest(begin - {pii.SPREAD}, 0) as edge, substr(text, greatest(begin - {pii.SPREAD}, 0) + 1, begin - greatest(begin - {pii.SPREAD}, 0)) as before, substr(text, stop + 1, {pii.SPREAD}) as after from base join d using (doc_id)),
 l as (select x.*, row_number() over (partition by id order by begin desc) as k from {spans('ctx', 'id', 'before', 'l', 0, WORD)} x join ctx using (id) where edge = 0 or begin > 0),
 r as (select x.*, row_number() over (partition by id order by begin) as k from {spans('ctx', 'id', 'after', 'r', 1, WORD)} x join ctx c using (id) where length(text) - c.stop <= {pii.SPREAD} or x.stop < {pii.SPREAD}),
 w as (select id, rank, begin::bigint as b, stop::bigint as e, hit from l where k <= {pii.REACH} union all select id, rank, begin::bigint, stop::bigint, hit from r where k <= {pii.REACH}),
 seen as (select id, string_agg(lower(hit), ' ' order by rank, b) as context from w group by id),
 near as (select doc_id, entity, context, lower(hit) as term, case when w.rank = 0 then c.edge + b else c.stop + b end as begin, case when w.rank = 0 then c.edge + e else c.stop + e end as stop
  from w join seen using (id) join ctx c using (id) where not regexp_matches(lower(hit), '[0-9@]')),
 pairs as (select entity, term from near group by all having count(distinct context) >= {pii.SUPPORT}),
 holds as (select distinct entity, text from ctx),
 n_entity as (select entity, count(*) as n_entity from holds group by all),
 says as (select text, unnest(list_distinct(regexp_extract_all(lower(text), {quoted(WORD)}))) as term from (select distinct text from d)),
 n_term as (select term, count(*) as n_term from says where term in (select term from pairs) group by all),
 n_both as (select entity, term, count(*) as n_both from pairs join holds using (entity) join says using (text, term) group by all),
 told as (select entity, term from n_both join n_entity using (entity) join n_term using (term), (select count(distinct text) as n from d) where n_entity < n and log2(least(1.0, n_both::double / n_term)) + log2(n::double / n_entity) >= {pii.THRESHOLD} * log2(n::double / n_entity)),
 everything as (select doc_id, kind, rank, begin, stop from base union all select distinct doc_id, 'term', 4, begin, stop from near join told using (entity, term))
 select d.doc_id, {', '.join(f"(select count(*) from base b where b.doc_id = d.doc_id and kind = '{k}') as n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
  sha256(coalesce(x.s, '')) as base_sha256, coalesce(y.s, '') as spans
 from d left join {joined('base', 'rank, begin')} x on x.doc_id = d.doc_id left join {joined('everything', 'rank, begin')} y on y.doc_id = d.doc_id"""

OP5 = f"""with {DOCS}, w as (select doc_id, source, text, regexp_extract_all(text, {quoted(WORD)}) as w, [x for x in string_split(text, chr(10)) if regexp_matches(x, {quoted(WORD)})] as l from d),
 g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
 twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
 covered as (select doc_id, sum(n)::bigint as n from (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from twice) group by doc_id),
 even as (select doc_id, source, regexp_replace(lower(text), '[ \\t\\x0b\\x0c\\r]+', ' ', 'g') as even from d),
 lines as (select doc_id, source, signature, line, len(string_split(line, ' ')) as n from (select doc_id, source, trim(even) as signature, trim(unnest(string_split(even, chr(10)))) as line from even) where line <> ''),
 hosts as (select source, count(distinct signature) as docs from lines group by source),
 often as (select c.source, line from (select source, line, count(distinct signature) as n from lines group by all) c join hosts on c.source is not distinct from hosts.source where n > {quality.LEAST} and n > {quality.SHARE} * docs),
 gone as (select doc_id, sum(n)::bigint as gone from lines where exists (select 1 from often o where o.line = lines.line and o.source is not distinct from lines.source) group by doc_id),
 m as (select doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0) as n_repeat_words, (len(w) - coalesce(gone, 0))::bigint as n_left_words from w left join covered using (doc_id) left join gone using (doc_id)),
 f as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, not base_failed and 100 * n_left_words >= {quality.KEEP_PERCENT} * n_words as kept from f"""

_rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
_upper = "".join(map(chr, range(65, 91)))

OP6 = f"""with u as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
 p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_upper}', '{_upper.lower()}') as host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from u),
 r(v, h, q) as (values {_rules}),
 best as (select page_id, arg_max(h || q, (length(h), length(q))) as rule, arg_max(v, (length(h), length(q))) as v from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by page_id)
 select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join best using (page_id)"""

ORACLES = {"op3_secret_scan": OP3, "op4_personal_data": OP4, "op5_quality_rules": OP5, "op6_url_filter": OP6}
