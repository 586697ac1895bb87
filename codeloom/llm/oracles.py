"""DuckDB SQL for the queries of this package that SQL can express."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = rf"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
b as (select page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} host, rest, length(regexp_extract(rest, '^[^/?#]*')) n from a),
c as (select page_id, host, regexp_extract(substr(rest, n + 1), '^[^?#]*') path from b),
r(name, rhost, rpath, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m as (select page_id, max_by(name, length(name)) as rule, max_by(verdict, length(name)) as verdict from c join r
  on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select c.page_id, host, path, m.rule, coalesce(m.verdict,
  case when regexp_matches(host || path, '/(login|signin)(/|$)') or regexp_matches(host || path, '^([^/]*\.)?(ads|adserver|doubleclick)\.')
    or regexp_matches(host || path, '/shop/cart(/|$)') or regexp_matches(host || path, '/wiki/special/tags(/|$)') then 'block' else 'allow' end) as verdict
from c left join m using (page_id)
"""

OP9 = rf"""
with b as (select item_id, w, len(w) n from (select item_id, regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark) where len(w) > 0),
win as (select distinct item_id, least(n, 13) k, array_to_string(w[i:i + least(n, 13) - 1], ' ') g from b, unnest(range(1, n - least(n, 13) + 2)) t(i)),
sizes as (select distinct k from win),
dw as (select doc_id, w, len(w) n from (select doc_id, regexp_extract_all({_LOW.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents) where len(w) > 0),
dg as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g from dw, sizes, unnest(range(1, n - k + 2)) t(i) where n >= k),
hit as (select doc_id, i, k, item_id from dg join win using (k, g)),
cov as (select doc_id, count(distinct p) n_hit from hit, unnest(range(i, i + k)) u(p) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from hit) group by doc_id)
select x.doc_id, coalesce(dw.n, 0)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(dw.n, 0) contaminated
from documents x left join dw using (doc_id) left join cov using (doc_id) left join its using (doc_id)
"""

_WORDS = r"len(regexp_extract_all({0}, '[^ \x09-\x0D]+'))"

OP10 = rf"""
with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) n from documents where text is not null),
l1 as (select doc_id, n, line, {_WORDS.format("line")} w from l),
r as (select *, lead(line, 1) over d b, lead(line, 2) over d c, lead(line, 3) over d e, lead(w, 1) over d wb, lead(w, 2) over d wc, lead(w, 3) over d we
  from l1 window d as (partition by doc_id order by n)),
k as (
  select doc_id, n, 1 s from r where w >= 50 qualify row_number() over (partition by line order by doc_id, n) > 1
  union all select doc_id, n, 2 from r where b is not null and w + wb >= 50 qualify row_number() over (partition by line, b order by doc_id, n) > 1
  union all select doc_id, n, 3 from r where c is not null and w + wb + wc >= 50 qualify row_number() over (partition by line, b, c order by doc_id, n) > 1
  union all select doc_id, n, 4 from r where e is not null and w + wb + wc + we > 0 qualify row_number() over (partition by line, b, c, e order by doc_id, n) > 1),
g as (select distinct doc_id, n + i as n from k, unnest(range(0, s)) u(i)),
o as (select l.doc_id, count(*) n_lines, count(g.n) n_deleted, coalesce(string_agg(line, chr(10) order by l.n) filter (g.n is null), '') t from l left join g using (doc_id, n) group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_deleted, 0)::bigint n_deleted, case when d.text is null then null else md5(t) end as text_md5 from documents d left join o using (doc_id)
"""

ORACLES: dict[str, str] = {"op8_url_rules": OP8, "op9_decontaminate": OP9, "op10_line_dedup": OP10}
