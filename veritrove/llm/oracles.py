"""DuckDB SQL for the queries that SQL can express at the sizes it is run on.

The others (language model scores, packing, retrieval by word pairs, token
vocabularies and DOM trees) are held against brute force, the library or exact round trips in
tests/llm.
"""

from veritrove.llm.license_scan import BASE_PHRASES, MIN_SHARE, TEMPLATES

_WORDS = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""with d as (
  select row_number() over () as rn, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_WORDS}') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) as lines from d),
g as (select rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rn, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select rn, i from (select rn, i, count(*) over (partition by rn, g) as c from g) where c > 1),
c as (select rn, count(distinct p) as c from (select rn, unnest([i, i + 1, i + 2]) as p from r) group by 1),
f as (select doc_id, host, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.c, 0) as n_repeat_words
  from w left join c on c.rn = w.rn),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
h as (select host, count(*)::double as n, sum(base_failed::int)::double as k from b group by 1),
q as (select count(*) as c, sum(n) as n, sum(k) as k, sum(k * k / n) as kk, sum(n * n) as nn, sum(k) / sum(n) as m from h),
y as (select m, case when m * (1 - m) * (n - nn / n - (c - 1)) > 0 then (kk - m * k - m * (1 - m) * (c - 1)) / (m * (1 - m) * (n - nn / n - (c - 1))) end as rho from q),
z as (select m, case when rho is null then 10.0 when rho > 0 then greatest(1.0, least(10000.0, (1 - rho) / rho)) else 10000.0 end as s from y),
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _wording(label: str, key: str, text: str) -> str:
    """A template as a row: the place of its key phrase (words from 0), the key's first word and both as lists."""
    words, part = text.split(), key.split()
    shift = next(k for k in range(len(words)) if words[k : k + len(part)] == part)
    return f"('{label}', {shift}, '{part[0]}', string_split('{key}', ' '), string_split('{text}', ' '))"


def _license_sql() -> str:
    base = ", ".join(f"('{label}', '{p.split()[0]}', string_split('{p}', ' '))" for p, label in BASE_PHRASES.items())
    templates = ", ".join(_wording(*t) for t in TEMPLATES)
    return rf"""with d as (select row_number() over () as rn, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b(label, head, key) as (values {base}),
t(label, shift, head, key, words) as (values {templates}),
p as (select rn, unnest(w) as x, unnest(range(0, len(w))) as i from d),
f as (select p.rn, p.i, b.label from p join b on b.head = p.x join d on d.rn = p.rn where d.w[p.i + 1:p.i + len(b.key)] = b.key),
s as (select p.rn, t.label, list_sum(list_transform(range(0, len(t.words)), lambda j: (p.i - t.shift + j >= 0 and coalesce(d.w[p.i - t.shift + j + 1] = t.words[j + 1], false))::int)) / len(t.words)::double as share
  from p join t on t.head = p.x join d on d.rn = p.rn where d.w[p.i + 1:p.i + len(t.key)] = t.key),
l as (select rn, label from f union select rn, label from s where share >= {MIN_SHARE}),
fa as (select rn, count(*) as n, min(i) as lo, max(i) as hi, string_agg(distinct label, ',' order by label) as labels from f group by 1),
la as (select rn, string_agg(label, ',' order by label) as labels from l group by 1),
sa as (select rn, max(share) as share from s where share >= {MIN_SHARE} group by 1)
select doc_id, len(w) as n_words, coalesce(fa.n, 0) as n_base, lo as first_word, hi as last_word, coalesce(fa.labels, '') as base_labels, coalesce(la.labels, '') as labels,
  greatest(case when fa.n > 0 then 0.5 else 0 end::double, coalesce(share, 0)::double) as score
from d left join fa on fa.rn = d.rn left join la on la.rn = d.rn left join sa on sa.rn = d.rn"""


#: Five hex digits are four base32 digits, so a SHA-1 is eight such groups.
_BASE32 = """list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((list_sum(list_transform(range(1, 6), lambda j: (instr('0123456789abcdef', substr(h, (5 * g + j)::int, 1)) - 1) * (1 << (20 - 4 * j)::int)))::bigint >> k) & 31)::int, 1)), 'string_agg', '')), 'string_agg', '')"""

#: Frequencies of all phrases of up to three words by language, then cuts, cover and rank.
_PHRASES = rf"""with d as (select coalesce(lang, 'und') as lang, {_LOWER} as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from d),
w as materialized (select lang, row_number() over () as pn, regexp_extract_all(p, '[^\x20\x09]+') as w from p),
u as (select lang, pn, unnest(w) as x, unnest(range(0, len(w))) as i from w),
v as materialized (select lang, x as w1, lead(x) over o as w2, lead(x, 2) over o as w3 from u window o as (partition by pn order by i)),
f1 as materialized (select lang, w1, count(*) as f from v group by 1, 2),
f2 as materialized (select lang, w1, w2, count(*) as f from v where w2 is not null group by 1, 2, 3),
f3 as materialized (select lang, w1, w2, w3, count(*) as f from v where w3 is not null group by 1, 2, 3, 4 having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by 1),
x as (select c.lang, c.w1 || ' ' || c.w2 as phrase, c.w1, c.w2, null as w3, c.f as a, 1 as k, l.f as l, r.f as r from f2 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f1 r on r.lang = c.lang and r.w1 = c.w2 where c.f >= 10
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.w1, c.w2, c.w3, c.f, 1, l.f, r.f from f3 c join f1 l on l.lang = c.lang and l.w1 = c.w1 join f2 r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all select c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.w1, c.w2, c.w3, c.f, 2, l.f, r.f from f3 c join f2 l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join f1 r on r.lang = c.lang and r.w1 = c.w3),
s as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from x),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, w1, w2, max(f) as f from (select lang, w1, w2, f from f3 union all select lang, w2, w3, f from f3) group by 1, 2, 3),
o as (select b.* from b left join i on b.w3 is null and i.lang = b.lang and i.w1 = b.w1 and i.w2 = b.w2 where i.f is null or 100 * i.f < 50 * b.a)
select o.lang, row_number() over (partition by o.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from o join n on n.lang = o.lang qualify rank <= 2000"""

#: CRC-32 bit by bit; the fold as a recursion over turns, whose states carry cost, audit and the repaired turns.
_REPAIR = r"""with recursive c as (select row_number() over () as rn, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as t,
  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint) as bytes from conversations),
h as (select *, xor(list_reduce(list_concat([4294967295::bigint], bytes), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint) % 20 as h from c),
d as (select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then translate(t, '.!?', '') else t end as t,
  unnest(case when h = 3 then [0, 1] else [0] end) as copy from h where h <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, t) as k, rtrim(t, E' \t\n\x0b\x0c\r') as body from d),
f as (select *, role[1:1] as i, case when body = '' then 'b' when row_number() over (partition by conv_id, role, t order by k) > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '' end as f,
  lag(role[1:1]) over (partition by conv_id order by k) as before from o),
m as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum((f = 'b')::int) as blank, sum((f = 'd')::int) as duplicate, sum((f = 't')::int) as truncated,
  sum((before is not null and before || i not in ('su', 'ua', 'au'))::int) as illegal, count(*) as n from f group by 1),
r as (select conv_id, 0::bigint as k, {c: 0::bigint, a: '', t: []::varchar[]} as s0, {c: 1000000000::bigint, a: '', t: []::varchar[]} as s1, {c: 1000000000::bigint, a: '', t: []::varchar[]} as s2,
    {c: 1000000000::bigint, a: '', t: []::varchar[]} as s3 from m
  union all
  select conv_id, k, {c: s0.c + 3, a: s0.a || 'D', t: s0.t},
    least({c: s1.c + 3, a: s1.a || 'D', t: s1.t}, {c: s0.c + x + case when i = 's' then 0 else 1000000000 end, a: s0.a || 'K', t: list_append(s0.t, role || ':' || t)}),
    least({c: p2.c + 3, a: p2.a || 'D', t: p2.t}, {c: s0.c + x + u.c, a: s0.a || u.a, t: list_append(s0.t, u.t)}, {c: s1.c + x + u.c, a: s1.a || u.a, t: list_append(s1.t, u.t)}, {c: p3.c + x + u.c, a: p3.a || u.a, t: list_append(p3.t, u.t)}),
    least({c: p3.c + 3, a: p3.a || 'D', t: p3.t}, {c: p2.c + x + a.c, a: p2.a || a.a, t: list_append(p2.t, a.t)})
  from (select *, least(s3, {c: p2.c + 2, a: p2.a || 'I', t: list_append(p2.t, 'assistant:')}) as p3 from (
    select r.conv_id, f.k, s0, s1, s2, s3, i, role, t, case f when 't' then 1 when '' then 0 else 1000000000 end as x,
      case when i = 'u' then {c: 0, a: 'K', t: role || ':' || t} else {c: 2, a: 'R', t: 'user:' || t} end as u, case when i = 'a' then {c: 0, a: 'K', t: role || ':' || t} else {c: 2, a: 'R', t: 'assistant:' || t} end as a,
      least(s2, {c: s0.c + 2, a: s0.a || 'I', t: list_append(s0.t, 'user:')}, {c: s1.c + 2, a: s1.a || 'I', t: list_append(s1.t, 'user:')}, {c: s3.c + 2, a: s3.a || 'I', t: list_append(s3.t, 'user:')}) as p2
    from r join f on f.conv_id is not distinct from r.conv_id and f.k = r.k + 1))),
e as (select conv_id, k, s0, s3, least(s2, {c: s0.c + 2, a: s0.a || 'I', t: list_append(s0.t, 'user:')}, {c: s1.c + 2, a: s1.a || 'I', t: list_append(s1.t, 'user:')}) as p2 from r),
b as (select e.conv_id, gaps, blank, duplicate, truncated, illegal, least(s0, s3, {c: p2.c + 2, a: p2.a || 'I', t: list_append(p2.t, 'assistant:')}) as s
  from e join m on m.conv_id is not distinct from e.conv_id and m.n = e.k)
select v.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(s.c, 0)::bigint as cost, coalesce(s.a, '') as audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) v left join b on b.conv_id is not distinct from v.conv_id"""

ORACLES: dict[str, str] = {
    "op12_conversation_repair": _REPAIR,
    "op11_phrase_mining": _PHRASES,
    "op5_license_scan": _license_sql(),
    "op8_warc": f"""with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, strlen(t)::bigint as payload_bytes, {_BASE32} as payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type,
  case when first < page_id then first end as refers_to from f""",
    "op1_ngram_jaccard": rf"""with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') as w from documents),
g as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as g from w),
n as (select doc_id, len(g) as n, sha256(array_to_string(list_sort(g), chr(10))) as k from g),
s as (select doc_id, unnest(g) as s from g),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(id, root) as (select doc_id, doc_id from n union select e.b, r.root from r join e on e.a = r.id),
m as (select id, min(root) as component_id from r group by 1),
d as (select e.a as id, count(distinct y.k) as n_links from e join n x on x.doc_id = e.a join n y on y.doc_id = e.b where x.k <> y.k group by 1)
select n.doc_id, n.n as n_shingles, m.component_id, coalesce(d.n_links, 0) as n_links from n join m on m.id = n.doc_id left join d on d.id = n.doc_id""",
    "op2_quality_rules": rf"""{_QUALITY}x as (select host, (k + m * s) / (n + s) > 0.5 as host_failed from h, z)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept, host_failed from b join x on x.host = b.host""",
    "quality_hosts": rf"""{_QUALITY}select host, n::bigint as n_docs, k::bigint as n_failed, round((k + m * s) / (n + s), 6) as host_rate, (k + m * s) / (n + s) > 0.12 as host_failed from h, z""",
    "op7_line_dedup": rf"""with d as (select row_number() over () as rn, doc_id, coalesce(source, '') as site, string_split(coalesce(text, ''), chr(10)) as l from documents),
e as (select rn, doc_id, site, unnest(l) as line, generate_subscripts(l, 1) as pos from d),
s as (select line, min(doc_id) as keeper from e where regexp_matches(line, '{_WORDS}') group by 1 having count(distinct site) >= 8),
k as (select e.rn, e.pos, e.line, s.keeper is not null and e.doc_id > s.keeper as gone from e left join s on s.line = e.line)
select d.doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_removed, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text
from k join d on d.rn = k.rn group by d.rn, d.doc_id""",
}
