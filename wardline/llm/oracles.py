"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLES = {
    "op1_warc": r"""
with facts as (
  select page_id, encode(coalesce(html, '')) as body from pages),
digested as (
  select page_id, octet_length(body) as payload_bytes, upper(sha1(body)) as h from facts),
firsts as (
  select *, min(page_id) over (partition by h, payload_bytes) as head from digested)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i * 5 + 1)::int, 5))::int >> s) & 31) + 1)::int, 1)),
    'string_agg', '')), 'string_agg', '') as payload_digest,
  case when head = page_id then 'response' else 'revisit' end as record_type,
  case when head <> page_id then head end as refers_to
from firsts""",
    "op2_line_dedup": r"""
with lines as (
  select doc_id, generate_subscripts(l, 1) as pos, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
firsts as (
  select k, min(doc_id) as head from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
judged as (
  select y.doc_id, y.pos, y.line, f.k is not null and y.doc_id <> f.head as gone
  from keyed y left join firsts f on y.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op3_embeddings": r"""
with recursive vectors as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
sound as (
  select vec_id, v, sqrt(list_inner_product(v, v)) as n from vectors
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from sound a join sound b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as component_id from reach group by a),
degrees as (select a, count(*) as n_links from links group by a)
select e.vec_id, coalesce(d.n_links, 0) as n_links, r.component_id, r.component_id = e.vec_id as kept
from embeddings e join roots r on r.a = e.vec_id left join degrees d on d.a = e.vec_id""",
    "op9_ngram_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
grams as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
half as (
  select s.a, s.b from shared s join sizes x on x.doc_id = s.a join sizes y on y.doc_id = s.b
  where 100 * s.n >= 90 * (x.n + y.n - s.n)),
links as (select a, b from half union all select b, a from half),
reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.component_id
from documents d join roots r on r.a = d.doc_id left join sizes s on s.doc_id = d.doc_id""",
    "op11_prefix_trie": r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(
      length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} as content
  from conversations where conv_id is not null),
original as (select conv_id, list(content order by pos) as l from turns group by conv_id),
heads as (
  select conv_id, l, conv_id - conv_id % 100 as donor, xor(list_reduce(list_prepend(4294967295::bigint,
    list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint)), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)),
    4294967295::bigint) % 6 as h from original),
convs as (
  select h.conv_id, list_concat(coalesce(d.l, [])[1:h], h.l[h + 1:]) as l
  from (select conv_id, l, donor, h::int as h from heads) h left join original d on d.conv_id = h.donor),
paths as (
  select conv_id, len(l) as length, list_prepend('', list_transform(range(1, len(l) + 1), lambda d: sha256(l[1:d]::json::varchar))) as p,
    list_prepend(0, list_transform(l, lambda x: length(x.t))) as chars from convs),
members as (
  select conv_id, length, p, unnest(range(0, length + 1)) as depth, unnest(p) as node, unnest(chars) as chars from paths),
nodes as (
  select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars, any_value(p[1:depth + 1]) as path,
    any_value(case when depth > 0 then p[depth] end) as parent,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = depth), '') as ends
  from members group by node, depth),
kids as (select parent, depth - 1 as depth, count(*) as n_children from nodes where parent is not null group by 1, 2),
facts as (
  select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k on k.parent = n.node and k.depth = n.depth),
spread as (
  select unnest(path) as top, unnest(range(0, depth + 1)) as top_depth, (n_children = 0)::int as leaf, (n_convs - 1) * chars as saved from facts),
sums as (select top, top_depth, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from spread group by 1, 2)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens,
  sha256(f.ends) as ends_sha256
from facts f join sums s on s.top = f.node and s.top_depth = f.depth left join facts u on u.node = f.parent and u.depth = f.depth - 1""",
}


def _personal_data() -> str:
    """Patterns as RE2 takes them; checksums, neighbours and context words in plain SQL."""
    digit = "list_transform(range(1, length({d}) + 1), lambda i: ord(substr({d}, i::int, 1)) - 48)"
    bare = "regexp_replace(value, '[^0-9]', '', 'g')"
    digits = digit.format(d="d")
    luhn = f"""list_sum(list_transform(list_reverse({digits}), lambda x, i:
      case when i % 2 = 1 then x when x > 4 then 2 * x - 9 else 2 * x end)) % 10 = 0"""
    iban = """list_reduce(list_prepend(0::bigint, list_transform(string_split(
      replace(substr(value, 5), ' ', '') || left(value, 4), ''), lambda c: (case when c between '0' and '9'
      then 1000 + ord(c) - 48 else 10000 + ord(c) - 55 end)::bigint)),
      lambda rest, c: (case when c < 10000 then rest * 10 + c - 1000 else rest * 100 + c - 10000 end) % 97) = 1"""
    routing = f"list_sum(list_transform({digits}, lambda x, i: x * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0 and d <> '000000000'"
    octets = "len(list_filter(string_split(value, '.'), lambda x: try_cast(ltrim(x, '0') as int) > 255 or length(ltrim(x, '0')) > 3)) = 0"
    call, net = "phone|tel|telephone|mobile|cell|fax|call", "ip|host|address|server|client"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 70, "mail|email|contact", False),
        ("ip", r"[0-9]+(?:\.[0-9]+){3}", octets, 60, net, False),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", f"length(d) between 13 and 19 and {luhn}", 90, "card|credit|debit|visa|mastercard|amex", False),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15", 60, call, False),
        ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
         f"length(replace(value, ' ', '')) between 15 and 34 and {iban}", 90, "iban|account|bank|transfer", True),
        ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "not regexp_matches(value, '^(000|666|9)|-00-|0000$')", 40, "ssn|social|security|taxpayer", True),
        ("routing", r"[0-9]{9}", routing, 40, "routing|aba|bank|transfer", True),
        ("birth", r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}", "true", 25, "born|birth|birthday|dob", True),
        ("local", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true", 30, call, True),
        ("ipv6", r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}", "true", 60, net, True),
    ]
    counter = "version|release|build|isbn|invoice|order|ticket|example|sample|figure|table"
    words = sorted({w for k in [*kinds, ("", "", "", 0, counter)] for w in k[4].split("|")}, key=lambda w: (-len(w), w))
    patterns = [(n, k[1]) for n, k in enumerate(kinds)] + [(99, "|".join(words))]
    found = " union all ".join(
        f"""select doc_id, {n} as kind, unnest(regexp_extract_all({body}, '{p}')) as value,
      generate_subscripts(regexp_extract_all({body}, '{p}'), 1) as i, regexp_split_to_array({body}, '{p}') as gaps from texts"""
        for n, p in patterns
        for body in ["small" if n == 99 else "text"]
    )
    pick = lambda at: " ".join(f"when {n} then {k[at]}" for n, k in enumerate(kinds))
    listed = lambda text: ", ".join(f"'{w}'" for w in text.split("|"))
    said = " ".join(f"when {n} then w.value in ({listed(k[4])})" for n, k in enumerate(kinds))
    whole = ", ".join(str(n) for n, k in enumerate(kinds) if k[5])
    names = ", ".join(f"'{k[0]}'" for k in kinds)
    return f"""
with texts as (
  select doc_id, coalesce(text, '') as text,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as small from documents),
found as ({found}),
placed as (
  select doc_id, kind, value, {bare} as d,
    regexp_matches(right(gaps[i], 1) || '.' || left(gaps[i + 1], 1), '[A-Za-z0-9]') as touched,
    (sum(length(gaps[i]) + length(value)) over (partition by doc_id, kind order by i))::bigint as e from found),
spans as (
  select *, e - length(value) as s from placed
  where case kind {pick(2)} else true end and not (touched and kind in ({whole}, 99))),
near as (
  select p.doc_id, p.kind, p.s, p.e,
    coalesce(bool_or(case p.kind {said} end), false) as plus, coalesce(bool_or(w.value in ({listed(counter)})), false) as minus
  from spans p left join spans w on w.doc_id = p.doc_id and w.kind = 99 and
    ((w.e <= p.s and p.s - w.e <= 60) or (w.s >= p.e and w.s - p.e <= 60))
  where p.kind < 99 group by all),
judged as (
  select n.*, least(greatest(case kind {pick(3)} end + case when plus then 35 else 0 end - case when minus then 30 else 0 end, 0), 100) as points,
    [{names}][kind + 1] as name from near n),
kept as (
  select *, name || ':' || s || ':' || e as shown from judged j
  where kind < 4 or (points >= 50 and not exists (
    select 1 from spans b where b.doc_id = j.doc_id and b.kind < 4 and b.s < j.e and b.e > j.s)))
select t.doc_id, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip,
  count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone,
  sha256(coalesce(string_agg(shown, ',' order by kind, s) filter (kind < 4), '')) as base_sha256,
  coalesce(string_agg(shown, ',' order by kind, s), '') as spans,
  coalesce(string_agg(points::varchar, ',' order by kind, s), '') as points
from texts t left join kept k on k.doc_id = t.doc_id group by t.doc_id"""


ORACLES["op13_pii"] = _personal_data()
