"""The same answers in DuckDB SQL, computed another way.

Where Spark works on arrays inside the row, the SQL here unnests, joins and groups. Word lists and
fixture phrases come from the same constants; the logic does not.
"""

from __future__ import annotations

import re

from wardline import vocab
from wardline.plans import catalog
from wardline.sources import fixtures

_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"
_WORD = r"[\p{L}\p{N}_]"
_EDGE = r"[^\p{L}\p{N}_]"


def _q(value: object) -> str:
    if value is None:
        return "cast(null as varchar)"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def _values(rows) -> str:
    return "values " + ", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in rows)


def _numbered(phrases) -> str:
    return _values(enumerate(phrases))


# --- snippets ----------------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


def _norm(x: str) -> str:
    # RE2 knows ASCII words only, so other letters become a word character first.
    x = f"regexp_replace({x}, 'https?://{_NON_SPACE}+', '', 'g')"
    x = rf"regexp_replace({x}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]', '_', 'g')"
    x = rf"regexp_replace({x}, '(?i)\b(rt|via)\b', '', 'g')"
    return f"lower(trim(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"


def _title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '([\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|"
        f"[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+)', 1), lambda p: case when left(p, 1) = 'ß' then 'Ss' else upper(left(p, 1)) end "
        f"|| lower(substr(p, 2))), '')"
    )


def _any_word(x: str, words) -> str:
    names = "|".join(re.escape(w) for w in words)
    return _match(x, f"(^|{_EDGE})({names})($|{_EDGE})")


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def _any_part(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, {_q(w)})" for w in words) + ")"


def _hits(x: str, words) -> str:
    return f"cast(len(list_filter({[*words]!r}, lambda w: contains({x}, w))) as integer)"


def _severity(x: str) -> str:
    low = _collapse(f"lower({x})")
    return f"""case
      when {_any_part(low, vocab.POWER_TERMS)} and {_any_part(low, vocab.POWER_FAULTS)} then 'High'
      when {_any_word(low, vocab.SEVERITY_HIGH)} then 'High'
      when {_any_word(low, vocab.SEVERITY_MEDIUM)} then 'Medium'
      when {_any_word(low, vocab.SEVERITY_LOW)} then 'Low' end"""


def _urgency(x: str) -> str:
    return f"""case when {_hits(f'lower({x})', vocab.URGENCY_URGENT)} >= 1 then 'Angry/Urgent'
      when {_hits(f'lower({x})', vocab.URGENCY_CONCERNED)} >= 1 then 'Concerned' end"""


def _weak_text(*fields: str) -> str:
    joined = " || ' ' || ".join(f"replace(lower(coalesce({f}, '')), '-', ' ')" for f in fields)
    return _collapse(joined)


def _weak_severity(sub: str, remarks: str) -> str:
    t = _weak_text(sub, remarks)
    return f"""case
      when {_any_part(t, vocab.POWER_TERMS)} and {_any_part(t, vocab.POWER_FAULTS)} then 'HIGH'
      when {_any_word(t, vocab.WEAK_HIGH)} then 'HIGH'
      when {_any_word(t, vocab.WEAK_MEDIUM)} then 'MEDIUM'
      when {_any_word(t, vocab.WEAK_LOW)} then 'LOW' else 'MEDIUM' end"""


def _weak_urgency(sub: str, remarks: str) -> str:
    t = _weak_text(sub, remarks)
    return f"""case
      when {_any_part(t, vocab.POWER_TERMS)} and contains({t}, 'not working') then 'URGENT'
      when {_any_word(t, vocab.WEAK_URGENT)} then 'URGENT'
      when {_any_word(t, vocab.WEAK_CONCERNED)} then 'CONCERNED'
      when {_any_word(t, vocab.WEAK_NEUTRAL)} then 'NEUTRAL' else 'CONCERNED' end"""


def _compose(category: str, sub: str, ward: str, remarks: str) -> str:
    c, s, w, r = (f"coalesce({x}, '')" for x in (category, sub, ward, remarks))
    return _collapse(f"{c} || ' - ' || {s} || ' in ' || {w} || '. ' || {r}")


def _civic(x: str) -> str:
    cases = " ".join(
        f"when {x} = {_q(k)} then {_q(v)}" for k, v in vocab.MODEL_LABEL_CATEGORY.items()
    )
    plain = f"trim(replace({x}, '_', ' '))"
    return f"case {cases} when coalesce({plain}, '') = '' then {_q(vocab.GENERAL)} else {_title(plain)} end"


def _urgency_label(x: str) -> str:
    return f"""case when regexp_matches(lower({x}), 'urgent|angry') then 'Angry/Urgent'
      when regexp_matches(lower({x}), 'concern|warn') then 'Concerned' else 'Neutral' end"""


def _preview(x: str) -> str:
    s = _strip(x)
    return f"case when length({s}) > 160 then left({s}, 157) || '...' else {s} end"


def _pick(x: str, labels, salt: str = "") -> str:
    # The first eight hex digits as a number, by position.
    return (
        f"({[*labels]!r})[cast(('0x' || left(md5({x} || {_q(salt)}), 8)) as bigint) % {len(labels)} + 1]"
    )


def _words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{_WORD}{{2,}}')"


def _raw(key: str, k: str) -> str:
    return f"cast(1 + ({key} * 7919 + {k} * 104729) % 97 as double)"


_MINIMUM = "case when hint = 'High' then 0.85::double when hint = 'Low' then 0.75::double else 0.65::double end"
_URGENT_MINIMUM = "case when hint = 'Angry/Urgent' then 0.8::double else 0.7::double end"


def _urgent_flag(labels) -> str:
    return f"coalesce(lower(urgency) in ({', '.join(_q(x) for x in labels)}), false)"


def _percent(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then round_even(cast({part} as double) / {whole} * 100.0, 1) else 0.0::double end"


# --- common table expressions: name -> (needs, body) ----------------------------------

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


_cte("subj(i, phrase)", _numbered(fixtures.SUBJECTS))
_cte("place(i, phrase)", _numbered(fixtures.PLACES))
_cte("tone(i, phrase)", _numbered(fixtures.TONES))
_cte(
    "cx",
    """select e.event_id as complaint_id, e.ts as created_at,
      'LABEL_' || cast(e.event_id % 31 as varchar) as model_label,
      cast((40 + (e.event_id * 37) % 60) / 100.0 as double) as model_confidence,
      nullif(p.phrase, '') as location,
      s.phrase || case when p.phrase = '' then '' else ' in ' || p.phrase end
        || case when t.phrase = '' then '' else ', ' || t.phrase end as complaint_text
    from events e join subj s on s.i = e.event_id % 12 join place p on p.i = e.user_id % 6
      join tone t on t.i = (e.event_id + e.user_id) % 5""",
    "subj(i, phrase)", "place(i, phrase)", "tone(i, phrase)",
)
_cte("cat(i, phrase)", _numbered(fixtures.CATEGORIES))
_cte("sub(i, phrase)", _numbered(fixtures.SUB_CATEGORIES))
_cte("rem(i, phrase)", _numbered(fixtures.REMARKS))
_cte(
    "gx",
    """select o.o_orderkey as grievance_id, c.phrase as category, s.phrase as sub_category,
      n.n_name as ward_name, r.phrase as staff_remarks
    from orders o join customer k on k.c_custkey = o.o_custkey
      join nation n on n.n_nationkey = k.c_nationkey join cat c on c.i = o.o_orderkey % 5
      join sub s on s.i = o.o_orderkey % 7 join rem r on r.i = o.o_custkey % 6""",
    "cat(i, phrase)", "sub(i, phrase)", "rem(i, phrase)",
)
_cte(
    "kw(category, rank, keyword)",
    _values(
        (category, rank, keyword)
        for rank, (category, keywords) in enumerate(vocab.CATEGORY_KEYWORDS.items())
        for keyword in keywords
    ),
)


def _keyword_winner(source: str, key: str, text: str) -> str:
    """Rows ``key, category, evidence`` for texts with a hit."""
    return f"""select {key}, category, evidence from (
      select {key}, category, evidence, row_number() over (partition by {key} order by n desc, rank) as rn
      from (select s.{key}, k.category, k.rank, count(*) as n,
              string_agg(k.keyword, ', ' order by k.keyword) as evidence
            from (select distinct {key}, {text} from {source}) s
            join kw k on contains(lower(s.{text}), k.keyword) group by all)) where rn = 1"""


_cte("dd", "select doc_id as complaint_id, text as complaint_text from documents")
for _winner, _named, _source in (("kc", "cn", "cx"), ("dk", "dn", "dd")):
    _cte(
        _winner,
        _keyword_winner(_source, "complaint_id", "complaint_text"),
        _source, "kw(category, rank, keyword)",
    )
    _cte(
        _named,
        f"""select s.*, {_norm('complaint_text')} as cleaned,
          coalesce(k.category, {_q(vocab.GENERAL)}) as keyword, k.evidence
        from {_source} s left join {_winner} k using (complaint_id)""",
        _source, _winner,
    )
_cte(
    "lx",
    f"""select complaint_id, created_at,
      case when model_confidence >= 0.68 then model_label else nullif(keyword, {_q(vocab.GENERAL)}) end as issue_type,
      {_severity('complaint_text')} as severity, {_urgency('cleaned')} as urgency, location, complaint_text
    from cn""",
    "cn",
)
_cte(
    "weak",
    f"""select grievance_id, {_compose('category', 'sub_category', 'ward_name', 'staff_remarks')} as text,
      category, {_weak_severity('sub_category', 'staff_remarks')} as severity,
      {_weak_urgency('sub_category', 'staff_remarks')} as urgency from gx""",
    "gx",
)

# Score lists in long form: doc_id, pos, label, score.
_cte("lab(k, label)", _numbered(["Low", "Medium", "High"]))
_cte(
    "px",
    f"""select doc_id, k as pos, label,
      case when doc_id % 13 = 0 then 0.0::double
        else {_raw('doc_id', 'k')} / sum({_raw('doc_id', 'k')}) over (partition by doc_id) end as score
    from documents cross join lab where doc_id % 17 <> 0""",
    "lab(k, label)",
)
# Damaged lists: text scores, one row per entry; lists that are NULL or empty have no rows.
_cte(
    "dx",
    f"""select doc_id, pos,
      case when doc_id % 10 = 2 and pos = 1 then null else label end as label,
      case when doc_id % 10 = 3 and pos = 2 then null
           when doc_id % 10 = 4 and pos = 0 then '1.5'
           when doc_id % 10 = 6 and pos = 1 then 'bad'
           when doc_id % 10 = 5 then cast(score * 0.5 as varchar) else cast(score as varchar) end as score
    from (select doc_id, k as pos, label,
            {_raw('doc_id', 'k')} / sum({_raw('doc_id', 'k')}) over (partition by doc_id) as score
          from documents cross join lab) where doc_id % 10 > 1""",
    "lab(k, label)",
)


def _fuse(prefix: str, ids: str, items: str, zero_guard: bool) -> list[tuple[str, str]]:
    """CTEs that end in ``{prefix}_out(id, pos, label, score)``.

    ``ids`` gives id, target, minimum; ``items`` gives id, pos, label, score.
    """
    guard = "when mass <= 0 then cast(label = target as double)" if zero_guard else ""
    return [
        (
            f"{prefix}_items",
            f"""select id, pos, label, score, target, minimum, false as empty
                from ({items}) join ({ids}) using (id)
              union all
              select i.id, coalesce(n, 0), target, 0.0, target, minimum, n is null
              from ({ids}) i left join (select id, count(*) as n from ({items}) group by id) c using (id)
              where not exists (select 1 from ({items}) x where x.id = i.id and x.label = i.target)""",
        ),
        (
            f"{prefix}_mass",
            f"""select *, sum(score) over (partition by id) as mass,
                sum(case when label = target then score else 0 end) over (partition by id) as own,
                count(*) over (partition by id) as n from {prefix}_items""",
        ),
        (
            f"{prefix}_moved",
            f"""select id, pos, label, target, case when empty then 1.0 {guard}
                when own < minimum and label = target then least(1.0, minimum)
                when own < minimum and mass - own > 0 then score * (1.0 - minimum) / (mass - own)
                when own < minimum then (1.0 - minimum) / greatest(n - 1, 1) else score end as moved
              from {prefix}_mass""",
        ),
        (
            f"{prefix}_out",
            f"""select id, pos, label, target, case when sum(moved) over (partition by id) > 0
                then moved / sum(moved) over (partition by id) else moved end as score
              from {prefix}_moved""",
        ),
    ]


def _decide(prefix: str, minimum: str, zero_guard: bool) -> list[tuple[str, str]]:
    """CTEs that end in ``{prefix}(id, label, confidence)`` and ``{prefix}_lists(id, pos, label, score)``.

    Needs a relation ``{prefix}_hint(id, hint)`` and ``{prefix}_list(id, pos, label, score)``.
    """
    return [
        (
            f"{prefix}_top",
            f"""select id, label, score from (select *, row_number() over (partition by id order by score desc, pos) as rn
              from {prefix}_list) where rn = 1""",
        ),
        (
            f"{prefix}_case",
            f"""select h.id, h.hint, t.label, t.score, coalesce(l.score, 0.0) as own,
                h.hint is not null and (h.hint <> t.label or coalesce(l.score, 0.0) < {minimum}) as enforce
              from {prefix}_hint h join {prefix}_top t using (id)
              left join {prefix}_list l on l.id = h.id and l.label = h.hint""",
        ),
        *_fuse(
            f"{prefix}_f",
            f"select id, hint as target, {minimum} as minimum from {prefix}_case where enforce",
            f"select id, pos, label, score from {prefix}_list",
            zero_guard,
        ),
        (
            prefix,
            f"""select c.id, coalesce(hint, c.label) as label,
                case when enforce then f.score when hint is null then c.score else own end as confidence
              from {prefix}_case c left join {prefix}_f_out f on f.id = c.id and f.label = f.target""",
        ),
        (
            f"{prefix}_lists",
            f"""select id, pos, label, score from {prefix}_f_out
              union all select l.id, l.pos, l.label, l.score from {prefix}_list l
                join {prefix}_case c using (id) where not c.enforce""",
        ),
    ]


def _naive_bayes(prefix: str, train: str, heads) -> list[tuple[str, str]]:
    """CTEs that end in ``{prefix}_w(term, head, label, w)``; ``train`` has id, text and the heads."""
    slots = [(h, x) for h, labels in heads.items() for x in labels]
    pairs = " union all ".join(
        f"select term, {_q(h)} as head, cast({h} as varchar) as label, count(*) as n from {prefix}_tok group by all"
        for h in heads
    )
    rows = " union all ".join(
        f"select {_q(h)} as head, cast({h} as varchar) as label, count(*) as n from ({train}) group by all"
        for h in heads
    )
    return [
        (f"{prefix}_slot(head, label)", _values(slots)),
        (f"{prefix}_tok", f"select * exclude (text), unnest({_words('text')}) as term from ({train})"),
        (f"{prefix}_pair", pairs),
        (
            f"{prefix}_n",
            f"""select v.term, s.head, s.label, coalesce(p.n, 0) as n
              from (select distinct head, term from {prefix}_pair) v join {prefix}_slot s using (head)
              left join {prefix}_pair p on p.term = v.term and p.head = s.head and p.label = s.label""",
        ),
        (f"{prefix}_mass", f"select head, label, sum(n) + count(*) as mass from {prefix}_n group by all"),
        (f"{prefix}_prior", rows),
        (
            f"{prefix}_w",
            f"""select term, head, label, ln((n + 1) / mass) as w
                from {prefix}_n join {prefix}_mass using (head, label)
              union all
              select '', s.head, s.label, case when p.n is null then '-infinity'::double
                else ln(p.n / sum(p.n) over (partition by s.head)) end
              from {prefix}_slot s left join {prefix}_prior p using (head, label)""",
        ),
    ]


def _apply_bayes(prefix: str, texts: str) -> list[tuple[str, str]]:
    """CTE ``{prefix}_p(id, head, label, score)``; ``texts`` has id and text."""
    return [
        (
            f"{prefix}_tf",
            f"""select id, term, count(*) as n from (select id, unnest({_words('text')}) as term from ({texts})) group by all
              union all select id, '', 1 from ({texts})""",
        ),
        (
            f"{prefix}_s",
            f"""select id, head, label, sum(n * w) as s from {prefix}_tf join {prefix}_w using (term) group by all""",
        ),
        (
            f"{prefix}_e",
            f"select *, exp(s - max(s) over (partition by id, head)) as e from {prefix}_s",
        ),
        (
            f"{prefix}_p",
            f"select id, head, label, e / sum(e) over (partition by id, head) as score from {prefix}_e",
        ),
    ]


_place_at = "instr(complaint_text, location) - 1"
_first = "split_part(complaint_text, ' ', 1)"
_cte(
    "ex",
    f"""select complaint_id, 0 as pos, location as text, (['GPE', 'loc', 'LOCATION', 'ORG'])[complaint_id % 4 + 1] as label,
        {_place_at} as s, {_place_at} + length(location) as e from cx where location is not null and complaint_id % 11 <> 0
      union all
      select complaint_id, 1, case when complaint_id % 5 <> 1 then {_first} end,
        case complaint_id % 5 when 3 then '' when 0 then null else 'PROBLEM' end,
        case when complaint_id % 5 <> 2 then 0 end, case when complaint_id % 5 <> 2 then length({_first}) end
      from cx where complaint_id % 11 <> 0
      union all
      select complaint_id, 2, left(complaint_text, 20), 'AREA', 0, 20 from cx where complaint_id % 11 <> 0""",
    "cx",
)
_cte(
    "en",
    """select complaint_id, cast(row_number() over (partition by complaint_id order by pos) - 1 as integer) as pos,
      text, label, cast(coalesce(s, 0) as integer) as s, cast(coalesce(e, 0) as integer) as e
    from ex where text is not null and label is not null""",
    "ex",
)
_cte(
    "runs",
    f"""select complaint_id, piece, n, sum(length(piece)) over (partition by complaint_id order by n) - length(piece) as s
    from (select complaint_id, unnest(l) as piece, generate_subscripts(l, 1) as n
          from (select complaint_id, regexp_extract_all(complaint_text, '{_NON_SPACE}+|{_SPACE}+') as l from cx))""",
    "cx",
)
_cte(
    "tok",
    f"""select complaint_id, cast(row_number() over (partition by complaint_id order by n) - 1 as integer) as pos,
      piece as token, cast(s as integer) as s, cast(s + length(piece) as integer) as e
    from runs where regexp_matches(piece, '{_NON_SPACE}')""",
    "runs",
)
_cte(
    "tag",
    """select t.*, coalesce(nullif((select first(n.label order by n.pos) from en n
        where n.complaint_id = t.complaint_id and t.s >= n.s and t.e <= n.e), ''), 'O') as label from tok t""",
    "tok", "en",
)
_cte(
    "names(term, label)",
    _values([(t, "LOCATION") for t in vocab.PLACES] + [(t, "PROBLEM") for t in vocab.PROBLEMS]),
)
for _found, _spotted, _source in (("found", "spotted", "cx"), ("dfound", "dspotted", "dd")):
    _cte(
        _found,
        f"""select distinct complaint_id, label, p as s, p + length(term) as e,
          substr(complaint_text, p + 1, length(term)) as text
        from (select complaint_id, complaint_text, term, label, unnest(range(0, length(complaint_text))) as p
              from {_source} join names on contains(lower(complaint_text), term))
        where substr(lower(complaint_text), p + 1, length(term)) = term
          and not regexp_matches(substr(' ' || complaint_text, p + 1, 1), '{_WORD}')
          and not regexp_matches(substr(complaint_text || ' ', p + 1 + length(term), 1), '{_WORD}')""",
        _source, "names(term, label)",
    )
    _cte(
        _spotted,
        f"""select complaint_id, cast(row_number() over (partition by complaint_id order by s) - 1 as integer) as pos,
          text, label, cast(s as integer) as s, cast(e as integer) as e
        from {_found} f where not exists (select 1 from {_found} g where g.complaint_id = f.complaint_id
          and g.s <= f.s and g.e >= f.e and g.e - g.s > f.e - f.s)""",
        _found,
    )
_cte(
    "dtok",
    f"""select doc_id, unnest(l) as term, generate_subscripts(l, 1) as n
    from (select doc_id, {_words('text')} as l from documents)""",
)
_cte(
    "gram",
    """select doc_id, term from dtok union all
    select doc_id, term || ' ' || nxt from (select doc_id, term, lead(term) over (partition by doc_id order by n) as nxt from dtok)
    where nxt is not null""",
    "dtok",
)
_cte("gtf", "select doc_id, term, count(*) as n from gram group by all", "gram")
_cte(
    "voc",
    f"""select term, cast(row_number() over (order by term) - 1 as integer) as idx, cf, df,
      ln((1.0 + (select count(*) from documents)) / (1.0 + df)) + 1.0 as idf
    from (select term, cast(sum(n) as bigint) as cf, count(*) as df from gtf group by term
          order by cf desc, term limit {vocab.MAX_FEATURES})""",
    "gtf",
)
_cte(
    "tfidf",
    """select doc_id, idx, w / sqrt(sum(w * w) over (partition by doc_id)) as value
    from (select doc_id, idx, n * idf as w from gtf join voc using (term))""",
    "gtf", "voc",
)
_cte(
    "hashed",
    f"""select doc_id, idx, n / sum(n) over (partition by doc_id) as value from (
      select doc_id, cast(cast(('0x' || left(md5(term), 8)) as bigint) % {catalog.HASH_DIM} as integer) as idx, count(*) as n
      from dtok group by all)""",
    "dtok",
)


def _with(main: str, *needs: str, extra: list[tuple[str, str]] = ()) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} as materialized ({_CTES[name][1]})" for name in ordered]
    parts += [f"{name} as materialized ({body})" for name, body in extra]
    return f"with {', '.join(parts)}\n{main}" if parts else main


# --- queries ----------------------------------------------------------------------------

ORACLES: dict[str, str] = {}


def _add(name: str, main: str, *needs: str, extra: list[tuple[str, str]] = ()) -> None:
    ORACLES[name] = _with(main, *needs, extra=extra)


_add(
    "log_schema_pad",
    """select '' as created_at, '' as issue_type, '' as severity, '' as urgency, location, complaint_text, complaint_id
    from cx""",
    "cx",
)
_add(
    "raw_fill_blank",
    """select grievance_id, coalesce(category, '') as category, coalesce(sub_category, '') as sub_category,
      coalesce(ward_name, '') as ward_name, coalesce(staff_remarks, '') as staff_remarks from gx""",
    "gx",
)
_add(
    "log_union",
    """select issue_type, severity, complaint_text, cast(null as varchar) as urgency from lx
    union all select category, null, text, urgency from weak""",
    "lx", "weak",
)
_add(
    "log_projection",
    f"""select complaint_id, cast(created_at as varchar) as created_at, coalesce(issue_type, '') as issue_type,
      coalesce({_title('lower(severity)')}, '') as severity, coalesce({_title('upper(urgency)')}, '') as urgency,
      coalesce(location, '') as location, complaint_text from lx""",
    "lx",
)
_add("normalize_text", f"select doc_id, {_norm('text')} as cleaned from documents")
_add("normalize_complaints", f"select complaint_id, {_norm('complaint_text')} as cleaned from cx", "cx")
_add("normalize_conversations", f"select conv_id, turn, {_norm('text')} as cleaned from conversations")
_add("compose_text", "select grievance_id, text from weak", "weak")
_add(
    "title_case",
    f"""select grievance_id, {_title('category')} as category, {_title('staff_remarks')} as remarks,
      {_title('lower(ward_name)')} as ward from gx""",
    "gx",
)
_add("title_case_documents", f"select doc_id, {_title('text')} as title from documents")
_add("map_category", f"select complaint_id, {_civic('issue_type')} as issue_category from lx", "lx")
_add(
    "map_urgency",
    f"""select grievance_id, {_urgency_label('urgency')} as urgency, {_urgency_label('text')} as urgency_of_text
    from weak""",
    "weak",
)
_add("text_preview", f"select doc_id, {_preview('text')} as preview from documents")
_add(
    "format_ts",
    """select event_id, coalesce(case when event_type <> 'error' then strftime(ts, '%d %b %Y • %H:%M') end, '—') as shown
    from events""",
)


def _count_columns(x: str, keywords) -> str:
    # Occurrences are the pieces between them, less one.
    return ", ".join(
        f"cast(len(string_split(lower({x}), {_q(k)})) - 1 as integer) as n_{k}" for k in keywords
    )


_add(
    "keyword_counts",
    f"select complaint_id, {_count_columns('complaint_text', vocab.FEATURE_KEYWORDS)} from cx",
    "cx",
)
_add(
    "keyword_counts_documents",
    f"select doc_id, {_count_columns('text', catalog.DOCUMENT_KEYWORDS)} from documents",
)
_add("severity_rule", f"select complaint_id, {_severity('complaint_text')} as severity from cx", "cx")
_add(
    "urgency_rule",
    f"""select complaint_id, {_urgency('cleaned')} as urgency,
      {_hits('cleaned', vocab.URGENCY_URGENT)} as urgent_hits,
      {_hits('cleaned', vocab.URGENCY_CONCERNED)} as concerned_hits from cn""",
    "cn",
)
_add("category_rule", "select complaint_id, keyword as category from cn", "cn")
_EVIDENCE = (
    f"case when evidence is null then {_q(vocab.NO_KEYWORD_RATIONALE)} "
    f"else {_q(vocab.KEYWORD_RATIONALE)} || evidence end"
)
_add("rule_evidence", f"select complaint_id, keyword as category, {_EVIDENCE} as rationale from cn", "cn")
ORACLES["rule_table_category"] = ORACLES["rule_table_category_join"] = ORACLES["rule_evidence"]


def _whole(x: str, keyword: str) -> str:
    """Whole-word test for a keyword column: a side that ends in a word character needs an edge there."""
    edge = lambda side, at: f"case when regexp_matches({side}({keyword}, 1), '{_WORD}') then '{at}' else '' end"
    pattern = f"{edge('left', f'(^|[^{_WORD[1:]})')} || regexp_escape({keyword}) || {edge('right', f'($|[^{_WORD[1:]})')}"
    return f"regexp_matches({x}, {pattern})"


_LEVELS = {"High": vocab.SEVERITY_HIGH, "Medium": vocab.SEVERITY_MEDIUM, "Low": vocab.SEVERITY_LOW}
_add(
    "rule_table_levels",
    """select c.complaint_id, b.category as severity, b.keywords from cx c left join (
      select * from hit qualify row_number() over (partition by complaint_text order by rank) = 1) b using (complaint_text)""",
    "cx",
    extra=[
        ("rule(category, rank, keyword)", _values((c, n, kw) for n, (c, kws) in enumerate(_LEVELS.items()) for kw in kws)),
        ("phrase", "select distinct complaint_text, lower(complaint_text) as t from cx"),
        ("near", "select * from (select * from phrase join rule on contains(t, keyword) limit 1000000000)"),
        (
            "hit",
            f"""select complaint_text, category, rank, string_agg(distinct keyword, ',' order by keyword) as keywords
              from near where {_whole('t', 'keyword')} group by all""",
        ),
    ],
)
_add(
    "rule_table_phrases",
    f"""with split as (
      select item_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') as w from benchmark),
    rule as (
      select item_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as keyword
      from split where len(w) > 1),
    low as (select doc_id, lower(text) as t from documents),
    near as materialized (select l.doc_id, l.t, r.item_id, r.keyword from low l join rule r on contains(l.t, r.keyword)),
    hit as (
      select doc_id, item_id, count(*) as hits, md5(string_agg(keyword, '|' order by keyword)) as keywords
      from near where case when item_id % 2 = 0 then true else {_whole('t', 'keyword')} end group by all),
    best as (
      select *, count(*) over (partition by doc_id) as items from hit
      qualify row_number() over (partition by doc_id order by hits desc, item_id) = 1)
    select d.doc_id, cast(b.item_id as varchar) as item, b.hits,
      case when d.text is not null then coalesce(b.items, 0) end as items, b.keywords
    from documents d left join best b using (doc_id)""",
)
ORACLES["rule_table_phrases_join"] = ORACLES["rule_table_phrases"]
_add(
    "rules_documents",
    f"""select d.doc_id, {_severity('text')} as severity, {_urgency('text')} as urgency,
      coalesce(k.category, {_q(vocab.GENERAL)}) as category
    from documents d left join ({_keyword_winner('documents', 'doc_id', 'text')}) k on k.doc_id = d.doc_id""",
    "kw(category, rank, keyword)",
)
_add(
    "rules_conversations",
    f"""select conv_id, turn, {_severity('text')} as severity, {_urgency('text')} as urgency,
      coalesce(k.category, {_q(vocab.GENERAL)}) as category
    from keyed d left join ({_keyword_winner('keyed', 'id', 'text')}) k on k.id = d.id""",
    "kw(category, rank, keyword)",
    extra=[("keyed", "select *, row_number() over (order by conv_id, turn, role, text) as id from conversations")],
)
_before, _after = vocab.MODEL_RATIONALE.split("{}")
_add(
    "category_fusion",
    f"""select complaint_id,
      case when keyword <> {_q(vocab.GENERAL)} and keyword <> model and model_confidence < 0.68 then keyword else model end as category,
      case when keyword <> {_q(vocab.GENERAL)} and (keyword = model or model_confidence < 0.68) then {_EVIDENCE}
        else {_q(_before)} || model || {_q(_after)} end as rationale
    from (select *, {_civic('model_label')} as model from cn)""",
    "cn",
)
_add("weak_severity", "select grievance_id, severity from weak", "weak")
_add("weak_urgency", "select grievance_id, urgency from weak", "weak")
_add("weak_label_etl", "select grievance_id, text, category, severity, urgency from weak", "weak")

_cte(
    "advice",
    f"""select complaint_id, 1 as n, {_q(vocab.REC_ESCALATE)} as recommendation from lx where severity = 'High'
    union all select complaint_id, 2, {_q(vocab.REC_DISPATCH)} from lx where urgency in ('Angry/Urgent', 'Urgent')
    union all select complaint_id, 3, {_q(vocab.REC_ROAD)} from lx where contains(lower({_civic('issue_type')}), 'road')""",
    "lx",
)
_cte(
    "advised",
    f"""select * from advice union all select complaint_id, 4, {_q(vocab.REC_QUEUE)} from lx
    where complaint_id not in (select complaint_id from advice)""",
    "advice", "lx",
)
_add(
    "recommendations",
    "select complaint_id, string_agg(recommendation, ' | ' order by n) as recommendations from advised group by 1",
    "advised",
)
_add("recommendation_load", "select recommendation, count(*) as n from advised group by 1", "advised")

# Scores and heads.

_LABELLED = "select doc_id as id, text, quality, toxic from documents join labels using (doc_id)"
_DOC_MODEL = _naive_bayes("nb", _LABELLED, catalog.DOCUMENT_HEADS)
_add("nb_train", "select term, head, label, round(w, 6) as weight from nb_w", extra=_DOC_MODEL)
_DOC_SCORES = _DOC_MODEL + _apply_bayes("nb", "select doc_id as id, text from documents")
_add(
    "nb_score",
    "select id as doc_id, head, label, round(score, 6) as score from nb_p",
    extra=_DOC_SCORES,
)
_HELD = f"('0x' || left(md5(cast(id as varchar)), 8))::bigint % {catalog.HELD_OUT} = 0"
_TRAINED = f"select * from ({_LABELLED}) where not ({_HELD})"
_add(
    "eval_metrics",
    """select part, head, cast(sum(support) as bigint) as n, round(cast(sum(hit) as double) / sum(support), 6) as accuracy,
      round(sum(support * case when support + claimed = 0 then 0 else 2.0 * hit / (support + claimed) end) / sum(support), 6) as weighted_f1
    from (select v.part, s.head, s.label, count(*) filter (v.truth = s.label) as support,
            count(*) filter (v.guess = s.label) as claimed,
            count(*) filter (v.truth = s.label and v.guess = s.label) as hit
          from nbt_slot s join verdict v on v.head = s.head group by all) group by part, head""",
    extra=_naive_bayes("nbt", _TRAINED, catalog.DOCUMENT_HEADS)
    + _apply_bayes("nbt", _LABELLED)
    + [
        (
            "verdict",
            f"""select g.id, g.head, g.label as guess, case g.head when 'quality' then cast(t.quality as varchar) else cast(t.toxic as varchar) end as truth,
              case when {_HELD.replace('(id ', '(g.id ')} then 'held_out' else 'trained' end as part
            from (select *, row_number() over (partition by id, head order by score desc, label) as rn from nbt_p) g
            join ({_LABELLED}) t on t.id = g.id where rn = 1""",
        )
    ],
)
_add(
    "stub_scores",
    f"""select complaint_id, {_pick('cleaned', vocab.STUB_CATEGORY_LABELS)} as category_label,
      {_pick('cleaned', vocab.SEVERITY_LABELS, 'sev')} as severity_label,
      {_pick('cleaned', vocab.URGENCY_LABELS, 'urg')} as urgency_label,
      round(1.0::double / 6, 6) as category_score, round(1.0::double / 3, 6) as severity_score,
      round(1.0::double / 3, 6) as urgency_score from cn""",
    "cn",
)
_add(
    "normalize_scores",
    """select doc_id, cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as pos, label,
      round(try_cast(score as double), 6) as score
    from dx where label is not null and try_cast(score as double) is not null""",
    "dx",
)
_add(
    "top_label",
    """select d.doc_id, t.label, round(t.score, 6) as score from documents d left join
      (select *, row_number() over (partition by doc_id order by score desc, pos) as rn from px) t
      on t.doc_id = d.doc_id and t.rn = 1""",
    "px",
)
_add(
    "category_probs",
    f"""select complaint_id, cast(row_number() over (partition by complaint_id order by seen) - 1 as integer) as pos, label,
      round(s / sum(s) over (partition by complaint_id), 9) as score
    from (select complaint_id, {_civic('l.label')} as label, min(k) as seen, sum({_raw('complaint_id', 'k')}) as s
          from cx cross join ml l group by all)""",
    "cx",
    extra=[("ml(k, label)", _numbered(catalog.MODEL_LABELS))],
)
_FUSE_IDS = f"""select doc_id as id, ({catalog.FUSION_TARGETS!r})[doc_id % 4 + 1] as target,
  ([0.65::double, 0.75::double, 0.85::double])[doc_id % 3 + 1] as minimum from documents"""
for _name, _guard in (("severity_fusion", True), ("urgency_fusion", False)):
    _add(
        _name,
        "select id as doc_id, cast(pos as integer) as pos, label, round(score, 9) as score from fu_out",
        "px",
        extra=_fuse("fu", _FUSE_IDS, "select doc_id as id, pos, label, score from px", _guard),
    )


def _complaint_list(labels) -> str:
    shown = ", ".join(_q(x) for x in labels)
    return f"""select complaint_id as id, k as pos, ([{shown}])[k + 1] as label,
      {_raw('complaint_id', 'k')} / sum({_raw('complaint_id', 'k')}) over (partition by complaint_id) as score
      from cx cross join (select unnest([0, 1, 2]) as k)"""


_SHOWN = "string_agg(format('{}={:.4f}', label, round(score + 1e-9, 4)), ', ' order by pos)"
for _name, _labels, _hint, _least, _guard in (
    ("severity_decision", vocab.SEVERITY_LABELS, _severity("complaint_text"), _MINIMUM, True),
    ("urgency_decision", vocab.URGENCY_LABELS, _urgency("cleaned"), _URGENT_MINIMUM, False),
):
    _add(
        _name,
        f"""select d.id as complaint_id, d.label, round(d.confidence, 9) as confidence, s.scores from dec d
        join (select id, {_SHOWN} as scores from dec_lists group by id) s using (id)""",
        "cn",
        extra=[
            ("dec_hint", f"select complaint_id as id, {_hint} as hint from cn"),
            ("dec_list", _complaint_list(_labels)),
            *_decide("dec", _least, _guard),
        ],
    )
_add(
    "score_fallback",
    f"""select complaint_id, coalesce(s, 'Medium') as severity,
      case when s is null then 0.33::double else 0.5::double end as severity_confidence,
      case when s is null then 3 else 1 end as severity_entries, 'Neutral' as urgency,
      0.33::double as urgency_confidence, 1.0::double as urgency_mass
    from (select complaint_id, {_severity('complaint_text')} as s from cx)""",
    "cx",
)

def _captioned(spotted: str) -> str:
    return f"""select complaint_id, count(*) as entity_count,
      string_agg(text || '(' || label || ')', ', ' order by pos) as entities,
      first(text order by pos) filter (label = 'LOCATION') as location from {spotted} group by 1"""


def _fused(model: str, confidence: str) -> str:
    general = _q(vocab.GENERAL)
    return f"""case when keyword <> {general} and keyword <> {model} and {confidence} < 0.68 then keyword else {model} end as issue_type,
      case when keyword <> {general} and (keyword = {model} or {confidence} < 0.68) then {_EVIDENCE}
        else {_q(_before)} || {model} || {_q(_after)} end as issue_rationale"""


_STUB_SEVERITY = """case hint when 'High' then 0.75::double when 'Low' then 0.75::double when 'Medium' then 0.6::double
  else round(1.0::double / 3, 6) end"""
for _name, _source, _spotted in (("enrich_stub", "cn", "spotted"), ("enrich_documents", "dn", "dspotted")):
    _add(
        _name,
        f"""select n.complaint_id, {_fused('model', '(1.0 / 6)')}, round(1.0::double / 6, 6) as issue_confidence,
          coalesce(hint, stub_severity) as severity, {_STUB_SEVERITY} as severity_confidence,
          stub_urgency as urgency, round(1.0::double / 3, 6) as urgency_confidence,
          coalesce(entities, '') as entities, coalesce(c.location, '') as location, cleaned as cleaned_text,
          complaint_text as raw_text, 'stub' as mode, cast(coalesce(entity_count, 0) as integer) as entity_count
        from (select *, {_severity('complaint_text')} as hint, {_pick('cleaned', vocab.STUB_CATEGORY_LABELS)} as model,
                {_pick('cleaned', vocab.SEVERITY_LABELS, 'sev')} as stub_severity,
                {_pick('cleaned', vocab.URGENCY_LABELS, 'urg')} as stub_urgency from {_source}) n
        left join capt c on c.complaint_id = n.complaint_id""",
        _source, _spotted,
        extra=[("capt", _captioned(_spotted))],
    )

_LIVE_MODEL = _naive_bayes(
    "wb", "select grievance_id as id, text, category, severity, urgency from weak", catalog.WEAK_HEADS
) + _apply_bayes("wb", "select complaint_id as id, cleaned as text from cn")


def _ordered(labels, column: str = "label") -> str:
    return f"list_position({[*labels]!r}, {column})"


def _enrich_live(
    best: str, severity: str, urgency: str, extra: list[tuple[str, str]]
) -> list[tuple[str, str]]:
    """Relations for the best category and the two score lists lead to the enriched rows."""
    return [
        ("capt", _captioned("spotted")),
        *extra,
        ("best", best),
        ("sv_hint", f"select complaint_id as id, {_severity('complaint_text')} as hint from cn"),
        ("sv_list", severity),
        *_decide("sv", _MINIMUM, True),
        ("ur_hint", f"select complaint_id as id, {_urgency('cleaned')} as hint from cn"),
        ("ur_list", urgency),
        *_decide("ur", _URGENT_MINIMUM, False),
    ]


_ENRICH_LIVE = f"""select n.complaint_id, {_fused('m.model', 'm.score')}, round(m.score, 6) as issue_confidence,
  s.label as severity, round(s.confidence, 6) as severity_confidence,
  u.label as urgency, round(u.confidence, 6) as urgency_confidence,
  coalesce(entities, '') as entities, coalesce(c.location, '') as location, cleaned as cleaned_text,
  complaint_text as raw_text, 'production' as mode, cast(coalesce(entity_count, 0) as integer) as entity_count
from cn n join best m on m.id = n.complaint_id join sv s on s.id = n.complaint_id
join ur u on u.id = n.complaint_id left join capt c on c.complaint_id = n.complaint_id"""
_add(
    "enrich_complaints",
    _ENRICH_LIVE,
    "cn", "weak", "spotted",
    extra=_enrich_live(
        f"""select id, {_civic('label')} as model, score from (select *, row_number() over
          (partition by id order by score desc, {_ordered(vocab.CATEGORY_LABELS)}) as rn from wb_p where head = 'category') where rn = 1""",
        f"""select id, {_ordered(catalog.WEAK_HEADS['severity'])} as pos, {_title('label')} as label, score
          from wb_p where head = 'severity'""",
        f"""select id, {_ordered(catalog.WEAK_HEADS['urgency'])} as pos, {_urgency_label('label')} as label, score
          from wb_p where head = 'urgency'""",
        _LIVE_MODEL,
    ),
)


def _length_list(labels) -> str:
    raw = _raw("length(cleaned)", "k")
    return f"""select complaint_id as id, k as pos, ({[*labels]!r})[k + 1] as label,
      {raw} / sum({raw}) over (partition by complaint_id) as score from cn cross join (select unnest([0, 1, 2]) as k)"""


_add(
    "enrich_model",
    _ENRICH_LIVE,
    "cn", "spotted",
    extra=_enrich_live(
        f"""select id, {_civic('label')} as model, score from (select *, row_number() over
          (partition by id order by score desc, pos) as rn from ({_length_list(catalog.MODEL_HEADS['category'])})) where rn = 1""",
        _length_list(vocab.SEVERITY_LABELS),
        _length_list(vocab.URGENCY_LABELS),
        [],
    ),
)

# Entities.

_SPOTTED = "select complaint_id, pos, text, label, s as span_start, e as span_end from spotted"
_add("gazetteer_entities", _SPOTTED, "spotted")
_add("gazetteer_entities_inline", _SPOTTED, "spotted")
_add(
    "clean_entities",
    "select complaint_id, pos, text, label, s as span_start, e as span_end from en",
    "en",
)


def _spans_of(source: str) -> str:
    return f"""select *, row_number() over (partition by complaint_id, label, s, e) as twin from (
      select complaint_id, case when upper(label) in ('LOC', 'GPE', 'LOCATION') then 'LOC' else upper(label) end as label, s, e
      from {source})"""


_RATES = ", ".join(
    f"""round(case when {whole} > 0 then cast({part} as double) / ({whole}) end, 6) as {kind}_{name}"""
    for kind in ("exact", "overlap")
    for name, part, whole in (
        ("precision", kind, "predicted"), ("recall", kind, "annotated"), ("f1", f"2 * {kind}", "(predicted + annotated)")
    )
)
_add(
    "span_quality",
    f"""select label, predicted, annotated, exact, overlap, {_RATES} from (
      select label, cast(sum(p) as bigint) as predicted, cast(sum(a) as bigint) as annotated,
        cast(sum(x) as bigint) as exact, cast(sum(o) as bigint) as overlap
      from (
        select l.label, c.* exclude (label) from sq_counts c cross join lateral (select unnest([c.label, '*']) as label) l)
      group by label)""",
    "spotted", "en",
    extra=[
        ("sq_p", _spans_of("spotted")),
        ("sq_a", _spans_of("en")),
        (
            "sq_pairs",
            """select p.complaint_id, p.label, concat_ws(':', p.s, p.e, p.twin) as p, concat_ws(':', a.s, a.e, a.twin) as a,
              row_number() over (partition by p.complaint_id, p.label order by
                (least(p.e, a.e) - greatest(p.s, a.s)) / cast(greatest(p.e, a.e) - least(p.s, a.s) as double) desc,
                p.s, p.e, p.twin, a.s, a.e, a.twin) as place
            from sq_p p join sq_a a using (complaint_id, label) where p.s < a.e and a.s < p.e""",
        ),
        (
            "sq_matched",
            """select label, len(list_reduce(list({'p': [p], 'a': [a]} order by place), lambda kept, x:
                case when list_has_any(kept.p, x.p) or list_has_any(kept.a, x.a) then kept
                  else {'p': list_concat(kept.p, x.p), 'a': list_concat(kept.a, x.a)} end).p) as n
            from sq_pairs group by complaint_id, label""",
        ),
        (
            "sq_counts",
            """select label, 1 as p, 0 as a, 0 as x, 0 as o from sq_p union all select label, 0, 1, 0, 0 from sq_a
            union all select label, 0, 0, 1, 0 from sq_p join sq_a using (complaint_id, label, s, e, twin)
            union all select label, 0, 0, 0, n from sq_matched""",
        ),
    ],
)
_add(
    "first_location",
    """select complaint_id, coalesce((select first(n.text order by n.pos) from en n
      where n.complaint_id = cx.complaint_id and upper(n.label) in ('LOC', 'GPE', 'LOCATION')), '') as location from cx""",
    "cx", "en",
)
_TAGS = "select complaint_id, pos, token, s as token_start, e as token_end, label from tag"
_add("token_tags", _TAGS, "tag")
_add("token_tags_table", _TAGS, "tag")
_add(
    "token_offsets_documents",
    f"""select doc_id, cast(count(*) as integer) as tokens, cast(sum(s) as bigint) as start_sum,
      cast(max(s + length(piece)) as integer) as last_end
    from (select doc_id, piece, sum(length(piece)) over (partition by doc_id order by n) - length(piece) as s
          from (select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as n
                from (select doc_id, regexp_extract_all(text, '{_NON_SPACE}+|{_SPACE}+') as l from documents)))
    where regexp_matches(piece, '{_NON_SPACE}') group by 1""",
)
_add(
    "entity_caption",
    f"""select cx.complaint_id, coalesce(c.caption, '') as caption, i.inline from cx
    left join (select complaint_id, string_agg(case when {_strip('label')} = '' then {_strip('text')}
        else {_strip('text')} || '(' || {_strip('label')} || ')' end, ', ' order by pos) as caption
      from en where {_strip('text')} <> '' group by 1) c using (complaint_id)
    join (select complaint_id, string_agg(token || '(' || label || ')', ' ' order by pos) as inline from tag group by 1) i
      using (complaint_id)""",
    "en", "tag", "cx",
)
_add(
    "text_segments",
    """select complaint_id, string_agg(piece || '<' || coalesce(label, '-') || '>', '|' order by nth, part) as segments
    from (
      select complaint_id, nth, 0 as part, substr(complaint_text, before + 1, s - before) as piece, null as label
        from cutting where s > before
      union all select complaint_id, nth, 1, substr(complaint_text, s + 1, e - s), label from cutting
      union all select cx.complaint_id, 99, 0, substr(complaint_text, coalesce(k.e, 0) + 1), null
        from cx left join (select * from cutting qualify row_number() over (partition by complaint_id order by nth desc) = 1) k
          using (complaint_id, complaint_text))
    where piece <> '' or label is not null group by 1""",
    "cx", "en",
    extra=[
        (
            "sized",
            "select complaint_id, complaint_text, pos, label, s, greatest(case when e = 0 then s else e end, s) as e from en join cx using (complaint_id)",
        ),
        (
            "cutting",
            """select *, row_number() over w as nth, coalesce(lag(e) over w, 0) as before from sized
              window w as (partition by complaint_id order by s, pos)""",
        ),
    ],
)
_add("entity_counts", "select label, count(*) as n from en group by 1", "en")

# Dashboards.


def _top(column: str) -> str:
    return f"""select {column}, count(*) as n from lx where {column} is not null group by 1
      order by n desc, {column} limit 1"""


_add("top_issue", _top("issue_type"), "lx")
_add("top_location", _top("location"), "lx")
for _name, _urgent in (("urgent_share", ["urgent"]), ("urgent_share_any", ["urgent", "angry/urgent"])):
    _add(
        _name,
        f"""select urgent, total, {_percent('urgent', 'total')} as urgent_pct from
          (select count(*) filter ({_urgent_flag(_urgent)}) as urgent, count(*) as total from lx)""",
        "lx",
    )
_add(
    "log_summary",
    f"""select count(*) as total, count(distinct issue_type) as issue_types,
      count(*) filter (created_at >= timestamp '{catalog.AS_OF} 00:00:00') as today_count,
      {_percent(f"(count(*) filter ({_urgent_flag(['urgent', 'angry/urgent'])}))", 'count(*)')} as urgent_pct,
      coalesce((select issue_type from ({_top('issue_type')})), '') as top_issue,
      coalesce((select location from ({_top('location')})), '') as top_location,
      max(created_at) as last_update from lx""",
    "lx",
)
_add(
    "issue_distribution",
    f"select {_civic('issue_type')} as issue_category, count(*) as n from lx group by 1",
    "lx",
)
_add(
    "severity_distribution",
    "select severity, count(*) as n from lx where severity is not null group by 1",
    "lx",
)
_add(
    "severity_urgency",
    """select severity, urgency, count(*) as n,
      cast(case severity when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 4 end as integer) as severity_key,
      cast(case urgency when 'Urgent' then 1 when 'Angry/Urgent' then 2 when 'Concerned' then 3 when 'Neutral' then 4 else 5 end as integer) as urgency_key
    from lx where severity is not null and urgency is not null group by all""",
    "lx",
)
_add(
    "severity_urgency_pivot",
    """select severity, count(*) filter (urgency = 'Urgent') as urgent,
      count(*) filter (urgency = 'Angry/Urgent') as angry_urgent,
      count(*) filter (urgency = 'Concerned') as concerned, count(*) filter (urgency = 'Neutral') as neutral,
      count(*) filter (urgency not in ('Urgent', 'Angry/Urgent', 'Concerned', 'Neutral')) as other
    from lx where severity is not null and urgency is not null group by 1""",
    "lx",
)
_add("daily_counts", "select cast(created_at as date) as day, count(*) as n from lx group by 1", "lx")
_DAILY_URGENCY = "select cast(created_at as date) as day, urgency, count(*) as n from lx where urgency is not null group by all"
_add("daily_urgency", _DAILY_URGENCY, "lx")
_add(
    "latest_complaints",
    """select created_at, issue_type, severity, urgency, location, complaint_text, complaint_id from lx
    order by created_at desc, complaint_id desc limit 20""",
    "lx",
)
_add(
    "recent_analyses",
    f"""select issue_type, severity, urgency, created_at, complaint_id, {_preview('complaint_text')} as preview from lx
    order by created_at desc, complaint_id desc limit 5""",
    "lx",
)


def _terms(source: str, text: str) -> str:
    stop = ", ".join(_q(w) for w in vocab.STOP_WORDS)
    return f"""select term, count(*) as n from (select unnest({_words(text)}) as term from {source})
      where term not in ({stop}) group by 1 order by n desc, term limit 200"""


_add("top_terms", _terms("lx", "complaint_text"), "lx")
_add("top_terms_documents", _terms("documents", "text"))
_add(
    "location_hotspots",
    f"""select location, n, {_percent('urgent', 'n')} as urgent_pct from
      (select location, count(*) as n, count(*) filter ({_urgent_flag(['urgent', 'angry/urgent'])}) as urgent
       from lx where location is not null group by 1 order by n desc, location limit 10)""",
    "lx",
)
_add(
    "daily_counts_range",
    """select cast(created_at as date) as day, count(*) as n from lx
    where created_at >= timestamp '2024-01-10' and created_at < timestamp '2024-01-20' group by 1""",
    "lx",
)
_add(
    "dashboard_rollup",
    f"""select 'issue' as chart, {_civic('issue_type')} as key1, '' as key2, count(*) as n from lx group by all
    union all select 'severity', severity, '', count(*) from lx where severity is not null group by all
    union all select 'severity_urgency', severity, urgency, count(*) from lx
      where severity is not null and urgency is not null group by all
    union all select 'day', cast(cast(created_at as date) as varchar), '', count(*) from lx group by all
    union all select 'day_urgency', cast(cast(created_at as date) as varchar), urgency, count(*) from lx
      where urgency is not null group by all
    union all select 'location', location, '', count(*) from lx where location is not null group by all""",
    "lx",
)

# Quality.


def _score_errors(least: float) -> list[tuple[str, str]]:
    return [
        (
            "judged",
            f"""select d.doc_id, case when d.doc_id % 10 = 0 then 'null_output' when d.doc_id % 10 = 1 then 'empty_output'
                else coalesce(bad, case when kept = 0 then 'below_confidence' end) end as error,
                coalesce(far, false) as far, coalesce(odd, false) as odd
              from documents d left join (
                select doc_id, first(code order by pos) filter (code is not null) as bad,
                  count(*) filter (code is null and number >= {least}) as kept,
                  bool_or(number < 0 or number > 1) as far,
                  bool_or(code is null and number >= {least} and label not in ('Low', 'High')) as odd
                from (select *, try_cast(score as double) as number, case when label is null then 'missing_label'
                  when score is null then 'missing_score' when try_cast(score as double) is null then 'score_not_numeric' end as code
                  from dx) group by doc_id) x using (doc_id)""",
        )
    ]


_WARNED = """array_to_string(list_filter([case when far then 'score_out_of_range' end,
  case when odd then 'unexpected_label' end], lambda x: x is not null), ',')"""
_add(
    "validate_scores",
    f"select doc_id, error, {_WARNED} as warnings from judged",
    "dx",
    extra=_score_errors(0.0),
)
_add(
    "min_confidence_filter",
    """select doc_id, label, round(try_cast(score as double), 6) as score from dx join judged using (doc_id)
    where error is null and try_cast(score as double) >= 0.3""",
    "dx",
    extra=_score_errors(0.3),
)
_add(
    "validate_probabilities",
    """select d.doc_id, case when second is null then 'null_label' end as error,
      array_to_string(list_filter([case when second not in ('Low', 'High') then 'unexpected_label' end,
        case when far then 'probability_out_of_range' end,
        case when d.doc_id % 10 = 1 or abs(mass - 1) > 0.01001 then 'sum_not_one' end], lambda x: x is not null), ',') as warnings
    from documents d left join (
      select doc_id, max(label) filter (pos = 1) as second, bool_or(p < 0 or p > 1) as far, sum(p) as mass
      from (select *, coalesce(try_cast(score as double), 0.0) as p from dx) group by 1) x using (doc_id)""",
    "dx",
)
_add(
    "match_rows",
    """select doc_id, lang as label, cast(dim as integer) as dim,
      case when lang is null then 'missing_label_row' when dim is null then 'missing_probability_row' end as row_error
    from documents full outer join (select vec_id as doc_id, len(embedding) as dim from embeddings) using (doc_id)""",
)
_add(
    "validate_vectors",
    """select vec_id, case when label = 0 then 'null_vector' when x < -0.1::float then 'nan_value' when x > 0.1::float then 'inf_value'
      when x > 0 then 'wrong_dimension' end as error
    from (select *, embedding[1] as x from embeddings)""",
)
_add(
    "violation_report",
    """select 'error' as level, error as code, count(*) as n from judged where error is not null group by all
    union all select 'warning', 'score_out_of_range', count(*) from judged where far having count(*) > 0
    union all select 'warning', 'unexpected_label', count(*) from judged where odd having count(*) > 0""",
    "dx",
    extra=_score_errors(0.0),
)

# Features.

_add("tfidf_fit", "select term, idx, cf, df, round(idf, 6) as idf from voc", "voc")
_add("tfidf_transform", "select doc_id, idx, round(value, 6) as value from tfidf", "tfidf")
_add(
    "mean_pool",
    """select label, cast(dim - 1 as integer) as dim, round(sum(m * x) / greatest(sum(m), 1e-9), 5) as x
    from (select label, case when embedding[1] > 0 then 1.0::double else 0.0::double end as m,
            unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings)
    group by all""",
)
_add("encode_hash", "select doc_id, idx, round(value, 6) as value from hashed", "hashed")
_add(
    "feature_concat",
    f"""select doc_id, idx, round(value, 6) as value from tfidf
    union all select doc_id, cast(idx + {vocab.MAX_FEATURES} as integer), round(value, 6) from hashed
    union all select doc_id, cast(k + {vocab.MAX_FEATURES + catalog.HASH_DIM} as integer), cast(n as double)
      from (select doc_id, k, len(string_split(lower(text), keyword)) - 1 as n from documents cross join fk) where n > 0""",
    "tfidf", "hashed",
    extra=[("fk(k, keyword)", _numbered(catalog.DOCUMENT_KEYWORDS))],
)

# Streams.

ORACLES["log_roundtrip"] = ORACLES["location_hotspots"]
_add(
    "log_range",
    """select cast(moment as date) as day, count(*) as n from (
      select created_at + case complaint_id % 4 when 1 then interval '-330 minutes' when 2 then interval '5 hours'
        else interval '0 minutes' end as moment from lx)
    where moment >= timestamp '2024-01-10' and moment < timestamp '2024-01-20' group by 1""",
    "lx",
)
_add(
    "log_range_offsets",
    """select cast(moment as date) as day, count(*) as n from (
      select created_at + case complaint_id % 4 when 1 then interval '-330 minutes' when 2 then interval '5 hours'
        else interval '0 minutes' end as moment from lx)
    where moment >= timestamp '2024-01-10 01:30:00' and moment < timestamp '2024-01-20 04:30:00' group by 1""",
    "lx",
)
_add(
    "log_committed",
    """select complaint_id, coalesce(issue_type, '') as issue_type, coalesce(severity, '') as severity,
      coalesce(urgency, '') as urgency, coalesce(location, '') as location,
      cast(cast(created_at as date) as varchar) as created_date from lx""",
    "lx",
)
_add(
    "encode_udf",
    f"""select doc_id, cast(('0x' || left(md5(w), 8))::bigint % {catalog.HASH_DIM} as integer) as idx,
      round(count(*) / max(n), 6) as value
    from (select doc_id, len(ws) as n, unnest(ws) as w
      from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as ws from documents))
    group by 1, 2""",
)
ORACLES["stream_enrich"] = ORACLES["enrich_stub"]
ORACLES["stream_daily_urgency"] = ORACLES["daily_urgency"]
_CLOSED = "window_end <= (select max(created_at) from lx where urgency is not null) - interval 1 day"
_add(
    "stream_windows",
    f"""select *, {_CLOSED} as closed from (select date_trunc('day', created_at)::timestamp as window_start,
        (date_trunc('day', created_at) + interval 1 day)::timestamp as window_end, urgency, count(*) as n
      from lx where urgency is not null group by all)""",
    "lx",
)
_add(
    "stream_sliding_windows",
    f"""select *, {_CLOSED} as closed from (select (date_trunc('day', created_at) - interval 1 day * back)::timestamp as window_start,
        (date_trunc('day', created_at) - interval 1 day * back + interval 2 day)::timestamp as window_end, urgency, count(*) as n
      from lx cross join (select unnest([0, 1]) as back) where urgency is not null group by all)""",
    "lx",
)
for _name, _same in (
    ("live_rollup", "dashboard_rollup"), ("live_hotspots", "location_hotspots"), ("live_summary", "log_summary"),
    ("stream_cube", "dashboard_rollup"),
):
    ORACLES[_name] = ORACLES[_same]
ORACLES["violation_observed"] = ORACLES["violation_report"]
ORACLES["heavy_terms_documents"] = ORACLES["top_terms_documents"]
_add(
    "distinct_by_range",
    " union all ".join(
        f"""select '{name}' as days, count(distinct issue_type) as issue_type, count(distinct location) as location
        from lx where {where}"""
        for name, where in (
            ("all", "true"),
            ("one day", "cast(created_at as date) = date '2024-01-05'"),
            ("a week", "cast(created_at as date) between date '2024-01-08' and date '2024-01-14'"),
        )
    ),
    "lx",
)
