"""What DuckDB says of the same tables, for the queries that SQL can express."""

from __future__ import annotations

import itertools

from cardloom.operators.records import ACCEPTED, AUTHOR_TAGS, ORIGINAL_TAGS, PLAIN_TAGS, SERIES_TAGS, TITLE_TAGS
from cardloom.operators.spans import MASK_SIGNS
from cardloom.plans.core_queries import LABEL_COLUMNS

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]

# The forms of a shelf mark, and a quoted stretch; an oracle independent of what the operator infers.
_MARK = r'"(?:[^"]|"")*"|[IVX]+ \d+\.\d+|Sg\. \d+/\d+|\d-\d+\.\d+|BK\d+|[A-Z]{2}-\d+/\d+|[A-Z]-\d+'


def _in(tags) -> str:
    return "(" + ", ".join("'" + t + "'" for t in tags) + ")"


def _fold(x: str) -> str:
    return f"regexp_replace(translate(lower({x}), 'áčďéěíňóřšťúůýžäöüëß', 'acdeeinorstuuyzaoues'), '[^\\x00-\\x7F]', '?', 'g')"


LINES = "lines as (select distinct line_no, db_id, tag, content from db_record_line where tag is not null and db_id is not null and trim(content) <> '')"
SUB = f"""{LINES},
parts as (select line_no, db_id, tag, list_filter(string_split(content, '$$')[2:], lambda p: p <> '') as p from lines),
sub0 as (select line_no, db_id, tag, unnest(p) as s, generate_subscripts(p, 1) as i from parts),
sub as (select line_no, db_id, tag, i, substring(s, 1, 1) as code, substring(s, 2) as text from sub0),
one as (select line_no, code, min(i) as i, arg_max(text, i) as text from sub group by line_no, code)"""
_CODES = "abcetvx4"
PIV = f"""{SUB},
piv as (
    select l.line_no, l.db_id, l.tag, l.content,
        {", ".join(f"max(o.text) filter (where o.code = '{c}') as n{c}, coalesce(max(o.text) filter (where o.code = '{c}'), '') as s{c}" for c in _CODES)},
        coalesce(string_agg(o.text || ' ', '' order by o.i) filter (where o.code not in ('v', 'x')), '') as series
    from lines l left join one o using (line_no) group by all
),
ids as (select line_no, string_agg(text || ' ', '' order by i) as ids from sub group by line_no)"""
_PLAIN = "\n".join(f"union all select db_id, line_no * 100, '{label}', sa from piv where tag = '{tag}'" for tag, label in PLAIN_TAGS.items())
LABELS = f"""{PIV},
lab as (
    select db_id, line_no * 100 as ord, 'Author' as label, sa as text from piv where tag in {_in(AUTHOR_TAGS)} and content like '%aut'
    union all select db_id, line_no * 100, 'Title', sa from piv where tag in {_in(TITLE_TAGS)}
    union all select db_id, line_no * 100 + 1, 'Subtitle', sb from piv where tag in {_in(TITLE_TAGS)}
    union all select db_id, line_no * 100, 'Original_title', st from piv where tag in {_in(ORIGINAL_TAGS)}
    union all select db_id, line_no * 100, 'Publisher', sa || ', ' || sb from piv where tag = '260'
    union all select db_id, line_no * 100 + 1, 'Date', sc from piv where tag = '260'
    union all select db_id, line_no * 100, 'Pages', sa || ' ' || se from piv where tag = '300'
    union all select db_id, line_no * 100, 'Series', series from piv where tag in {_in(SERIES_TAGS)}
    union all select db_id, line_no * 100 + 1, 'Volume', sv from piv where tag in {_in(SERIES_TAGS)}
    union all select db_id, line_no * 100 + 2, 'ISSN', sx from piv where tag in {_in(SERIES_TAGS)}
    union all select db_id, line_no * 100, 'ID', coalesce(ids, '') from piv left join ids using (line_no) where tag = '910'
    {_PLAIN}
),
labels as (
    select db_id, label, min(ord) as first, arg_max(trim(text), ord) as text from lab where trim(text) <> '' group by db_id, label
),
labelled as (select db_id, label, text, cast(row_number() over (partition by db_id order by first) - 1 as integer) as label_ord from labels)"""
_PLAIN_ROWS = "\n".join(f"union all select db_id, line_no, 0, '{label}', na from piv where tag = '{tag}'" for tag, label in PLAIN_TAGS.items())
_ACCEPTED = "\n union all ".join(
    f"select line_no, db_id, tag || '{c}' as full_type, {({'a': 'ta', 'b': 'tb', 'c': 'sc'}[c]) if tag == '245' else 's' + c} as content from cut where {'tag' if tag != '245' else 'substring(tag, 1, 3)'} = '{tag}'"
    for tag, codes in ACCEPTED.items()
    for c in codes
)
ACC = f"""{PIV},
cut as (
    select *, case when nc is not null and nb is null then regexp_replace(sa, ' /$', '') else sa end as ta,
        case when nc is not null then regexp_replace(sb, ' /$', '') else sb end as tb from piv
),
acc as ({_ACCEPTED})"""
RAW = "raw as (select line_no, concat_ws(' ', db_id, tag, case when tag is not null then 'L' end, content) as raw from (select distinct line_no, db_id, tag, content from db_record_line))"
PARSED = f"""{RAW},
cutw as (select line_no, string_split_regex(regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g'), '{WS}+') as w from raw),
parsed as (
    select line_no, w[1] as db_id, case when pl > 2 then array_to_string(w[2:pl - 1], ' ') end as entry_type,
        array_to_string(w[pl + 1:], ' ') as content
    from (select line_no, w, coalesce(list_position(w, 'L'), 0) as pl from cutw)
)"""
FIXED = f"{LINES}, fixed as (select line_no, db_id, rpad(db_id, 16, ' ') || rpad(tag, 8, ' ') || content as raw from lines)"
MAP = """map as (
    select card, arg_max(db_id, (score, db_id)) as db_id, max(score) as score
    from (select split_part(replace(card_file, '-', '/'), '.', 1) as card, db_id, score from card_mapping) where card is not null group by card
)"""
FIELDS = "fields as (" + "\n union all ".join(
    f"select distinct db_id, '{label}' as label, {c} as text, {i} as label_ord from db_record where trim({c}) <> ''" for i, (label, c) in enumerate(LABEL_COLUMNS.items())
) + ")"
TEXTS = "texts as (select card, max(transcription) as transcription from card_transcription where card is not null and transcription is not null group by card)"
CARD_LINES = f"""{TEXTS},
rawl as (select card, unnest(string_split(transcription, chr(10))) as raw, generate_subscripts(string_split(transcription, chr(10)), 1) - 1 as line_no from texts),
placed as (
    select card, line_no, raw, trim(raw) as line,
        coalesce(sum(length(raw) + 1) over (partition by card order by line_no rows between unbounded preceding and 1 preceding), 0) + length(raw) - length(ltrim(raw)) as line_start
    from rawl
),
card_lines as (
    select card, line_no, line, line_start from placed
    where line <> '' and length(raw) >= case when line_no = (select max(p.line_no) from placed p where p.card = placed.card) then 3 else 2 end
)"""
SPANS = """spans as (
    select distinct card, replace(label, ' ', '_') as label, least(start_pos, end_pos) as start_pos, greatest(start_pos, end_pos) as end_pos
    from card_span where card is not null and label is not null and start_pos is not null and end_pos is not null
),
moved as (select card, label, start_pos + start_pos % 4 as start_pos, end_pos + start_pos % 4 as end_pos from spans)"""
PAIRS = f"""{SPANS},
pairs as (
    select a.card, a.label, a.start_pos as a_start, a.end_pos as a_end, b.start_pos as b_start, b.end_pos as b_end,
        greatest(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos), 0) as inter,
        greatest(a.end_pos, b.end_pos) - least(a.start_pos, b.start_pos) as hull
    from spans a join moved b on a.card = b.card and a.label = b.label and a.start_pos < b.end_pos and b.start_pos < a.end_pos
),
best as (
    select card, label, a_start, a_end, b_start, b_end, inter, hull from pairs
    qualify row_number() over (partition by card, label, a_start, a_end order by inter / hull desc, b_start, b_end) = 1
)"""


def _mask(name: str, source: str) -> str:
    return f"""{name} as (
    select card, pos, arg_max(label, (start_pos, end_pos, label)) as label
    from (select card, label, start_pos, end_pos, unnest(range(start_pos, end_pos)) as pos from {source} where end_pos > start_pos) group by card, pos
)"""


MASKS = f"""{SPANS}, {_mask('ma', 'spans')}, {_mask('mb', 'moved')},
masks as (select coalesce(a.card, b.card) as card, a.label as truth, b.label as pred from ma a full join mb b on a.card = b.card and a.pos = b.pos)"""
ISLANDS = """marked as (
    select user_id, ts, event_id, event_type, value / 1000 as conf,
        case when lag(event_type) over w = event_type then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)
),
runs as (select *, cast(sum(fresh) over (partition by user_id order by ts, event_id) as integer) as island from marked)"""
TOKENS = f"""{TEXTS},
tok as (
    select card, list_filter(string_split_regex(replace(transcription, chr(10), ' [LF] '), '{WS}+'), lambda x: x <> '') as w from texts
),
tokens as (select card, unnest(w) as token, cast(generate_subscripts(w, 1) - 1 as integer) as tok_ord from tok)"""
_ASSIGN = f"""{MAP}, {FIELDS}, {CARD_LINES},
scored as (
    select m.card, l.line_no, l.line, f.label, f.label_ord, f.text,
        levenshtein({_fold('l.line')}, {_fold('f.text')}) / cast(length({_fold('f.text')}) as double) as cer
    from map m join card_lines l using (card) join fields f using (db_id)
),
assigned as (select * from scored qualify row_number() over (partition by card, line_no order by cer, label_ord, label) = 1)"""


def _permutations() -> str:
    rows = []
    for size in range(1, 6):
        every = (p for k in range(1, size + 1) for c in itertools.combinations(range(size), k) for p in itertools.permutations(c))
        rows += [f"({size}, {i}, {list(p)})" for i, p in enumerate(every)]
    return ", ".join(rows)


def _confidence(expr: str) -> str:
    return f"with {ISLANDS} select user_id, island, min(event_type) as label, round({expr}, 9) as confidence from runs group by user_id, island"


#: Nearest substring of a card's text for every field: all substrings as long as the field, give or take twelve characters.
_NEAREST = f"""{MAP}, {FIELDS}, {TEXTS},
asked as (select card, label, {_fold('text')} as ref, {_fold('transcription')} as t from map join texts using (card) join fields using (db_id)),
bounded as (select *, least(cast(floor(length(ref) * 0.6) as integer), 12) as most from asked),
ends as (select *, unnest(range(1, length(t) + 1)) as e from bounded),
cuts as (select *, unnest(range(greatest(length(ref) - most, 0), length(ref) + most + 1)) as n from ends),
measured as (select card, label, most, e - n as s, e, levenshtein(substring(t, e - n + 1, n), ref) as dist from cuts where n <= e),
nearest as (select card, label, dist, s, e from measured where dist <= most qualify row_number() over (partition by card, label order by dist, e, s desc) = 1)"""


def _inner(source: str) -> str:
    """Spans of `source` (card, label, start_pos, end_pos) with the inner of nested ones left out and partial overlaps parted in the middle."""
    return f"""
    select card, list_reduce(list([{{'l': label, 's': start_pos, 'e': end_pos}}] order by start_pos, end_pos, label), lambda acc, x: case
        when len(list_filter(acc, lambda p: p.s <= x[1].s and x[1].e <= p.e)) > 0 then acc
        when x[1].s < acc[-1].e then list_concat(list_concat(acc[:-2],
            [{{'l': acc[-1].l, 's': acc[-1].s, 'e': cast((x[1].s + acc[-1].e) // 2 as integer)}}]), [{{'l': x[1].l, 's': cast((x[1].s + acc[-1].e) // 2 + 1 as integer), 'e': x[1].e}}])
        else list_concat(acc, x) end) as a
    from {source} group by card"""


def _outer(source: str) -> str:
    """Spans of `source` with the outer of nested ones left out and partial overlaps parted at a space of the card's text: all pairs
    in order, one after the other, each changing the list of spans (k counts from 1, ok: still there)."""

    def refine(a: str, b: str) -> str:
        inside, before, after = f"list_filter(sp, lambda z: z >= {a} and z <= {b})", f"list_max(list_filter(sp, lambda z: z < {a}))", f"list_min(list_filter(sp, lambda z: z > {b}))"
        return f"""case when len({inside}) > 0 then {inside}[len({inside}) // 2 + 1] when {before} is null and {after} is null then ({a} + {b}) // 2
            when {before} is null or {after} - {b} <= {a} - {before} then {after} else {before} end"""

    a, b = "acc[x[1].s]", "acc[x[1].e]"
    one = lambda s, e, ok: f"{{'l': p.l, 's': cast({s} as integer), 'e': cast({e} as integer), 'ok': {ok}, 'k': p.k}}"
    left = refine(f"{b}.s", f"{a}.e")
    right = refine(f"{a}.s", f"{b}.e")
    return f"""
    select card, list_reduce(list_concat([own], pairs), lambda acc, x: case
        when not {a}.ok or not {b}.ok or {a}.l = {b}.l or not ({a}.s < {b}.e and {b}.s < {a}.e) then acc
        when {a}.s < {b}.s and {b}.e < {a}.e then list_transform(acc, lambda p: {one('p.s', 'p.e', 'p.ok and p.k <> x[1].s')})
        when {b}.s < {a}.s and {a}.e < {b}.e then list_transform(acc, lambda p: {one('p.s', 'p.e', 'p.ok and p.k <> x[1].e')})
        when {a}.s < {b}.s and {b}.s < {a}.e then list_transform(acc, lambda p: {one(f'case when p.k = x[1].e then {left} else p.s end', f'case when p.k = x[1].s then {left} else p.e end', 'p.ok')})
        when {b}.s < {a}.s and {a}.s < {b}.e then list_transform(acc, lambda p: {one(f'case when p.k = x[1].s then {right} else p.s end', f'case when p.k = x[1].e then {right} else p.e end', 'p.ok')})
        else acc end) as a
    from (
        select card, sp, list({{'l': label, 's': start_pos, 'e': end_pos, 'ok': true, 'k': k}} order by k) as own,
            flatten(list_transform(range(1, cast(count(*) + 1 as bigint)), lambda i: list_transform(range(1, cast(count(*) + 1 as bigint)),
                lambda j: [{{'l': '', 's': cast(i as integer), 'e': cast(j as integer), 'ok': false, 'k': cast(0 as bigint)}}]))) as pairs
        from (select s.*, row_number() over (partition by card order by start_pos, end_pos, label) as k, coalesce(sp, []) as sp from {source} s left join spaces using (card))
        group by card, sp
    )"""


def _spans_of(name: str) -> str:
    return f"select card, x.l as label, x.s as start_pos, x.e as end_pos from (select card, unnest(a) as x from {name}) where x.e > x.s"


IO = """per as (
    select t.card, transcription as t, coalesce(list({'a': start_pos, 'b': end_pos, 'l': label} order by start_pos, end_pos, label) filter (where end_pos > start_pos), []) as s
    from texts t left join chosen using (card) group by t.card, transcription
),
cuts as (
    select card, t, unnest(list_concat(flatten(list_transform(s, lambda x, i: [
        {'a': coalesce(s[i - 1].b, 0), 'b': x.a, 'l': 'O'}, {'a': x.a, 'b': x.b, 'l': x.l}])), [{'a': coalesce(s[-1].b, 0), 'b': length(t), 'l': 'O'}])) as c,
        unnest(range(2 * len(s) + 1)) as seg from per
),
io as (
    select card, cast(seg as integer) as seg, label, unnest(w) as token, cast(generate_subscripts(w, 1) - 1 as integer) as tok_ord
    from (select card, seg, c.l as label, list_filter(string_split_regex(replace(substring(t, c.a + 1, greatest(c.b - c.a, 0)), chr(10), ' [LF] '), '%s+'), lambda x: x <> '') as w from cuts)
)""" % WS


def oracle_sql() -> dict[str, str]:
    share = lambda a, b: f"coalesce({a} / nullif(cast({b} as double), 0), 0.0)"
    return {
        "p3_found": rf"""
with bare as (
    select distinct db_id, line_no, regexp_replace(content, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') as c from db_record_line where trim(content) <> ''
),
inner_text as (
    select db_id, line_no,
        regexp_replace(case when regexp_full_match(c, '"(?:[^"]|"")*"') then replace(c[2:-2], '""', '"') else c end, '^ +', '') as c
    from bare
),
marked as (
    select *, case when starts_with(c, '$$') then '$$' when starts_with(c, '$') then '$' when starts_with(c, '|') then '|'
        when starts_with(c, '‡') then '‡' when starts_with(c, chr(31)) then chr(31) end as mark
    from inner_text
),
parts as (
    select db_id, line_no, list_filter(list_transform(string_split(c, mark)[2:], lambda p: trim(p[2:])), lambda p: p <> '') as v
    from marked where mark is not null
),
values_of as (
    select db_id, list_transform(regexp_extract_all(id, '{_MARK}'),
        lambda p: trim(case when starts_with(p, '"') then replace(p[2:-2], '""', '"') else p end)) as v
    from (select distinct db_id, id from db_record where trim(id) <> '')
)
select 'content' as field, db_id, line_no, cast(generate_subscripts(v, 1) - 1 as integer) as pos, unnest(v) as piece from parts where len(v) >= 2
union all
select 'id', db_id, cast(0 as bigint), cast(generate_subscripts(v, 1) - 1 as integer), unnest(v) from values_of where len(v) >= 2
""",
        "subfield_parse": f"with {SUB} select line_no, code, text from one",
        "marc_line_parse": f"""with {PARSED},
pp as (select line_no, db_id, entry_type, list_filter(string_split(content, '$$'), lambda p: p <> '') as p from parsed where entry_type is not null),
each as (select line_no, db_id, entry_type, unnest(p) as s, generate_subscripts(p, 1) as i from pp)
select line_no, any_value(db_id) as db_id, any_value(entry_type) as entry_type, substring(s, 1, 1) as code, arg_max(substring(s, 2), i) as text
from each group by line_no, substring(s, 1, 1)""",
        "failed_lines": f"with {PARSED} select count(*) as n_lines, count(*) filter (where entry_type is null) as n_failed from parsed",
        "accepted_subfields": f"with {ACC} select * from acc",
        "last_wins": f"with {ACC} select db_id, full_type, arg_max(content, line_no) as content from acc group by db_id, full_type",
        "filter_empty": f"with {ACC} select * from (select db_id, full_type, arg_max(content, line_no) as content from acc group by db_id, full_type) where content <> ''",
        "record_labels": f"with {LABELS} select * from labelled",
        "record_rows": f"""with {PIV},
r as (
    select db_id, line_no, 0 as i, 'Author' as label, na as text from piv where tag = '100'
    union all select db_id, line_no, 0, 'Author_2', case when n4 like '%aut%' then na end from piv where tag = '700'
    union all select db_id, line_no, 0, 'Title', na from piv where tag = '245'
    union all select db_id, line_no, 1, 'Subtitle', case when na is not null then nb end from piv where tag = '245'
    union all select db_id, line_no, 0, 'Original_title', nt from piv where tag = '765'
    union all select db_id, line_no, 0, 'Publisher', na || ', ' || nb from piv where tag = '260'
    union all select db_id, line_no, 1, 'Date', case when na is not null and nb is not null then nc end from piv where tag = '260'
    union all select db_id, line_no, 0, 'Pages', case when ne is not null then na || ' ' || ne else na end from piv where tag = '300'
    union all select db_id, line_no, 0, 'Series', series from piv where tag = '490'
    union all select db_id, line_no, 1, 'Volume', nv from piv where tag = '490'
    union all select db_id, line_no, 2, 'ISSN', nx from piv where tag = '490'
    union all select db_id, line_no, i - 1, 'ID', text from sub where tag = '910'
    {_PLAIN_ROWS}
)
select db_id, line_no, cast(i as integer) as i, label, text from r where text is not null""",
        "fixed_width_project": f"with {FIXED} select line_no, substring(raw, 17, 3) || ' ' || substring(raw, 25) as clean from fixed",
        "clean_record": f"with {LINES} select line_no, rpad(tag, 3, ' ') || ' ' || content as clean from lines",
        "merge_boundaries": f"""with {LABELS}
select db_id, label, cast(sum(length(trim(text)) + 1) over (partition by db_id order by label_ord) - 1 as integer) as boundary from labelled""",
        "semi_join_ids": f"""with {LINES}, {MAP}
select db_id, row_number() over (partition by db_id order by line_no, concat_ws(' ', tag, content)) as ord, line_no, concat_ws(' ', tag, content) as line
from lines where db_id in (select db_id from map)""",
        "mapping": f"with {MAP} select card, db_id, score from map",
        "card_lines": f"with {CARD_LINES} select card, cast(line_no as integer) as line_no, line, cast(line_start as integer) as line_start from card_lines",
        "card_record_join": f"""with {MAP}, {TEXTS}, {FIELDS}
select m.card, m.db_id, length(transcription) as n_chars, n_labels from map m join texts using (card)
join (select db_id, count(*) as n_labels from fields group by db_id) using (db_id)""",
        "anti_resume": "select distinct card from card_transcription where card is not null and card not in (select card from card_span where card is not null)",
        "suffix_first_match": """
select s.stem, min(t.card) as card from (select distinct split_part(card, '/', -1) as stem from card_span) s
join card_transcription t on split_part(t.card, '/', -1) = s.stem group by s.stem""",
        "grep_ids": f"""with {RAW}, {MAP}
select distinct m.db_id, r.line_no from raw r join (select distinct db_id from map) m on regexp_matches(r.raw, '(^|[^0-9])' || m.db_id || '([^0-9]|$)')""",
        "union_prefixed": """
select 'old-' || card_file as card_file, db_id from card_mapping union all
select 'new-' || card_file, db_id from (select distinct card_file, db_id from card_mapping)""",
        "ranked_matches": f"""with {MAP}
select card, db_id, score, cast(row_number() over (order by score desc, card || ' ' || db_id || ' ' || score desc, card desc, db_id desc) as integer) as rank from map""",
        "task_numbering": f"""with {TEXTS} select cast(row_number() over (order by card) as integer) as id, card, '{{"id":' || row_number() over (order by card) || ',"data":{{"text":' || to_json(card) || ',"body":' || to_json(transcription) || '}}}}' as task from texts""",
        "xml_text_extract": f"""with {TEXTS}
select card || '#' || (generate_subscripts(l, 1) - 1) || '#1' as line_no, unnest(l) as text from (select card, string_split(transcription, chr(10)) as l from texts)""",
        "index_search": f"""with {TEXTS},
docs as (select distinct db_id, concat_ws(' ', title, author) as text from db_record),
terms as (select db_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) as term from docs),
postings as (select term, db_id, count(*) as tf from terms group by term, db_id),
lengths as (select db_id, count(*) as len from terms group by db_id),
stats as (select count(*) as n_docs, avg(len) as avg_len from lengths),
df as (select term, count(*) as df from postings group by term),
good as (select term, df, n_docs, avg_len from df, stats),
asked as (select distinct card, unnest(list_filter(string_split_regex(lower(transcription), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) as term from texts),
hits as (
    select card, db_id, round(sum(ln(1 + (n_docs - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double
        / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))), 6) as score
    from asked join good using (term) join postings using (term) join lengths using (db_id) group by card, db_id
)
select card, db_id, score, cast(rank as integer) as rank
from (select *, row_number() over (partition by card order by score desc, db_id) as rank from hits) where rank <= 5""",
        "cer": f"""with {MAP}, {FIELDS},
own as (select distinct card, replace(label, ' ', '_') as label, span_text, start_pos from card_span)
select o.card, o.label, o.start_pos, round(levenshtein({_fold('span_text')}, {_fold('text')}) / cast(length({_fold('text')}) as double), 6) as cer
from own o join map using (card) join fields f on f.db_id = map.db_id and f.label = o.label where span_text is not null""",
        "infix_distance": f"""with {MAP}, {FIELDS},
own as (select distinct card, {_fold('span_text')} as word from card_span),
two as (
    select distinct word, {_fold('text')} as title from own join map using (card) join fields using (db_id) where label = 'Title' and word <> ''
),
ordered as (select word, title, case when length(word) <= length(title) then word else title end as s, case when length(word) <= length(title) then title else word end as l from two),
starts as (select word, title, s, l, unnest(range(1, length(l) + 1)) as a from ordered),
cuts as (select word, title, s, substring(l, a, n) as c from (select *, unnest(range(0, 2 * length(s) + 1)) as n from starts))
select word, title, cast(min(levenshtein(s, c)) as integer) as dist from cuts group by word, title""",
        "line_label_assign": f"with {_ASSIGN} select card, cast(line_no as integer) as line_no, label, round(cer, 6) as cer from assigned",
        "best_permutation": f"""with {_ASSIGN},
groups as (
    select card, label, any_value(text) as ref, list(line order by line_no, line) as lines from assigned group by card, label
),
perms(n, ord, perm) as (values {_permutations()}),
tried as (
    select card, label, ord, perm, array_to_string(list_transform(perm, lambda i: lines[i + 1]), ' ') as joined, ref
    from groups join perms on len(lines) = n
),
measured as (select card, label, ord, perm, levenshtein({_fold('joined')}, {_fold('ref')}) / cast(length({_fold('ref')}) as double) as cer from tried)
select card, label, perm, round(cer, 6) as cer from measured where cer < 1 qualify row_number() over (partition by card, label order by measured.cer, ord) = 1""",
        "records_match_score": f"""with {MAP}, {FIELDS}, {CARD_LINES},
ls as (select card, line_no, {_fold('line')} as line from card_lines where length(line) >= 4),
vs as (select distinct db_id, {_fold('text')} as v from fields where length(text) >= 4),
two as (
    select distinct line, v, case when length(line) <= length(v) then line else v end as s, case when length(line) <= length(v) then v else line end as l
    from (select distinct card, db_id from map) join ls using (card) join vs using (db_id)
),
sizes as (select *, unnest(range(cast(floor(length(s) * 0.7) as integer), cast(ceil(length(s) * 1.3) as integer) + 1)) as n from two),
cuts as (select line, v, s, substring(l, unnest(range(1, greatest(length(l) - n + 1, 1) + 1)), n) as c from sizes),
near as (select line, v from cuts group by line, v, s having min(levenshtein(s, c)) < 0.3 * length(s)),
hit as (select card, db_id, line_no, max(case when near.v is not null then 1 else 0 end) as ok from (select distinct card, db_id from map) join ls using (card) join vs using (db_id) left join near on near.line = ls.line and near.v = vs.v group by card, db_id, line_no)
select card, db_id, cast(sum(ok) as integer) as n_matched from hit group by card, db_id""",
        "best_fuzzy_match": f"with {_NEAREST} select card, label, cast(dist as integer) as dist, cast(s as integer) as start_pos, cast(e as integer) as end_pos from nearest",
        "align_fuzzy": f"""with {_NEAREST},
src as (select card, label, cast(s as integer) as start_pos, cast(e as integer) as end_pos from nearest where e > s), done as ({_inner('src')}) {_spans_of('done')}""",
        "resolve_outer": f"""with {SPANS}, {TEXTS},
spaces as (select card, list_filter(range(0, length(transcription)), lambda i: substring(transcription, i + 1, 1) = ' ') as sp from texts),
done0 as ({_outer('moved')}), done as (select card, list_filter(a, lambda p: p.ok) as a from done0) {_spans_of('done')}""",
        "resolve_inner": f"with {SPANS}, done as ({_inner('moved')}) {_spans_of('done')}",
        "offsets_to_io": f"with {TEXTS}, {SPANS}, chosen as (select * from spans), {IO} select card, seg, tok_ord, token, label from io",
        "label_id_join": f"""with {TEXTS}, {SPANS}, chosen as (select * from spans where label in ('Author', 'Title', 'ID')), {IO}
select card, seg, tok_ord, token, case when token = '[LF]' then -100 else coalesce(list_position(['Author', 'Title', 'ID'], label), 0) end as label_id from io""",
        "label_whitelist": f"with {SPANS} select * from spans where label in ('Author', 'Title', 'ID')",
        "found_offsets": f"""with {TEXTS},
x as (select card, regexp_extract_all(transcription, '{NOT_WS}+') as w, regexp_extract_all(transcription, '({WS}*){NOT_WS}+', 1) as g from texts),
y as (select card, unnest(w) as token, unnest(g) as gap, generate_subscripts(w, 1) as i from x),
z as (select *, sum(length(token) + length(gap)) over (partition by card order by i) as e, sum(length(gap) - length(replace(gap, chr(10), ''))) over (partition by card order by i) as breaks from y)
select card, cast(i - 1 + breaks as integer) as tok_ord, token, cast(e - length(token) as integer) as start_pos, cast(e as integer) as end_pos from z where token <> '[LF]'""",
        "mask_signs": f"""with {TEXTS}, {SPANS}, {_mask('m', 'spans')}, chars as (select card, unnest(range(length(transcription))) as pos from texts)
select c.card, string_agg(coalesce(map_extract_value(map({[k.replace(' ', '_') for k in MASK_SIGNS]}, {list(MASK_SIGNS.values())}), m.label), '0'), '' order by c.pos) as mask
from chars c left join m on m.card = c.card and m.pos = c.pos group by c.card""",
        "unmasked": f"""with {TEXTS}, {SPANS}, {_mask('m', 'spans')},
chars as (select card, unnest(range(length(transcription))) as pos from texts),
lab as (
    select c.card, c.pos, case when list_contains({[k.replace(' ', '_') for k in MASK_SIGNS]}, m.label) then m.label else 'O' end as label from chars c left join m on m.card = c.card and m.pos = c.pos
),
f as (select *, case when lag(label) over (partition by card order by pos) = label then 0 else 1 end as fresh from lab),
g as (select *, sum(fresh) over (partition by card order by pos) as i from f)
select card, cast(min(pos) as integer) as start_pos, cast(max(pos) + 1 as integer) as end_pos, label from g group by card, i, label""",
        "union_dumps": f"with {LINES} select db_id, line_no, cast(abs(line_no) % 2 as integer) as part from lines",
        "resplit": "select doc_id, cast(length(text) as integer) as n, case when doc_id % 5 = 0 then 'test' else 'train' end as part from documents",
        "shuffled": "select count(*) as n, count(*) as n_places, cast(count(*) as integer) as last, cast(sum(doc_id) as bigint) as ids, true as is_mixed from documents",
        "length_density": """with v as (select len(string_split(text, ' ')) as v from documents where text is not null),
st as (select count(*) as n, stddev_samp(v) * pow(count(*), -0.2) as h from v), g as (select unnest(range(0, 801, 50)) as x)
select cast(x as integer) as x, round(sum(exp(-pow((x - v) / h, 2) / 2) / (n * h * sqrt(2 * pi()))), 9) as density from g, v, st group by x""",
        "predicted_spans": f"""with {TEXTS},
x as (select card, regexp_extract_all(transcription, '{NOT_WS}+') as w, regexp_extract_all(transcription, '({WS}*){NOT_WS}+', 1) as g from texts),
y as (select card, unnest(w) as token, unnest(g) as gap, generate_subscripts(w, 1) as i from x),
z as (select *, sum(length(token) + length(gap)) over (partition by card order by i) - length(token) as s, case when length(token) < 4 then 'O' when length(token) > 7 then 'LONG' else 'MID' end as label,
    case when length(token) < 4 then 1.0::double else (length(token) % 10) / 10.0::double end as conf from y),
f as (select *, case when lag(label) over (partition by card order by i) = label then 0 else 1 end as fresh from z),
r as (select *, cast(sum(fresh) over (partition by card order by i) as integer) as island from f)
select card, island, label, count(*) as n, cast(min(s) as integer) as first, cast(max(s) as integer) as last, round(avg(conf), 6) as confidence
from r where label <> 'O' group by card, island, label having avg(conf) >= 0.5""",
        "read_mapping": """select card, arg_max(db_id, (card_file, score, db_id)) as db_id, arg_max(score, (card_file, score, db_id)) as score
from (select split_part(replace(card_file, '-', '/'), '.', 1) as card, card_file, db_id, score from card_mapping) where card is not null group by card""",
        "read_dump": f"with {RAW} select cast(row_number() over (order by line_no) as integer) as n, regexp_replace(raw, '[\\n\\r]', ' ', 'g') as raw from raw",
        "read_clean_records": f"""with {LINES}, c as (select regexp_replace(rpad(tag, 3, ' ') || ' ' || content, '[\\n\\r]', ' ', 'g') as v from lines)
select string_split_regex(trim(v), '\\s+')[1] as tag, regexp_replace(trim(v), '^[^\\s]+\\s+', '') as body, count(*) as n from c group by all""",
        "read_cards": f"""with {TEXTS} select replace(card, '/', '-') as card, rtrim(replace(transcription, chr(13), ' '), ' ') as transcription from texts where card in (select card from card_span)""",
        "read_spans": f"with {SPANS} select card, label, 'x' as span_text, start_pos, end_pos from spans",
        "read_dataset": f"with {SPANS} select card, cast(row_number() over (partition by card order by start_pos, end_pos, label) - 1 as integer) as n, label, start_pos, end_pos from spans",
        "read_annotations": f"with {SPANS} select replace(card, '/', '-') as card, label, start_pos, end_pos from spans",
        "read_tasks": f"with {TEXTS} select cast(row_number() over (order by card) as integer) as id, card as text, transcription as body from texts",
        "read_texts": f"""with {CARD_LINES}, l as (select trim(regexp_replace(line, '[\\r\\x0b\\x0c]', ' ', 'g')) as text from card_lines)
select text, count(*) as n from l where length(text) > 10 group by text""",
        "read_numbers": "select cast(length(text) as integer) as x, count(*) as n from documents where text is not null group by 1",
        "read_store": f"with {TEXTS} select card, transcription from texts where card in (select split_part(replace(card_file, '-', '/'), '.', 1) from card_mapping)",
        "read_record_files": f"with {LABELS} select db_id, label, text, label_ord from labelled",
        "read_index": """with docs as (select distinct db_id, concat_ws(' ', title, author) as text from db_record),
terms as (select db_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) as term from docs)
select term, db_id, count(*) as tf, len from terms join (select db_id, count(*) as len from terms group by db_id) using (db_id) group by term, db_id, len""",
        "html_rows": f"""with {LABELS},
esc as (select db_id, label_ord, replace(replace(replace(concat_ws(' ', label, text), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as h from labelled)
select db_id, cast(-1 as bigint) as ord, '<tr><td>' || string_agg(h, '<br>' order by label_ord) || '</td><td>' as html from esc group by db_id
union all select db_id, line_no, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '<br>' from lines where db_id in (select db_id from labelled)
union all select distinct db_id, 9223372036854775807, '</td></tr>' from labelled""",
        "error_report": f"""with {PAIRS},
tot as (select card, coalesce(label, '') as label, case when sum(hull) > 0 then 1 - sum(inter) / sum(hull) else -1.0 end as e from best group by grouping sets ((card, label), (card)))
select card, string_agg(case when label = '' then 'total' else label end || ': ' || printf('%.4f', e), chr(10) order by label) as report from tot group by card""",
        "interval_iou": f"with {PAIRS} select *, round(inter / hull, 6) as iou from pairs",
        "iou_match": f"with {PAIRS} select *, round(inter / hull, 6) as iou from best",
        "iou_totals": f"""with {PAIRS}
select card, label, cast(sum(inter) as bigint) as inter, cast(sum(hull) as bigint) as hull, cast(grouping(card, label) as integer) as level
from best group by grouping sets ((card, label), (card), (label), ())""",
        "label_error": f"""with {PAIRS}
select coalesce(label, 'total') as label, case when coalesce(sum(hull), 0) > 0 then round(1 - sum(inter) / sum(hull), 6)
    when grouping(label) = 0 then -1.0 end as error from best group by grouping sets ((label), ())""",
        "overlap_pairs": f"""with {SPANS}
select a.card, a.label as a_label, a.start_pos as a_start, a.end_pos as a_end, b.label as b_label, b.start_pos as b_start, b.end_pos as b_end,
    case when (a.start_pos <= b.start_pos and b.end_pos <= a.end_pos) or (b.start_pos <= a.start_pos and a.end_pos <= b.end_pos) then 'inside' else 'partial' end as kind
from moved a join moved b on a.card = b.card and a.start_pos < b.end_pos and b.start_pos < a.end_pos
    and (a.start_pos, a.end_pos, a.label) < (b.start_pos, b.end_pos, b.label)""",
        "merge_adjacent_spans": f"""with {SPANS},
f as (select *, case when lag(end_pos) over w + 1 = start_pos then 0 else 1 end as fresh from spans window w as (partition by card, label order by start_pos, end_pos)),
g as (select *, sum(fresh) over (partition by card, label order by start_pos, end_pos) as island from f)
select card, label, min(start_pos) as start_pos, max(end_pos) as end_pos, count(*) as n_spans from g group by card, label, island""",
        "char_mask": f"with {SPANS}, {_mask('m', 'spans')} select card, pos, label from m",
        "masked_error": f"""with {MASKS}
select coalesce(truth, pred) as label, count(*) filter (where truth = pred) as inter, count(*) as "union",
    round(1 - count(*) filter (where truth = pred) / count(*), 6) as error from masks group by 1""",
        "classification_report": f"""with {MASKS},
m as (select coalesce(truth, '-') as t, coalesce(pred, '-') as p from masks),
per as (
    select kind, (select count(*) from m where t = kind) as support, (select count(*) from m where p = kind) as named,
        (select count(*) from m where t = kind and p = kind) as hit
    from (select t as kind from m union select p from m)
),
pr as (select *, {share('hit', 'named')} as p, {share('hit', 'support')} as r from per),
f as (select *, {share('2 * p * r', 'p + r')} as f1 from pr)
select kind, round(p, 6) as precision, round(r, 6) as recall, round(f1, 6) as f1, support from f
union all select 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), cast(sum(support) as bigint) from f having sum(support) > 0
union all select 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f having sum(support) > 0
union all select 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from f having sum(support) > 0""",
        "masked_accuracy": f"""with {MASKS},
per as (
    select avg(case when truth = coalesce(pred, '') then 1.0::double else 0.0::double end) as share, count(*) as n
    from masks where list_contains({[k.replace(' ', '_') for k in MASK_SIGNS]}, truth) group by split_part(card, '/', 1)
)
select round(avg(share), 6) as accuracy, cast(sum(n) as bigint) as n from per""",
        "space_positions": """
select card, label, start_pos, case when span_text is null then '' else
    array_to_string(list_filter(range(0, length(span_text)), lambda i: substring(span_text, i + 1, 1) = ' '), ',') end as spaces
from (select distinct card, label, start_pos, span_text from card_span)""",
        "refine_border": f"""with {SPANS}, {TEXTS},
sp as (select card, list_filter(range(0, length(transcription)), lambda i: substring(transcription, i + 1, 1) = ' ') as spaces from texts),
b as (
    select s.*, list_filter(spaces, lambda x: x >= start_pos and x <= end_pos) as inside,
        list_max(list_filter(spaces, lambda x: x < start_pos)) as before, list_min(list_filter(spaces, lambda x: x > end_pos)) as after
    from spans s join sp using (card)
)
select card, label, start_pos, end_pos, cast(case when len(inside) > 0 then inside[len(inside) // 2 + 1]
    when before is null and after is null then (start_pos + end_pos) // 2
    when before is null then after when after is null then before
    when start_pos - before < after - end_pos then before else after end as integer) as border from b""",
        "span_text": f"""with {SPANS}, {TEXTS}
select card, label, string_agg(trim(substring(transcription, start_pos + 1, end_pos - start_pos)), ' ' order by start_pos, end_pos) as text
from spans join texts using (card) group by card, label""",
        "merge_annotations": f"""with {SPANS}
select card, card || chr(9) || string_agg(label || ' ' || start_pos || ' ' || end_pos, chr(9) order by start_pos, end_pos, label) as line from spans group by card""",
        "training_filter": f"""with {SPANS}
select card, count(*) as n_spans from spans group by card
having count(*) >= 4 and count(distinct label) filter (where label in ('Author', 'ID', 'Title')) = 3""",
        "lf_tokenize": f"with {TOKENS} select card, tok_ord, token from tokens",
        "token_offsets": f"""with {TEXTS},
x as (
    select card, regexp_extract_all(transcription, '{NOT_WS}+') as w, regexp_extract_all(transcription, '({WS}*){NOT_WS}+', 1) as g from texts
),
y as (select card, unnest(w) as token, length(unnest(g)) as gap, generate_subscripts(w, 1) - 1 as tok_ord from x),
z as (select *, sum(length(token) + gap) over (partition by card order by tok_ord) as e from y)
select card, cast(tok_ord as integer) as tok_ord, token, cast(e - length(token) as integer) as start_pos, cast(e as integer) as end_pos from z""",
        "label_islands": f"""with {ISLANDS}
select user_id, island, min(event_type) as label, count(*) as n, min(ts) as first, max(ts) as last from runs group by user_id, island""",
        "confidence_agg_prod": _confidence("product(conf)"),
        "confidence_agg_mean": _confidence("avg(conf)"),
        "confidence_agg_max": _confidence("max(conf)"),
        "confidence_agg_min": _confidence("min(conf)"),
        "confidence_agg_median": _confidence("median(conf)"),
        "iob_tags": """
select event_id, user_id, case when event_type = 'O' then 'O' when lag(event_type) over w = event_type then 'I-' || event_type else 'B-' || event_type end as tag
from events window w as (partition by user_id order by ts, event_id)""",
        "propagate_labels": f"""with {TOKENS}
select card, tok_ord, cast(unnest(range(0, (length(token) - 1) // 3 + 1)) as integer) as piece, cast(length(token) as integer) as piece_label from tokens
union all select distinct card, -1, 0, -100 from tokens""",
        "label_ids": "select 'O' as label, 0 as id union all select k || '-' || l, cast((i - 1) * 3 + j as integer) from "
        + f"(select unnest({list(LABEL_COLUMNS)}) as l, unnest(range(1, {len(LABEL_COLUMNS) + 1})) as i), (select unnest(['I', 'O', 'B']) as k, unnest([1, 2, 3]) as j)",
        "length_histogram": """
select cast(least(x // 50, 15) as integer) as bin, count(*) as n, count(*) filter (where x > 230) as n_above
from (select len(string_split(text, ' ')) as x from documents where text is not null) where x <= 800 group by 1""",
        "softmax_confidence": """
select vec_id, round(1.0::double / list_sum(list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double)))), 6) as confidence,
    cast(list_position(embedding, list_max(embedding)) - 1 as integer) as best from embeddings""",
    }
