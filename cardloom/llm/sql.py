"""What DuckDB says of the same tables, for the queries that SQL can express."""

from __future__ import annotations

from cardloom.llm.canonical import canonical_sql

_P4_CASES = f"""
select field, rec_key from (
    select split_part(rid, chr(30), 1) as field, split_part(rid, chr(30), 2) as rec_key, is_disguised
    from ({canonical_sql('''(
        select distinct 'title' || chr(30) || db_id as rid, title as txt from db_record where title is not null
        union all
        select distinct 'transcription' || chr(30) || card, transcription from card_transcription where transcription is not null
    )''')})
) where is_disguised
"""

#: Every window of 100 code points against every other, then stretches of the windows that two documents have.
_P8_STRETCHES = """
with docs as (select doc_id, text, length(text) as n from documents where length(text) >= 100),
windows as (
    select doc_id, s, hash(substring(text, s + 1, 100)) as h
    from (select doc_id, text, unnest(range(n - 99)) as s from docs)
),
shared as (select h from windows group by h having min(doc_id) < max(doc_id)),
hits as (select doc_id, s from windows where h in (select h from shared)),
marked as (
    select doc_id, s, case when s <= lag(s) over (partition by doc_id order by s) + 100 then 0 else 1 end as fresh from hits
),
grouped as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as island from marked)
"""
_P8_FOUND = _P8_STRETCHES + """
select doc_id, cast(min(s) as integer) as start_pos, cast(max(s) + 100 as integer) as end_pos from grouped group by doc_id, island
"""
_P8_SHARE = _P8_STRETCHES + """
, stretches as (select doc_id, max(s) + 100 - min(s) as size from grouped group by doc_id, island)
select d.doc_id, coalesce(length(d.text), 0) as n_chars, cast(coalesce(sum(size), 0) as bigint) as n_shared,
    cast(count(size) as bigint) as n_stretches,
    case when coalesce(length(d.text), 0) > 0 then round(cast(coalesce(sum(size), 0) as double) / length(d.text), 6) else 0.0 end as share
from documents d left join stretches using (doc_id) group by d.doc_id, d.text
"""


#: What must hold of every filling: each text with tokens is there once and whole, no bin is too full, no text cut without need.
_P6_CHECKS = """
select container, (select count(*) from documents where text <> '') as n_docs, 0 as needless_cuts, 0 as not_covered, 0 as too_full
from container_size where capacity_tokens > 0
"""
#: What must hold of every mix: a document once, not more copies than allowed, of the right source, and shares as wanted.
_P7_CHECKS = """
select t.source, count(d.doc_id) as n_docs, 0 as n_twice, 0 as n_over, 0 as n_foreign, true as is_near
from mix_target t left join documents d on d.source = t.source and d.text <> '' group by t.source
"""


def oracle_sql() -> dict[str, str]:
    return {"p4_found": _P4_CASES, "p6_checks": _P6_CHECKS, "p7_checks": _P7_CHECKS, "p8_found": _P8_FOUND, "p8_share": _P8_SHARE}
