"""Registered query of the line deduplication."""

from .common import table
from .lines import line_dedup
from .registry import query

LINES_SQL = """
split as (select doc_id, text, string_split(text, chr(10)) as ls from {docs}),
win as (
  select doc_id, i, list_slice(ls, i, i + 2) as w from split, unnest(range(1, len(ls) - 1)) u(i)
  where regexp_matches(array_to_string(list_slice(ls, i, i + 2), ''), '[^ \\t\\n\\x0B\\f\\r]')
),
later as (select doc_id, i from (select doc_id, i, row_number() over (partition by w order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 3)) as p from later),
left_lines as (
  select s.doc_id, count(*) as n_kept, string_agg(l, chr(10) order by p) as kept
  from (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as p from split) s
  anti join gone g on s.doc_id = g.doc_id and s.p = g.p group by 1
),
lines as (
  select split.doc_id, case when text is null then null else coalesce(kept, '') end as text,
    coalesce(len(ls), 0) as n_lines, coalesce(len(ls), 0) - coalesce(n_kept, 0) as n_removed
  from split left join left_lines using (doc_id)
)"""


@query("op6_line_dedup", f"with {LINES_SQL.format(docs='documents')} select doc_id, n_lines, n_removed, text from lines")
def op6_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "lines.n_lines", "lines.n_removed", "text")
