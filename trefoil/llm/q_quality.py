"""Registered query of the quality cascade."""

from .common import table
from .quality import judge
from .registry import query

_W = "[ \\t\\n\\x0B\\f\\r]"
# ``documents`` may be another name, for the pipeline.
QUALITY_SQL = f"""
base as (
  select doc_id, coalesce(text, '') as text from {{docs}}
),
words as (
  select *, list_filter(regexp_split_to_array(text, '{_W}+'), lambda w: w <> '') as w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) as lines,
    row_number() over () as r
  from base
),
windows as (
  select r, i, list_slice(w, i, i + 7) as win from words, unnest(range(1, len(w) - 6)) u(i) where len(w) > 8
),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, win) n from windows) where n > 1
),
reps as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) p from twice) group by r
),
counted as (
  select words.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from words left join reps on words.r = reps.r
),
judged as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counted
),
quality as (
  select *, not base_failed
    and not (10 * n_symbols > n_words)
    and not (word_chars < 2 * n_words or word_chars > 15 * n_words)
    and not (2 * n_dup_lines > length(regexp_replace(text, '[^\\n]', '', 'g')) + 1)
    and not (5 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words)
    and not (length(regexp_replace(text, '\\P{{{{Lu}}}}', '', 'g')) > 2 * length(regexp_replace(text, '\\P{{{{Ll}}}}', '', 'g')))
    and not (2 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) as kept
  from judged
)"""


@query("op5_quality_rules", f"with {QUALITY_SQL.format(docs='documents')} "
       "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from quality")
def op5_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "quality.*")
