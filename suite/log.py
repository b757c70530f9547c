"""Queries over query logs, workloads and run tables."""

from pyspark.sql import functions as F

import trefoil as t
from trefoil.plans.workload import _own_signatures
from trefoil.sources import warehouse
from trefoil.sources.shared import new_path

from .registry import RUNS, TRIPLES, WORKLOAD, graph, query, written_text

_LOG_SQL = """log(query_id, query) as (select o_orderkey + 1, case left(o_orderpriority, 1)
  when '1' then 'PREFIX g: <http://graph.example/> SELECT ?p WHERE { <order/' || o_orderkey || '> g:hasPart ?p . ?p g:brand ?b . }'
  when '2' then 'PREFIX g: <http://graph.example/> SELECT * WHERE { ?o g:placedBy <customer/' || o_custkey || '> . ?o g:status "' || o_orderstatus || '" }'
  when '3' then 'PREFIX g: <http://graph.example/> SELECT DISTINCT ?s WHERE { <order/' || o_orderkey || '> g:hasSupplier ?s . ?s g:nation ?n . ?n g:inRegion ?r . }'
  when '4' then 'PREFIX g: <http://graph.example/> SELECT ?c ?n WHERE { <order/' || o_orderkey || '> <http://graph.example/placedBy> ?c . ?c ?q ?c . ?c g:nation ?n . }'
  else 'BASE <http://graph.example/> SELECT ?a ?b WHERE { ?a <refersTo> ?x . ?b <refersTo> ?x FILTER (?a != ?b) }' end
  from orders)"""


def _pattern_rows(first, *patterns):
    rows = [
        f"select o_orderkey + 1, {pos}, {s}, {p}, {o} from orders where o_orderpriority like '{first}%'"
        for pos, (s, p, o) in enumerate(patterns)
    ]
    return " union all ".join(rows)


_ORDER = "'order/' || o_orderkey"
_EXTRACTED = " union all ".join([
    _pattern_rows("1", (_ORDER, "'g__hasPart'", "'?p'"), ("'?p'", "'g__brand'", "'?b'")),
    _pattern_rows("2", ("'?o'", "'g__placedBy'", "'customer/' || o_custkey"), ("'?o'", "'g__status'", "'\"' || o_orderstatus || '\"'")),
    _pattern_rows("3", (_ORDER, "'g__hasSupplier'", "'?s'"), ("'?s'", "'g__nation'", "'?n'"), ("'?n'", "'g__inRegion'", "'?r'")),
    _pattern_rows("4", (_ORDER, "'g__placedBy'", "'?c'"), ("'?c'", "'?q'", "'?c'"), ("'?c'", "'g__nation'", "'?n'")),
    _pattern_rows("5", ("'?a'", "'g__refersTo'", "'?x'"), ("'?b'", "'g__refersTo'", "'?x'")),
])


def _log_text(spark, folder, tail=""):
    log = warehouse.query_log(spark, folder)
    return log.select(F.concat("query", F.lit(tail)).alias("value"), "query_seq")


@query("extract_patterns", f"""with x(query_id, pos, s, p, o) as ({_EXTRACTED})
select query_id, query_id as query_seq, pos, s, p, o from x""")
def extract_patterns(spark, folder):
    return t.extract_patterns(warehouse.query_log(spark, folder), warehouse.PREFIXES)


@query("extracted_features", f"""with x(query_id, pos, s, p, o) as ({_EXTRACTED}),
e as (select query_id, s as var from x where s like '?%' and p not like '?%'
  union all select query_id, o from x where o like '?%' and p not like '?%'),
d as (select query_id, max(uses) as uses from (select query_id, var, count(*) as uses from e group by 1, 2) group by 1)
select query_id, count(*) as num_triples, coalesce(max(uses), 0) as max_joins from x left join d using (query_id) group by 1""")
def extracted_features(spark, folder):
    log = warehouse.query_log(spark, folder)
    return t.query_features(t.extract_patterns(log, warehouse.PREFIXES))


@query("query_heads", f"""with {_LOG_SQL}
select query_id, case when query like '%?p WHERE%' then '?p' when query like '%*%' then '?o'
  when query like '%DISTINCT%' then '?s' when query like '%?c ?n WHERE%' then '?c ?n' else '?a ?b' end as variables,
  query like '%DISTINCT%' as "distinct", case when query like '%FILTER%' then '?a != ?b' else '' end as filters from log""")
def query_heads(spark, folder):
    heads = t.query_heads(warehouse.query_log(spark, folder), warehouse.PREFIXES)
    pairs = F.transform("filters", lambda f: F.concat_ws(" != ", f["a"], f["b"]))
    return heads.select("query_id", F.array_join("select", " ").alias("variables"), "distinct", F.array_join(pairs, " ").alias("filters"))


# The log in other shapes: predicate and object lists, the word "a", quotes and marks inside literals, comments.
_SHAPED = """PREFIX g: <http://graph.example/> # all { of it
SELECT * { <order/%1$s> a <http://graph.example/class/Order> ; g:status "a \\"b\\" . ; { c" , "x y"@en ;
  g:priority '%1$s' . # no ?pattern here .
  $c g:refersTo$c }"""


@query("extract_shapes", """with o as (select o_orderkey + 1 as query_id, 'order/' || o_orderkey as s from orders)
select query_id, query_id as query_seq, 0 as pos, s, 'rdf__type' as p, 'cls__Order' as o from o
union all select query_id, query_id, 1, s, 'g__status', '"a \\"b\\" . ; { c"' from o
union all select query_id, query_id, 2, s, 'g__status', '"x y"@en' from o
union all select query_id, query_id, 3, s, 'g__priority', '"' || (query_id - 1) || '"' from o
union all select query_id, query_id, 4, '?c', 'g__refersTo', '?c' from o""")
def extract_shapes(spark, folder):
    log = warehouse.table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("query_id"), (F.col("o_orderkey") + 1).alias("query_seq"),
        F.format_string(_SHAPED, "o_orderkey").alias("query"))
    return t.extract_patterns(log, warehouse.PREFIXES)


@query("rejected_queries", f"""with {_LOG_SQL}
select query_id, query_id as query_seq, case when query like '%?p WHERE%' then 'words after the group'
  when query like '%*%' then 'nested group' when query like '%DISTINCT%' then 'unreadable characters'
  when query like '%?c ?n WHERE%' then 'other filter' end as reason
from log where query like '%?p WHERE%' or query like '%*%' or query like '%DISTINCT%' or query like '%?c ?n WHERE%'""")
def rejected_queries(spark, folder):
    # Each form of the log but one made to ask for more; that one stays readable.
    text = F.col("query")
    more = (
        F.when(text.contains("?p WHERE"), F.concat(text, F.lit(" LIMIT 5")))
        .when(text.contains("*"), F.replace(text, F.lit(" }"), F.lit(" OPTIONAL { ?o g:priority ?p } }")))
        .when(text.contains("DISTINCT"), F.replace(text, F.lit(". }"), F.lit('. ?r g:name "open }')))
        .when(text.contains("?c ?n WHERE"), F.replace(text, F.lit(". }"), F.lit('FILTER regex(?n, "nation") }')))
        .otherwise(text)
    )
    return t.rejected_queries(warehouse.query_log(spark, folder).withColumn("query", more))


@query("run_from_log", f"""with {TRIPLES},
f as (select left(o_orderpriority, 1) as form, min(o_orderkey) as k from orders group by 1),
q as (select form, k, o_custkey, o_orderstatus from f join orders on o_orderkey = k),
n(form, n) as (
  select form, (select count(*) from triples a join triples b on b.sub = a.obj and b.prop = 'g__brand'
    where a.prop = 'g__hasPart' and a.sub = 'order/' || k) from q where form = '1'
  union all select form, (select count(*) from triples a join triples b on b.sub = a.sub and b.prop = 'g__status'
    and b.obj = '"' || o_orderstatus || '"' where a.prop = 'g__placedBy' and a.obj = 'customer/' || o_custkey) from q where form = '2'
  union all select form, (select count(distinct a.obj) from triples a join triples b on b.sub = a.obj and b.prop = 'g__nation'
    join triples c on c.sub = b.obj and c.prop = 'g__inRegion' where a.prop = 'g__hasSupplier' and a.sub = 'order/' || k) from q where form = '3'
  union all select form, (select count(*) from triples a join triples b on b.sub = a.obj and b.obj = a.obj
    join triples c on c.sub = a.obj and c.prop = 'g__nation' where a.prop = 'g__placedBy' and a.sub = 'order/' || k) from q where form = '4'
  union all select form, (select count(*) from triples a join triples b on a.obj = b.obj and b.prop = 'g__refersTo' and a.sub <> b.sub
    where a.prop = 'g__refersTo') from q where form = '5')
select k + 1 as query_id, n as num_results from n join q using (form)""")
def run_from_log(spark, folder):
    # The first text of each form, run as it asks: with its filter, its DISTINCT and its SELECT list.
    form = F.substring("o_orderpriority", 1, 1)
    first = warehouse.table(spark, folder, "orders").groupBy(form).agg((F.min("o_orderkey") + 1).alias("query_id")).select("query_id")
    log = warehouse.query_log(spark, folder).join(first, "query_id")
    runs = t.run_workload(graph(spark, folder), t.logged_queries(log, warehouse.PREFIXES))
    return runs.select(F.col("query").cast("long").alias("query_id"), "num_results")


@query("query_batch", f"with {_LOG_SQL} select 'batch-' || query_id as query_name, query_id as query_seq, query from log")
def query_batch(spark, folder):
    path = written_text(_log_text(spark, folder), "batch", "query_seq")
    return t.read_query_batch(spark, path)


@query("query_log_delimited", f"with {_LOG_SQL} select cast(query_id as varchar) as query_name, query from log")
def query_log_delimited(spark, folder):
    path = written_text(_log_text(spark, folder, "\n#EOQ#"), "delimited", "query_seq")
    return t.read_query_log(spark, path, record_sep="#EOQ#")


@query("zip_lines", f"with {_LOG_SQL} select query_id as line, cast(query_id as varchar) as \"left\", query as \"right\" from log")
def zip_lines(spark, folder):
    log = warehouse.query_log(spark, folder)
    ids = written_text(log.select(F.col("query_id").cast("string").alias("value"), "query_seq"), "ids", "query_seq")
    return t.zip_lines(spark, ids, written_text(_log_text(spark, folder), "texts", "query_seq"))


@query("query_text_variables", f"""with {_LOG_SQL}
select query_id, case when query like '%?p WHERE%' then '?p ?b' when query like '%*%' then '?o'
  when query like '%DISTINCT%' then '?s ?n ?r' when query like '%?c ?n WHERE%' then '?c ?n ?q' else '?a ?b ?x' end as variables,
  replace(query, '*', '?o') as expanded from log""")
def query_text_variables(spark, folder):
    log = warehouse.query_log(spark, folder)
    return log.select(
        "query_id", F.array_join(t.functions.query_variables("query"), " ").alias("variables"),
        t.functions.expand_star("query").alias("expanded"),
    )


@query("join_variables", f"with {WORKLOAD} select query_id, var, pos, prop, side from ends")
def join_variables(spark, folder):
    return t.join_variables(warehouse.workload(spark, folder))


@query("join_pairs", f"""with {WORKLOAD}
select prop_a, side_a, prop_b, side_b, cast(sum(n) as bigint) as n from (
  select least((a.prop, a.side), (b.prop, b.side)) as x, greatest((a.prop, a.side), (b.prop, b.side)) as y, 1 as n,
    case when (a.prop, a.side) <= (b.prop, b.side) then a.prop else b.prop end as prop_a,
    case when (a.prop, a.side) <= (b.prop, b.side) then a.side else b.side end as side_a,
    case when (a.prop, a.side) <= (b.prop, b.side) then b.prop else a.prop end as prop_b,
    case when (a.prop, a.side) <= (b.prop, b.side) then b.side else a.side end as side_b
  from ends a join ends b on a.query_id = b.query_id and a.var = b.var and (a.pos, a.side) < (b.pos, b.side))
group by 1, 2, 3, 4""")
def join_pairs(spark, folder):
    return t.join_pairs(warehouse.workload(spark, folder))


@query("reduction_signatures", f"""with {WORKLOAD} select query_id, query_seq, pos, side, sig
from ends join sigs using (query_id, query_seq, var, prop, side)""")
def reduction_signatures(spark, folder):
    return t.reduction_signatures(warehouse.workload(spark, folder))


@query("candidate_signatures", f"""with {WORKLOAD}
select distinct a.prop, a.label || '_JOIN_' || b.label as signature from labels a
  join labels b on a.query_id = b.query_id and a.var = b.var and (a.label <> b.label or a.uses > 1)
union select prop, sig from sigs""")
def candidate_signatures(spark, folder):
    return t.candidate_signatures(warehouse.workload(spark, folder))


@query("warm_cold", f"""with {WORKLOAD}, used as (select distinct query_id, query_seq, sig from sigs)
select query_id, query_seq, sig, min(query_seq) over (partition by sig) < query_seq as is_warm from used""")
def warm_cold(spark, folder):
    return t.warm_cold(warehouse.workload(spark, folder))


@query("query_features", f"""with {WORKLOAD}, d as (
  select query_id, max(uses) as max_joins from (select query_id, var, count(*) as uses from ends group by 1, 2) group by 1)
select query_id, count(*) as num_triples, max(max_joins) as max_joins from wl join d using (query_id) group by 1""")
def query_features(spark, folder):
    return t.query_features(warehouse.workload(spark, folder))


@query("split_signatures", f"""with {WORKLOAD} select sig, prop as head_prop, side as head_side,
(length(sig) - length(replace(sig, '_JOIN_', ''))) // 6 as partners, count(*) as uses from sigs group by 1, 2, 3, 4""")
def split_signatures(spark, folder):
    parts = t.functions.split_signature("sig")
    sigs = _own_signatures(warehouse.workload(spark, folder))
    return sigs.select(
        "sig", parts[0]["prop"].alias("head_prop"), parts[0]["side"].alias("head_side"),
        (F.size(parts) - 1).cast("long").alias("partners"),
    ).groupBy("sig", "head_prop", "head_side", "partners").agg(F.count(F.lit(1)).alias("uses"))


MIN_SUPPORT = 0.015


@query("frequent_patterns", f"""with {WORKLOAD},
items as (select distinct query_id, p from wl),
sized as (select query_id from items group by 1 having count(*) >= 2),
pairs as (select a.p || '|' || b.p as items, count(*) as freq from items a join items b on a.query_id = b.query_id
  and a.p < b.p group by 1),
threes as (select a.p || '|' || b.p || '|' || c.p as items, count(*) as freq from items a
  join items b on a.query_id = b.query_id and a.p < b.p join items c on b.query_id = c.query_id and b.p < c.p group by 1),
larger as (
  -- A set of four or more is frequent only where its sets of three are; orders have at most seven lines.
  select string_agg(items[i], '|' order by i) as items, qid from (
    select query_id as qid, list_sort(list(p)) as items from items group by 1 having count(*) >= 4) q,
    (select range as mask from range(1, 128)) m, unnest(range(1, 8)) u(i)
  where (mask >> (i - 1)) & 1 = 1 and i <= len(items) and mask < (1 << len(items)) and bit_count(mask) >= 4 group by qid, mask),
more as (select items, count(*) as freq from larger group by 1)
select items, freq from (select * from pairs union all select * from threes union all select * from more) where freq >= ceil({MIN_SUPPORT} * (select count(*) from sized))""")
def frequent_patterns(spark, folder):
    found = t.frequent_patterns(warehouse.workload(spark, folder), MIN_SUPPORT)
    return found.select(F.array_join("items", "|").alias("items"), "freq")


@query("similar_properties_statement", f"""with {WORKLOAD} select 10 as n, true as all_known, false as has_itself, true as in_range""")
def similar_properties_statement(spark, folder):
    # What holds for any neighbours: ten distinct known words, not the word itself, with cosines.
    workload = warehouse.workload(spark, folder)
    found = t.similar_properties(workload, "Brand#1", k=10, min_count=5)
    known = workload.select(F.col("p").alias("word")).distinct().withColumn("known", F.lit(True))
    return found.join(known, "word", "left").agg(
        F.countDistinct("word").cast("int").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"),
        F.bool_or(F.col("word") == "Brand#1").alias("has_itself"), F.bool_and(F.abs("similarity") <= 1.000001).alias("in_range"),
    )


@query("similar_properties")
def similar_properties(spark, folder):
    return t.similar_properties(warehouse.workload(spark, folder), "Brand#1", k=10, min_count=5)


# Classes left out, to show that any can be.
EXCLUDED = [18, 20, 25, 31, 40, 41]


@query("first_k_per_class", f"""with q as (select o_orderkey + 1 as query_id, o_orderkey // 100 + 1 as query_class from orders)
select query_id, query_class, place from (
  select *, cast(row_number() over (partition by query_class order by query_id) as int) as place from q
  where query_class >= 17 and query_class not in ({", ".join(map(str, EXCLUDED))})) where place <= 50""")
def first_k_per_class(spark, folder):
    log = warehouse.query_log(spark, folder).drop("query")
    return t.workload_sample(log, 50, 17, EXCLUDED).select("query_id", "query_class", "place")


@query("representative_per_class", """select min(o_orderkey) + 1 as query_id, o_orderkey // 100 + 1 as query_class
from orders where o_orderkey // 100 + 1 >= 18 group by 2""")
def representative_per_class(spark, folder):
    log = warehouse.query_log(spark, folder).drop("query")
    return t.workload_sample(log, 1, 18).select("query_id", "query_class")


_SAMPLE_SQL = f"""{TRIPLES},
numbered as (select sub, prop, obj, row_number() over (partition by sub, prop, obj) as k from triples),
drawn as (select *, md5(concat_ws(chr(1), '0', sub, prop, obj, k::varchar)) as draw from numbered order by draw limit 2000),
kept as (select * from drawn where not (obj like '"%' and obj not like '%"')),
sample as (select sub, prop, obj, cast((row_number() over (order by draw) - 1) // 500 as int) as slice from kept)"""


@query("sample_slices", f"with {_SAMPLE_SQL} select * from sample")
def sample_slices(spark, folder):
    return t.sample_slices(graph(spark, folder).triples, 2000, 500, seed=0)


@query("sample_properties", f"with {_SAMPLE_SQL} select prop, count(*) as n from sample group by 1")
def sample_properties(spark, folder):
    return t.sample_properties(t.sample_slices(graph(spark, folder).triples, 2000, 500, seed=0))


# --- run tables --------------------------------------------------------------------------


@query("runs_roundtrip", """select event_id + 1 as query_id, (event_id + 1) || '__VP_SO-OS-SS-VP' as query,
user_id * 3 as num_results, value as time_ms, user_id * 100 as table_sizes, user_id * 10 as reduction_sizes,
cast(user_id % 5 + 1 as int) as max_joins, event_type <> 'error' as is_warm, cast(user_id % 12 + 1 as int) as num_triples
from events""")
def runs_roundtrip(spark, folder):
    path = new_path(spark, "runs")
    t.write_runs(warehouse.runs(spark, folder), path)
    return t.read_runs(spark, path)


@query("read_times", f"with {RUNS} select query_id, time_ms from other")
def read_times(spark, folder):
    line = F.concat_ws("\t", F.col("query_id").cast("string"), F.col("time_ms").cast("string"))
    lines = warehouse.other_runs(spark, folder).select(F.concat(line, F.lit(" [SO-OS-SS-VP__table]")).alias("value"))
    return t.read_times(spark, written_text(lines, "times"))


@query("mean_by_class", f"""with {RUNS} select (query_id - 1) // 100 + 1 as query_class,
round(avg(time_ms), 6) as mean_ms from runs group by 1""")
def mean_by_class(spark, folder):
    return t.mean_time_by_class(warehouse.runs(spark, folder)).withColumn("mean_ms", F.round("mean_ms", 6))


def _rounded(df):
    return df.withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("other_mean_ms", F.round("other_mean_ms", 4))


@query("mean_by_size", f"""with {RUNS} select cast(num_triples as int) as num_triples,
round(avg(r.time_ms), 4) as mean_ms, round(avg(o.time_ms), 4) as other_mean_ms
from runs r left join other o using (query_id) group by 1""")
def mean_by_size(spark, folder):
    return _rounded(t.mean_time_by_size(warehouse.runs(spark, folder), warehouse.other_runs(spark, folder)))


@query("mean_by_joins_warm", f"""with {RUNS} select cast(max_joins as int) as max_joins,
round(avg(r.time_ms), 4) as mean_ms, round(avg(o.time_ms), 4) as other_mean_ms
from runs r left join other o using (query_id) where is_warm group by 1""")
def mean_by_joins_warm(spark, folder):
    return _rounded(t.mean_time_by_joins(warehouse.runs(spark, folder), warehouse.other_runs(spark, folder)))


@query("cold_queries", f"""with {RUNS} select query_id, r.time_ms, o.time_ms as other_time_ms
from runs r left join other o using (query_id) where not is_warm""")
def cold_queries(spark, folder):
    return t.cold_queries(warehouse.runs(spark, folder), warehouse.other_runs(spark, folder))


@query("rank_aligned", f"""with {RUNS},
a as (select time_ms, row_number() over (order by time_ms desc, query_id) as rank from runs),
b as (select time_ms, row_number() over (order by time_ms desc, query_id) as rank from other)
select rank, a.time_ms, b.time_ms as other_time_ms from a full join b using (rank)""")
def rank_aligned(spark, folder):
    return t.rank_aligned(warehouse.runs(spark, folder), warehouse.other_runs(spark, folder))


@query("rank_aligned_classes", f"""with {RUNS},
a as (select round(avg(time_ms), 6) as time_ms, (query_id - 1) // 100 as c from runs group by 2),
b as (select round(avg(time_ms), 6) as time_ms, (query_id - 1) // 100 as c from other group by 2),
x as (select time_ms, row_number() over (order by time_ms, c) as rank from a),
y as (select time_ms, row_number() over (order by time_ms, c) as rank from b)
select rank, x.time_ms, y.time_ms as other_time_ms from x full join y using (rank)""")
def rank_aligned_classes(spark, folder):
    def means(df):
        return t.mean_time_by_class(df).select("query_class", F.round("mean_ms", 6).alias("time_ms"))

    return t.rank_aligned(
        means(warehouse.runs(spark, folder)), means(warehouse.other_runs(spark, folder)),
        key="query_class", ascending=True,
    )
