"""Queries over stores, statistics, filters and reductions."""

from pyspark.sql import functions as F

import trefoil as t
from trefoil.operators.bgp import bgp, bgp_count
from trefoil.operators.reduction import Reductions
from trefoil.sources import warehouse
from trefoil.sources.shared import new_path

from .answers import CHAIN, CYCLE, SNOWFLAKE, _CHAIN_SQL, _CYCLE_SQL
from .registry import TRIPLES, _once, graph, on_graph, query, stored_graph, written_text, per_property

_ALL = f"with {TRIPLES} select sub, prop, obj from triples"


@query("read_triples", _ALL)
def read_triples(spark, folder):
    path = written_text(warehouse.triple_lines(spark, folder), "lines")
    return t.read_triples(spark, path, sep="\t", prefixes=warehouse.PREFIXES)


@query("clean_triples", f"""with {TRIPLES}, fixed as (select
  case when sub like 'cls\\_\\_%' escape '\\' then sub else 'kb__' || sub end as sub, prop,
  case when obj like '"%' or obj like 'cls\\_\\_%' escape '\\' then obj else 'kb__' || obj end as obj from triples)
select sub, prop, obj from fixed""")
def clean_triples(spark, folder):
    # Each line also as a comment and as a directive, which must vanish.
    forms = F.array("value", F.concat(F.lit("# "), "value"), F.concat(F.lit("@base "), "value"))
    lines = warehouse.triple_lines(spark, folder).select(F.explode(forms).alias("value"))
    return t.clean_triples(lines, warehouse.PREFIXES, "kb")


@query("triple_store", _ALL)
def triple_store(spark, folder):
    path = new_path(spark, "vp")
    t.write_vp(graph(spark, folder).triples, path)
    return t.read_vp(spark, path)


@query("property_scan", f"with {TRIPLES} select sub, obj from triples where prop = 'g__hasPart'")
def property_scan(spark, folder):
    return stored_graph(spark, folder).prop("g__hasPart")


@query("placed_graph", f"with {TRIPLES} select prop, count(*) as n, count(distinct sub) as subjects from triples group by 1")
def placed_graph(spark, folder):
    # Cached, the whole graph by subject.
    placed = stored_graph(spark, folder).place("sub")
    return placed.triples.groupBy("prop").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sub").alias("subjects"))


@on_graph("properties", "select distinct prop from triples")
def properties(g):
    return t.properties(g)


@on_graph("property_stats", """select prop, count(*) as n, count(distinct sub) as n_sub, count(distinct obj) as n_obj,
round(count(*) / (select count(*) from triples), 6) as ratio from triples group by prop""")
def property_stats(g):
    return t.property_stats(g).withColumn("ratio", F.round("ratio", 6))


@on_graph("property_order", """select cast(row_number() over (order by n, prop) as int) as place, prop, n
from (select prop, count(*) as n from triples group by prop)""")
def property_order(g):
    # Properties from the rarest on: numbers come from a window over one row per property.
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("n", "prop"))
    return t.property_stats(g).select(place.alias("place"), "prop", "n")


@on_graph("graph_stats", """select count(*) as n_triples, count(distinct prop) as n_properties,
count(distinct sub) as n_sub, count(distinct obj) as n_obj from triples""")
def graph_stats(g):
    return t.graph_stats(g)


@on_graph("compact_property", """select sub, 0 as part, count(*) as n, string_agg(obj, '|' order by obj) as objs
from triples where prop = 'g__hasPart' group by sub""")
def compact_property(g):
    table = t.compact_property(g, "g__hasPart", max_items=1_000_000)
    array = F.col("g__hasPart")
    return table.select("sub", "part", F.size(array).cast("long").alias("n"), F.array_join(array, "|").alias("objs"))


# --- heavy values ------------------------------------------------------------------------


def _divided_graph(spark, folder):
    # Any value with a 256th of its column counts as heavy, however small the tables.
    return _once("divided", spark, folder, lambda: warehouse.graph(spark, folder).save(new_path(spark, "divided"), least_heavy=1))


@query("heavy_values", f"""with {TRIPLES}, v as (
  select prop, 'sub' as side, sub as value, count(*) as n from triples group by all
  union all select prop, 'obj', obj, count(*) from triples group by all),
w as (select * from v union all select null, side, value, sum(n) from v group by all)
select prop, side, value, cast(n as bigint) as n, cast(total as bigint) as total from (
  select *, sum(n) over (partition by prop, side) as total from w) where n * 256 >= total""")
def heavy_values(spark, folder):
    return _divided_graph(spark, folder)._heavy_table


@query("bgp_divided", f"""with {TRIPLES} select a.sub as c, a.obj as n, b.obj as r, d.obj as m from triples a
join triples b on b.sub = a.obj and b.prop = 'g__inRegion' join triples d on d.sub = a.obj and d.prop = 'g__name'
where a.prop = 'g__nation'""")
def bgp_divided(spark, folder):
    # Nations are heavy objects; both joins on ?n share one salt.
    g = _divided_graph(spark, folder)
    return bgp(g, [("?c", "g__nation", "?n"), ("?n", "g__inRegion", "?r"), ("?n", "g__name", "?m")])


@query("bgp_divided_count", per_property(f"select count(*) as n {_CYCLE_SQL}"))
def bgp_divided_count(spark, folder):
    return bgp_count(_divided_graph(spark, folder), CYCLE)


@query("bgp_divided_groups", f"""with {TRIPLES}, x as (select sub, obj from triples where prop = 'rdf__type'),
y as (select obj as c, count(*) as k from x group by 1)
select sub as a, k as n from x join y on x.obj = y.c""")
def bgp_divided_groups(spark, folder):
    # Every subject with the number of subjects of its class: a class may hold most of them.
    g = _divided_graph(spark, folder)
    return t.bgp_grouped(g, [("?a", "rdf__type", "?c"), ("?b", "rdf__type", "?c")], ["?a"])


# --- Bloom filters -----------------------------------------------------------------------


@query("bloom_sizes", f"""with {TRIPLES}, d as (
  select prop, 'sub' as side, count(distinct sub) as n from triples group by 1
  union all select prop, 'obj', count(distinct obj) from triples group by 1)
select prop, side, n, case when bits > 262144 then cast(ceil(bits / 262144.0) as bigint) * 262144 else bits end as m
from (select *, cast(greatest(64, ceil(n * (-ln(0.01) / power(ln(2), 2)))) as bigint) as bits from d)""")
def bloom_sizes(spark, folder):
    return stored_graph(spark, folder).blooms.meta.select("prop", "side", "n", "m")


@query("bloom_no_false_negatives", f"with {TRIPLES} select prop, 0 as missed from triples group by 1")
def bloom_no_false_negatives(spark, folder):
    # Every object of every property must pass that property's own object filter.
    from trefoil.operators.bloom import chunk_of, in_chunk

    g = stored_graph(spark, folder)
    sizes = g.blooms.meta.where("side = 'obj'").select("prop", "m")
    probes = g.triples.select("prop", "obj").distinct().join(sizes, "prop").withColumn("chunk", chunk_of(F.col("obj"), F.col("m")))
    probes = probes.join(g.blooms.words.where("side = 'obj'").drop("side"), ["prop", "chunk"], "left")
    passes = F.coalesce(in_chunk(F.col("obj"), g.blooms.hashes, F.col("m")), F.lit(False))
    return probes.groupBy("prop").agg(F.count_if(~passes).cast("int").alias("missed"))


@query("bloom_fpp_bound", "select true as within_bound")
def bloom_fpp_bound(spark, folder):
    # Orders are no customers: what passes the customers' filter is a false positive.
    g = stored_graph(spark, folder)
    strangers = g.prop("g__placedBy").select("sub").distinct()
    passed = t.bloom_filter_rows(strangers, "sub", g.blooms.of(("g__refersTo", "sub")))
    rate = passed.agg(F.count(F.lit(1)).alias("n")).scalar() / F.count(F.lit(1))
    return strangers.agg((rate <= 0.03).alias("within_bound"))


# --- reductions --------------------------------------------------------------------------

_PLACED = "(select obj from triples where prop = 'g__placedBy')"


@on_graph("reduction_exact_sub", f"""select sub, obj from triples where prop = 'g__nation' and sub in {_PLACED}""")
def reduction_exact_sub(g):
    return t.reduce_property(g, "g__nation", "sub", [("g__placedBy", "obj")])


@on_graph("reduction_exact_obj", """select sub, obj from triples where prop = 'g__placedBy'
and obj in (select obj from triples where prop = 'g__refersTo')""")
def reduction_exact_obj(g):
    return t.reduce_property(g, "g__placedBy", "obj", [("g__refersTo", "obj")])


@on_graph("reduction_exact_both", f"""select sub, obj from triples where prop = 'g__nation' and sub in {_PLACED}
and obj in (select t2.obj from triples t2 join triples t3 on t2.sub = t3.sub and t3.prop = 'rdf__type'
  and t3.obj = 'cls__Supplier' where t2.prop = 'g__nation') and obj in (select sub from triples where prop = 'g__inRegion')
""")
def reduction_exact_both(g):
    suppliers = bgp(g, [("?s", "rdf__type", "cls__Supplier"), ("?s", "g__nation", "?n")], select=["?n"])
    both = t.reduce_property(
        g, "g__nation", "both", {"sub": [("g__placedBy", "obj")], "obj": [("g__inRegion", "sub")]}
    )
    return both.join(suppliers.select(F.col("n").alias("obj")).distinct(), "obj", "left_semi").select("sub", "obj")


@query("reduction_bloom_join", f"with {TRIPLES} select a.sub as o, a.obj as c {_CHAIN_SQL}")
def reduction_bloom_join(spark, folder):
    # Over Bloom-reduced tables; the join removes their false positives.
    return bgp(stored_graph(spark, folder), CHAIN, select=["?o", "?c"], reductions="bloom")


@query("reduction_bloom_missed", f"with {TRIPLES} select sub, obj from triples where false")
def reduction_bloom_missed(spark, folder):
    # Rows of the exact reduction that the Bloom reduction lost: none.
    g = stored_graph(spark, folder)
    exact = t.reduce_property(g, "g__placedBy", "obj", [("g__refersTo", "obj")])
    bloom = t.reduce_property(g, "g__placedBy", "obj", [("g__refersTo", "obj")], mode="bloom")
    return exact.join(bloom.distinct(), ["sub", "obj"], "left_anti")


@on_graph("bgp_over_reductions", per_property(f"select a.sub as o, a.obj as s, b.obj as n, c.obj as c {_CYCLE_SQL}"))
def bgp_over_reductions(g):
    return bgp(g, CYCLE, reductions="exact")


@on_graph("bgp_count_over_reductions", per_property(f"select count(*) as n {_CYCLE_SQL}"))
def bgp_count_over_reductions(g):
    return bgp_count(g, CYCLE, reductions="exact")


@on_graph("reduction_report", f"""select 0 as pos, 'g__placedBy' as prop,
  (select count(*) from triples where prop = 'g__placedBy') as n_before,
  (select count(*) from triples where prop = 'g__placedBy' and obj in (select sub from triples where prop = 'g__nation')) as n_after,
  1.0 as ratio
union all select 1, 'g__nation', (select count(*) from triples where prop = 'g__nation'),
  (select count(*) from triples where prop = 'g__nation' and sub in {_PLACED}
    and obj in (select sub from triples where prop = 'g__inRegion')),
  round((select count(*) from triples where prop = 'g__nation' and sub in {_PLACED}
    and obj in (select sub from triples where prop = 'g__inRegion'))
    / (select count(*) from triples where prop = 'g__nation'), 6)
union all select 2, 'g__inRegion', 25, 25, 1.0""")
def reduction_report(g):
    return t.reduction_report(g, CHAIN).withColumn("ratio", F.round("ratio", 6))


SIGNATURES = [
    "g__nation_TRPS_JOIN_g__placedBy_TRPO",
    "g__nation_TRPS_JOIN_g__refersTo_TRPO",
    "g__nation_TRPS_JOIN_g__placedBy_TRPO_JOIN_g__refersTo_TRPO",
    "g__placedBy_TRPO_JOIN_g__refersTo_TRPO",
]
_REFERRED = "(select obj from triples where prop = 'g__refersTo')"
_REDUCTION_COUNTS = f"""counts(prop, signature, n) as (
  select 'g__nation', '{SIGNATURES[0]}', count(*) from triples where prop = 'g__nation' and sub in {_PLACED}
  union all select 'g__nation', '{SIGNATURES[1]}', count(*) from triples where prop = 'g__nation' and sub in {_REFERRED}
  union all select 'g__nation', '{SIGNATURES[2]}', count(*) from triples
    where prop = 'g__nation' and sub in {_PLACED} and sub in {_REFERRED}
  union all select 'g__placedBy', '{SIGNATURES[3]}', count(*) from triples where prop = 'g__placedBy' and obj in {_REFERRED}
)"""


@query("materialized_reduction", f"""with {TRIPLES} select sub, obj from triples where prop = 'g__nation'
and sub in {_PLACED} and sub in {_REFERRED}""")
def materialized_reduction(spark, folder):
    g, path = stored_graph(spark, folder), new_path(spark, "reductions")
    t.materialize_reductions(g, SIGNATURES, path)
    return t.reduced(g, path, "g__nation", SIGNATURES[2])


@query("bgp_over_stored_reductions", per_property(f"select a.sub as o, a.obj as s, b.obj as n, c.obj as c {_CYCLE_SQL}"))
def bgp_over_stored_reductions(spark, folder):
    # Every signature of the query is stored; one of another query is no use to it.
    g, path = stored_graph(spark, folder), new_path(spark, "reductions")
    wanted = [s for i in range(len(CYCLE)) for s in t.Reductions(g).signatures(CYCLE, i).values()]
    t.materialize_reductions(g, [*wanted, SIGNATURES[2]], path)
    return t.bgp(g, CYCLE, reductions=t.StoredReductions(g, path))


@query("materialized_counts", f"with {TRIPLES}, {_REDUCTION_COUNTS} select prop, signature, n from counts")
def materialized_counts(spark, folder):
    return t.materialize_reductions(graph(spark, folder), SIGNATURES, new_path(spark, "reductions"))


@query("best_reduction", f"""with {TRIPLES}, {_REDUCTION_COUNTS}
select prop, signature, n from (select *, row_number() over (partition by prop order by n, signature) as place
  from counts where n > 0) where place = 1""")
def best_reduction(spark, folder):
    return t.best_reduction(
        t.materialize_reductions(graph(spark, folder), SIGNATURES, new_path(spark, "reductions"))
    )


# --- running a workload ------------------------------------------------------------------

RUN = [
    ("chain", CHAIN),
    ("chain-again", CHAIN[::-1]),
    ("loop", [("?c", "g__refersTo", "?c"), ("?c", "g__nation", "?n")]),
    ("free", [("?c", "g__refersTo", "?c"), ("?c", "?p", "?x")]),
    ("snowflake", SNOWFLAKE),
]


def _run_line(name, count, props, reductions, joins, warm, patterns):
    tables = " + ".join(f"(select count(*) from triples where prop = '{p}')" for p in props)
    reduced = " + ".join(f"(select count(*) from triples where {r})" for r in reductions)
    return (
        f"select '{name}' as query, ({count}) as num_results, {tables} as table_sizes, {reduced} as reduction_sizes, "
        f"{joins} as max_joins, {warm} as is_warm, {patterns} as num_triples"
    )


def _in(prop, *conditions):
    tests = [f"{end} in (select {other} from triples where prop = '{q}')" for end, q, other in conditions]
    return " and ".join([f"prop = '{prop}'", *tests])


_CHAIN_RUN = (
    f"select count(*) {_CHAIN_SQL}", ["g__placedBy", "g__nation", "g__inRegion"],
    [
        _in("g__placedBy", ("obj", "g__nation", "sub")),
        _in("g__nation", ("sub", "g__placedBy", "obj"), ("obj", "g__inRegion", "sub")),
        _in("g__inRegion", ("sub", "g__nation", "obj")),
    ], 2,
)
_RUN_SQL = "\nunion all ".join([
    _run_line("chain", *_CHAIN_RUN, "false", 3),
    _run_line("chain-again", *_CHAIN_RUN, "true", 3),
    _run_line(
        "loop",
        "select count(*) from triples a join triples b on a.sub = b.sub where a.prop = 'g__refersTo' "
        "and a.sub = a.obj and b.prop = 'g__nation'",
        ["g__refersTo", "g__nation"],
        [
            _in("g__refersTo", ("sub", "g__refersTo", "obj"), ("sub", "g__nation", "sub"),
                ("obj", "g__refersTo", "sub"), ("obj", "g__nation", "sub")),
            _in("g__nation", ("sub", "g__refersTo", "sub"), ("sub", "g__refersTo", "obj")),
        ], 3, "false", 2,
    ),
    _run_line(
        "free",
        "select count(*) from triples a join triples b on a.sub = b.sub where a.prop = 'g__refersTo' and a.sub = a.obj",
        ["g__refersTo"],
        [_in("g__refersTo", ("sub", "g__refersTo", "obj"), ("obj", "g__refersTo", "sub"))], 2, "false", 2,
    ),
    _run_line(
        "snowflake",
        """select count(*) from triples a join triples b on a.obj = b.sub join triples s on s.sub = a.sub
join triples d on d.sub = a.sub join triples e on e.sub = d.obj join triples f on f.sub = e.obj
where a.prop = 'g__hasPart' and b.prop = 'g__brand' and s.prop = 'g__status' and s.obj = '"P"'
and d.prop = 'g__placedBy' and e.prop = 'g__nation' and f.prop = 'g__inRegion' and f.obj = 'region/2'""",
        ["g__hasPart", "g__brand", "g__status", "g__placedBy", "g__nation", "g__inRegion"],
        [
            _in("g__hasPart", ("sub", "g__status", "sub"), ("sub", "g__placedBy", "sub"), ("obj", "g__brand", "sub")),
            _in("g__brand", ("sub", "g__hasPart", "obj")),
            _in("g__status", ("sub", "g__hasPart", "sub"), ("sub", "g__placedBy", "sub")),
            _in("g__placedBy", ("sub", "g__hasPart", "sub"), ("sub", "g__status", "sub"), ("obj", "g__nation", "sub")),
            _in("g__nation", ("sub", "g__placedBy", "obj"), ("obj", "g__inRegion", "sub")),
            _in("g__inRegion", ("sub", "g__nation", "obj")),
        ], 3, "false", 6,
    ),
])


@query("run_workload", f"with {TRIPLES}\n{_RUN_SQL}")
def run_workload(spark, folder):
    return t.run_workload(stored_graph(spark, folder), RUN).drop("time_ms")


@query("run_workload_bloom", f"with {TRIPLES}, r as ({_RUN_SQL}) select query, num_results, is_warm from r")
def run_workload_bloom(spark, folder):
    # Bloom reductions may keep more rows, but the answers are the same.
    g = stored_graph(spark, folder)
    kept = Reductions(g, mode="bloom")
    table = t.run_workload(g, RUN, kept).select("query", "num_results", "is_warm")
    kept.release()
    return table
