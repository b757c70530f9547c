"""Queries that answer graph patterns."""

from pyspark.sql import functions as F

import trefoil as t
from trefoil.operators.bgp import bgp, bgp_count, bgp_grouped

from .registry import on_graph, query, stored_graph, TRIPLES, per_property

CHAIN = [("?o", "g__placedBy", "?c"), ("?c", "g__nation", "?n"), ("?n", "g__inRegion", "region/1")]
CYCLE = [
    ("?o", "g__hasSupplier", "?s"), ("?s", "g__nation", "?n"),
    ("?o", "g__placedBy", "?c"), ("?c", "g__nation", "?n"),
]
SNOWFLAKE = [
    ("?o", "g__hasPart", "?p"), ("?p", "g__brand", "?b"), ("?o", "g__status", '"P"'),
    ("?o", "g__placedBy", "?c"), ("?c", "g__nation", "?n"), ("?n", "g__inRegion", "region/2"),
]
SHARED = [("?a", "g__refersTo", "?x"), ("?b", "g__refersTo", "?x")]
# Ten patterns: one order's two neighbourhoods, closed through the supplier's nation.
COMPLEX = [
    ("?o", "rdf__type", "cls__Order"), ("?o", "g__priority", "?pr"), ("?o", "g__hasPart", "?p"),
    ("?p", "g__partType", "?pt"), ("?p", "g__brand", "?b"), ("?o", "g__placedBy", "?c"),
    ("?c", "g__segment", '"BUILDING"'), ("?c", "g__nation", "?n"), ("?o", "g__hasSupplier", "?s"),
    ("?s", "g__nation", "?n"),
]

_CHAIN_SQL = """from triples a join triples b on a.obj = b.sub join triples c on b.obj = c.sub
where a.prop = 'g__placedBy' and b.prop = 'g__nation' and c.prop = 'g__inRegion' and c.obj = 'region/1'"""
_CYCLE_SQL = """from g__hasSupplier a join g__nation b on a.obj = b.sub join g__placedBy c on c.sub = a.sub
join g__nation d on d.sub = c.obj and d.obj = b.obj"""


@on_graph("bgp_chain", f"select a.sub as o, a.obj as c {_CHAIN_SQL}")
def chain(g):
    return bgp(g, CHAIN, select=["?o", "?c"])


@on_graph("bgp_star", """select a.sub as o, a.obj as c, b.obj as s, d.obj as p from triples a
join triples b on a.sub = b.sub join triples d on a.sub = d.sub
where a.prop = 'g__placedBy' and b.prop = 'g__status' and d.prop = 'g__priority'""")
def star(g):
    return bgp(g, [("?o", "g__placedBy", "?c"), ("?o", "g__status", "?s"), ("?o", "g__priority", "?p")])


@on_graph("bgp_linear", per_property("""select b.obj as p, c.obj as t from g__placedBy a join g__hasPart b on a.sub = b.sub
join g__partType c on b.obj = c.sub where a.obj = 'customer/10'"""))
def linear(g):
    # The second pattern joins the first only through the third.
    patterns = [("?o", "g__placedBy", "customer/10"), ("?p", "g__partType", "?t"), ("?o", "g__hasPart", "?p")]
    return bgp(g, patterns, select=["?p", "?t"])


@on_graph("bgp_object_object", """select a.obj as x, count(*) as n from triples a join triples b on a.obj = b.obj
where a.prop = 'g__refersTo' and b.prop = 'g__refersTo' group by 1""")
def object_object(g):
    return bgp_grouped(g, SHARED, ["?x"])


@on_graph("bgp_object_object_rows", """select b.obj as p, b.sub as o from triples a join triples b on a.obj = b.obj
where a.sub = 'order/1' and a.prop = 'g__hasPart' and b.prop = 'g__hasPart'""")
def object_object_rows(g):
    return bgp(g, [("order/1", "g__hasPart", "?p"), ("?o", "g__hasPart", "?p")])


@on_graph("bgp_two_var_cycle", per_property(f"select a.sub as o, a.obj as s, b.obj as n, c.obj as c {_CYCLE_SQL}"))
def cycle(g):
    return bgp(g, CYCLE)


@on_graph("bgp_two_var_pair", """select a.sub as x, a.obj as y from triples a join triples b
on a.sub = b.sub and a.obj = b.obj where a.prop = 'g__refersTo' and b.prop = 'g__refersTo'""")
def two_var_pair(g):
    return bgp(g, [("?x", "g__refersTo", "?y"), ("?x", "g__refersTo", "?y")])


@on_graph("bgp_self_loop", "select sub as c from triples where prop = 'g__refersTo' and sub = obj")
def self_loop(g):
    return bgp(g, [("?c", "g__refersTo", "?c")])


@on_graph("bgp_self_loop_join", """select a.sub as o, a.obj as c from triples a join triples b on a.obj = b.sub
where a.prop = 'g__placedBy' and b.prop = 'g__refersTo' and b.sub = b.obj""")
def self_loop_join(g):
    return bgp(g, [("?o", "g__placedBy", "?c"), ("?c", "g__refersTo", "?c")])


@on_graph("bgp_repeated_property", """select d.sub as c, d.obj as n, e.obj as r
from triples a join triples d on a.sub = d.sub join triples b on b.sub = d.obj join triples e on e.sub = b.sub
join triples f on f.sub = e.obj
where a.prop = 'rdf__type' and a.obj = 'cls__Customer' and b.prop = 'rdf__type' and b.obj = 'cls__Nation'
and f.prop = 'rdf__type' and f.obj = 'cls__Region' and d.prop = 'g__nation' and e.prop = 'g__inRegion'""")
def repeated_property(g):
    return bgp(g, [
        ("?c", "rdf__type", "cls__Customer"), ("?n", "rdf__type", "cls__Nation"), ("?r", "rdf__type", "cls__Region"),
        ("?c", "g__nation", "?n"), ("?n", "g__inRegion", "?r"),
    ])


@on_graph("bgp_snowflake", per_property("""select a.sub as o, a.obj as p, b.obj as b, d.obj as c, e.obj as n
from g__hasPart a join g__brand b on a.obj = b.sub join g__status s on s.sub = a.sub join g__placedBy d on d.sub = a.sub
join g__nation e on e.sub = d.obj join g__inRegion f on f.sub = e.obj
where s.obj = '"P"' and f.obj = 'region/2'"""))
def snowflake(g):
    return bgp(g, SNOWFLAKE)


@on_graph("bgp_complex_count", """select count(*) as n from triples o
join triples pr on pr.sub = o.sub and pr.prop = 'g__priority'
join triples hp on hp.sub = o.sub and hp.prop = 'g__hasPart'
join triples pt on pt.sub = hp.obj and pt.prop = 'g__partType'
join triples b on b.sub = hp.obj and b.prop = 'g__brand'
join triples pb on pb.sub = o.sub and pb.prop = 'g__placedBy'
join triples sg on sg.sub = pb.obj and sg.prop = 'g__segment' and sg.obj = '"BUILDING"'
join triples n on n.sub = pb.obj and n.prop = 'g__nation'
join triples hs on hs.sub = o.sub and hs.prop = 'g__hasSupplier'
join triples sn on sn.sub = hs.obj and sn.prop = 'g__nation' and sn.obj = n.obj
where o.prop = 'rdf__type' and o.obj = 'cls__Order'""")
def complex_count(g):
    return bgp_count(g, COMPLEX)


@on_graph("bgp_cross", """select (select count(*) from triples where prop = 'rdf__type' and obj = 'cls__Region')
* (select count(*) from triples where prop = 'g__segment' and obj = '"BUILDING"') as n""")
def cross(g):
    return bgp_count(g, [("?r", "rdf__type", "cls__Region"), ("?c", "g__segment", '"BUILDING"')], allow_cross=True)


@on_graph("bgp_filter_ne", """select a.obj as x, count(*) as n from triples a join triples b on a.obj = b.obj
where a.prop = 'g__refersTo' and b.prop = 'g__refersTo' and a.sub <> b.sub group by 1""")
def filter_ne(g):
    return bgp_grouped(g, SHARED, ["?x"], filters=[("?a", "!=", "?b")])


@on_graph("bgp_filter_ne_rows", per_property("""select a.sub as o, b.obj as n, d.obj as m
from g__hasSupplier a join g__nation b on a.obj = b.sub join g__placedBy c on c.sub = a.sub
join g__nation d on d.sub = c.obj where b.obj <> d.obj"""))
def filter_ne_rows(g):
    patterns = CYCLE[:3] + [("?c", "g__nation", "?m")]
    return bgp(g, patterns, select=["?o", "?n", "?m"], filters=[("?n", "!=", "?m")])


@on_graph("bgp_distinct", """select distinct b.obj as b, d.obj as n
from triples a join triples b on a.obj = b.sub join triples c on c.sub = a.sub join triples d on d.sub = c.obj
where a.prop = 'g__hasPart' and b.prop = 'g__brand' and c.prop = 'g__placedBy' and d.prop = 'g__nation'""")
def distinct(g):
    patterns = [
        ("?o", "g__hasPart", "?p"), ("?p", "g__brand", "?b"), ("?o", "g__placedBy", "?c"), ("?c", "g__nation", "?n")
    ]
    return bgp(g, patterns, select=["?b", "?n"], distinct=True)


@on_graph("bgp_distinct_filter", """select distinct sa.obj as s, sb.obj as t
from triples a join triples b on a.obj = b.obj join triples sa on sa.sub = a.sub join triples sb on sb.sub = b.sub
where a.prop = 'g__refersTo' and b.prop = 'g__refersTo' and sa.prop = 'g__segment' and sb.prop = 'g__segment'
and a.sub <> b.sub""")
def distinct_filter(g):
    patterns = SHARED + [("?a", "g__segment", "?s"), ("?b", "g__segment", "?t")]
    return bgp(g, patterns, select=["?s", "?t"], distinct=True, filters=[("?a", "!=", "?b")])


@on_graph("bgp_const_subject", "select obj as p from triples where sub = 'order/1' and prop = 'g__hasPart'")
def const_subject(g):
    return bgp(g, [("order/1", "g__hasPart", "?p")])


@on_graph("bgp_const_object", "select sub as c from triples where obj = 'nation/3' and prop = 'g__nation'")
def const_object(g):
    return bgp(g, [("?c", "g__nation", "nation/3")])


@on_graph("bgp_const_both", """select r.sub as r from triples r, triples u where r.prop = 'rdf__type'
and r.obj = 'cls__Region' and u.sub = 'user/8' and u.prop = 'g__did' and u.obj = '"error"'""")
def const_both(g):
    # A pattern without variables repeats every answer by its number of matches.
    return bgp(g, [("user/8", "g__did", '"error"'), ("?r", "rdf__type", "cls__Region")])


@on_graph("bgp_projection", """select c.obj as n from triples a join triples c on a.obj = c.sub
where a.prop = 'g__placedBy' and c.prop = 'g__nation'""")
def projection(g):
    return bgp(g, [("?o", "g__placedBy", "?c"), ("?c", "g__nation", "?n")], select=["?n"])


@on_graph("bgp_count", per_property(f"select count(*) as n {_CYCLE_SQL}"))
def count(g):
    return bgp_count(g, CYCLE)


@on_graph("bgp_count_filter", """select count(*) as n from triples a join triples b on a.obj = b.obj
where a.prop = 'g__placedBy' and b.prop = 'g__placedBy' and a.sub <> b.sub""")
def count_filter(g):
    # Pairs of orders by one customer, counted without listing a pair.
    return bgp_count(g, [("?a", "g__placedBy", "?x"), ("?b", "g__placedBy", "?x")], [("?a", "!=", "?b")])


@query("bgp_ordered", f"with {TRIPLES} select a.sub as o, a.obj as c {_CHAIN_SQL}")
def ordered(spark, folder):
    # On the store, saved statistics order the joins.
    return bgp(stored_graph(spark, folder), CHAIN[::-1], select=["?o", "?c"])


@query("join_order", f"""with {TRIPLES}, counts as (
  select p.pos, p.prop, p.const, (select count(*) from triples t where t.prop = p.prop) as n
  from (values (0, 'g__placedBy', 1), (1, 'g__nation', 1), (2, 'g__inRegion', 0)) p(pos, prop, const))
select cast(row_number() over (order by const, n, pos) - 1 as int) as place, prop, n from counts""")
def order(spark, folder):
    # For the chain, the order is by constant, then size; it happens to stay connected.
    g = stored_graph(spark, folder)
    counts = g.counts([p for _, p, _ in CHAIN])
    places = {CHAIN[i][1]: place for place, i in enumerate(t.join_order(CHAIN, counts))}
    place = F.coalesce(*[F.when(F.col("prop") == p, F.lit(i)) for p, i in places.items()])
    return g.stats.where(F.col("prop").isin(list(places))).select(place.alias("place"), "prop", "n")


# --- free properties ---------------------------------------------------------------------


@on_graph("unbound_sUo", "select prop as p from triples where sub = 'customer/10' and obj = 'customer/10'")
def s_u_o(g):
    return bgp(g, [("customer/10", "?p", "customer/10")])


@on_graph("unbound_sUU", "select prop as p, obj as o from triples where sub = 'customer/10'")
def s_u_u(g):
    return bgp(g, [("customer/10", "?p", "?o")])


@on_graph("unbound_UUo", "select sub as s, prop as p from triples where obj = 'nation/3'")
def u_u_o(g):
    return bgp(g, [("?s", "?p", "nation/3")])


@on_graph("unbound_UUU", "select sub as s, prop as p, obj as o from triples")
def u_u_u(g):
    return bgp(g, [("?s", "?p", "?o")])


@query("unbound_pruned", f"with {TRIPLES} select sub as s, prop as p from triples where obj = 'nation/3'")
def pruned(spark, folder):
    # Bloom candidates on the store; false positives vanish with the constant filter.
    return bgp(stored_graph(spark, folder), [("?s", "?p", "nation/3")], candidates="bloom")


@on_graph("unbound_join", """select a.prop as p, a.obj as n, b.sub as c, d.sub as o
from triples a join triples b on a.obj = b.obj join triples d on d.obj = b.sub join triples e on e.sub = d.sub
where a.sub = 'supplier/1' and b.prop = 'g__nation' and d.prop = 'g__placedBy' and e.prop = 'g__status'
and e.obj = '"O"'""")
def unbound_join(g):
    return bgp(g, [
        ("supplier/1", "?p", "?n"), ("?c", "g__nation", "?n"), ("?o", "g__placedBy", "?c"), ("?o", "g__status", '"O"'),
    ], select=["?p", "?n", "?c", "?o"])


@query("unbound_join_candidates", f"""with {TRIPLES} select sub as c, prop as p, obj as x from triples
where sub in (select 'customer/' || c_custkey from customer where c_custkey % 10 = 0)""")
def unbound_join_candidates(spark, folder):
    g = stored_graph(spark, folder)
    return bgp(g, [("?c", "g__refersTo", "?c"), ("?c", "?p", "?x")], candidates="exact")


@on_graph("unbound_double", """select a.prop as p, b.prop as q, count(*) as n from triples a
join triples b on a.obj = b.sub where a.sub = 'order/1' group by 1, 2""")
def double(g):
    return bgp_grouped(g, [("order/1", "?p", "?x"), ("?x", "?q", "?y")], ["?p", "?q"])


@on_graph("unbound_property_pairs", """select a.prop as p, b.prop as q, count(*) as n
from triples a join triples b on a.obj = b.sub group by 1, 2""")
def property_pairs(g):
    # Both properties free and no constant: which properties form paths, and how many.
    return bgp_grouped(g, [("?s", "?p", "?x"), ("?x", "?q", "?y")], ["?p", "?q"])


@on_graph("unbound_property_as_node", """select a.sub as s, b.prop as q, count(*) as n from triples a
join triples b on a.prop = b.prop where a.sub = 'nation/3' group by 1, 2""")
def property_as_node(g):
    # One variable for two properties.
    return bgp_grouped(g, [("nation/3", "?q", "?y"), ("?z", "?q", "?w")], ["?q"]).select(
        F.lit("nation/3").alias("s"), "q", "n"
    )


# Two-pattern joins by position of the shared variable and by which ends and properties are free:
# A both other ends constant, B one, C none; D, E1, E2, F the same with the second property free;
# G and H with both properties free. Counts, so that no class lists pairs.
_JOIN_CLASSES = {
    "ss_a": ([("?x", "g__status", '"P"'), ("?x", "g__priority", '"5-LOW"')], "a.sub = b.sub", "a.prop = 'g__status' and a.obj = '\"P\"' and b.prop = 'g__priority' and b.obj = '\"5-LOW\"'"),
    "ss_c": ([("?x", "g__hasPart", "?y"), ("?x", "g__hasSupplier", "?z")], "a.sub = b.sub", "a.prop = 'g__hasPart' and b.prop = 'g__hasSupplier'"),
    "ss_d": ([("?x", "g__status", '"P"'), ("?x", "?p", '"5-LOW"')], "a.sub = b.sub", "a.prop = 'g__status' and a.obj = '\"P\"' and b.obj = '\"5-LOW\"'"),
    "ss_f": ([("?x", "g__placedBy", "?y"), ("?x", "?p", "?z")], "a.sub = b.sub", "a.prop = 'g__placedBy'"),
    "ss_h": ([("?x", "?p", "?y"), ("?x", "?q", '"5-LOW"')], "a.sub = b.sub", "b.obj = '\"5-LOW\"'"),
    "so_b": ([("?x", "g__placedBy", "?y"), ("?y", "g__segment", '"BUILDING"')], "a.obj = b.sub", "a.prop = 'g__placedBy' and b.prop = 'g__segment' and b.obj = '\"BUILDING\"'"),
    "so_e": ([("?x", "g__placedBy", "?y"), ("?y", "?p", "nation/3")], "a.obj = b.sub", "a.prop = 'g__placedBy' and b.obj = 'nation/3'"),
    "so_f": ([("?x", "g__placedBy", "?y"), ("?y", "?p", "?z")], "a.obj = b.sub", "a.prop = 'g__placedBy'"),
    "so_g": ([("order/1", "?p", "?y"), ("?y", "?q", "nation/3")], "a.obj = b.sub", "a.sub = 'order/1' and b.obj = 'nation/3'"),
    "so_h": ([("?x", "?p", "?y"), ("?y", "?q", "nation/3")], "a.obj = b.sub", "b.obj = 'nation/3'"),
    "oo_a": ([("order/1", "g__hasSupplier", "?y"), ("order/2", "g__hasSupplier", "?y")], "a.obj = b.obj", "a.prop = 'g__hasSupplier' and a.sub = 'order/1' and b.prop = 'g__hasSupplier' and b.sub = 'order/2'"),
    "oo_c": ([("?x", "g__hasPart", "?y"), ("?z", "g__hasPart", "?y")], "a.obj = b.obj", "a.prop = 'g__hasPart' and b.prop = 'g__hasPart'"),
    "oo_d": ([("customer/10", "g__nation", "?y"), ("supplier/1", "?p", "?y")], "a.obj = b.obj", "a.prop = 'g__nation' and a.sub = 'customer/10' and b.sub = 'supplier/1'"),
    "oo_e": ([("customer/10", "g__nation", "?y"), ("?z", "?p", "?y")], "a.obj = b.obj", "a.prop = 'g__nation' and a.sub = 'customer/10'"),
    "oo_f": ([("?x", "g__segment", "?y"), ("?z", "?p", "?y")], "a.obj = b.obj", "a.prop = 'g__segment'"),
    "oo_g": ([("customer/10", "?p", "?y"), ("customer/11", "?q", "?y")], "a.obj = b.obj", "a.sub = 'customer/10' and b.sub = 'customer/11'"),
}


def _join_class(patterns):
    return lambda g: bgp_count(g, patterns)


for _name, (_patterns, _on, _where) in _JOIN_CLASSES.items():
    on_graph(f"join_class_{_name}", f"select count(*) as n from triples a join triples b on {_on} where {_where}")(
        _join_class(_patterns)
    )


@on_graph("candidate_props_const", """select prop from triples where sub = 'customer/10'
intersect select prop from triples where obj = 'customer/10'""")
def candidate_props_const(g):
    return t.candidate_properties(g, s="customer/10", o="customer/10")


@query("candidate_props_bloom_verified", f"""with {TRIPLES}
select prop, count(*) as n from triples where obj = 'customer/10' group by 1""")
def candidate_props_bloom(spark, folder):
    g = stored_graph(spark, folder)
    return t.verified_properties(g, "?s", "customer/10", t.candidate_properties(g, o="customer/10", mode="bloom"))


@on_graph("candidate_props_join", """select distinct prop from triples
where sub in (select obj from triples where prop = 'g__placedBy')""")
def candidate_props_join(g):
    return t.candidate_properties_by_join(g, g.prop("g__placedBy").select("obj"), "sub")


@query("candidate_props_join_bloom_missed", f"""with {TRIPLES}
select prop from triples where false""")
def candidate_props_join_bloom(spark, folder):
    # Bloom candidates may be too many, never too few: exact ones less Bloom ones is empty.
    g = stored_graph(spark, folder)
    values = g.prop("g__inRegion").select("obj")
    exact = t.candidate_properties_by_join(g, values, "sub")
    return exact.join(t.candidate_properties_by_join(g, values, "sub", mode="bloom"), "prop", "left_anti")


@on_graph("union_properties", "select sub, prop, obj from triples where prop in ('g__nation', 'g__inRegion', 'g__refersTo')")
def union_properties(g):
    return t.union_properties(g, ["g__nation", "g__inRegion", "g__refersTo"])


@on_graph("intersect_candidates", """select prop from triples where obj = 'nation/3' intersect
select prop from triples where sub = 'supplier/1'""")
def intersect_candidates(g):
    return t.intersect_candidates(t.candidate_properties(g, o="nation/3"), t.candidate_properties(g, s="supplier/1"))


@on_graph("exclude_table", """select sub, prop, obj from triples where sub not in (select obj from triples where prop = 'g__placedBy')
and prop in ('g__segment', 'g__nation')""")
def exclude_table(g):
    # The listed values are a table: customers without an order, and what is no customer.
    rows = t.union_properties(g, ["g__segment", "g__nation"])
    return t.exclude(rows, "sub", g.prop("g__placedBy").select("obj"))


@on_graph("exclude_properties", """select prop, count(*) as n from triples
where prop not in ('g__hasPart', 'rdf__type') group by 1""")
def exclude_properties(g):
    return t.exclude(g.triples, "prop", ["g__hasPart", "rdf__type"]).groupBy("prop").agg(F.count(F.lit(1)).alias("n"))
