"""Registered queries, each with the SQL that states its expected answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trefoil import Graph
from trefoil.sources import warehouse
from trefoil.sources.shared import new_path

QUERIES = {}
SQL = {}

# The warehouse graph in SQL; every registered statement may start from it.
TRIPLES = """
triples(sub, prop, obj) as (
  select 'customer/' || c_custkey, 'rdf__type', 'cls__Customer' from customer
  union all select 'supplier/' || s_suppkey, 'rdf__type', 'cls__Supplier' from supplier
  union all select 'part/' || p_partkey, 'rdf__type', 'cls__Part' from part
  union all select 'order/' || o_orderkey, 'rdf__type', 'cls__Order' from orders
  union all select 'nation/' || n_nationkey, 'rdf__type', 'cls__Nation' from nation
  union all select 'region/' || r_regionkey, 'rdf__type', 'cls__Region' from region
  union all select 'nation/' || n_nationkey, 'g__name', '"' || n_name || '"' from nation
  union all select 'region/' || r_regionkey, 'g__name', '"' || r_name || '"' from region
  union all select 'nation/' || n_nationkey, 'g__inRegion', 'region/' || n_regionkey from nation
  union all select 'customer/' || c_custkey, 'g__nation', 'nation/' || c_nationkey from customer
  union all select 'supplier/' || s_suppkey, 'g__nation', 'nation/' || s_nationkey from supplier
  union all select 'customer/' || c_custkey, 'g__segment', '"' || c_mktsegment || '"' from customer
  union all select 'customer/' || c_custkey, 'g__refersTo', 'customer/' || (c_custkey - c_custkey % 10) from customer
  union all select 'order/' || o_orderkey, 'g__placedBy', 'customer/' || o_custkey from orders
  union all select 'order/' || o_orderkey, 'g__status', '"' || o_orderstatus || '"' from orders
  union all select 'order/' || o_orderkey, 'g__priority', '"' || o_orderpriority || '"' from orders
  union all select 'order/' || l_orderkey, 'g__hasPart', 'part/' || l_partkey from lineitem
  union all select 'order/' || l_orderkey, 'g__hasSupplier', 'supplier/' || l_suppkey from lineitem
  union all select 'part/' || p_partkey, 'g__brand', '"' || p_brand || '"' from part
  union all select 'part/' || p_partkey, 'g__partType', '"' || p_type || '"' from part
  union all select 'user/' || user_id, 'g__did', '"' || event_type || '"' from events
)"""

# Each property as a table of its own, from the base table; ``per_property`` puts in those that a statement names.
PROPERTIES = {
    "g__inRegion": "select 'nation/' || n_nationkey, 'region/' || n_regionkey from nation",
    "g__nation": "select 'customer/' || c_custkey, 'nation/' || c_nationkey from customer "
    "union all select 'supplier/' || s_suppkey, 'nation/' || s_nationkey from supplier",
    "g__refersTo": "select 'customer/' || c_custkey, 'customer/' || (c_custkey - c_custkey % 10) from customer",
    "g__placedBy": "select 'order/' || o_orderkey, 'customer/' || o_custkey from orders",
    "g__status": """select 'order/' || o_orderkey, '"' || o_orderstatus || '"' from orders""",
    "g__hasPart": "select 'order/' || l_orderkey, 'part/' || l_partkey from lineitem",
    "g__hasSupplier": "select 'order/' || l_orderkey, 'supplier/' || l_suppkey from lineitem",
    "g__brand": """select 'part/' || p_partkey, '"' || p_brand || '"' from part""",
    "g__partType": """select 'part/' || p_partkey, '"' || p_type || '"' from part""",
}


def per_property(sql: str) -> str:
    """A statement over tables named like properties, each ``(sub, obj)``."""
    named = [f"{p}(sub, obj) as ({select})" for p, select in PROPERTIES.items() if p in sql]
    return f"with {', '.join(named)}\n{sql}"


WORKLOAD = """
wl(query_id, query_seq, pos, s, p, o) as (
  select l_orderkey + 1, l_orderkey + 1, l_partkey * 8 + l_linenumber,
    case when l_linenumber % 2 = 1 then '?v0' else '?s' || supp end, p_brand,
    case when l_linenumber % 2 = 1 then '?s' || supp else '?v0' end
  from (select l_orderkey, l_linenumber, l_partkey, min(l_suppkey) supp from lineitem group by 1, 2, 3) l
  join part on p_partkey = l_partkey
),
ends(query_id, query_seq, var, pos, prop, side) as (
  select query_id, query_seq, s, pos, p, 'sub' from wl union all select query_id, query_seq, o, pos, p, 'obj' from wl
),
labels as (
  select query_id, query_seq, var, prop, side,
    prop || case side when 'sub' then '_TRPS' else '_TRPO' end as label, count(*) as uses
  from ends group by 1, 2, 3, 4, 5
),
sigs as (
  select a.query_id, a.query_seq, a.var, a.prop, a.side, a.label,
    a.label || '_JOIN_' || string_agg(b.label, '_JOIN_' order by b.label) as sig
  from labels a join labels b on a.query_id = b.query_id and a.var = b.var and (a.label <> b.label or a.uses > 1)
  group by 1, 2, 3, 4, 5, 6
)"""

RUNS = """
runs as (
  select event_id + 1 as query_id, value as time_ms, user_id % 5 + 1 as max_joins,
    event_type <> 'error' as is_warm, user_id % 12 + 1 as num_triples
  from events
),
other as (select o_orderkey + 1 as query_id, o_totalprice as time_ms from orders)"""


def query(name: str, sql: str | None = None):
    """Register ``f(spark, folder) -> DataFrame`` under a name."""
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f
    return register


def on_graph(name: str, sql: str):
    """Register ``f(graph) -> DataFrame``; its SQL reads ``triples``, or has its own tables."""
    def register(f):
        query(name, sql if sql.startswith("with ") else f"with {TRIPLES}\n{sql}")(lambda spark, folder: f(graph(spark, folder)))
        return f
    return register


_graphs: dict = {}


def _once(kind: str, spark: SparkSession, folder: str, make):
    key = (kind, spark.sparkContext.applicationId, folder)
    if key not in _graphs:
        _graphs[key] = make()
    return _graphs[key]


def graph(spark: SparkSession, folder: str) -> Graph:
    """The warehouse as a view: every query reads the tables themselves."""
    return _once("view", spark, folder, lambda: warehouse.graph(spark, folder))


def stored_graph(spark: SparkSession, folder: str) -> Graph:
    """The same graph saved as a store with statistics and Bloom filters."""
    return _once(
        "store", spark, folder, lambda: warehouse.graph(spark, folder).save(new_path(spark, "graph"), fpp=0.01)
    )


def written_text(df: DataFrame, name: str, *order: str) -> str:
    """Folder of text files with the ``value`` column, lines in the given order."""
    path = new_path(df.sparkSession, name)
    (df.orderBy(*order) if order else df).select("value").write.text(path)
    return path
