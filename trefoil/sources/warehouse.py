"""A star-schema warehouse (customers, orders, parts, ...) seen as a graph.

Every mapping below is a projection of one table, so a query for one property
reads only the tables and columns behind it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.graph import Graph

# Namespaces of the warehouse graph; the second begins with the first.
PREFIXES = [
    ("g", "http://graph.example/"),
    ("cls", "http://graph.example/class/"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string"))


def literal(column: str) -> Column:
    return F.concat(F.lit('"'), F.col(column), F.lit('"'))


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """All triples of the warehouse, as a bag."""
    read = lambda name: table(spark, folder, name)
    edge = lambda rows, sub, prop, obj: rows.select(sub.alias("sub"), F.lit(prop).alias("prop"), obj.alias("obj"))

    region, nation, customer = read("region"), read("nation"), read("customer")
    supplier, part, orders = read("supplier"), read("part"), read("orders")
    lineitem, events = read("lineitem"), read("events")
    tenth = F.col("c_custkey") - F.col("c_custkey") % 10
    edges = [
        edge(customer, node("customer", "c_custkey"), "rdf__type", F.lit("cls__Customer")),
        edge(supplier, node("supplier", "s_suppkey"), "rdf__type", F.lit("cls__Supplier")),
        edge(part, node("part", "p_partkey"), "rdf__type", F.lit("cls__Part")),
        edge(orders, node("order", "o_orderkey"), "rdf__type", F.lit("cls__Order")),
        edge(nation, node("nation", "n_nationkey"), "rdf__type", F.lit("cls__Nation")),
        edge(region, node("region", "r_regionkey"), "rdf__type", F.lit("cls__Region")),
        edge(nation, node("nation", "n_nationkey"), "g__name", literal("n_name")),
        edge(region, node("region", "r_regionkey"), "g__name", literal("r_name")),
        edge(nation, node("nation", "n_nationkey"), "g__inRegion", node("region", "n_regionkey")),
        edge(customer, node("customer", "c_custkey"), "g__nation", node("nation", "c_nationkey")),
        edge(supplier, node("supplier", "s_suppkey"), "g__nation", node("nation", "s_nationkey")),
        edge(customer, node("customer", "c_custkey"), "g__segment", literal("c_mktsegment")),
        edge(customer, node("customer", "c_custkey"), "g__refersTo", node("customer", tenth)),
        edge(orders, node("order", "o_orderkey"), "g__placedBy", node("customer", "o_custkey")),
        edge(orders, node("order", "o_orderkey"), "g__status", literal("o_orderstatus")),
        edge(orders, node("order", "o_orderkey"), "g__priority", literal("o_orderpriority")),
        edge(lineitem, node("order", "l_orderkey"), "g__hasPart", node("part", "l_partkey")),
        edge(lineitem, node("order", "l_orderkey"), "g__hasSupplier", node("supplier", "l_suppkey")),
        edge(part, node("part", "p_partkey"), "g__brand", literal("p_brand")),
        edge(part, node("part", "p_partkey"), "g__partType", literal("p_type")),
        edge(events, node("user", "user_id"), "g__did", literal("event_type")),
    ]
    return reduce(DataFrame.unionByName, edges)


# Lines of one task of a workload; the aggregates of its queries take a few hundred bytes for each.
TASK_LINES = 200_000


def graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(triples(spark, folder))


def triple_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The triples as tab-separated text lines (``value``)."""
    from ..functions.terms import expand_iri, is_literal

    def render(c):
        return F.when(is_literal(c), F.col(c)).otherwise(expand_iri(c, PREFIXES, brackets=True))

    return triples(spark, folder).select(
        F.concat(F.concat_ws("\t", render("sub"), render("prop"), render("obj")), F.lit(" .")).alias("value")
    )


def workload(spark: SparkSession, folder: str) -> DataFrame:
    """One query per order: a pattern per distinct (line number, part).

    The property is the part's brand, one end is the order's variable ``?v0``,
    the other the variable of a supplier; odd lines have ``?v0`` as subject.
    Rows are ``(query_id, query_seq, pos, s, p, o)``, dealt by ``query_id`` over as
    many partitions as the number of lines asks for, so that a task holds the same
    whatever the input. Aggregates by query follow without another shuffle.
    """
    lineitem = table(spark, folder, "lineitem")
    partitions = max(spark.sparkContext.defaultParallelism, math.ceil(lineitem.count() / TASK_LINES))
    query = (F.col("l_orderkey") + 1).alias("query_id")
    lines = lineitem.select(query, "l_linenumber", "l_partkey", "l_suppkey").repartition(partitions, "query_id")
    lines = lines.groupBy("query_id", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    brand = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    centre, leaf = F.lit("?v0"), F.concat(F.lit("?s"), F.col("l_suppkey").cast("string"))
    odd = F.col("l_linenumber") % 2 == 1
    # Spark leaves the second deal out unless the join has moved the rows by part.
    return lines.join(brand, "l_partkey").repartition(partitions, "query_id").select(
        "query_id",
        F.col("query_id").alias("query_seq"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.when(odd, centre).otherwise(leaf).alias("s"),
        F.col("p_brand").alias("p"),
        F.when(odd, leaf).otherwise(centre).alias("o"),
    )


# Texts of the query log, by order priority: one text per first character.
_PREFIX = "PREFIX g: <http://graph.example/> "
QUERY_TEXTS = {
    "1": _PREFIX + "SELECT ?p WHERE { <order/%1$s> g:hasPart ?p . ?p g:brand ?b . }",
    "2": _PREFIX + "SELECT * WHERE { ?o g:placedBy <customer/%2$s> . ?o g:status \"%3$s\" }",
    "3": _PREFIX + "SELECT DISTINCT ?s WHERE { <order/%1$s> g:hasSupplier ?s . ?s g:nation ?n . ?n g:inRegion ?r . }",
    "4": _PREFIX + "SELECT ?c ?n WHERE { <order/%1$s> <http://graph.example/placedBy> ?c . ?c ?q ?c . ?c g:nation ?n . }",
    "5": "BASE <http://graph.example/> SELECT ?a ?b WHERE { ?a <refersTo> ?x . ?b <refersTo> ?x FILTER (?a != ?b) }",
}


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, query_seq, query)``: one query text per order."""
    priority = F.substring("o_orderpriority", 1, 1)
    text = F.lit("")
    for first, form in QUERY_TEXTS.items():
        filled = F.format_string(form, "o_orderkey", "o_custkey", "o_orderstatus")
        text = F.when(priority == first, filled).otherwise(text)
    query = (F.col("o_orderkey") + 1).alias("query_id")
    return table(spark, folder, "orders").select(query, query.alias("query_seq"), text.alias("query"))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run table with one row per event."""
    user = F.col("user_id")
    return table(spark, folder, "events").select(
        (F.col("event_id") + 1).alias("query_id"),
        F.concat((F.col("event_id") + 1).cast("string"), F.lit("__VP_SO-OS-SS-VP")).alias("query"),
        (user * 3).alias("num_results"),
        F.col("value").alias("time_ms"),
        (user * 100).alias("table_sizes"),
        (user * 10).alias("reduction_sizes"),
        (user % 5 + 1).cast("int").alias("max_joins"),
        (F.col("event_type") != "error").alias("is_warm"),
        (user % 12 + 1).cast("int").alias("num_triples"),
    )


def other_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, time_ms)`` of a second system, one row per order."""
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 1).alias("query_id"), F.col("o_totalprice").alias("time_ms")
    )
