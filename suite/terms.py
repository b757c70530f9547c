"""Queries over terms: names, literals, query texts of triples."""

from pyspark.sql import functions as F

from trefoil import functions as tf
from trefoil.sources import warehouse

from .registry import TRIPLES, graph, query

_DISTINCT = f"with {TRIPLES}, terms as (select sub as term from triples union select prop from triples union select obj from triples)"
_FULL = """case when term like 'rdf\\_\\_%' escape '\\' then 'http://www.w3.org/1999/02/22-rdf-syntax-ns#' || substr(term, 6)
  when term like 'cls\\_\\_%' escape '\\' then 'http://graph.example/class/' || substr(term, 6)
  when term like 'g\\_\\_%' escape '\\' then 'http://graph.example/' || substr(term, 4) else term end"""


def _terms(spark, folder):
    triples = graph(spark, folder).triples
    return triples.select(F.explode(F.array("sub", "prop", "obj")).alias("term")).distinct()


@query("expand_iri", f"{_DISTINCT} select term, {_FULL} as iri from terms")
def expand_iri(spark, folder):
    return _terms(spark, folder).select("term", tf.expand_iri("term", warehouse.PREFIXES).alias("iri"))


@query("compress_iri", f"{_DISTINCT} select '<' || {_FULL} || '>' as iri, term from terms where term not like '\"%' "
       "union all select term, term from terms where term like '\"%'")
def compress_iri(spark, folder):
    iris = _terms(spark, folder).select(tf.expand_iri("term", warehouse.PREFIXES, brackets=True).alias("iri"))
    return iris.select("iri", tf.compress_iri("iri", warehouse.PREFIXES).alias("term"))


@query("resolve_iri", f"""{_DISTINCT} select term, case when term like '"%' then term
  else 'http://base.example/' || term end as iri from terms""")
def resolve_iri(spark, folder):
    return _terms(spark, folder).select("term", tf.resolve_iri("term", "http://base.example/").alias("iri"))


@query("term_kinds", f"""{_DISTINCT} select term like '"%' as is_literal, term not like '"%' as is_iri, count(*) as n
from terms group by 1, 2""")
def term_kinds(spark, folder):
    kinds = _terms(spark, folder).select(tf.is_literal("term").alias("is_literal"), tf.is_iri("term").alias("is_iri"))
    return kinds.groupBy("is_literal", "is_iri").agg(F.count(F.lit(1)).alias("n"))


@query("unbound_query_text", f"""with {TRIPLES}, p as (select '<' || sub || '>' as s, '<' || obj || '>' as o from triples
  where prop = 'g__placedBy')
select 'SELECT ?predicate WHERE {{ ' || s || ' ?predicate ' || o || ' }}' as s_u_o,
  'SELECT ?subject ?predicate WHERE {{ ?subject ?predicate ' || o || ' }}' as u_u_o,
  'SELECT ?predicate ?object WHERE {{ ' || s || ' ?predicate ?object }}' as s_u_u from p""")
def unbound_query_text(spark, folder):
    ends = graph(spark, folder).prop("g__placedBy").select(
        *[tf.expand_iri(c, warehouse.PREFIXES, brackets=True).alias(c) for c in ("sub", "obj")]
    )
    return ends.select(
        tf.unbound_query_text("sub", "obj", "sUo").alias("s_u_o"),
        tf.unbound_query_text("sub", "obj", "UUo").alias("u_u_o"),
        tf.unbound_query_text("sub", "obj", "sUU").alias("s_u_u"),
    )


@query("query_names", """select (event_id + 1) || '__VP_SO-OS-SS-VP.sparql' as file, cast(event_id + 1 as varchar) as name,
event_id // 100 + 1 as query_class from events""")
def query_names(spark, folder):
    files = warehouse.runs(spark, folder).select("query_id", F.concat("query", F.lit(".sparql")).alias("file"))
    return files.select("file", tf.query_name("file").alias("name"), tf.query_class("query_id").alias("query_class"))
