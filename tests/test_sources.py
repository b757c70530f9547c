"""Files in and out, terms, stores."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import trefoil as t
from trefoil import Graph, functions as tf
from trefoil.functions.prefixes import LUBM, WATDIV, YAGO, read_prefixes
from trefoil.operators.numbering import global_rank, repeat_rows

PREFIXES = [("g", "http://x.org/"), ("c", "http://x.org/class/"), ("d", "http://x.org/a$b\\c#")]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f("v")).collect()]


def test_terms(spark):
    terms = ["<http://x.org/class/A>", "http://x.org/b", "<rel>", '"http://x.org/b"', '"<a>"@en', "<http://y.org/http://x.org/>", "<http://x.org/a$b\\c#z>"]
    short = ["c__A", "g__b", "rel", '"http://x.org/b"', '"<a>"@en', "http://y.org/http://x.org/", "d__z"]
    assert column(spark, terms, lambda v: tf.compress_iri(v, PREFIXES)) == short
    assert column(spark, ["c__A", "d__z", "z__y", '"g__x"', "?g__v"], lambda v: tf.expand_iri(v, PREFIXES, brackets=True)) == [
        "<http://x.org/class/A>", "<http://x.org/a$b\\c#z>", "<z__y>", '"g__x"', "?g__v"
    ]
    assert column(spark, ["<a>", "a", "http://h/b", '"a"', "?v"], lambda v: tf.resolve_iri(v, "http://b/")) == [
        "<http://b/a>", "http://b/a", "http://h/b", '"a"', "?v"
    ]
    assert column(spark, ['"1"^^<t>', "?x", "a"], lambda v: F.struct(tf.is_literal(v), tf.is_variable(v), tf.is_iri(v))) == [
        (True, False, False), (False, True, False), (False, False, True)
    ]


def test_long_prefix_lists(spark):
    terms = [f"<{ns}x>" for _, ns in WATDIV]
    assert column(spark, terms, lambda v: tf.compress_iri(v, WATDIV)) == [f"{s}__x" for s, _ in WATDIV]
    assert len(LUBM) == 4 and len(YAGO) == 9


def test_prefix_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("g\thttp://x.org/\nc\thttp://x.org/class/\n")
    assert read_prefixes(spark, str(tmp_path / "p.txt")) == [("g", "http://x.org/"), ("c", "http://x.org/class/")]


def test_signatures(spark):
    df = spark.createDataFrame([("p_1", ["r_TRPO", "q__x_TRPS"])], "p string, partners array<string>")
    sig = tf.signature(tf.label("p", "obj"), "partners")
    row = df.select(sig.alias("s"), tf.split_signature(sig).alias("parts")).first()
    assert row["s"] == "p_1_TRPO_JOIN_q__x_TRPS_JOIN_r_TRPO"
    assert [tuple(x) for x in row["parts"]] == [("p_1", "obj"), ("q__x", "sub"), ("r", "obj")]
    assert tf.signature_parts(row["s"]) == [("p_1", "obj"), ("q__x", "sub"), ("r", "obj")]
    assert tf.signature_text(("p_1", "obj"), [("r", "obj"), ("q__x", "sub")]) == row["s"]


def test_query_text(spark):
    text = "SELECT * WHERE { ?a <p> ?b . ?b <q> ?a . }"
    assert column(spark, [text], tf.query_variables) == [["?a", "?b"]]
    assert column(spark, [text], tf.expand_star) == [text.replace("*", "?a ?b")]
    assert column(spark, ["12__VP_SO-OS-SS-VP.sparql", "Q2.x.y"], tf.query_name) == ["12", "Q2"]
    ids = spark.createDataFrame([(1,), (100,), (101,)], "i long").select(tf.query_class("i")).collect()
    assert [r[0] for r in ids] == [1, 1, 2]


@pytest.mark.parametrize("sep,name", [(" ", "space"), ("\t", "tab"), ("||", "bars")])
def test_triple_text(spark, tmp_path, sep, name):
    lines = [
        sep.join(["<http://x.org/s>", "<http://x.org/p>", "<o>"]) + " .",
        sep.join(["s", "p", '"two words"']) + " .",
        sep.join(["s", "p", '"no dot"']),
        sep.join(["s", "p", '"ends."']) + ".",
        sep.join(["s", "p", "<http://x.org/v1.5>"]),
        sep.join(["s", "p", '"a', 'b"@en']) + " . ",
        sep.join(["s", "p"]) + " .",
        "",
    ]
    (tmp_path / "t.nt").write_text("\n".join(lines) + "\n")
    got = Counter(map(tuple, t.read_triples(spark, str(tmp_path), sep, PREFIXES).collect()))
    assert got == Counter([
        ("g__s", "g__p", "o"), ("s", "p", '"two words"'), ("s", "p", '"no dot"'), ("s", "p", '"ends."'),
        ("s", "p", "g__v1.5"), ("s", "p", '"a b"@en'),
    ])


def test_clean(spark):
    lines = [
        "# c", "@base <x>", "<http://x.org/a>\t<p>\t<o> .", "<a>\trdf:type\tx:y .", '<a>\t<p>\t"12:30"^^xsd:time .',
        '<a>\t<p>\t"see: this"@en\t.', "<a>\t<p>", "<a>\t<p>\t<o>\t<extra> .", '<a>\t<p>\t"x"^^<http://x.org/t> .',
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert Counter(map(tuple, t.clean_triples(df, PREFIXES, "kb").collect())) == Counter([
        ("g__a", "kb__p", "kb__o"), ("kb__a", "rdf__type", "x__y"), ("kb__a", "kb__p", '"12:30"^^xsd__time'),
        ("kb__a", "kb__p", '"see: this"@en'), ("kb__a", "kb__p", '"x"^^<http://x.org/t>'),
    ])


def test_store_spreads_a_hot_property(spark, tmp_path):
    hot = spark.range(4000, numPartitions=4).select(
        F.lit("s").alias("sub"), F.lit("a/b:c").alias("prop"), F.lit("same").alias("obj")
    )
    rare = spark.createDataFrame([("s", "7", "o")], "sub string, prop string, obj string")
    path = str(tmp_path / "vp")
    t.write_vp(hot.unionByName(rare), path, partitions=8)
    back = t.read_vp(spark, path)
    assert back.count() == 4001 and back.schema.simpleString() == "struct<sub:string,prop:string,obj:string>"
    # Even copies of one triple are written by several tasks.
    assert len({r[0] for r in back.where("prop = 'a/b:c'").select(F.input_file_name()).distinct().collect()}) > 1
    plan = Graph(back).prop("7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prop" in plan


def test_compact(spark, social):
    rows = {r["sub"]: r["tweet"] for r in t.compact_property(social, "tweet", max_items=1000).collect()}
    assert rows == {"Ann": ['"t1"', '"t1"'], "Bob": ['"t2"@en']}
    big = Graph(spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sub"),
        F.lit("p").alias("prop"), F.col("id").cast("string").alias("obj"),
    ))
    parts = t.compact_property(big, "p", max_items=100).where("sub = 'hot'").collect()
    assert [len(r["p"]) for r in parts] == [100] * 5
    # Parts in order are the one sorted array.
    joined = [v for r in sorted(parts, key=lambda r: r["part"]) for v in r["p"]]
    assert joined == sorted(str(v) for v in range(0, 1000, 2))


def test_line_numbers_cross_splits_and_files(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (folder / "a.txt").write_text("\n".join(lines[:4000]) + "\n")
    (folder / "b.txt").write_text("\n".join(lines[4000:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r["line"]: r["value"] for r in t.numbered_lines(spark, str(folder)).collect()}
        assert got == {i + 1: v for i, v in enumerate(lines)}
        paired = t.zip_lines(spark, str(folder), str(folder / "a.txt")).collect()
        assert len(paired) == 4000 and all(r["left"] == r["right"] for r in paired)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_numbers_without_broadcast(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    lines = [f"{i} {'y' * (i % 30)}" for i in range(3000)]
    for k in range(30):
        (folder / f"{k:02}.txt").write_text("\n".join(lines[100 * k : 100 * (k + 1)]) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        numbered = t.numbered_lines(spark, str(folder))
        assert "Broadcast" not in numbered._jdf.queryExecution().toString()
        assert {r["line"]: r["value"] for r in numbered.collect()} == {i + 1: v for i, v in enumerate(lines)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_query_logs(spark, tmp_path):
    folder = tmp_path / "queries"
    folder.mkdir()
    (folder / "2__x.sparql").write_text("SELECT ?a\nWHERE { ?a <p> ?b }")
    (folder / "1__x.in").write_text("SELECT ?b WHERE { ?a <q> ?b }\n")
    got = [tuple(r) for r in t.read_query_log(spark, str(folder)).orderBy("query_name").collect()]
    assert got == [("1__x", "SELECT ?b WHERE { ?a <q> ?b }\n"), ("2__x", "SELECT ?a\nWHERE { ?a <p> ?b }")]
    (tmp_path / "log").write_text("first\nline\n#EOQ#\nsecond\n#EOQ#\n")
    got = [tuple(r) for r in t.read_query_log(spark, str(tmp_path / "log"), "#EOQ#").orderBy("query_name").collect()]
    assert got == [("1", "first\nline"), ("2", "second")]
    (tmp_path / "batch").write_text("q one\nq two\n")
    got = [tuple(r) for r in t.read_query_batch(spark, str(tmp_path / "batch")).orderBy("query_seq").collect()]
    assert got == [("batch-1", 1, "q one"), ("batch-2", 2, "q two")]


def test_run_files(spark, social, tmp_path):
    table = t.run_workload(social, [("7__VP_SO-OS-SS-VP", [("?x", "lives", "?y")])])
    t.write_runs(table, str(tmp_path / "runs"))
    row = t.read_runs(spark, str(tmp_path / "runs")).first()
    assert (row["query_id"], row["query"], row["num_results"], row["is_warm"]) == (7, "7__VP_SO-OS-SS-VP", 3, False)
    (tmp_path / "times").write_text("3\t12.5 [SO-OS-SS-VP__a]\n4\t7 [SO-OS-SS-VP__b]\n")
    assert [tuple(r) for r in t.read_times(spark, str(tmp_path / "times")).collect()] == [(3, 12.5), (4, 7.0)]


def test_numbering(spark):
    df = spark.range(10_000, numPartitions=7).select((F.col("id") % 100).alias("v"), "id")
    ranked = global_rank(df, F.col("v").desc(), F.col("id")).collect()
    expected = sorted(range(10_000), key=lambda i: (-(i % 100), i))
    assert {r["rank"]: r["id"] for r in ranked} == {k + 1: i for k, i in enumerate(expected)}
    repeated = repeat_rows(spark.createDataFrame([("a", 3), ("b", 0), ("c", 1)], "k string, n long"), "n", block=2)
    assert Counter(r["k"] for r in repeated.collect()) == Counter({"a": 3, "c": 1})


def test_delimited_log_with_other_line_ends(spark, tmp_path):
    from trefoil import read_query_log

    (tmp_path / "log").write_bytes(b"SELECT ?a\r\n{ }\r\n#EOQ#\r\nSELECT ?b { }\n#EOQ# \t\nSELECT ?c { }\n#EOQ#\r\n \r\n")
    got = read_query_log(spark, str(tmp_path / "log"), record_sep="#EOQ#").collect()
    assert sorted(map(tuple, got)) == [("1", "SELECT ?a\r\n{ }"), ("2", "SELECT ?b { }"), ("3", "SELECT ?c { }")]


def test_directory_of_queries_runs(spark, social, tmp_path):
    """Files of a folder, in the order of their names, as texts that are run as they ask."""
    from pyspark.sql import functions as F

    from trefoil import logged_queries, read_query_log, run_workload

    for name, text in (("Q2.b.sparql", "SELECT DISTINCT ?z { ?x lives ?z }"), ("Q1.a.sparql", "SELECT * { ?x friends ?y FILTER (?x != ?y) }")):
        (tmp_path / name).write_text(text)
    log = read_query_log(spark, str(tmp_path))
    log = log.select(F.col("query_name").alias("query_id"), F.col("query_name").alias("query_seq"), "query")
    runs = run_workload(social, logged_queries(log)).collect()
    assert [(r["query"], r["num_results"]) for r in runs] == [("Q1", 3), ("Q2", 2)]
