"""Query texts as tables: plain ``SELECT`` texts are read whole, all others are listed with a reason.

A text becomes one array of tokens; so quotes, comments and the characters inside
names cannot be mistaken for structure. Joined again with marks around each token,
statements, predicate lists (``;``) and object lists (``,``) are plain splits of that
stream. What is read: PREFIX and BASE, SELECT with a list or ``*``, DISTINCT, one
group of triple patterns with ``a``, and filters of ``!=`` joined by ``&&``. It is no
grammar: any other word or bracket makes a text a rejected one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import Prefixes, shorten, strip_brackets

MARK = "\x01"
_TAG = r"(?:@[A-Za-z][\w-]*+|\^\^<[^<>\s]*+>|\^\^[\w-]*+:[\w-]++)?+"
_STOP = r"""\s{}()\[\]<>",;=!&|*?$"""
_REST = rf"[^{_STOP}.]"
# Comment, IRI, literal, variable, operator or bracket, word (also a prefixed name). Possessive, so that long literals need no stack.
_TOKEN = (
    rf"""(?<!\S)#[^\n]*+|<[^<>\s"{{}}]*+>|"(?:[^"\\]++|\\.)*+"{_TAG}|'(?:[^'\\]++|\\.)*+'{_TAG}|[?$]\w++"""
    rf"""|!=|&&|\|\||<=|>=|[{{}}()\[\].;,=<>!*&|]|(?!['#]){_REST}(?:{_REST}|\.(?={_REST}))*+"""
)
_M, _ONE = MARK, rf"{MARK}[^{MARK}]*+{MARK}"
_WORD = lambda word: rf"{_M}(?i:{word}){_M}"
_PROLOGUE = rf"^(?:{_WORD('prefix')}{_M}[^:{_M}]*+:{_M}{_M}<[^{_M}>]*+>{_M}|{_WORD('base')}{_M}<[^{_M}>]*+>{_M})*+"
_SELECT = rf"^{_WORD('select')}(?:{_WORD('distinct')})?+({_M}\*{_M}|(?:{_M}[?$]\w++{_M})++)(?:{_WORD('where')})?+$"
_UNLIKE = rf"{_M}([?$]\w++|[^{_M}()]++){_M}{_M}!={_M}{_M}([^{_M}()]++){_M}"
_UNNAMED = rf"{_M}[^{_M}()]++{_M}{_M}!={_M}{_M}[^{_M}()]++{_M}"
_FILTER = rf"{_WORD('filter')}{_M}\({_M}{_UNNAMED}(?:{_M}&&{_M}{_UNNAMED})*+{_M}\){_M}"
# Tokens that are no terms: operators, brackets and unnamed nodes; of a filter, but for its own.
_NO_TERM = rf"{_M}(?:[()\[\]=<>!*&|]|[<>]=|!=|&&|\|\||_:[^{_M}]*+){_M}"
_NO_TERM_HERE = rf"{_M}(?:[\[\]=<>!*&|.;,]|[<>]=|\|\||_:[^{_M}]*+){_M}"
# Fixed value: the IRI that the word "a" stands for.
TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
_KEY = ["query_id", "query_seq"]


class LoggedQuery(NamedTuple):
    """A query as its text asks for it."""

    name: str
    patterns: list[tuple[str, str, str]]
    select: list[str]
    distinct: bool = False
    filters: list[tuple[str, str, str]] = []


def _replaced(text: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def _tokens_of(part: Column) -> Column:
    """Tokens of a piece of the stream, without marks."""
    return F.split(F.trim(part, F.lit(MARK)), MARK * 2)


def _triples(blocks: str) -> Column:
    """``(s, p, o, sound)`` of the statements of a group."""
    def of_list(block, part, i):
        objects = F.split(part, f"{_M},{_M}")
        head = _tokens_of(objects[0])
        first = F.when(i == 0, 2).otherwise(1)

        def triple(o, k):
            alone = F.trim(o, F.lit(MARK))
            sound = F.when(k == 0, F.size(head) == first + 1).otherwise((alone != "") & ~alone.contains(MARK))
            return F.struct(
                F.regexp_extract(block, f"^{_M}([^{_M}]*){_M}", 1).alias("s"), F.coalesce(F.get(head, first - 1), F.lit("")).alias("p"),
                F.when(k == 0, F.coalesce(F.get(head, first), F.lit(""))).otherwise(alone).alias("o"), sound.alias("sound"))
        return F.transform(objects, triple)

    def of_block(block):
        parts = F.filter(F.split(block, f"{_M};{_M}"), lambda x: x != "")
        return F.flatten(F.transform(parts, lambda part, i: of_list(block, part, i)))

    return F.flatten(F.transform(blocks, of_block))


def _read(query_log: DataFrame) -> DataFrame:
    """Every text with its parts, unresolved, and ``reason`` (null where all of it was understood)."""
    text = F.translate(F.coalesce("query", F.lit("")), MARK, " ")
    # One step per select: each reads plain columns, so no long expression is evaluated twice.
    rows = query_log.select(*_KEY, text.alias("_text"))
    rows = rows.select(
        *_KEY, F.filter(F.regexp_extract_all("_text", F.lit(_TOKEN), 0), lambda x: ~x.startswith("#")).alias("_tokens"),
        (~_replaced("_text", _TOKEN).rlike(r"\S")).alias("_clear"))
    stream = F.concat(F.lit(MARK), F.array_join("_tokens", MARK * 2), F.lit(MARK))
    rows = rows.select(*_KEY, "_clear", stream.alias("_stream"))
    opening, closing = F.lit(f"{_M}{{{_M}"), F.lit(f"{_M}}}{_M}")
    end = F.instr(F.reverse("_stream"), closing)
    first, last = F.instr("_stream", opening), F.length("_stream") - end - 1
    rows = rows.select(
        *_KEY, "_clear", F.when(first > 0, F.col("_stream").substr(F.lit(1), first - 1)).otherwise(F.col("_stream")).alias("_head"),
        F.when((first > 0) & (end > 0) & (last > first), F.col("_stream").substr(first + 3, last - first - 3)).alias("_body"),
        F.col("_stream").substr(last + 3, F.length("_stream")).alias("_tail"))
    rows = rows.select(
        *_KEY, "_clear", "_body", "_tail", F.regexp_extract("_head", _PROLOGUE, 0).alias("_prologue"),
        _replaced("_head", _PROLOGUE).alias("_select"))
    prefix = f"{_WORD('prefix')}{_M}([^{_M}]*):{_M}{_M}<([^{_M}]*)>{_M}"
    variables = F.transform(F.regexp_extract_all("_select", F.lit(rf"{_M}[?$](\w+){_M}"), 1), lambda v: F.concat(F.lit("?"), v))
    rows = rows.select(
        *_KEY, "_clear", "_body", "_tail", F.col("_select").rlike(_SELECT).alias("_plain"), variables.alias("select"),
        F.col("_select").rlike(f"^{_WORD('select')}{_WORD('distinct')}").alias("distinct"),
        F.regexp_extract_all("_prologue", F.lit(prefix), 1).alias("_names"), F.regexp_extract_all("_prologue", F.lit(prefix), 2).alias("_full"),
        F.regexp_extract("_prologue", f".*{_WORD('base')}{_M}<([^{_M}]*)>{_M}", 1).alias("_base"),
        F.regexp_extract_all("_body", F.lit(_FILTER), 0).alias("_filters"), _replaced("_body", _FILTER, f"{_M}.{_M}").alias("_group"))
    # Of a prefix declared twice the last declaration holds, as a map takes no key twice.
    last = F.filter(
        F.transform("_names", lambda n, i: F.struct(n.alias("name"), F.get("_full", i).alias("full"), i.alias("at"))),
        lambda d: ~F.exists(F.slice("_names", d["at"] + 2, F.greatest(F.size("_names"), F.lit(1))), lambda n: n == d["name"]))
    declared = F.when(F.size(F.array_distinct("_names")) == F.size("_names"), F.map_from_arrays("_names", "_full")).otherwise(
        F.map_from_arrays(F.transform(last, lambda d: d["name"]), F.transform(last, lambda d: d["full"])))
    joined = F.array_join("_filters", "")
    rows = rows.select(
        *_KEY, "_clear", "_tail", "_plain", "select", "distinct", "_base", "_group",
        declared.alias("_declared"),
        F.arrays_zip(F.regexp_extract_all(joined, F.lit(_UNLIKE), 1).alias("a"), F.regexp_extract_all(joined, F.lit(_UNLIKE), 2).alias("b")).alias("_unlike"),
        F.filter(F.split("_group", rf"{_M}\.{_M}"), lambda x: x != "").alias("_blocks"), joined.alias("_joined"))
    rows = rows.withColumn("_triples", _triples("_blocks"))
    # Whole groups are searched, not term by term.
    named = lambda c: F.transform(F.regexp_extract_all(c, F.lit(rf"{_M}[?$](\w+){_M}"), 1), lambda v: F.concat(F.lit("?"), v))
    sound = F.forall("_triples", lambda x: x["sound"]) & ~F.col("_group").rlike(_NO_TERM)
    variable = lambda c: c.startswith("?") | c.startswith("$")
    comparable = F.forall("_unlike", lambda u: variable(u["a"]) | variable(u["b"])) & ~F.col("_joined").rlike(_NO_TERM_HERE)
    asked = F.concat("select", named(F.col("_joined")))
    # A filter on the reason would be pushed through all selects, and every step be repeated in the next. It
    # cannot pass a row number, which the reason names to keep it.
    rows = rows.withColumns({
        "_variables": F.array_distinct(named(F.col("_group"))), "_asked": asked, "_sound": sound, "_comparable": comparable,
        "_row": F.monotonically_increasing_id()})
    group = F.col("_group")
    reason = (
        F.when(~F.col("_clear") | (F.col("_row") < 0), "unreadable characters")
        .when(~F.col("_plain"), "no plain SELECT")
        .when(group.isNull(), "no group")
        .when(F.col("_tail") != "", "words after the group")
        .when(group.rlike(rf"{_M}[{{}}]{_M}"), "nested group")
        .when(group.rlike(_WORD("filter")), "other filter")
        .when(F.size("_triples") == 0, "no pattern")
        .when(~F.col("_sound"), "unreadable pattern")
        .when(~F.col("_comparable"), "other filter")
        .when(F.size(F.array_except("_asked", "_variables")) > 0, "variable without pattern")
    )
    whole = F.when(F.size("select") > 0, F.col("select")).otherwise(F.col("_variables"))
    return rows.select(*_KEY, reason.alias("reason"), whole.alias("select"), "distinct", "_unlike", "_triples", "_declared", "_base")


def _written(c: Column) -> Column:
    """Variables and quotes in one way of writing."""
    variable = F.concat(F.lit("?"), c.substr(F.lit(2), F.length(c)))
    inside, after = [F.regexp_extract(c, r"(?s)^'((?:[^'\\]++|\\.)*+)'(.*)$", k) for k in (1, 2)]
    quoted = F.concat(F.lit('"'), F.replace(inside, F.lit('"'), F.lit('\\"')), F.lit('"'), after)
    return F.when(c.startswith("$"), variable).when(c.startswith("'"), quoted).otherwise(c)


def _full(c: Column) -> Column:
    """Prefixed names, also of a literal's type, by the text's own prefixes; relative IRIs by its base."""
    name = F.substring_index(c, ":", 1)
    full = F.concat(F.try_element_at("_declared", name), c.substr(F.length(name) + 2, F.length(c)))
    kind = F.regexp_extract(c, r"\^\^([\w-]*):[\w-]+$", 1)
    typed = F.concat(
        F.regexp_extract(c, r"(?s)^(.*\^\^)[\w-]*:[\w-]+$", 1), F.lit("<"), F.try_element_at("_declared", kind), F.regexp_extract(c, r"\^\^[\w-]*:([\w-]+)$", 1), F.lit(">"))
    # A base changes only texts that name one.
    relative = c.startswith("<") & ~c.contains("://") & (F.col("_base") != "")
    return (
        F.when(c.startswith('"'), F.coalesce(F.when(c.rlike(r"\^\^[\w-]*:[\w-]+$"), typed), c))
        .when(relative, F.concat(F.lit("<"), F.col("_base"), strip_brackets(c), F.lit(">")))
        .when(c.rlike(r"^[^<?].*:|^:"), F.coalesce(F.concat(F.lit("<"), full, F.lit(">")), c))
        .otherwise(c)
    )


def _term(c: Column, prefixes: Prefixes) -> Column:
    return shorten(strip_brackets(_full(_written(c))), prefixes)


def extract_patterns(query_log: DataFrame, prefixes: Prefixes = ()) -> DataFrame:
    """Workload rows of the texts that were understood, one per triple pattern.

    ``query_log`` has ``(query_id, query_seq, query)``. Names are expanded with the
    text's own PREFIX and BASE lines and then shortened with ``prefixes``, exactly
    like stored terms. For the others see :func:`rejected_queries`.
    """
    rows = _read(query_log).where("reason is null")
    fixed = [*_KEY, "pos"]
    rows = rows.select(*_KEY, "_declared", "_base", F.posexplode("_triples").alias("pos", "_t"))
    predicate = F.when(F.col("_t.p") == "a", F.lit(TYPE)).otherwise(F.col("_t.p"))
    rows = rows.select(*fixed, "_declared", "_base", F.col("_t.s").alias("s"), predicate.alias("p"), F.col("_t.o").alias("o"))
    names = ("s", "p", "o")
    rows = rows.select(*fixed, "_declared", "_base", *[_written(F.col(n)).alias(n) for n in names])
    rows = rows.select(*fixed, *[_full(F.col(n)).alias(n) for n in names])
    rows = rows.select(*fixed, *[strip_brackets(n).alias(n) for n in names])
    return rows.select(*fixed, *[shorten(n, prefixes).alias(n) for n in names])


def query_heads(query_log: DataFrame, prefixes: Prefixes = ()) -> DataFrame:
    """``(query_id, query_seq, select, distinct, filters)`` of the texts that were understood.

    ``select`` lists variables (those of the patterns for ``*``), ``filters`` has
    ``(a, b)`` pairs that must differ.
    """
    rows = _read(query_log).where("reason is null")
    pairs = F.transform("_unlike", lambda u: F.struct(_term(u["a"], prefixes).alias("a"), _term(u["b"], prefixes).alias("b")))
    return rows.select(*_KEY, "select", "distinct", pairs.alias("filters"))


def rejected_queries(query_log: DataFrame) -> DataFrame:
    """``(query_id, query_seq, reason)`` of the texts that ask for more than is read here."""
    return _read(query_log).where("reason is not null").select(*_KEY, "reason")


def logged_queries(query_log: DataFrame, prefixes: Prefixes = ()):
    """Yield a :class:`LoggedQuery` for each text that was understood, in order of execution.

    Queries are run one after the other from the driver, so they pass it one by one.
    """
    patterns = extract_patterns(query_log, prefixes).groupBy(*_KEY).agg(
        F.array_sort(F.collect_list(F.struct("pos", "s", "p", "o"))).alias("patterns"))
    found = query_heads(query_log, prefixes).join(patterns, _KEY).orderBy("query_seq", "query_id")
    for r in found.toLocalIterator():
        yield LoggedQuery(
            str(r["query_id"]), [(x["s"], x["p"], x["o"]) for x in r["patterns"]], r["select"], r["distinct"],
            [(x["a"], "!=", x["b"]) for x in r["filters"]])
