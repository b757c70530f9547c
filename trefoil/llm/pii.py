"""Personal data by proposed spans and boosted trees.

The four base forms (e-mail, network address, card number, telephone number) are
found by their own tests. Generators with high recall propose further spans, which
overlap: stretches of 13 to 19 digits between any two group borders, beginnings of
9 to 15 digits of what follows a plus sign, national telephone numbers, e-mails
with spelled-out signs. Proposals that touch a base span are dropped; the others
get features of their format and context, and a small gradient boosting of
two-level trees, one SQL expression, scores them. Of proposals that touch each
other the best one above its generator's threshold is added.

The trees learn from the planted texts of ``pii_sample``, where every proposal is
labelled by whether it is the planted span: half of the texts train, the other
half calibrates a threshold per generator to a precision. The driver handles only
that sample, and what is added to a row depends on its text alone.

Everything runs on DataFrame expressions.

Defined cases: a null text is empty; repeated rows are searched one by one, null
ids too; an empty table gives no rows; a generator that does not reach the
precision adds nothing. Positions count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ROW, let, numbered, text_of
from .pii_sample import planted

# Names of the kinds, in the order of the output.
KINDS = ["email", "ip", "card", "phone"]

# The forms are stated so that each place of a text is tried from one start only,
# and possessively, which a long run of digits or letters cannot make slow.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A whole chain of digits with single separators, of 13 to 19 digits.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++"
_NATIONAL = r"\(?[0-9]{3}\)?[ .-] ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"

# The base forms and spelled e-mails: name of the generator: (kind, pattern, a text without this string has no match)
GENERATORS = {
    "email": ("email", _EMAIL, "@"), "ip": ("ip", _IP, "."), "card": ("card", _CARD, ""), "phone": ("phone", _PHONE, "+"),
    "spelled": ("email", _SPELLED, "at"),
}
# Generators whose spans overlap: (kind, where spans begin, patterns of the spans that may begin there, a string as above).
# A beginning is one character, so each place is tried; the spans are read from the WINDOW characters that follow.
WINDOW = 80
OVERLAPPING = {
    "stretch": ("card", r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})(?=([\s\S]{0,80}))[0-9]", [rf"^([0-9](?:[ -]?[0-9]){{{n - 1}}})(?![0-9])" for n in range(13, 20)], ""),
    "prefix": ("phone", r"(?=\+[0-9](?:[ ().-]{0,3}[0-9]){8})(?=([\s\S]{0,80}))\+", [rf"^(\+[0-9](?:[ ().-]{{0,3}}[0-9]){{{n - 1}}})(?![0-9])" for n in range(9, 16)], "+"),
    "national": ("phone", rf"(?<![0-9(])(?={_NATIONAL})(?=([\s\S]{{0,80}}))[(0-9]", [f"^({_NATIONAL})"], ""),
}
ADDED = ["spelled", *OVERLAPPING]
_NAMED = r"(?i)\b(e-?mail|mail|contact|write|phone|tel|call|ring|reach|fax|mobile|card|visa|mastercard|credit|charge|payment)\b[^\n]{0,12}$"
_OTHER = r"(?i)\b(order|invoice|isbn|serial|ref|part|sku|ids?|tracking|table|values?|case|log|sum|measured|version|v)\b[^\n]{0,6}$"


def _proposals(text: Column) -> Column:
    """Array of all proposals of a text, in order within each generator."""
    parts = []
    nothing = F.array().cast("array<struct<gen:string,i:int,gap:int,width:int,match:string,before:string,after:string>>")
    for name, (_, pattern, sign) in GENERATORS.items():
        found = let(F.split(text, pattern), lambda gaps: F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(
                F.lit(name).alias("gen"), i.alias("i"), F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(m).alias("width"), m.alias("match"),
                F.substring(F.get(gaps, i), -30, 30).alias("before"), F.substring(F.get(gaps, i + 1), 1, 12).alias("after"),
            )))
        there = text.contains(sign) if sign else text.rlike("[0-9]")
        parts.append(F.when(there, found).otherwise(nothing))
    for name, (_, begin, patterns, sign) in OVERLAPPING.items():
        def spans(gaps, windows):
            # What lies before, also over the last three beginnings.
            before = lambda i: F.substring(F.array_join(F.transform(F.sequence(F.greatest(i - 3, F.lit(0)), i), lambda j: F.concat(
                F.get(gaps, j), F.when(j < i, F.substring(F.get(windows, j), 1, 1)).otherwise(""))), ""), -30, 30)
            return F.flatten(F.transform(windows, lambda w, i: F.transform(
                F.filter(F.array(*[F.struct(F.regexp_extract(w, p, 1).alias("m"), F.lit(n == 0).alias("first")) for n, p in enumerate(patterns)]), lambda x: (x["m"] != "") | x["first"]),
                lambda x: F.struct(
                    F.lit(name).alias("gen"), i.alias("i"), F.when(x["first"], F.char_length(F.get(gaps, i))).otherwise(0).alias("gap"),
                    F.when(x["first"], 1).otherwise(0).alias("width"), x["m"].alias("match"), before(i).alias("before"),
                    w.substr(F.char_length(x["m"]) + 1, F.lit(12)).alias("after"),
                ))))
        found = let(F.split(text, begin), lambda gaps: let(F.regexp_extract_all(text, F.lit(begin), F.lit(1)), lambda ws: spans(gaps, ws)))
        there = text.contains(sign) if sign else text.rlike("[0-9]")
        parts.append(F.when(there & text.rlike(begin), found).otherwise(nothing))
    return F.concat(*parts)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + _digit(digits, i))
    return F.coalesce(total % 10 == 0, F.lit(False))


def _digit(digits: Column, i: Column) -> Column:
    d = digits.substr(F.char_length(digits) - i, F.lit(1)).cast("int")
    return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))


def _features(df: DataFrame) -> DataFrame:
    """Add kind, base verdict (null where the generator is no base form) and the features, all true or false."""
    kind = F.lit(None).cast("int")
    for name, (k, *_) in {**GENERATORS, **OVERLAPPING}.items():
        kind = F.when(F.col("gen") == name, KINDS.index(k)).otherwise(kind)
    digits = F.regexp_replace("match", "[^0-9]", "")
    small = F.forall(F.split("match", "\\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    df = df.withColumns({"kind": kind, "digits": digits, "n_digits": F.char_length(digits)})
    df = df.withColumn("luhn", F.when(F.col("gen").isin("card", "stretch") & (F.col("n_digits") > 0), _luhn(F.col("digits"))).otherwise(False))
    base = (
        F.when(F.col("gen") == "email", True).when(F.col("gen") == "ip", small).when(F.col("gen") == "card", F.col("luhn"))
        .when(F.col("gen") == "phone", F.col("n_digits").between(9, 15))
    )
    match = lambda pattern: F.col("match").rlike(pattern)
    named = {
        **{f"is_{g}": F.col("gen") == g for g in ADDED},
        "sum_ok": F.col("luhn"), "issuer": match("^[3-6]"), "usual_length": F.col("n_digits").isin(15, 16),
        "card_groups": match("^(?:[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\\2[0-9]{5})$"),
        "ungrouped": match("^[0-9]+$"), "spaced": match("^[0-9 ]+$"), "bracketed": match("\\([0-9]"),
        "phone_groups": match("^\\+[0-9]{1,3}[ .-]\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
        "one_digit": F.col("digits").rlike("^([0-9])\\1*$"), "spelled_dot": match("[(\\[]dot[)\\]]"),
        "domain": match("[.)\\]] ?[a-z]{2,6}$") & ~match("\\. "),
        "glued_left": F.col("before").rlike("[A-Za-z0-9_=/\"'#$]$"), "glued_right": F.col("after").rlike("^[A-Za-z0-9_=/%]"),
        "digit_left": F.col("before").rlike("[0-9][ .-]$"), "one_left": F.col("before").rlike("(?<![0-9+])(?<![0-9] )1[ .-]$"),
        "digit_right": F.col("after").rlike("^[ .-][0-9]"), "expiry_right": F.col("after").rlike("^ (?:[0-9]{2}[/ ][0-9]{2}|20[0-9]{2}|[0-9]{3})(?![0-9])"),
        "date_right": F.col("after").rlike("^ (?:19|20)[0-9]{2}-[0-9]"),
        "named": F.col("before").rlike(_NAMED), "other": F.col("before").rlike(_OTHER),
    }
    return df.withColumn("base", base).withColumns({n: F.coalesce(c, F.lit(False)) for n, c in named.items()})


FEATURES = [
    *[f"is_{g}" for g in ADDED], "sum_ok", "issuer", "usual_length", "card_groups", "ungrouped", "spaced", "bracketed", "phone_groups", "one_digit",
    "spelled_dot", "domain", "glued_left", "glued_right", "digit_left", "one_left", "digit_right", "expiry_right", "date_right", "named", "other",
]


def boost(rows: list[tuple[tuple[bool, ...], int, int]], rounds: int = 40, rate: float = 0.5) -> list[tuple]:
    """Two-level trees fitted to (features, positives, negatives) by gradient boosting of the logistic loss.

    A tree is (feature, low, high) with low and high (feature, value if false,
    value if true); its leaves are Newton steps.
    """
    trees: list[tuple] = []
    score = [0.0] * len(rows)

    def leaf(members):
        g = h = 0.0
        for k in members:
            _, pos, neg = rows[k]
            p = 1 / (1 + math.exp(-score[k]))
            g += pos - (pos + neg) * p
            h += (pos + neg) * p * (1 - p)
        return g / (h + 1.0), g * g / (h + 1.0)

    def split(members):
        best = (-1.0, 0)
        for f in range(len(FEATURES)):
            no, yes = [k for k in members if not rows[k][0][f]], [k for k in members if rows[k][0][f]]
            best = max(best, (leaf(no)[1] + leaf(yes)[1], -f))
        f = -best[1]
        return f, [k for k in members if not rows[k][0][f]], [k for k in members if rows[k][0][f]]

    for _ in range(rounds if rows else 0):
        top, no, yes = split(range(len(rows)))
        sides = []
        for members in (no, yes):
            f, a, b = split(members)
            sides.append((f, rate * leaf(a)[0], rate * leaf(b)[0]))
        trees.append((top, *sides))
        score = [s + evaluate([trees[-1]], r[0]) for s, r in zip(score, rows)]
    return trees


def evaluate(trees: list[tuple], features: tuple[bool, ...]) -> float:
    total = 0.0
    for top, low, high in trees:
        f, no, yes = high if features[top] else low
        total += yes if features[f] else no
    return total


def score_column(trees: list[tuple]) -> Column:
    """The sum of the trees as an expression over the feature columns."""
    total = F.lit(0.0)
    for top, low, high in trees:
        side = [F.when(F.col(FEATURES[f]), float(yes)).otherwise(float(no)) for f, no, yes in (low, high)]
        total = total + F.when(F.col(FEATURES[top]), side[1]).otherwise(side[0])
    return total


def thresholds(rows, trees, precision: float) -> dict[str, float]:
    """Per generator the lowest score from which on the labelled proposals reach the precision; never below even odds."""
    out = {}
    for k, name in enumerate(ADDED):
        scored = sorted(((evaluate(trees, f), pos, neg) for f, pos, neg in rows if f[k]), reverse=True)
        good = bad = 0
        limit = math.inf
        for i, (s, pos, neg) in enumerate(scored):
            good, bad = good + pos, bad + neg
            last = i + 1 == len(scored) or scored[i + 1][0] < s
            if last and s > 0 and good >= precision * (good + bad):
                limit = s
        out[name] = limit
    return out


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """All proposals of the rows of ``df`` with place, base verdict and features."""
    opened = df.select(ROW, F.explode_outer(_proposals(text_of(text))).alias("p")).select(ROW, "p.*")
    # Several spans may share a beginning: the first of them carries its place, and an empty one only that.
    order = Window.partitionBy(ROW, "gen").orderBy("i")
    upto = F.sum(F.col("gap") + F.col("width")).over(order.rangeBetween(Window.unboundedPreceding, 0))
    length = F.char_length("match")
    whole = F.when(F.col("gen").isin(list(OVERLAPPING)), 1).otherwise(length)
    placed = opened.withColumn("start", (upto - whole).cast("int")).withColumn("end", F.col("start") + length)
    return _features(placed)


_touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])


def _model(spark, precision: float) -> tuple[list[tuple], dict[str, float]]:
    """Trees and thresholds from the planted texts, the same for every table; kept by the driver."""
    if precision not in _models:
        sample = planted()
        texts = spark.createDataFrame([(i, "".join(p)) for i, p in enumerate(sample)], f"{ROW} long, text string").coalesce(1)
        found = _candidates(texts, "text").where("match != ''").select(ROW, "start", "end", "base", "gen", *FEATURES).collect()
        sure = {}
        for r in found:
            if r["base"]:
                sure.setdefault(r[ROW], []).append(r)
        halves = ({}, {})
        for r in found:
            if r["gen"] in ADDED and not any(r["start"] < b["end"] and b["start"] < r["end"] for b in sure.get(r[ROW], ())):
                before, span, _ = sample[r[ROW]]
                hit = bool(span) and (r["start"], r["end"]) == (len(before), len(before) + len(span))
                counts = halves[r[ROW] % 2].setdefault(tuple(r[f] for f in FEATURES), [0, 0])
                counts[not hit] += 1
        train, held = (sorted((f, pos, neg) for f, (pos, neg) in h.items()) for h in halves)
        trees = boost(train)
        _models[precision] = trees, thresholds(held, trees, precision)
    return _models[precision]


_models: dict[float, tuple] = {}


def find_spans(df: DataFrame, text: str = "text", precision: float = 0.98) -> DataFrame:
    """For each row of ``df`` (numbered by ``_row``): ``spans`` (kind, start, end, base), sorted."""
    trees, limits = _model(df.sparkSession, precision)
    limit = F.lit(None).cast("double")
    for g, v in limits.items():
        if v < math.inf:
            limit = F.when(F.col("gen") == g, v - 1e-9).otherwise(limit)
    found = _candidates(df, text).withColumn("score", score_column(trees))
    sure = F.coalesce(F.col("base"), F.lit(False))
    kept = sure | ((F.col("match") != "") & F.coalesce(F.col("score") >= limit, F.lit(False)))
    # The best come first, of equal ones the longer.
    span = F.when(kept, F.struct((-F.col("score")).alias("worse"), (-F.char_length("match")).alias("shorter"), "kind", "start", "end", sure.alias("base")))
    grouped = found.groupBy(ROW).agg(F.array_sort(F.collect_list(span)).alias("all"))
    bare = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))
    base = F.transform(F.filter("all", lambda s: s["base"]), bare)
    more = let(base, lambda bs: F.transform(F.filter("all", lambda s: ~s["base"] & ~F.exists(bs, lambda b: _touches(s, b))), bare))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean>>")
    added = F.aggregate(more, none, lambda acc, s: F.when(F.exists(acc, lambda a: _touches(s, a)), acc).otherwise(F.array_append(acc, s)))
    return grouped.select(ROW, F.array_sort(F.concat(base, added)).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` without its text, and per kind the base counts, the digest of the base spans and all spans."""
    rest = [c for c in df.columns if c != text]
    # The rows are numbered while they are searched: the proposals are written with that number and those columns.
    inside = F.struct(F.monotonically_increasing_id().alias("n"), *[df[c].alias(f"c{k}") for k, c in enumerate(rest)])
    found = find_spans(df.select(inside.alias(ROW), F.col(text).alias("text")), "text", **options)
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        *[F.col(ROW)[f"c{k}"].alias(c) for k, c in enumerate(rest)],
        *[F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with each span replaced by its kind in brackets; spans that touch become one, named by the first."""
    docs = numbered(df, *[df[c].alias(f"c{k}") for k, c in enumerate(df.columns)])
    at = f"c{df.columns.index(text)}"
    found = find_spans(docs.select(ROW, F.col(at).alias("text")), "text", **options).where(F.size("spans") > 0)
    joined = docs.join(found.hint("shuffle_hash"), ROW, "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # By place; a span that begins inside the reach of those before it adds nothing but its end.
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("to"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["to"]
        out = F.concat(acc["out"], F.col(at).substr(acc["to"] + 1, s["start"] - acc["to"]), F.get(names, s["kind"]))
        return F.struct(F.greatest(acc["to"], s["end"]).alias("to"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_place, zero, step, lambda acc: F.concat(acc["out"], F.col(at).substr(acc["to"] + 1, F.char_length(at))))
    new = F.when(F.col("spans").isNull(), F.col(at)).otherwise(done)
    return joined.select(*[(new if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(df.columns)])
