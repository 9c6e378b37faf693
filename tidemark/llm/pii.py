"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators with high recall propose candidate spans for each kind: the base rules, and wider ones whose spans may overlap
them (e-mail addresses with spelled-out signs, phone numbers without a country code, card numbers with other separators or
a wrong check digit, addresses in hexadecimal groups). Each candidate gets format features and features of its context.
Boosted regression trees score the wider candidates; the trees are fitted here, from a fixed list of labelled example
sentences run through the same features, and become CASE expressions. The threshold of each kind is calibrated on the part
of the examples that the trees have not seen: halfway between the lowest score down to which at least ``PRECISION`` of them
are right and the next one below.

Base spans always stay. A wider candidate is added if its score reaches its kind's threshold and it overlaps neither a
base span nor a wider one that starts before it.

Places are code points, end exclusive. They come from the pieces between matches, so no text leaves the scan: only matches
with a few code points around them do.

Cases: null and empty texts have no span; equal places are ordered by kind as listed; repeated rows are each reported;
texts of any length are whole, and a text with many matches is many rows, not one large value, until its spans are joined;
an empty table gives no row; extra columns pass by unread in :func:`find`, and are all kept in :func:`redact`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, written
from tidemark.llm.pii_examples import examples

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS, RATE, LEAST = 30, 0.3, 4
#: Base rules, by possessive forms of the same languages: a match starts where no earlier start can match.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])[0-9]++(?:[\\x20-][0-9]++)*+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Wider rules.
WIDE = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\\x20?(?:@|\\(at\\)|\\[at\\])\\x20?[A-Za-z0-9-]{1,63}+(?:\\x20?(?:\\.|\\(dot\\)|\\[dot\\])\\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": "(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": "(?<![0-9])[0-9]{3,6}+(?:[\\x20./_-][0-9]{3,6}+){2,4}+(?![0-9])",
    "phone": "(?<![0-9A-Za-z+])(?:\\([0-9]{2,4}\\)\\x20?|[0-9]{2,4}[\\x20./-])[0-9]{3}[\\x20./-][0-9]{4}(?![0-9])",
}
#: A text without a match of this has no candidate of the kind.
HINT = {"email": "[@]|\\((?:at)\\)|\\[at\\]", "ip": "[0-9]\\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]{3}", "phone": "\\+[0-9]|[0-9]{3}[\\x20./-][0-9]{4}"}
#: The same for the base rules. A base card's digits stand alone or have one separator between them.
BASE_HINT = HINT | {"card": "(?:[0-9][\\x20-]?){11}[0-9]"}
#: Words before a span that speak for a kind, in lower case.
CONTEXT = {
    "email": "(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)[^0-9@]{0,16}$",
    "ip": "(?:\\bip\\b|ipv6|host|server|address|login from|adresse)[^0-9]{0,16}$",
    "card": "(?:card|visa|mastercard|amex|credit|carte|karte|tarjeta|iban)[^0-9]{0,16}$",
    "phone": "(?:phone|tel\\b|tel\\.|call|mobile|cell|fax|telefon|t[eé]l|llame|anruf)[^0-9]{0,16}$",
}
#: Words before a span that speak against personal data.
AGAINST = "(?:order|invoice|version|isbn|serial|ref|no\\.|part|build|page|row|total|sku|id|ticket|case)[^0-9@]{0,8}$"
BEFORE, AFTER = 32, 1
MATCH = [("kind", "int"), ("base", "boolean"), ("number", "int"), ("gap", "int"), ("size", "int"), ("match", "string"), ("before", "string"), ("after", "string")]


def _matches(text: Column, rule: str, hint: str, kind: int, base: bool) -> Column:
    """array<struct>: number, code points since the last match, length, the match and what stands around it."""
    found, between = F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1)
    n = F.size(found)
    zipped = F.arrays_zip(found.alias("match"), F.slice(between, 1, n).alias("left"), F.slice(between, 2, n).alias("right"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("number"), F.length(x["left"]).alias("gap"), F.length(x["match"]).alias("size"),
            x["match"].alias("match"), F.lower(F.right(x["left"], F.lit(BEFORE))).alias("before"), F.left(x["right"], F.lit(AFTER)).alias("after"),
        ),
    )
    return F.when(text.rlike(hint), rows).otherwise(F.array().cast(f"array<struct<{','.join(map(':'.join, MATCH))}>>"))


def _found(rows: DataFrame) -> DataFrame:
    """The columns of rows (row_key, text, ..) but the text, with one row for each match and one of kind -1 for the text."""
    lists = [_matches(F.col("text"), rules[k], hints[k], i, base) for rules, hints, base in ((BASE, BASE_HINT, True), (WIDE, HINT, False)) for i, k in enumerate(KINDS)]
    own = F.array(F.struct(F.lit(-1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in MATCH[1:])))
    others = [c for c in rows.columns if c != "text"]
    met = rows.select(*others, F.concat(own, *lists).alias("found"))
    return met.select(*others, F.inline("found"))


def _placed(found: DataFrame) -> DataFrame:
    """The matches with their starts and ends."""
    so_far = Window.partitionBy("row_key", "kind", "base").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return found.filter("kind >= 0").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))


def _digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    backward = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    doubled = F.transform(backward, lambda x, i: F.when(i % 2 == 1, 2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return (F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0) & (F.length(digits) > 0)


def _valid() -> Column:
    """Whether a base match is personal data by its kind's rule."""
    n = F.length(_digits(F.col("match")))
    parts = F.split(F.col("match"), "\\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & F.forall(parts, lambda p: F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 4).try_cast("int") <= 255)
    by_kind = {"email": F.lit(True), "ip": small, "card": n.between(12, 19) & F.when(n.between(12, 19), luhn(_digits(F.col("match")))).otherwise(False), "phone": n.between(9, 15)}
    return reduce(lambda rest, k: F.when(F.col("kind") == KINDS.index(k), by_kind[k]).otherwise(rest), KINDS, F.lit(False))


def _features() -> list[Column]:
    """Whole numbers that the trees split on."""
    match, before, digits = F.col("match"), F.col("before"), _digits(F.col("match"))
    n = F.length(digits)
    of_kind = reduce(lambda rest, k: F.when(F.col("kind") == KINDS.index(k), before.rlike(CONTEXT[k])).otherwise(rest), KINDS, F.lit(False))
    numbers = [
        F.col("kind"),
        n,
        F.when((F.col("kind") == 2) & n.between(12, 19), luhn(digits)).otherwise(False),
        of_kind,
        before.rlike(AGAINST),
        before.rlike("[a-z0-9]$"),
        F.col("after").rlike("^[A-Za-z0-9]"),
        match.rlike("[(\\[](?:at|dot)[)\\]]"),
        match.rlike("@"),
        match.rlike("(?:\\.|dot\\)|dot\\])\\x20?[A-Za-z]{2,12}$"),
        match.rlike("\\("),
        match.rlike("\\x20"),
        match.rlike("-"),
        match.rlike("[./_]"),
        F.length(F.regexp_replace(match, "[A-Za-z0-9]+", "")),
        n.between(13, 16),
    ]
    return [x.cast("int").alias(f"f{i}") for i, x in enumerate(numbers)]


FEATURES = 16


def fit_trees(rows: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Boosted depth-two regression trees for log-odds. A tree is a leaf value or (feature, at most, left, right)."""
    import math

    cuts = [sorted({x[i] for x, _ in rows})[:-1] for i in range(FEATURES)]
    scores = [0.0] * len(rows)

    def leaf(part: list[int]) -> float:
        g = sum(rows[i][1] - p[i] for i in part)
        return rate * g / (sum(p[i] * (1 - p[i]) for i in part) + 1.0)

    def gain(part: list[int]) -> float:
        g = sum(rows[i][1] - p[i] for i in part)
        return g * g / (sum(p[i] * (1 - p[i]) for i in part) + 1.0)

    def grow(part: list[int], depth: int):
        best, whole = None, gain(part)
        for i in range(FEATURES) if depth else ():
            for cut in cuts[i]:
                left = [k for k in part if rows[k][0][i] <= cut]
                if LEAST <= len(left) <= len(part) - LEAST:
                    chosen = set(left)
                    right = [k for k in part if k not in chosen]
                    better = gain(left) + gain(right) - whole
                    if better > 1e-9 and (best is None or better > best[0]):
                        best = better, i, cut, left, right
        return leaf(part) if best is None else (best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1))

    def value(tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    trees = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        trees.append(grow(list(range(len(rows))), 2))
        scores = [s + value(trees[-1], x) for s, (x, _) in zip(scores, rows, strict=True)]
    return trees


def score_row(trees: list, x: tuple[int, ...]) -> float:
    total = 0.0
    for tree in trees:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        total += tree
    return total


def score_column(trees: list) -> Column:
    def case(tree) -> Column:
        return F.when(F.col(f"f{tree[0]}") <= tree[1], case(tree[2])).otherwise(case(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

    return reduce(lambda a, b: a + b, (case(t) for t in trees), F.lit(0.0))


def calibrated(trees: list, held: list[tuple[tuple[int, ...], int]]) -> dict[int, float]:
    """For each kind the score that the held-out examples call for; infinite where none of them is personal data."""
    out = {}
    for kind in range(len(KINDS)):
        scored = sorted(((score_row(trees, x), y) for x, y in held if x[0] == kind), reverse=True)
        level, right = float("inf"), 0
        for k, (s, y) in enumerate(scored):
            right += y
            below = scored[k + 1][0] if k + 1 < len(scored) else s - 1
            if right >= PRECISION * (k + 1) and below < s:
                level = (s + below) / 2
        out[kind] = level
    return out


_model: dict = {}


def model(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """Trees and thresholds, fitted once in a driver from the fixed examples."""
    if "trees" not in _model:
        quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
        said = examples()
        rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}L, {quoted(t)})" for i, (t, _, _) in enumerate(said)) + " AS t(row_key, text)")
        wide = _placed(_found(rows)).filter("not base").select("row_key", "start", "end", *_features())
        found = sorted(wide.collect())
        data = [(tuple(r[3:]), int(any(KINDS[r.f0] == k and a <= r.start and r.end <= b for k, a, b in said[r.row_key][1])), said[r.row_key][2]) for r in found]
        trees = fit_trees([(x, y) for x, y, held in data if not held])
        _model["trees"], _model["levels"] = trees, calibrated(trees, [(x, y) for x, y, held in data if held])
    return _model["trees"], _model["levels"]


def _accepted(found: DataFrame) -> DataFrame:
    """row_key, kind, base, start, end of all spans of written matches."""
    trees, levels = model(found.sparkSession)
    placed = _placed(found).select("row_key", "kind", "base", "start", "end", "match", "before", "after")
    sure = placed.filter("base").filter(_valid()).select("row_key", "kind", "base", "start", "end")
    level = reduce(lambda rest, k: F.when(F.col("kind") == k, F.lit(levels[k])).otherwise(rest), levels, F.lit(float("inf")))
    wide = placed.filter("not base").select("row_key", "kind", "base", "start", "end", *_features())
    wide = wide.filter(score_column(trees) >= level).select("row_key", "kind", "base", "start", "end")
    both = sure.union(wide)
    order = Window.partitionBy("row_key").orderBy("start", F.desc("base"), "end", "kind")
    backward = Window.partitionBy("row_key").orderBy(F.desc("start"), "base", F.desc("end"), F.desc("kind"))  # frames that only grow
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, backward))
    free = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after), F.col("end")) >= F.col("end"))
    return both.withColumn("free", free).filter("base or free").select("row_key", "kind", "base", "start", "end")


def _joined(spans: DataFrame) -> DataFrame:
    """row_key, counts of each kind's base spans, the base spans and all spans as sorted arrays."""
    span = F.struct("start", "kind", "end")
    counts = [F.count_if(F.col("base") & (F.col("kind") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return spans.groupBy("row_key").agg(*counts, F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("every"))


def _spelled(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans of every row."""
    keyed = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = written(_found(keyed), "candidates")  # keys and ids of one scan: another may number its rows differently
    spans = _joined(_accepted(found))
    nothing = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    out = found.filter("kind = -1").select("row_key", "doc_id").join(spans, "row_key", "left")
    return out.select(
        "doc_id", *(F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_spelled(F.coalesce("base", nothing)), 256).alias("base_sha256"), _spelled(F.coalesce("every", nothing)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in its texts replaced by its kind in square brackets; overlapping spans become one, named
    by the first. ``docs`` is written once, unless it is a bare scan, so that its rows have fixed keys."""
    names = docs.columns
    of = {n.lower(): f"c{k}" for k, n in enumerate(names)}
    keyed = numbered(docs, "pii-rows")
    text = F.coalesce(F.col(of["text"]), F.lit(""))
    spans = _joined(_accepted(written(_found(keyed.select("row_key", text.alias("text"))), "candidates"))).select("row_key", "every")
    met = keyed.join(spans, "row_key", "left")
    kinds = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col(of["text"]), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(kinds, s["kind"] + 1))).alias("out"),
            s["end"].alias("at"),
        )
    )
    clean = F.aggregate("every", start, step, lambda a: F.concat(a["out"], F.substring(F.col(of["text"]), (a["at"] + 1).cast("int"), F.length(of["text"]))))
    return met.withColumn(of["text"], F.when(F.col("every").isNull(), F.col(of["text"])).otherwise(clean)).select(*of.values()).toDF(*names)
