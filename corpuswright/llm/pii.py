"""Personal data by gradient-boosted candidates, in SQL functions only.

1. Base rules: leftmost non-overlapping matches of four patterns that pass their checks. They stay.
2. High-recall generators propose further, overlapping spans: anything around an at sign (spelt out
   too), any run of seven digits or more with separators, long runs of letters and digits, and what
   stands behind a word such as `password=`.
3. Boosted trees score every candidate by its format and context. They are fitted on the lines of
   pii_examples, whose labels come from how the lines were made. All features are small integers.
4. Thresholds, one a kind, are calibrated for precision on lines held out of the fit. Candidates at
   or above them that overlap no base span are added.

The fitted trees become one SQL expression, and a table is read once. Positions are code points.

Work is close to linear in a text: patterns start only where a run of their first class starts and never
give characters back, places are running sums by doubling, overlaps are found by bisection, and context
is taken from what stands between matches, never by walking the text again.
"""

from __future__ import annotations

import functools
import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii_examples

#: Of the columns that this module adds to a table for a while.
PREFIX = "__pii_"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
IP_OK = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
BASE_PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, r"[0-9]\.[0-9]"), "card": (CARD, "[0-9][ -]?[0-9]"), "phone": (PHONE, r"\+[0-9]")}

#: Generators: a pattern, what a text must hold for it to be tried, and which end of a match is the candidate.
_AT, _DOT = r"(?: ?[(\[{] ?at ?[)\]}] ?| at )", r"(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)"
_KEY = r"(?:passw(?:or)?d|pwd|secret|token|bearer|(?:api|access)[_-]?key)"
OFFERED = {
    "around": (r"(?:\G|(?<![^\s@<>,;]))[^\s@<>,;]++@[^\s@<>,;]++", "@", ".+"),
    "spelt": (rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++", r"(?i)[ (\[{]at[ )\]}]", ".+"),
    "digits": (r"[+(]?[0-9](?:[\x20().\x2F-]{0,2}[0-9])++", "[0-9].?.?[0-9]", ".+"),
    "opaque": (r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+", "[A-Za-z0-9_+/-]{16}", ".+"),
    "keyed": (rf"(?i){_KEY}[\"']?[ ]?[:=]?[ ]?[\"']?[^\s\"',;:=]{{6,}}+", rf"(?i){_KEY}", r"[^\s\"',;:=]+$"),
}
#: Digits from which a run counts as a candidate: the least that a local telephone number has.
LEAST_DIGITS = 7

CONTEXT_CHARS = 24
CONTEXT = {
    "contact": r"(?i)(?:\b(?:call|phone|tel|mobile|fax|ring|anruf|telefon|llame)|tel.fono|appel)",
    "pays": r"(?i)(?:card|visa|credit|karte|tarjeta|carte)",
    "writes": r"(?i)(?:mail|contact|write|kontakt|correo|reach)",
    "keyed": rf"(?i){_KEY}[\"']?[ ]?[:=]?[ ]?[\"']?$",
    "counts": r"(?i)\b(?:order|invoice|version|page|isbn|commit|sha256|id|build|part|section|costs|between)\b",
}
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-/. ]?(?:0[1-9]|1[0-2])[-/. ]?[0-3][0-9]|[0-3][0-9][./-][01][0-9][./-](?:19|20)[0-9]{2}|(?:1[89]|20)[0-9]{2}[- ](?:19|20)[0-9]{2})"
VENDOR = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza)"
TLD = r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
FEATURES = (
    "kind", "length", "digits", "letters", "groups", "first", "last", "most", "luhn", "quad", "plus", "paren", "dots", "hyphens", "spaces", "slashes", "at", "domain_dots", "tld",
    "date", "hexa", "upper", "lower", "turns", "words", "vendor", *CONTEXT, "glued",
)
TREES, DEPTH, RATE = 40, 4, 0.3
PRECISION = 0.99
#: Code points in one piece of a text that is redacted.
PIECE = 4096


def _doubled(values: Column, add) -> Column:
    """Running sums or maxima of an array, by doubling the reach: add(a, b), b null beyond the start."""
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    reach = lambda acc, k: F.transform(acc, lambda x, i: add(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), k))))
    return F.aggregate(steps, values, reach)


def _sum(a: Column, b: Column) -> Column:
    return a + F.coalesce(b, F.lit(0))


def _with_matches(rows: DataFrame, text: Column, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with a column m_<name> for each pattern: array<struct<at, m, before, after>>, every match with its
    start, and what stands between it and its neighbours (up to CONTEXT_CHARS before, one behind).

    Each step is a column of its own, and one that is read inside a lambda is read more than once, so that the
    optimizer leaves it there: no lambda computes a whole array again."""
    keep, p = rows.columns, PREFIX
    none = F.array().cast("array<string>")
    found = [F.when(text.rlike(sign), F.regexp_extract_all(text, F.lit(x), 0)).otherwise(none).alias(f"{p}f_{n}") for n, (x, sign) in patterns.items()]
    rows = rows.select(*keep, *found)
    gaps = [F.when(F.size(f"{p}f_{n}") > 0, F.split(text, x, -1)).otherwise(none).alias(f"{p}g_{n}") for n, (x, _) in patterns.items()]
    rows = rows.select("*", *gaps)
    steps = lambda n: F.transform(f"{p}f_{n}", lambda m, i: F.length(m) + F.length(F.get(F.col(f"{p}g_{n}"), i)))
    rows = rows.select("*", *[_doubled(steps(n), _sum).alias(f"{p}e_{n}") for n in patterns])

    def placed(n: str) -> Column:
        between = F.col(f"{p}g_{n}")
        ended = F.arrays_zip(f"{p}f_{n}", f"{p}e_{n}")
        return F.transform(ended, lambda x, i: F.struct(
            (x[f"{p}e_{n}"] - F.length(x[f"{p}f_{n}"])).alias("at"), x[f"{p}f_{n}"].alias("m"),
            F.right(F.get(between, i), F.lit(CONTEXT_CHARS)).alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after")))

    return rows.select(*keep, *[placed(n).alias(f"{p}m_{n}") for n in patterns])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of 13 to 19 digits; else false."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0))
    return F.length(digits).between(13, 19) & (F.when(F.length(digits).between(13, 19), total % 10).otherwise(1) == 0)


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_OK)
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(16, 19) & _luhn(_digits(m))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _has(m: Column, pattern: str) -> Column:
    return m.rlike(pattern).cast("int")


def _times(m: Column, pattern: str, most: int) -> Column:
    return F.least(F.size(F.regexp_extract_all(m, F.lit(pattern), 0)), F.lit(most))


def _cut(x: Column, end: str) -> Column:
    """The part of a match that is the candidate, with what stands before it."""
    if end == ".+":
        return F.struct(x["at"].alias("at"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"), F.lit(False).alias("named"))
    m = F.regexp_extract(x["m"], end, 0)
    skipped = F.length(x["m"]) - F.length(m)
    before = F.concat(x["before"], F.substring(x["m"], F.lit(1), skipped))
    return F.struct((x["at"] + skipped).alias("at"), m.alias("m"), before.alias("before"), x["after"].alias("after"), F.lit(True).alias("named"))


def _described(x: Column) -> Column:
    """A candidate's span and features, all small integers."""
    at, m, before = x["at"], x["m"], x["before"]
    digits = _digits(m)
    n = F.length(digits)
    runs = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), 0), F.length)
    size = lambda c: F.least(F.coalesce(c, F.lit(0)), F.lit(20))
    is_at = _has(m, r"@|(?i)[(\[{ ]at[)\]} ]")
    quad = _has(m, r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    letters = F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
    secret = x["named"] | (is_at == 0) & m.rlike("[A-Za-z_]")
    kind = F.when(secret, 4).when(is_at == 1, 0).when(quad == 1, 1).when((n >= 16) | (_luhn(digits) & (F.instr(m, "+") == 0)), 2).otherwise(3)
    return F.struct(
        at.cast("int").alias("start"), (at + F.length(m)).cast("int").alias("end"), kind.alias("kind"),
        F.least(F.length(m), F.lit(70)).alias("length"), F.least(n, F.lit(25)).alias("digits"), F.least(letters, F.lit(45)).alias("letters"),
        F.least(F.size(runs), F.lit(8)).alias("groups"), size(F.get(runs, F.lit(0))).alias("first"), size(F.get(runs, F.size(runs) - 1)).alias("last"), size(F.array_max(runs)).alias("most"),
        _luhn(digits).cast("int").alias("luhn"), quad.alias("quad"), _has(m, r"\+").alias("plus"), _has(m, r"[()]").alias("paren"), _times(m, r"\.", 4).alias("dots"),
        _times(m, "-", 5).alias("hyphens"), _times(m, " ", 5).alias("spaces"), _times(m, "/", 4).alias("slashes"), is_at.alias("at"),
        F.least(F.size(F.split(F.substring_index(m, "@", -1), r"\.")) - 1, F.lit(3)).alias("domain_dots"), _has(m, TLD).alias("tld"), _has(m, DATE).alias("date"),
        _has(m, "^[0-9a-f]+$").alias("hexa"), _has(m, "[A-Z]").alias("upper"), _has(m, "[a-z]").alias("lower"), _times(m, "[A-Za-z][0-9]", 6).alias("turns"),
        _times(m, "[A-Za-z]{5,}", 5).alias("words"), _has(m, VENDOR).alias("vendor"), *[_has(before, p).alias(c) for c, p in CONTEXT.items()],
        (_has(before, "[A-Za-z0-9_$]$") + _has(x["after"], "^[A-Za-z0-9_]")).alias("glued"),
    )


def _with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """rows with each kind's passing base spans, in order, and the candidates with their features."""
    keep = rows.columns
    rows = _with_matches(rows, text, BASE_PATTERNS | {n: (p, sign) for n, (p, sign, _) in OFFERED.items()})
    span = lambda x: F.struct(x["at"].cast("int").alias("start"), (x["at"] + F.length(x["m"])).cast("int").alias("end"))
    passing = lambda k: F.filter(PREFIX + "m_" + k, lambda x: _passes(k, x["m"]))
    cut = lambda n, end: F.transform(PREFIX + "m_" + n, lambda x: _cut(x, end))
    base = [F.transform(passing(k), span).alias(PREFIX + k) for k in BASE]
    rows = rows.select(*keep, *base, F.concat(*[cut(n, end) for n, (_, _, end) in OFFERED.items()]).alias(PREFIX + "cut"))
    fit = lambda c: (c["digits"] >= LEAST_DIGITS) | (c["at"] == 1) | (c["keyed"] == 1) | (c["kind"] == 4) & (c["digits"] > 0)
    return rows.select(*keep, *[PREFIX + k for k in BASE], F.filter(F.transform(PREFIX + "cut", _described), fit).alias(PREFIX + "offered"))


def _overlaps(c: Column, spans: Column) -> Column:
    """Of sorted spans that don't overlap each other: the last one that starts before c ends tells."""
    steps = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor(F.log2(F.size(spans))).cast("int"))).otherwise(F.array().cast("array<int>"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_, below = acc["lo"] < acc["hi"], F.get(spans, mid)["start"] < c["end"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])
    return F.coalesce(F.get(spans, found - 1)["end"] > c["start"], F.lit(False))


def _over_any(c: Column) -> Column:
    email, ip, card, phone = (_overlaps(c, F.col(PREFIX + k)) for k in BASE)
    return email | ip | card | phone


Tree = tuple  # (feature's number, at most, left, right), or a leaf's value


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree by Newton gains, over small integers."""
    best, gain = None, 1e-6
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1] if depth else 0):
        left_g, left_h = (np.cumsum(np.bincount(x[:, f], w))[:-1] for w in (g, h))
        if len(left_g):
            new = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            if new.max() > gain:
                best, gain = (f, int(new.argmax())), new.max()
    if not best:
        return float(-RATE * total_g / (total_h + 1))
    f, value = best
    low = x[:, f] <= value
    return f, value, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1)


def _values(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _values(tree[2], x), _values(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[list[Tree], list[float]]:
    """Trees, and a threshold on the margin for each kind: the least margin from which PRECISION of the held-out rows are positive."""
    margin, trees = np.zeros(len(x)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        use = ~held
        trees.append(_grow(x[use], (p - y)[use], (p * (1 - p))[use], DEPTH))
        margin = margin + _values(trees[-1], x)
    limits = []
    for kind in range(len(KINDS)):
        mine = held & (x[:, 0] == kind) & (margin > 0)
        order = np.argsort(-margin[mine], kind="stable")
        z, good = margin[mine][order], np.cumsum(y[mine][order])
        fine = (good >= PRECISION * np.arange(1, len(z) + 1)) & (np.append(z[1:], -np.inf) < z)
        limits.append(float(z[np.flatnonzero(fine)[-1]]) if fine.any() else math.inf)
    return trees, limits


def example_candidates(spark: SparkSession) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, label and whether held out, of all candidates of the examples. A candidate is positive if it
    covers four fifths of a personal span and little else."""
    schema = "array<struct<text:string,start:int,end:int,label:int>>"
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(pii_examples.examples())), schema)).alias("e")).select("e.*")
    rows = _with_spans(rows, F.col("text")).select("start", "end", "label", F.pmod(F.xxhash64("text"), F.lit(4)).alias("fold"), F.explode(PREFIX + "offered").alias("c"))
    both = F.least("end", "c.end") - F.greatest("start", "c.start")
    label = (F.col("label") == 1) & (both * 5 >= (F.greatest("end", "c.end") - F.least("start", "c.start")) * 4)
    found = rows.select(*[F.col(f"c.{f}") for f in FEATURES], label.cast("int").alias("y"), F.col("fold")).collect()  # bounded by EXAMPLES
    data = np.array([tuple(r) for r in sorted(found)], np.int64)
    return data[:, : len(FEATURES)], data[:, -2], data[:, -1] == 0


@functools.cache
def model() -> tuple[list[Tree], list[float]]:
    """The same on every input; fitted once for each driver."""
    return fit(*example_candidates(SparkSession.active()))


def _expression(tree) -> str:
    """A tree as SQL over the candidate c."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN c.`{FEATURES[tree[0]]}` <= {tree[1]} THEN {_expression(tree[2])} ELSE {_expression(tree[3])} END"


def _written(kind: Column | str, s: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _added(fitted: tuple[list[Tree], list[float]]) -> Column:
    """array<struct<kind,start,end>>: candidates that the trees select and that overlap no base span."""
    trees, limits = fitted
    usable = [k for k, x in enumerate(limits) if math.isfinite(x)]
    if not usable:
        return F.array().cast("array<struct<kind:int,start:int,end:int>>")
    # Each candidate's margin is computed once.
    margin = " + ".join(map(_expression, trees))
    rated = F.expr(f"transform({PREFIX}offered, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.`end`, 'margin', {margin}))")
    high = lambda r: F.coalesce(*[F.when(r["kind"] == k, r["margin"] >= limits[k] - 1e-9) for k in usable], F.lit(False))
    new = F.filter(rated, lambda r: high(r) & ~_over_any(r))
    return F.array_distinct(F.transform(new, lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end"))))


def _all_spans(fitted) -> Column:
    """Base and added spans, by kind as listed, then start."""
    of = lambda i, k: F.transform(PREFIX + k, lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(F.concat(*[of(i, k) for i, k in enumerate(BASE)], _added(fitted)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and added), n_added.

    A null text counts as empty: no spans. Rows that repeat a doc_id stay apart. Texts of any length count
    whole, in time that grows little faster than they do. Other columns are ignored. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _with_spans(rows, F.col("text")).drop("text").withColumn(PREFIX + "spans", _all_spans(model()))
    each = lambda k: F.transform(PREFIX + k, lambda s: _written(k, s))
    base = F.concat(*[each(k) for k in BASE])
    name = F.array(*[F.lit(k) for k in KINDS])
    n_base = sum((F.size(PREFIX + k) for k in BASE[1:]), F.size(PREFIX + BASE[0]))
    return rows.select(
        "doc_id", *[F.size(PREFIX + k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(PREFIX + "spans", lambda s: _written(F.get(name, s["kind"]), s)), ",").alias("spans"), (F.size(PREFIX + "spans") - n_base).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars (where there is such a
    column) counted anew. Overlapping spans become one, of the kind that starts first. All other columns
    and all rows stay, rows with a null or repeated doc_id too; a null text stays null, an empty one
    empty. Texts of any length count whole. An empty table gives no rows."""
    p, text = PREFIX, F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = _with_spans(docs, text).withColumn(p + "spans", F.array_sort(F.transform(_all_spans(model()), lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    pieces = F.when(F.size(p + "spans") > 0, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)).otherwise(F.array().cast("array<string>"))
    rows = rows.select(*docs.columns, p + "spans", pieces.alias(p + "pieces"), _doubled(F.transform(p + "spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b)).alias(p + "reach"))
    # A span that starts where no earlier one reaches begins a new redaction.
    heads = F.transform(p + "spans", lambda s, i: F.when(F.coalesce(s["start"] >= F.get(F.col(p + "reach"), i - 1), F.lit(True)), i))
    rows = rows.withColumn(p + "heads", F.filter(heads, lambda i: i.isNotNull()))

    def part(begin: Column, end: Column) -> Column:
        """The text from begin to end, from the pieces that hold it."""
        i, j = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(F.col(p + "pieces"), k), F.lit(""))
        within = F.substring(piece(i), (begin % PIECE + 1).cast("int"), (end - begin).cast("int"))
        across = F.concat(F.substring(piece(i), (begin % PIECE + 1).cast("int"), F.lit(PIECE)), F.array_join(F.slice(F.col(p + "pieces"), i + 2, j - i - 1), ""), F.substring(piece(j), F.lit(1), (end % PIECE).cast("int")))
        return F.when(i == j, within).otherwise(across)

    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    before = lambda h: F.coalesce(F.get(F.col(p + "reach"), h - 1), F.lit(0))
    body = F.transform(p + "heads", lambda h: F.concat(part(before(h), F.get(F.col(p + "spans"), h)["start"]), F.get(name, F.get(F.col(p + "spans"), h)["kind"])))
    new = F.concat(F.array_join(body, ""), part(F.array_max(p + "reach"), F.length(text)))
    changed = F.size(p + "spans") > 0
    rows = rows.withColumn("text", F.when(changed, new).otherwise(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
