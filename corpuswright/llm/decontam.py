"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Numbers, names and units become typed placeholders, so that a question with other parameters has the
same template. Windows of WIDTH template words of all documents meet those of the benchmark in a hash
join. A document that holds enough of an item's windows is aligned with it along every diagonal (place
less the window's number) that it holds: each window at its place nearest to the diagonal, at most an
item's length away. An alignment of enough windows counts if its slots are consistent, that is each value
of the item always stands for one value of the document, or if enough windows are the item's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables

WIDTH = 5
PERCENT = 80
#: Item windows are broadcast up to so many rows (of 24 bytes); beyond, the join shuffles.
MOST_BROADCAST = 2_000_000

#: Units that may follow a number.
UNITS = (
    "mm", "cm", "dm", "m", "km", "inch", "inches", "feet", "foot", "ft", "yards", "yard", "miles", "mile", "meters", "metres", "kilometers", "kilometres",
    "mg", "g", "kg", "tons", "tonnes", "grams", "kilograms", "pounds", "lb", "lbs", "ounces", "oz", "ml", "cl", "l", "liters", "litres", "gallons",
    "ms", "s", "sec", "seconds", "second", "min", "minutes", "minute", "h", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year",
    "mph", "kmh", "kph", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "kv", "a", "j", "kj", "cal", "kcal", "n", "pa", "kpa", "bar", "kb", "mb", "gb", "tb",
    "usd", "eur", "gbp", "dollars", "dollar", "euros", "euro", "cents", "cent", "percent", "degrees", "celsius", "fahrenheit", "kelvin",
)
NAME_MARK = "\u0002"
_UNIT = "(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")"
_WORD = r"\p{L}\p{N}"


def marked(text: Column) -> Column:
    """Words with names marked, marks dropped, in lower case, and numbers apart from their units."""
    t = F.regexp_replace(text, rf"(?<=[{_WORD},;] )\p{{Lu}}\p{{Ll}}++", NAME_MARK + "$0")
    t = F.lower(F.regexp_replace(t, rf"[^{_WORD}\x20\x09-\x0D{NAME_MARK}]++", ""))
    return F.regexp_replace(t, rf"(?<![{_WORD}])([0-9]++)({_UNIT})(?![{_WORD}])", "$1 $2")


def template(words: Column) -> Column:
    """Of marked words: the same number of words, with placeholders."""
    t = F.regexp_replace(words, rf"(?<![{_WORD}{NAME_MARK}])[0-9]++(?![{_WORD}])", "#")
    t = F.regexp_replace(t, rf"#([\x20\x09-\x0D]++){_UNIT}(?![{_WORD}])", "#$1~")
    return F.regexp_replace(t, rf"{NAME_MARK}[{_WORD}]++", "@")


def _words(t: Column) -> Column:
    return F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _window_hashes(words: Column) -> Column:
    """One hash for each window; none for fewer than WIDTH words."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WIDTH)]))
    return F.slice(hashes, 1, F.greatest(F.lit(0), F.size(words) - (WIDTH - 1)))


#: What tells rows apart: a doc_id (or none) and the text. Equal rows are decided alike.
KEY = ["no_id", "id", "text_hash"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _whole(raw: Column) -> Column:
    """The hash of a text of fewer than WIDTH words."""
    return F.xxhash64(F.lit("whole"), F.array_join(raw, " "))


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """item (number of a distinct text of an item_id), item_id, raw, words (template), windows."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), marked(F.col(item_text).cast("string")).alias("m"))
    rows = rows.select("item_id", _words(F.col("m")).alias("raw"), _words(template(F.col("m"))).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("windows", F.greatest(F.lit(1), F.size("words") - (WIDTH - 1))).dropDuplicates(["item_id", "raw"])
    return rows.select(F.xxhash64("item_id", F.array_join("raw", " ")).alias("item"), "*")


def _listed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose KEY is in keys, which is broadcast if it has few rows (of 32 bytes)."""
    keys = keys.select(*KEY).distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys.hint("merge"), KEY, "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, windows, matched, slots, consistent, verbatim: what holds, in one alignment,
    PERCENT of an item's windows, with consistent slots or PERCENT of the windows word for word.

    An item of fewer than WIDTH words is matched by documents of just its words. Null texts and texts
    without a word match nothing. Each row is matched by its own text: rows that repeat a doc_id stay apart
    if their texts differ, and a null doc_id is none. Texts of one item_id are each an item; the best
    match is given. Texts of any length count whole. Other columns are ignored. An empty table on either
    side gives no rows."""
    items = tables.written(_items(benchmark, item_col, item_text), "items")
    each = F.when(F.size("words") >= WIDTH, _window_hashes(F.col("words"))).otherwise(F.array(_whole(F.col("raw"))))
    item_windows = tables.written(items.select("item", F.posexplode(each).alias("at", "h")), "item_windows")
    few = item_windows.count() <= MOST_BROADCAST
    sided = lambda df: F.broadcast(df) if few else df.hint("merge")  # noqa: E731  tables of items

    # Which items a row holds enough of, wherever their windows stand.
    rows = _keyed(docs, id_col, text_col)
    found = rows.select(*KEY, marked(F.col("text")).alias("m")).select(*KEY, "m", _words(template(F.col("m"))).alias("words"))
    # No filter on words here: it would be pushed below, and cut the words twice. Texts without any match no item.
    found = found.select(*KEY, F.explode(F.when(F.size("words") >= WIDTH, _window_hashes(F.col("words"))).otherwise(F.array(_whole(_words(F.col("m")))))).alias("h"))
    found = found.join(sided(item_windows), "h").select(*KEY, "item", "at").distinct()
    held = found.groupBy(*KEY, "item").agg(F.count(F.lit(1)).alias("held"))
    known = items.select("item", "item_id", "windows", (F.size("words") < WIDTH).alias("short"))
    held = held.join(sided(known), "item").where(F.col("held") * 100 >= F.col("windows") * PERCENT)
    held = tables.written(held, "held")

    whole = held.where("short").select(*KEY, "item_id", "windows", F.col("held").alias("matched"), *[F.lit(n).alias(c) for c, n in (("slots", 0), ("consistent", 0), ("verbatim", 1))])
    out = _aligned(rows, held.where("NOT short"), sided(items), sided(item_windows)).unionByName(whole)
    measured = ["matched", "verbatim", "consistent", "slots", "windows"]
    best = out.groupBy(*KEY, "item_id").agg(F.max(F.struct(*measured)).alias("best"))
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return best.select(doc_id, "text_hash", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("windows", "matched", "slots", "consistent", "verbatim")])


def _aligned(rows: DataFrame, held: DataFrame, items: DataFrame, item_windows: DataFrame) -> DataFrame:
    """KEY, item_id, windows, matched, slots, consistent, verbatim, for each alignment that counts. items and
    item_windows carry the hint by which they are joined."""
    own = _listed(rows, held).distinct().select(*KEY, marked(F.col("text")).alias("m"))
    own = tables.written(own.select(*KEY, _words(F.col("m")).alias("own"), _words(template(F.col("m"))).alias("template")), "own")
    hits = own.select(*KEY, F.posexplode(_window_hashes(F.col("template"))).alias("place", "h")).join(item_windows, "h")
    hits = tables.written(hits.join(held.select(*KEY, "item", "windows"), [*KEY, "item"]).select(*KEY, "item", "windows", "at", "place").distinct(), "hits")

    # Each held window meets each diagonal; its nearest places before and behind come from sorted runs.
    wanted = hits.select(*KEY, "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    wanted = wanted.join(hits.select(*KEY, "item", "windows", "at").distinct(), [*KEY, "item"])
    spots = wanted.select(*KEY, "item", "windows", "at", (F.col("diagonal") + F.col("at")).alias("spot"), "diagonal", F.lit(None).cast("int").alias("place"))
    both = spots.unionByName(hits.select(*KEY, "item", "windows", "at", F.col("place").alias("spot"), F.lit(None).cast("int").alias("diagonal"), "place"))
    run = Window.partitionBy(*KEY, "item", "at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("before", F.max("place").over(run.orderBy("spot"))).withColumn("behind", F.min("place").over(run.orderBy(F.desc("spot"))))
    behind = F.col("before").isNull() | (F.col("behind") - F.col("spot") < F.col("spot") - F.col("before"))
    near = both.where("diagonal IS NOT NULL").withColumn("near", F.when(behind, F.col("behind")).otherwise(F.col("before")))
    near = near.where(F.abs(F.col("near") - F.col("spot")) <= F.col("windows") + (WIDTH - 1))
    chains = near.groupBy(*KEY, "item", "windows", "diagonal").agg(F.collect_list(F.struct("at", F.col("near").alias("place"))).alias("pairs"))  # one pair for each window of the item at most
    chains = tables.written(chains.where(F.size("pairs") * 100 >= F.col("windows") * PERCENT), "chains")

    # Aligned words under a placeholder, as (kind and item's value, document's value).
    step = F.sequence(F.lit(0), F.lit(WIDTH - 1))
    slots = F.flatten(F.transform("pairs", lambda p: F.transform(step, lambda k: F.struct(
        F.concat(F.get("words", p["at"] + k), F.get("raw", p["at"] + k)).alias("value"), F.get("own", p["place"] + k).alias("other"),
        F.get("words", p["at"] + k).isin("#", "@", "~").alias("slot")))))
    same = F.size(F.filter("pairs", lambda p: F.forall(step, lambda k: F.get("raw", p["at"] + k) == F.get("own", p["place"] + k))))
    chains = chains.join(items.select("item", "item_id", "raw", "words"), "item").join(own.select(*KEY, "own"), KEY)
    chains = chains.select(*KEY, "item_id", "windows", F.size("pairs").alias("matched"), same.alias("verbatim"), F.array_distinct(F.filter(slots, lambda s: s["slot"])).alias("found"))
    values = F.array_distinct(F.transform("found", lambda s: s["value"]))
    # A value is consistent if it stands for one value only.
    chains = chains.withColumn("values", values)
    steady = F.size(F.filter("values", lambda v: F.size(F.filter("found", lambda s: s["value"] == v)) == 1))
    out = chains.select(*KEY, "item_id", "windows", "matched", F.size("values").alias("slots"), steady.alias("consistent"), "verbatim")
    return out.where((F.col("slots") == F.col("consistent")) | (F.col("verbatim") * 100 >= F.col("windows") * PERCENT))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document (rows of one doc_id and text): doc_id, n_items, item_ids (ascending), matched (windows in all)."""
    m = matches(docs, benchmark)
    ids = F.sort_array(F.collect_set("item_id")).alias("item_ids")  # the items of one text
    return m.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n_items"), ids, F.sum("matched").alias("matched")).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns. Each row is judged by its own text,
    whatever its doc_id; rows with a null or empty text stay. An empty table on either side changes nothing."""
    bad = matches(docs, benchmark).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    bad = tables.written(bad, "contaminated")
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad.hint("merge")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__bad_hash"))
    return docs.join(bad, same, "left_anti")
