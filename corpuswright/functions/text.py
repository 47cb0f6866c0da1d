"""Column builders over text and nested records."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All that a plain split of Unicode text takes for white space.
WHITE = "\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{WHITE}]+"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"
LEAST_CHARS = 100


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def truncate(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def prefix(text: Column, n: int = 8192) -> Column:
    return F.substring(text, 1, n)


def content_hash(text: Column, n: int = 512) -> Column:
    return F.md5(F.concat_ws("|", F.left(text, F.lit(n)), F.right(text, F.lit(n)), F.length(text).cast("string")).cast("binary"))


def _mapped(f: Callable, kind: str, value: Callable = lambda v: v.as_py()) -> Callable[[Column], Column]:
    """f over each value of a column, one after another: of an Arrow batch, no more than one value is a Python object at
    a time. value makes it of an Arrow scalar."""
    made = {"double": pa.float64(), "string": pa.string()}[kind]

    def over(x: pa.Array) -> pa.Array:
        return pa.array((f(value(v)) for v in x), made)

    return lambda c: F.arrow_udf(over, kind)(c)


def _ratio(b: pa.Buffer | None) -> float:
    return len(zlib.compress(b)) / b.size if b is not None and b.size else 0.0


def compression_ratio(text: Column) -> Column:
    """Deflated size over size; 0 for no text."""
    return _mapped(_ratio, "double", lambda v: v.as_buffer())(text)


def netloc(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _shingles(items: Column, width: int, glue: str) -> Column:
    """Runs of width items; all of them as one if they are fewer; none of none."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(width)), glue))
        return F.when(n >= width, many).when(n > 0, F.array(F.array_join(w, glue))).otherwise(F.array().cast("array<string>"))

    # Bound to a variable of its own, items are made once and not again for every run.
    return F.get(F.transform(F.array(items), runs), 0)


def word_shingles(text: Column, width: int = 13) -> Column:
    return _shingles(words(F.lower(text)), width, " ")


def line_shingles(text: Column, width: int = 5) -> Column:
    lines = F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, f"^{SPACE}|{SPACE}$", ""))
    return _shingles(F.filter(lines, lambda x: x != ""), width, "\n")


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def composite_id(language: Column, i: Column) -> Column:
    return F.format_string("%s_%06d", language, i)


def any_keyword(text: Column, stems: tuple[str, ...]) -> Column:
    """Case-insensitive substring of any stem, without word boundaries."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in stems])


def fallback_text(df: DataFrame, names: tuple[str, ...] = ("text", "content", "document", "body")) -> Column:
    here = [F.col(n) for n in names if n in df.columns]
    if not here:
        raise ValueError(f"none of {names} is a column")
    return F.coalesce(*here)


# Request lines and their answers.


def request_line(custom_id: Column, prompt: str, text: Column, model: str, schema_name: str, schema: dict) -> Column:
    """One JSON request for a batch labelling job with a schema for the answer."""
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"),
        F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit(schema_name).alias("name"), F.lit(json.dumps(schema, sort_keys=True)).alias("schema")).alias("json_schema")).alias("response_format"),
    )
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


RESPONSE = "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"


def parse_response(line: Column, answer_schema: str) -> Column:
    """custom_id and the answer; the answer is null for a failed request or an unreadable one."""
    r = F.from_json(line, RESPONSE)
    content = F.get(r["response"]["body"]["choices"], 0)["message"]["content"]
    return F.struct(r["custom_id"].alias("custom_id"), F.when(r["response"]["status_code"] == 200, F.from_json(content, answer_schema)).alias("answer"))


# Training text from nested records. Too short a text is null.


def long_enough(text: Column, least: int = LEAST_CHARS) -> Column:
    return F.when(F.length(text) >= least, text)


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def conversation(messages: Column) -> Column:
    """messages: array<struct<role, content>>."""
    kept = F.filter(messages, lambda m: _given(m["role"]) & _given(m["content"]))
    return long_enough(F.array_join(F.transform(kept, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n"))


def best_answer(question: Column, answers: Column, least: int = 3) -> Column:
    """answers: array<struct<text, pm_score>>; the first of the highest score."""
    top = F.array_max(F.transform(answers, lambda a: F.coalesce(a["pm_score"], F.lit(0))))
    best = F.get(F.filter(answers, lambda a: F.coalesce(a["pm_score"], F.lit(0)) == top), 0)["text"]
    return long_enough(F.when(_given(question) & (top >= least) & _given(best), F.concat(F.lit("QUESTION: "), question, F.lit("\n\nANSWER: "), best)))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")


def function_calling(system: Column, chat: Column) -> Column:
    return long_enough(F.when(_given(system) & _given(chat), F.concat(_stripped(system), F.lit("\n\n"), _stripped(chat))))


def text_to_sql(schema: Column, question: Column, query: Column) -> Column:
    text = F.concat(F.lit("SCHEMA:\n"), _stripped(schema), F.lit("\n\nQUESTION: "), _stripped(question), F.lit("\n\nSQL:\n"), _stripped(query))
    return long_enough(F.when(_given(schema) & _given(question) & _given(query), text))


def _fields(parts: list | None, depth: int) -> list[tuple[str, str]]:
    out = []
    for p in parts or ():
        if p.get("type") == "field" and p.get("name") and p.get("value"):
            out.append((p["name"], p["value"]))
        elif p.get("type") == "section" and depth:
            out.extend(_fields(p.get("has_parts"), depth - 1))
    return out


def _prose(sections: list | None) -> str:
    """Depth first; a heading for each named section that has text, but for an abstract."""
    blocks = []
    for s in sections or ():
        held = [p["value"] if p.get("type") == "paragraph" and p.get("value") else _prose([p]) if p.get("type") == "section" else "" for p in s.get("has_parts") or ()]
        body = "\n".join(x for x in held if x)
        if body:
            blocks.append(f"\n## {s['name']}\n{body}" if s.get("name") not in (None, "", "Abstract") else body)
    return "\n".join(blocks)


def infobox_json(infobox: Column) -> Column:
    """A JSON infobox as one flat JSON object, of which a repeated name's last value stays; null if it has no field."""
    return _mapped(lambda x: json.dumps(dict(f), ensure_ascii=False) if x and (f := _fields(json.loads(x).get("has_parts"), 1)) else None, "string")(infobox)


def sections_text(sections: Column) -> Column:
    """A JSON section tree of any depth as prose."""
    return _mapped(lambda x: _prose(json.loads(x)) or None if x else None, "string")(sections)


def article(name: Column, description: Column, infoboxes: Column, abstract: Column, sections: Column) -> Column:
    """infoboxes: array of flat JSON objects (null ones left out); sections: prose."""
    some = lambda c: F.nullif(c, F.lit(""))
    boxes = F.transform(F.filter(infoboxes, lambda b: b.isNotNull()), lambda b: F.concat(F.lit("\n<infobox>\n"), b, F.lit("\n</infobox>")))
    boxes = F.nullif(F.array_join(F.coalesce(boxes, F.array().cast("array<string>")), "\n"), F.lit(""))
    return long_enough(_stripped(F.concat_ws("\n", F.concat(F.lit("# "), some(name)), some(description), boxes, F.concat(F.lit("\n"), some(abstract)), some(sections))))


#: Extractors by name; add to it to register another.
EXTRACTORS: dict[str, Callable[[DataFrame], Column]] = {
    "structured_wikipedia": lambda df: article(df["name"], df["description"], df["infoboxes"], df["abstract"], df["sections"]),
    "ultrachat": lambda df: conversation(df["messages"]),
    "stackexchange": lambda df: best_answer(df["question"], df["answers"]),
    "glaive_fc": lambda df: function_calling(df["system"], df["chat"]),
    "sqale": lambda df: text_to_sql(df["schema"], df["question"], df["query"]),
}
