"""Every operator as a query over the test tables, each next to the SQL that another engine runs for the same result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from . import tables
from .functions import scores, text
from .operators import dedup, filters, joins, metrics, packing, selection, stats
from .plans import curation, scoring
from .sources import readers, tkds, writers

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(f"`{c}`").cast("double").alias(c) if t == "float" else F.col(f"`{c}`") for c, t in df.dtypes])

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hashed_scores(_docs(spark, sf_dir))


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.web_meta(_scored(spark, sf_dir))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.code_meta(_scored(spark, sf_dir))


# SQL shared by the oracles.


def _h(name: str) -> str:
    return f"(('0x' || substr(md5(doc_id || ':{name}'), 1, 8))::BIGINT % 1000)"


def _part(name: str, low: float, span: float) -> str:
    return f"CAST({low}::DOUBLE + {_h(name)}::DOUBLE * {span}::DOUBLE / 999.0::DOUBLE AS FLOAT)"


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_TS = "list_transform(list_transform(range(0, 17), lambda i: ('0x' || substr(md5(doc_id || ':' || i), 1, 8))::BIGINT % 1000), lambda h: CAST(CAST(h * h * h AS DOUBLE) / 1e9::DOUBLE AS FLOAT))"
META = f"""meta AS (SELECT *, n_chars // 4 AS token_count, source AS dump, {_TS} AS ts, {_part("complexity", 1.0, 3.0)} AS complexity, {_part("quality", 1.0, 4.0)} AS quality,
 {_part("structured_data", 0.0, 3.0)} AS structured_data, ({_list(C.CONTENT_TYPES)})[1 + {_h("content_type")} % {len(C.CONTENT_TYPES)}] AS content_type,
 ({_list(scoring.CODE_LANGUAGES)})[1 + {_h("code_lang")} % {len(scoring.CODE_LANGUAGES)}] AS code_lang FROM documents)"""


def _group_hit(labels: tuple[int, ...], t: str = "0.3") -> str:
    return "(" + " OR ".join(f"ts[{i + 1}] >= {t}::FLOAT" for i in labels) + ")"


_ACTIVE = "len(list_filter(ts, lambda x: x >= 0.3::FLOAT))"
_CBIN = "CASE WHEN complexity >= 3.25::FLOAT THEN 'L4' WHEN complexity >= 2.5::FLOAT THEN 'L3' WHEN complexity >= 1.75::FLOAT THEN 'L2' ELSE 'L1' END"
_SDBIN = "CASE WHEN structured_data >= 2.5::FLOAT THEN 'SD3' WHEN structured_data >= 1.5::FLOAT THEN 'SD2' WHEN structured_data >= 0.5::FLOAT THEN 'SD1' ELSE 'SD0' END"
_REL = f"(greatest(ts[1], ts[2], ts[3])::DOUBLE + least({_ACTIVE} * 0.05::DOUBLE, 0.15::DOUBLE) + CAST(complexity * 0.1::FLOAT AS DOUBLE))"
_GROUPS = "list_filter([" + ", ".join(f"CASE WHEN {_group_hit(ls)} THEN '{g}' END" for g, ls, _, _ in C.GROUPS) + "], lambda x: x IS NOT NULL)"
WEB = META + f", web AS (SELECT *, {_GROUPS} AS groups, {_CBIN} AS cbin, {_REL} AS relevance FROM meta WHERE list_max(ts) >= 0.3::FLOAT AND token_count BETWEEN 50 AND 100000)"
_CREL = "(CAST(structured_data / 3.0::FLOAT AS FLOAT)::DOUBLE + CASE WHEN quality >= 3.5::FLOAT THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"
_SLICE = "CASE lower(code_lang) " + " ".join(f"WHEN '{lang}' THEN '{s}'" for lang, s in C.slice_languages().items() if lang in {x.lower() for x in scoring.CODE_LANGUAGES}) + " END"
CODE = META + f", code AS (SELECT *, {_SLICE} AS language_slice, {_CREL} AS relevance FROM meta)"
_HASH = "md5(doc_id || ':42')"
_WORDS = f"list_filter(string_split_regex({{}}, '{text.SPACE}'), lambda w: w <> '')"


def _meta(select: str) -> str:
    return f"WITH {META} {select}"


def _w(select: str) -> str:
    return f"WITH {WEB} {select}"


def _c(select: str) -> str:
    return f"WITH {CODE} {select}"


# Scans.


@query("SELECT doc_id, lang FROM documents")
def scan_projection(spark, d):
    return readers.scan(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


@query("SELECT doc_id, n_chars FROM documents WHERE source IN ('src0', 'src3')")
def scan_pushdown_source(spark, d):
    return readers.scan(spark, f"{d}/documents.parquet", ["doc_id", "n_chars"], ["src0", "src3"], "source")


@query("SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS BIGINT) AS turn FROM documents")
def scan_interleaved_lang(spark, d):
    return selection.interleaved(_docs(spark, d).select("doc_id", "lang"), "lang", 50)


@query("SELECT doc_id AS id, text AS body, lang FROM documents UNION ALL SELECT page_id, html, NULL FROM pages")
def multi_read_union(spark, d):
    return joins.union_of(_docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("body"), "lang"), _table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body")))


@query("""WITH f AS (SELECT source AS path, lang AS part, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY source, lang),
r AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY part ORDER BY md5(path || ':42'), path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM f)
SELECT * FROM r WHERE before < 20000""")
def early_stop_scan(spark, d):
    files = _docs(spark, d).groupBy(F.col("source").alias("path"), F.col("lang").alias("part")).agg(F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens"))
    return readers.early_stop(files, "part", F.lit(10_000))


@query("SELECT count(*) AS n FROM documents")
def footer_row_count(spark, d):
    return spark.createDataFrame([(readers.row_count(_docs(spark, d)),)], "n long")


@query("SELECT doc_id, coalesce(nullif(n_chars, 1000), 0) AS token_count FROM documents")
def scan_null_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(F.nullif("n_chars", F.lit(1000)), F.lit(0)).alias("token_count"))


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_HASH}, doc_id) AS r FROM documents) WHERE r <= 25")
def balanced_sample_per_lang(spark, d):
    return selection.sample_per_key(_docs(spark, d).select("doc_id", "lang"), "lang", 25)


@query(f"SELECT doc_id FROM documents ORDER BY {_HASH}, doc_id LIMIT 100")
def reservoir_sample(spark, d):
    return selection.sample(_docs(spark, d).select("doc_id"), 100)


# Expressions.


@query(_meta("SELECT doc_id, CAST(list_max(ts) AS DOUBLE) AS best, CAST(greatest(ts[1], ts[2], ts[3]) AS DOUBLE) AS stem FROM meta"))
def max_score(spark, d):
    ts = F.col("topic_scores")
    return _scored(spark, d).select("doc_id", scores.max_score(ts).alias("best"), scores.stem_core(ts).alias("stem"))


@query(_meta(f"SELECT doc_id, {_ACTIVE} AS n, least({_ACTIVE} * 0.05::DOUBLE, 0.15::DOUBLE) AS bonus FROM meta"))
def active_labels(spark, d):
    n = scores.active_labels(F.col("topic_scores"))
    return _scored(spark, d).select("doc_id", n.alias("n"), scores.multi_label_bonus(n).alias("bonus"))


@query(_meta(f"SELECT doc_id, round({_REL}, 6) AS relevance FROM meta"))
def relevance_web(spark, d):
    return _scored(spark, d).select("doc_id", F.round(scores.web_relevance(F.col("topic_scores"), F.col("complexity")), 6).alias("relevance"))


@query(_meta(f"SELECT doc_id, round({_CREL}, 6) AS relevance FROM meta"))
def relevance_code(spark, d):
    return _scored(spark, d).select("doc_id", F.round(scores.code_relevance(F.col("structured_data"), F.col("quality")), 6).alias("relevance"))


@query(_meta(f"SELECT doc_id, array_to_string({_GROUPS}, ',') AS groups FROM meta"))
def assign_groups(spark, d):
    return _scored(spark, d).select("doc_id", F.array_join(scores.assigned_groups(F.col("topic_scores")), ",").alias("groups"))


@query(_meta(f"SELECT doc_id, {_CBIN} AS bin FROM meta"))
def complexity_bins(spark, d):
    return _scored(spark, d).select("doc_id", scores.complexity_bin(F.col("complexity")).alias("bin"))


@query(_meta(f"SELECT doc_id, {_SDBIN} AS bin FROM meta"))
def sd_bins(spark, d):
    return _scored(spark, d).select("doc_id", scores.sd_bin(F.col("structured_data")).alias("bin"))


@query(_meta("SELECT doc_id, CASE WHEN content_type IN ('library', 'application', 'script', 'test') THEN content_type ELSE 'low_value' END AS content_group FROM meta"))
def content_group(spark, d):
    return _scored(spark, d).select("doc_id", scores.content_group(F.col("content_type")).alias("content_group"))


@query(_c("SELECT doc_id, language_slice FROM code"))
def language_slices(spark, d):
    return _code(spark, d).select("doc_id", "language_slice")


@query(_meta(f"SELECT doc_id, ({_list(C.TOPIC_LABELS)})[list_position(ts, list_max(ts))] AS label FROM meta"))
def argmax_label(spark, d):
    return _scored(spark, d).select("doc_id", scores.argmax_name(F.col("topic_scores"), C.TOPIC_LABELS).alias("label"))


_SIG = "list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE)))"


@query(f"SELECT vec_id, round(list_sum({_SIG}), 5) AS total FROM embeddings")
def sigmoid_scores(spark, d):
    s = scores.sigmoid(F.col("embedding"))
    return _table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(s, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"SELECT vec_id, round(list_max({_SIG}) * 4.0::DOUBLE, 5) AS complexity FROM embeddings")
def approx_complexity(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.round(scores.approx_complexity(scores.sigmoid(F.col("embedding"))), 5).alias("complexity"))


@query(f"SELECT vec_id, len(list_filter({_SIG}, lambda p: p > 0.5)) AS hot FROM embeddings")
def multi_hot(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.size(F.filter(scores.multi_hot(scores.sigmoid(F.col("embedding"))), lambda x: x)).alias("hot"))


@query(_meta("SELECT doc_id, CAST(greatest(1, least(5, round_even(quality::DOUBLE, 0))) AS BIGINT) AS quality_level, CAST(greatest(0, least(3, round_even(structured_data::DOUBLE, 0))) AS BIGINT) AS sd_level FROM meta"))
def round_clip_levels(spark, d):
    return _scored(spark, d).select("doc_id", scores.level(F.col("quality"), 1, 5).alias("quality_level"), scores.level(F.col("structured_data"), 0, 3).alias("sd_level"))


@query("SELECT doc_id, n_chars // 4 AS tokens FROM documents")
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", scores.token_estimate(F.col("n_chars")).alias("tokens"))


@query("SELECT doc_id, strlen(text) AS bytes FROM documents")
def utf8_bytes(spark, d):
    return _docs(spark, d).select("doc_id", text.utf8_bytes(F.col("text")).alias("bytes"))


@query(f"SELECT doc_id, len({_WORDS.format('text')}) AS words FROM documents")
def word_count(spark, d):
    return _docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS cut, substr(text, 1, 100) AS head FROM documents")
def truncate_ellipsis(spark, d):
    return _docs(spark, d).select("doc_id", text.truncate(F.col("text"), 300).alias("cut"), text.prefix(F.col("text"), 100).alias("head"))


@query("SELECT doc_id, md5(left(text, 512) || '|' || right(text, 512) || '|' || length(text)) AS hash FROM documents")
def content_hash(spark, d):
    return _docs(spark, d).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN n_chars // 4 <= {b} THEN {b}" for b in C.PAD_BUCKETS_WEB) + " ELSE 512 END AS bucket FROM documents")
def pad_bucket(spark, d):
    return _docs(spark, d).select("doc_id", scores.pad_bucket(scores.token_estimate(F.col("n_chars"))).alias("bucket"))


@query()
def zlib_ratio_filter(spark, d):
    return filters.compressible(_docs(spark, d).select("doc_id", "text"), "text").select("doc_id")


@query(r"SELECT nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS domain, CAST(sum(strlen(html) // 4) AS BIGINT) AS tokens FROM pages WHERE domain IS NOT NULL GROUP BY domain ORDER BY tokens DESC, domain LIMIT 20")
def url_domain_tokens(spark, d):
    pages = _table(spark, d, "pages").select(text.netloc(F.col("url")).alias("domain"), F.floor(F.octet_length("html") / 4).alias("token_count")).where("domain IS NOT NULL")
    return stats.top(pages, "domain", 20, "tokens").select("domain", "tokens")


def _shingle_sql(words: str, n: int, glue: str) -> str:
    return f"CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], {glue})) WHEN len(w) > 0 THEN [array_to_string(w, {glue})] ELSE [] END"


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_shingle_sql('w', 13, chr(39) + ' ' + chr(39))} AS s FROM (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents))")
def word_shingles(spark, d):
    s = _docs(spark, d).select("doc_id", text.word_shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_shingle_sql('w', 5, 'chr(10)')} AS s FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS w FROM documents))")
def line_shingles(spark, d):
    s = _docs(spark, d).select("doc_id", text.line_shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("SELECT doc_id, lang || '_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS id FROM documents")
def composite_ids(spark, d):
    return _docs(spark, d).select("doc_id", text.composite_id(F.col("lang"), F.col("doc_id")).alias("id"))


_STEPS = "(SELECT CAST(range AS BIGINT) AS step FROM range(0, 1000))"


@query(f"SELECT step, round(CASE WHEN step < 100 THEN 0.0006::DOUBLE * (step + 1) / 100 WHEN step >= 1000 THEN 0.00006 ELSE 0.00006::DOUBLE + 0.00054::DOUBLE * 0.5 * (1 + cos(3.141592653589793::DOUBLE * (step - 100) / 900.0)) END * 1e6) AS micro_lr, round(exp(least(step / 40.0::DOUBLE, 20.0)), 2) AS perplexity FROM {_STEPS}")
def lr_schedule(spark, d):
    steps = spark.range(1000).select(F.col("id").alias("step"))
    return steps.select("step", F.round(scores.cosine_lr(F.col("step"), 0.0006, 0.00006, 100, 1000) * 1e6).alias("micro_lr"), F.round(scores.perplexity(F.col("step") / 40.0), 2).alias("perplexity"))


@query("SELECT b.x AS batch, w.x AS workers, s.x AS static, g.x AS graph, CAST(20000000000 // (b.x * 2048 * 4) AS BIGINT) AS steps FROM (VALUES (256), (512), (1024)) b(x), (VALUES (2), (4)) w(x), (VALUES (true), (false)) s(x), (VALUES (true), (false)) g(x) WHERE s.x OR NOT g.x")
def grid_configs(spark, d):
    grid = spark.range(0, 1, 1, 1).select()  # one row in one partition: cross joins would multiply partitions
    for name, values in (("batch", (256, 512, 1024)), ("workers", (2, 4)), ("static", (True, False)), ("graph", (True, False))):
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid.where("static OR NOT graph").withColumn("steps", F.expr("20000000000L div (batch * 2048L * 4)"))


# Requests and answers.

_SCHEMA = {"type": "object", "properties": {"quality": {"type": "integer"}}}


@query("SELECT 'd' || doc_id AS custom_id, 'POST' AS method, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS content FROM documents")
def request_lines(spark, d):
    line = text.request_line(F.concat(F.lit("d"), "doc_id"), "Rate it.", text.truncate(F.col("text"), 200), "labeller", "rating", _SCHEMA)
    parsed = F.from_json(line, "custom_id string, method string, body struct<messages:array<struct<role:string,content:string>>>")
    return _docs(spark, d).select(parsed.alias("r")).select("r.custom_id", "r.method", F.get("r.body.messages", 1)["content"].alias("content"))


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 5 AS BIGINT) ELSE -1 END AS quality FROM events")
def parse_responses(spark, d):
    content = F.to_json(F.struct((F.col("event_id") % 5).alias("quality")))
    status = F.when(F.col("event_id") % 7 == 0, 500).otherwise(200)
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("custom_id"), F.struct(status.alias("status_code"), F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    r = text.parse_response(line, "quality long")
    return _table(spark, d, "events").select(r.alias("r")).select(F.col("r.custom_id").cast("long").alias("event_id"), F.coalesce("r.answer.quality", F.lit(-1)).alias("quality"))


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT lang AS part, strlen(text) + 1 AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
walk(part, k, file, size) AS (SELECT part, k, 0::BIGINT, n FROM l WHERE k = 1 UNION ALL SELECT l.part, l.k, CASE WHEN size + n > 500000 THEN file + 1 ELSE file END, CASE WHEN size + n > 500000 THEN n ELSE size + n END FROM walk JOIN l ON l.part = walk.part AND l.k = walk.k + 1)
SELECT part, file, count(*) AS lines, CAST(sum(n) AS BIGINT) AS bytes FROM walk JOIN l USING (part, k) GROUP BY part, file""")
def request_files(spark, d):
    lines = _docs(spark, d).select(F.format_string("%012d", "doc_id").alias("custom_id"), F.col("text").alias("line"), "lang")
    return writers.request_files(lines, 500_000, "lang").groupBy("part", "file").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))


@query("SELECT CAST(doc_id AS VARCHAR) AS custom_id, CAST((sum(strlen(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 500000 AS BIGINT) AS file FROM documents")
def request_files_by_bytes(spark, d):
    lines = _docs(spark, d).select("doc_id", F.col("text").alias("line"), F.col("lang").alias("part"))
    return writers.running_files(lines, 500_000, "doc_id").select(F.col("doc_id").cast("string").alias("custom_id"), "file")


# Nested text.

_ARTICLES = [
    {"name": "Tide", "description": "Rise and fall of sea levels", "abstract": "Tides are long waves.", "infobox": {"has_parts": [{"type": "section", "has_parts": [{"type": "field", "name": "period", "value": "12 h"}, {"type": "field", "name": "period", "value": "12.4 h"}]}, {"type": "field", "name": "cause", "value": "Moon"}]},
     "sections": [{"name": "Abstract", "has_parts": [{"type": "paragraph", "value": "Water moves."}]}, {"name": "Causes", "has_parts": [{"type": "paragraph", "value": "The moon pulls at the oceans."}, {"type": "section", "name": "Sun", "has_parts": [{"type": "paragraph", "value": "The sun pulls too."}]}]}]},
    {"name": "", "description": None, "abstract": None, "infobox": {"has_parts": []}, "sections": []},
]


def _articles(spark: SparkSession) -> DataFrame:
    rows = [(i, a["name"], a["description"], a["abstract"], json.dumps(a["infobox"]), json.dumps(a["sections"])) for i, a in enumerate(_ARTICLES)]
    return spark.createDataFrame(rows, "id long, name string, description string, abstract string, infobox string, sections string")


@query()
def article_text(spark, d):
    a = _articles(spark).withColumns({"infoboxes": F.array(text.infobox_json(F.col("infobox"))), "sections": text.sections_text(F.col("sections"))})
    return a.select("id", text.EXTRACTORS["structured_wikipedia"](a).alias("article"), F.get("infoboxes", 0).alias("box"), "sections")


@query("SELECT conv_id, CASE WHEN length(t) >= 100 THEN t END AS dialogue FROM (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role <> '' AND text <> '') AS t FROM conversations GROUP BY conv_id)")
def conversation_text(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return _table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("messages")).select("conv_id", text.conversation(F.col("messages")).alias("dialogue"))


@query("""WITH a AS (SELECT conv_id, text, CAST((conv_id + turn) % 6 AS BIGINT) AS pm_score, turn FROM conversations WHERE role = 'assistant'),
q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
b AS (SELECT conv_id, arg_min(text, -pm_score * 1000000 + turn) AS answer, max(pm_score) AS best FROM a GROUP BY conv_id)
SELECT conv_id, CASE WHEN best >= 3 AND length('QUESTION: ' || question || chr(10) || chr(10) || 'ANSWER: ' || answer) >= 100 THEN 'QUESTION: ' || question || chr(10) || chr(10) || 'ANSWER: ' || answer END AS qa FROM q JOIN b USING (conv_id)""")
def best_answer(spark, d):
    conv = _table(spark, d, "conversations")
    answers = conv.where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", ((F.col("conv_id") + F.col("turn")) % 6).alias("pm_score")))).alias("answers"))
    asked = conv.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return asked.join(answers, "conv_id").select("conv_id", text.best_answer(F.col("question"), F.col("answers")).alias("qa"))


@query(r"SELECT doc_id, CASE WHEN length(t) >= 100 THEN t END AS prompt FROM (SELECT doc_id, trim(lang) || chr(10) || chr(10) || regexp_replace(regexp_replace(text, '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+$', '') AS t FROM documents)")
def fc_text(spark, d):
    return _docs(spark, d).select("doc_id", text.function_calling(F.col("lang"), F.col("text")).alias("prompt"))


@query("SELECT doc_id, CASE WHEN length(t) >= 100 THEN t END AS prompt FROM (SELECT doc_id, 'SCHEMA:' || chr(10) || lang || chr(10) || chr(10) || 'QUESTION: ' || source || chr(10) || chr(10) || 'SQL:' || chr(10) || 'SELECT ' || n_chars || repeat(' + 1', 20) AS t FROM documents)")
def sql_text(spark, d):
    return _docs(spark, d).select("doc_id", text.text_to_sql(F.col("lang"), F.col("source"), F.concat(F.lit("SELECT "), F.col("n_chars").cast("string"), F.lit(" + 1" * 20))).alias("prompt"))


# Gates.


@query(_meta("SELECT doc_id FROM meta WHERE list_max(ts) >= 0.3::FLOAT AND token_count BETWEEN 50 AND 100000"))
def quality_gate_web(spark, d):
    return filters.web_quality_gate(_scored(spark, d)).select("doc_id")


@query(_meta("SELECT count(*) AS total, count(*) FILTER (NOT list_max(ts) >= 0.3::FLOAT) AS ambiguous, count(*) FILTER (token_count < 50) AS too_short, count(*) FILTER (token_count > 100000) AS too_long, count(*) FILTER (list_max(ts) >= 0.3::FLOAT AND token_count BETWEEN 50 AND 100000) AS kept FROM meta"))
def quality_gate_counts(spark, d):
    return filters.drop_counts(_scored(spark, d), filters.web_gate_parts(F.col("topic_scores"), F.col("token_count")))


@query(_meta("SELECT doc_id FROM meta WHERE quality > 1.5::FLOAT AND token_count BETWEEN 20 AND 100000"))
def quality_gate_code(spark, d):
    return filters.code_quality_gate(_scored(spark, d)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in ("ment", "tion or", "struct")))
def keyword_filter(spark, d):
    return _docs(spark, d).where(text.any_keyword(F.col("text"), ("ment", "tion or", "struct"))).select("doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality IN (1)")
def drop_invalid_labels(spark, d):
    return filters.valid_levels(_table(spark, d, "labels"), "quality", (1,))


@query(_meta("SELECT doc_id, CASE WHEN content_type IN ('library', 'other') THEN content_type ELSE content_type END AS content_type, CAST(round_even(quality::DOUBLE, 0) AS BIGINT) AS quality FROM meta WHERE round_even(quality::DOUBLE, 0) <> 0"))
def valid_code_labels(spark, d):
    return filters.valid_code_labels(_scored(spark, d).select("doc_id", "content_type", scores.level(F.col("quality"), 0, 5).alias("quality")))


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src2')")
def allowed_values(spark, d):
    return filters.allowed_values(_docs(spark, d), {"lang": ["en", "de"], "source": ["src1", "src2"]}).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def head_rows(spark, d):
    return filters.head(_docs(spark, d).select("doc_id"), 50)


# Joins.


@query("""WITH k AS (SELECT md5(left(text, 512) || '|' || right(text, 512) || '|' || length(text)) AS h, max_by(lang, list_position(['fr', 'de', 'es', 'en'], lang)) AS known FROM documents WHERE lang IN ('fr', 'de', 'es', 'en') GROUP BY h),
s AS (SELECT doc_id, text, CASE WHEN n_chars % 2 = 0 THEN 'unknown' ELSE lang END AS lang FROM documents)
SELECT doc_id, CASE WHEN lang = 'unknown' AND length(text) > 0 THEN coalesce(known, lang) ELSE lang END AS lang FROM s LEFT JOIN k ON h = md5(left(text, 512) || '|' || right(text, 512) || '|' || length(text))""")
def repair_lang(spark, d):
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("content"), "lang", "n_chars")
    shards = docs.withColumn("lang", F.when(F.col("n_chars") % 2 == 0, "unknown").otherwise(F.col("lang")))
    return joins.repair_language(shards, docs, ("fr", "de", "es", "en")).select("doc_id", "lang")


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def label_left_merge(spark, d):
    return joins.merge_with_defaults(_docs(spark, d).select("doc_id"), _table(spark, d, "labels"), "doc_id", {"quality": 0, "toxic": 0})


@query("WITH r AS (SELECT doc_id % 300 AS k, doc_id, doc_id // 100 AS g FROM documents) SELECT k, doc_id, g, quality, toxic FROM r JOIN (SELECT doc_id AS k, quality, toxic FROM labels) USING (k) QUALIFY g = min(g) OVER (PARTITION BY k)")
def label_semi_merge(spark, d):
    rows = _docs(spark, d).select((F.col("doc_id") % 300).alias("k"), "doc_id", F.floor(F.col("doc_id") / 100).alias("g"))
    return joins.merge_matched(rows, _table(spark, d, "labels").withColumnRenamed("doc_id", "k"), "k", "g")


@query("WITH r AS (SELECT doc_id % 300 AS k, doc_id, CAST(-1 AS BIGINT) AS quality FROM documents) SELECT r.k, r.doc_id, CASE WHEN r.doc_id = max(r.doc_id) OVER (PARTITION BY r.k) THEN coalesce(l.quality, r.quality) ELSE r.quality END AS quality FROM r LEFT JOIN labels l ON l.doc_id = r.k")
def label_update(spark, d):
    rows = _docs(spark, d).select((F.col("doc_id") % 300).alias("k"), "doc_id", F.lit(-1).cast("long").alias("quality"))
    return joins.update(rows, _table(spark, d, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("long")), "k", "doc_id", ["quality"])


@query(_w("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM web WHERE cbin = 'L3')"))
def late_materialise(spark, d):
    return joins.full_rows(_docs(spark, d).select("doc_id", "text"), _web(spark, d).where("cbin = 'L3'"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def resume_anti_join(spark, d):
    return joins.not_done(_docs(spark, d).select("doc_id", "source"), spark.createDataFrame([("src1",), ("src2",)], "source string"), "source")


# Distributions.

_AG = "SELECT unnest(groups) AS topic_group, * FROM web"
_DIM = "(VALUES " + ", ".join(f"('{g[0]}')" for g in C.GROUPS) + ") dim(topic_group)"


@query(_w(f"SELECT topic_group, count(token_count) AS docs, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM {_DIM} LEFT JOIN (SELECT unnest(groups) AS topic_group, token_count FROM web) USING (topic_group) GROUP BY topic_group"))
def group_distribution(spark, d):
    return stats.by_group(_web(spark, d))


@query(_w(" UNION ALL ".join(f"SELECT '{n}' AS label, count(*) FILTER (ts[{i + 1}] >= 0.3::FLOAT) AS docs, round(count(*) FILTER (ts[{i + 1}] >= 0.3::FLOAT) * 100.0::DOUBLE / count(*), 4) AS pct FROM web" for i, n in enumerate(C.TOPIC_LABELS))))
def label_distribution(spark, d):
    return stats.by_label(_web(spark, d))


@query(_w("SELECT b.cbin, count(doc_id) AS docs, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, round(coalesce(sum(token_count), 0) * 100.0::DOUBLE / (SELECT sum(token_count) FROM web), 4) AS pct, round(any_value(b.share) * 1000000.0::DOUBLE, 4) AS target FROM (VALUES " + ", ".join(f"('{b[0]}', {b[3]}::DOUBLE)" for b in C.COMPLEXITY_BINS) + ") b(cbin, share) LEFT JOIN web USING (cbin) GROUP BY b.cbin"))
def bin_distribution(spark, d):
    return stats.by_bin(_web(spark, d), 1_000_000)


def _ml(t: float) -> str:
    n = f"len(list_filter(ts, lambda x: x >= {t}::FLOAT))"
    share = lambda c: f"round(avg(CASE WHEN {c} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4)"
    return f"SELECT {t}::DOUBLE AS threshold, round(avg({n}), 4) AS mean_labels, {share(n + ' = 0')} AS pct_0, {share(n + ' = 1')} AS pct_1, {share(n + ' >= 2')} AS pct_2plus, {share(n + ' >= 3')} AS pct_3plus FROM meta"


_THRESHOLDS = [round(0.1 + 0.05 * k, 2) for k in range(13)]


@query(_meta(_ml(0.3)))
def multilabel_stats(spark, d):
    return stats.multi_label(_scored(spark, d), [0.3])


@query(_meta(" UNION ALL ".join(_ml(t) for t in _THRESHOLDS)))
def multilabel_by_threshold(spark, d):
    return stats.multi_label(_scored(spark, d), _THRESHOLDS)


@query(_meta(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, '{g}' AS topic_group, count(*) FILTER ({_group_hit(ls, str(t))}) AS docs FROM meta" for t in (0.3, 0.4, 0.5) for g, ls, _, _ in C.GROUPS)))
def group_by_threshold(spark, d):
    return stats.groups_by_threshold(_scored(spark, d), [0.3, 0.4, 0.5])


_HOT = "hot AS (SELECT doc_id, i FROM (SELECT doc_id, ts, unnest(range(0, 17)) AS i FROM web) WHERE ts[i + 1] >= 0.3::FLOAT)"
_PAIRS = "pairs AS (SELECT a.i, b.i AS j, count(*) AS docs FROM hot a JOIN hot b USING (doc_id) GROUP BY a.i, b.i)"
_CELLS = "cells AS (SELECT i, j, coalesce(docs, 0) AS docs FROM (SELECT x.range AS i, y.range AS j FROM range(0, 17) x, range(0, 17) y) LEFT JOIN pairs USING (i, j))"


@query(f"WITH {WEB}, {_HOT}, {_PAIRS}, {_CELLS} SELECT * FROM cells")
def label_overlap(spark, d):
    return stats.co_occurrence(_web(spark, d))


@query(f"WITH {WEB}, {_HOT}, {_PAIRS}, {_CELLS} SELECT c.i, c.j, round(c.docs / (CASE WHEN s.docs = 0 THEN 1 ELSE s.docs END)::DOUBLE, 6) AS rate FROM cells c JOIN cells s ON s.i = c.i AND s.j = c.i")
def label_overlap_rate(spark, d):
    return stats.co_occurrence_rates(stats.co_occurrence(_web(spark, d)))


@query(_meta(" UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr(ts[{i + 1}]::DOUBLE, ts[{j + 1}]::DOUBLE), 6) AS corr FROM meta" for i in range(len(C.TOPIC_LABELS)) for j in range(i + 1, len(C.TOPIC_LABELS)))).replace("meta AS (", "meta AS MATERIALIZED ("))
def label_correlation(spark, d):
    return stats.correlations(_scored(spark, d), "topic_scores", len(C.TOPIC_LABELS))


def _pivot_sql(value: str) -> str:
    cells = ", ".join(f"CAST(coalesce(sum({value}) FILTER (cbin = '{b[0]}'), 0) AS BIGINT) AS {b[0]}" for b in C.COMPLEXITY_BINS)
    return _w(f"SELECT topic_group, {cells} FROM ({_AG}) GROUP BY topic_group")


@query(_pivot_sql("token_count"))
def topic_complexity_tokens(spark, d):
    return stats.group_by_bin(_web(spark, d), F.col("token_count"))


@query(_pivot_sql("1"))
def topic_complexity_counts(spark, d):
    return stats.group_by_bin(_web(spark, d), F.lit(1).cast("long"))


@query(_w(f"SELECT topic_group, cbin, count(*) AS docs FROM ({_AG}) GROUP BY CUBE (topic_group, cbin)"))
def heatmap_totals(spark, d):
    return stats.totals(_web(spark, d).select(F.explode("assigned_groups").alias("topic_group"), "cbin"), "topic_group", "cbin")


@query(_w(f"SELECT topic_group, cbin, count(*) AS docs FROM ({_AG}) GROUP BY topic_group, cbin ORDER BY docs, topic_group, cbin LIMIT 5"))
def heatmap_bottom_cells(spark, d):
    cells = stats.contingency(_web(spark, d).select(F.explode("assigned_groups").alias("topic_group"), "cbin"), "topic_group", "cbin")
    return cells.orderBy("docs", "topic_group", "cbin").limit(5)


@query(_w(f"SELECT topic_group, cbin, count(*) AS docs FROM ({_AG}) GROUP BY topic_group, cbin ORDER BY docs DESC, topic_group, cbin LIMIT 10"))
def heatmap_top_cells(spark, d):
    cells = stats.contingency(_web(spark, d).select(F.explode("assigned_groups").alias("topic_group"), "cbin"), "topic_group", "cbin")
    return cells.orderBy(F.desc("docs"), "topic_group", "cbin").limit(10)


@query(_meta("SELECT " + ", ".join(f"CAST(trunc(quantile_cont(token_count, {p})) AS BIGINT) AS p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(avg(token_count), 4) AS mean FROM meta"))
def token_percentiles(spark, d):
    return stats.percentiles(_scored(spark, d), "token_count")


@query(_meta("SELECT round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) AS median, round(min(c), 6) AS low, round(max(c), 6) AS high, round(stddev_samp(c), 6) AS sample_std FROM (SELECT complexity::DOUBLE AS c FROM meta)"))
def score_moments(spark, d):
    return stats.moments(_scored(spark, d), "complexity")


@query(_meta("SELECT CAST(least(49, floor((c - 1.0::DOUBLE) / (3.0::DOUBLE / 50))) AS BIGINT) AS bin, count(*) AS docs FROM (SELECT complexity::DOUBLE AS c FROM meta) WHERE c BETWEEN 1.0 AND 4.0 GROUP BY bin"))
def score_histogram(spark, d):
    return stats.histogram(_scored(spark, d), "complexity", 1.0, 4.0, 50)


@query("SELECT lang, count(*) AS docs, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang ORDER BY tokens DESC, lang LIMIT 25")
def top_langs(spark, d):
    return stats.top(_scored(spark, d), "lang", 25, "tokens")


@query("SELECT source, count(*) AS docs, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY source ORDER BY docs DESC, source LIMIT 5")
def top_sources(spark, d):
    return stats.top(_scored(spark, d), "source", 5)


_GOALS = {name: 10_000 * (k + 1) for k, (name, *_) in enumerate(C.SLICES)}


@query(_c("SELECT g.language_slice, any_value(g.target) AS target, count(doc_id) AS docs, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, round(avg(quality::DOUBLE), 4) AS mean_quality, round(avg(structured_data::DOUBLE), 4) AS mean_structured_data FROM (VALUES " + ", ".join(f"('{k}', {v}::BIGINT)" for k, v in _GOALS.items()) + ") g(language_slice, target) LEFT JOIN code USING (language_slice) GROUP BY g.language_slice"))
def slice_distribution(spark, d):
    return stats.slice_report(_code(spark, d), _GOALS)


@query(_w(f"SELECT topic_group, count(*) AS docs, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM web), 4) AS pct_docs, round(count(*) * 100.0::DOUBLE / (SELECT sum(len(groups)) FROM web), 4) AS pct_assigned FROM ({_AG}) GROUP BY topic_group"))
def group_shares(spark, d):
    return stats.shares_of_groups(_web(spark, d))


_SUMMARY_AT = [0.2, 0.3, 0.4]


@query(_meta("SELECT count(*) AS docs, CAST(sum(token_count) AS BIGINT) AS all_tokens, CAST(trunc(quantile_cont(token_count, 0.5)) AS BIGINT) AS median_tokens, round(avg(complexity::DOUBLE), 6) AS mean_complexity, count(*) FILTER (ts[1] >= 0.3::FLOAT) AS first_label, round(avg(len(list_filter(ts, lambda x: x >= 0.3::FLOAT))), 4) AS mean_labels FROM meta"))
def run_summary(spark, d):
    one = stats.summary(_scored(spark, d), _SUMMARY_AT)
    first = F.element_at("labels.docs", C.TOPIC_LABELS[0])
    return one.select("docs", "all_tokens", F.col("tokens.p50").alias("median_tokens"), F.col("complexity.mean").alias("mean_complexity"), first.alias("first_label"), F.element_at("multi_label.at", 2)["mean_labels"].alias("mean_labels"))


_RANKED = "('typescript', 'python', 'rust_go_java', 'jupyter')"


@query(_c(f"SELECT count(*) AS total, count(*) FILTER (language_slice IN {_RANKED}) AS classified, CAST(sum(token_count) FILTER (language_slice IN {_RANKED}) AS BIGINT) AS classified_tokens FROM code"))
def classified_totals(spark, d):
    hit = F.col("language_slice").isin(*[n for n, _, s, _, _ in C.SLICES if s == "relevance_filter"])
    return _code(spark, d).agg(F.count(F.lit(1)).alias("total"), F.sum(F.coalesce(hit, F.lit(False)).cast("long")).alias("classified"), F.sum(F.when(hit, F.col("token_count"))).alias("classified_tokens"))


@query(_meta("SELECT CASE WHEN content_type IN ('library', 'application', 'script', 'test') THEN content_type ELSE 'low_value' END AS content_group, content_type, count(*) AS docs FROM meta GROUP BY ALL"))
def content_type_distribution(spark, d):
    return stats.contingency(_scored(spark, d).withColumn("content_group", scores.content_group(F.col("content_type"))), "content_group", "content_type")


@query(_meta("SELECT CAST(greatest(1, least(5, round_even(quality::DOUBLE, 0))) AS BIGINT) AS quality_level, count(*) AS docs FROM meta GROUP BY ALL"))
def quality_levels(spark, d):
    return _scored(spark, d).groupBy(scores.level(F.col("quality"), 1, 5).alias("quality_level")).agg(F.count(F.lit(1)).alias("docs"))


@query(_meta("SELECT CAST(greatest(1, least(5, round_even(quality::DOUBLE, 0))) AS BIGINT) AS q, CAST(greatest(0, least(3, round_even(structured_data::DOUBLE, 0))) AS BIGINT) AS sd, count(*) AS docs FROM meta GROUP BY ALL"))
def quality_sd_matrix(spark, d):
    return stats.contingency(_scored(spark, d).select(scores.level(F.col("quality"), 1, 5).alias("q"), scores.level(F.col("structured_data"), 0, 3).alias("sd")), "q", "sd")


@query("SELECT lang, round(avg(quality), 4) AS mean, CAST(median(quality) AS DOUBLE) AS median, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def per_lang_quality(spark, d):
    return _docs(spark, d).select("doc_id", "lang").join(_table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("mean"), F.median("quality").alias("median"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'quality' AS category, CAST(sum(quality) AS BIGINT) AS docs, round(sum(quality) * 100.0::DOUBLE / count(*), 4) AS pct FROM labels UNION ALL SELECT 'toxic', CAST(sum(toxic) AS BIGINT), round(sum(toxic) * 100.0::DOUBLE / count(*), 4) FROM labels")
def category_counts(spark, d):
    one = _table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    return one.unpivot(["n"], ["quality", "toxic"], "category", "docs").select("category", "docs", scores.percent(F.col("docs"), F.col("n"), 4).alias("pct"))


@query("SELECT quality, count(*) AS docs FROM labels WHERE quality IS NOT NULL GROUP BY quality")
def level_distribution(spark, d):
    return _table(spark, d, "labels").where("quality IS NOT NULL").groupBy("quality").agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH b AS (SELECT * FROM ({_meta(' UNION ALL '.join(_ml(t) for t in _THRESHOLDS))})) SELECT CAST(coalesce(min(threshold) FILTER (pct_2plus < 40 AND pct_0 < 10), 0.3) AS DOUBLE) AS threshold FROM b")
def threshold_recommendation(spark, d):
    return stats.recommended_threshold(stats.multi_label(_scored(spark, d), _THRESHOLDS))


@query(_meta("SELECT CAST(coalesce(" + ", ".join(f"CASE WHEN avg(CASE WHEN list_max(ts) < {t}::FLOAT THEN 100.0 ELSE 0.0 END) < 5 THEN {t} END" for t in (0.2, 0.25, 0.3, 0.35, 0.4)) + ", 0.3) AS DOUBLE) AS floor FROM meta"))
def floor_recommendation(spark, d):
    return stats.recommended_floor(_scored(spark, d))


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_record_per_run(spark, d):
    return stats.last_per_run(_table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id").select("user_id", "value", "event_id")


@query("SELECT event_type AS run, CAST(0 AS BIGINT) AS return_code, round(avg(value), 4) AS docs_per_sec FROM events GROUP BY event_type ORDER BY docs_per_sec DESC, run LIMIT 1")
def best_run(spark, d):
    runs = _table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.lit(0).cast("long").alias("return_code"), F.round(F.avg("value"), 4).alias("docs_per_sec"))
    return stats.best_run(runs)


# Budgets.


def _cut_sql(rows: str, part: str, order: str, budget: str, cols: str, fits: str = "<=") -> str:
    over = f"OVER ({('PARTITION BY ' + part) if part else ''} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT {cols} FROM (SELECT *, coalesce(sum(token_count) {over}, 0) AS run FROM {rows}) WHERE run {fits} {budget}"


@query(_meta(_cut_sql("meta", "", f"{_HASH}, doc_id", "50000", "doc_id, token_count")))
def budget_cut_random(spark, d):
    return selection.random_to_budget(_scored(spark, d), F.lit(50_000)).select("doc_id", "token_count")


@query(_w(_cut_sql("web", "", "relevance DESC, doc_id", "60000", "doc_id, token_count")))
def budget_cut_relevance(spark, d):
    return selection.relevance_to_budget(_web(spark, d), F.lit(60_000)).select("doc_id", "token_count")


@query(_w(_cut_sql("web", "cbin", "relevance DESC, doc_id", "(CASE cbin " + " ".join(f"WHEN '{b[0]}' THEN {b[3]}::DOUBLE" for b in C.COMPLEXITY_BINS) + " END * 100000.0::DOUBLE)", "doc_id, cbin")))
def complexity_targets(spark, d):
    return selection.with_complexity_targets(_web(spark, d), F.lit(100_000.0)).select("doc_id", "cbin")


_SLICE_TARGETS = {name: 3_000 + 4_000 * k for k, (name, *_) in enumerate(C.SLICES)}
_STRAT = "CASE language_slice " + " ".join(f"WHEN '{n}' THEN '{s}'" for n, _, s, _, _ in C.SLICES) + " END"
_KEYS = "(" + " OR ".join(f"contains(lower(text), '{k}')" for k in C.KEYWORDS) + ")"
_SELECTED = (
    f"cand AS (SELECT *, {_STRAT} AS strategy FROM code WHERE language_slice IS NOT NULL AND token_count BETWEEN 20 AND 100000), "
    f"good AS (SELECT * FROM cand WHERE CASE strategy WHEN 'relevance_filter' THEN quality > 1.5::FLOAT AND structured_data::DOUBLE >= 2.0 WHEN 'keyword_filter' THEN {_KEYS} ELSE true END), "
    "sel AS (" + _cut_sql("good", "language_slice", f"CASE WHEN strategy = 'relevance_filter' THEN -relevance ELSE 0.0 END, CASE WHEN strategy = 'relevance_filter' THEN '' ELSE {_HASH} END, doc_id", "(CASE language_slice " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _SLICE_TARGETS.items()) + " END)", "*") + ")"
)


@query(f"WITH {CODE}, {_SELECTED} SELECT doc_id, language_slice, token_count, round(CASE WHEN strategy = 'relevance_filter' THEN quality ELSE 0 END::DOUBLE, 5) AS quality, CASE WHEN strategy = 'relevance_filter' THEN content_type ELSE 'unclassified' END AS content_type FROM sel")
def slice_select(spark, d):
    return selection.select_slices(_code(spark, d), _SLICE_TARGETS).select("doc_id", "language_slice", "token_count", F.round(F.col("quality").cast("double"), 5).alias("quality"), "content_type")


@query(f"WITH {CODE}, {_SELECTED}, dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in _SLICE_TARGETS.items()) + ") v(language_slice, target)), agg AS (SELECT language_slice, target, count(doc_id) AS docs, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM dim LEFT JOIN sel USING (language_slice) GROUP BY ALL) SELECT *, CASE WHEN tokens >= 0.9 * target THEN 'ok' WHEN tokens >= 0.5 * target THEN 'shortfall' WHEN tokens > 0 THEN 'low' ELSE 'empty' END AS status FROM agg")
def slice_fill_report(spark, d):
    return stats.slice_fill(selection.select_slices(_code(spark, d), _SLICE_TARGETS), _SLICE_TARGETS)


_TARGET = 200_000


def _priority_ctes() -> tuple[str, str]:
    """One CTE for each group in turn, over the rows that those before it took."""
    ctes, taken = [], []
    pct = "CASE cbin " + " ".join(f"WHEN '{b[0]}' THEN {b[3]}::DOUBLE" for b in C.COMPLEXITY_BINS) + " END"
    for group, labels, share, _ in sorted(C.GROUPS, key=lambda g: g[3]):
        sel = "(" + " UNION ALL ".join(f"SELECT doc_id FROM take_{g}" for g in taken) + ")" if taken else "(SELECT doc_id FROM web WHERE false)"
        hit = _group_hit(labels)
        target = f"greatest(0.0, {_TARGET} - coalesce((SELECT sum(token_count) FROM web WHERE doc_id IN {sel}), 0))" if group == "general" else f"{share}::DOUBLE * {_TARGET}"
        need = f"need_{group} AS MATERIALIZED (SELECT greatest(0.0::DOUBLE, {target} - coalesce((SELECT sum(token_count) FROM web WHERE {hit} AND doc_id IN {sel}), 0))::DOUBLE AS r)"
        rows = f"(SELECT w.*, n.r FROM web w, need_{group} n WHERE {hit} AND n.r > 0 AND doc_id NOT IN {sel})"
        ctes += [need, f"take_{group} AS MATERIALIZED (" + _cut_sql(rows, "cbin", "relevance DESC, doc_id", f"{pct} * r", f"doc_id, '{group}' AS taken_by") + ")"]
        taken.append(group)
    return ", ".join(ctes), " UNION ALL ".join(f"SELECT doc_id, taken_by FROM take_{g}" for g in taken)


_PRIORITY = _priority_ctes()
_WEBM = WEB.replace("web AS (", "web AS MATERIALIZED (")


@query(f"WITH {_WEBM}, {_PRIORITY[0]} {_PRIORITY[1]}")
def priority_sample(spark, d):
    return selection.priority_sample(_web(spark, d), _TARGET)[0]


def _fill_sql() -> str:
    """Of each group: what it has when its turn is over."""
    out, taken = [], []
    for group, labels, share, _ in sorted(C.GROUPS, key=lambda g: g[3]):
        hit, before = _group_hit(labels), " UNION ALL ".join(f"SELECT doc_id FROM take_{g}" for g in taken) or "SELECT doc_id FROM web WHERE false"
        taken.append(group)
        after = f"{before} UNION ALL SELECT doc_id FROM take_{group}"
        target = f"greatest(0.0, {_TARGET} - coalesce((SELECT sum(token_count) FROM web WHERE doc_id IN ({before})), 0))" if group == "general" else f"{share}::DOUBLE * {_TARGET}"
        out.append(
            f"SELECT '{group}' AS topic_group, (SELECT count(*) FROM web WHERE {hit}) AS candidates, {target}::DOUBLE AS target, CAST(coalesce((SELECT sum(token_count) FROM web WHERE {hit} AND doc_id IN ({after})), 0) AS BIGINT) AS tokens, "
            f"(SELECT r FROM need_{group}) AS r, (SELECT count(*) FROM web WHERE {hit} AND doc_id NOT IN ({before})) AS free"
        )
    rows = " UNION ALL ".join(out)
    return f"SELECT topic_group, candidates, target, tokens, CASE WHEN candidates = 0 THEN 'empty' WHEN r <= 0 THEN 'filled_by_overlap' WHEN free = 0 THEN 'no_candidates' WHEN tokens >= 0.9 * target THEN 'ok' ELSE 'shortfall' END AS status FROM ({rows})"


@query(f"WITH {_WEBM}, {_PRIORITY[0]} {_fill_sql()}")
def group_fill_report(spark, d):
    rows = selection.priority_sample(_web(spark, d), _TARGET)[1]
    return spark.createDataFrame([(r["group"], r["candidates"], float(r["target"]), r["tokens"], r["status"]) for r in rows], "topic_group string, candidates long, target double, tokens long, status string")


# Duplicates.

_SH13 = f"(SELECT doc_id, unnest(list_distinct({_shingle_sql('w', 13, chr(39) + ' ' + chr(39))})) AS s FROM (SELECT doc_id, {_WORDS.format('lower(text)')} AS w FROM documents))"
_COEF = "(VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(dedup.coefficients())) + ") c(i, a, b)"
_SIGS = f"sh AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT >> 1 AS h FROM {_SH13}), mins AS MATERIALIZED (SELECT doc_id, i, min((a * h + b) % {dedup.PRIME}) AS m FROM sh, {_COEF} GROUP BY doc_id, i), bands AS MATERIALIZED (SELECT doc_id, i // 8 AS band, md5(string_agg(m, ',' ORDER BY i)) AS bucket FROM mins GROUP BY doc_id, i // 8)"


def _signed(spark: SparkSession, d: str) -> DataFrame:
    return dedup.signatures(_docs(spark, d), text.word_shingles(F.col("text")))


@query(f"WITH {_SIGS} SELECT doc_id, CAST(sum(m) AS BIGINT) AS total, min(m) AS least FROM mins GROUP BY doc_id")
def dedup_signatures(spark, d):
    return _signed(spark, d).where("signature IS NOT NULL").select("doc_id", F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("signature").alias("least"))


@query(f"WITH {_SIGS} SELECT band, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS members FROM (SELECT band, bucket, count(*) AS n FROM bands GROUP BY band, bucket) WHERE n > 1 GROUP BY band")
def dedup_candidates(spark, d):
    shared = dedup.shared_buckets(dedup.band_keys(_signed(spark, d)))
    return shared.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("members"))


@query(f"WITH RECURSIVE {_SIGS}, links AS MATERIALIZED (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM bands a JOIN bands b USING (band, bucket)), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y) SELECT x AS doc_id, min(y) AS component FROM reach WHERE x IN (SELECT x FROM links WHERE x <> y) GROUP BY x")
def dedup_components(spark, d):
    return dedup.components(dedup.shared_buckets(dedup.band_keys(_signed(spark, d))))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    meta = _scored(spark, d).select("doc_id", scores.web_relevance(F.col("topic_scores"), F.col("complexity")).alias("relevance"))
    return meta, dedup.star_clusters(dedup.shared_buckets(dedup.band_keys(_signed(spark, d))), meta)


# Greedy clusters: one document after another, in order, with the list of those that begin a cluster.
_STARS = (
    f"{META}, {_SIGS}, shared AS MATERIALIZED (SELECT doc_id, band, bucket FROM bands QUALIFY count(*) OVER (PARTITION BY band, bucket) > 1), "
    "near AS MATERIALIZED (SELECT a.doc_id, coalesce(list(DISTINCT b.doc_id) FILTER (b.doc_id < a.doc_id), []) AS before FROM shared a JOIN shared b USING (band, bucket) GROUP BY a.doc_id), "
    "turn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM near), "
    "walk(k, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT turn.k, CASE WHEN list_has_any(walk.seeds, turn.before) THEN walk.seeds ELSE list_append(walk.seeds, turn.doc_id) END FROM walk JOIN turn ON turn.k = walk.k + 1), "
    "seeds AS MATERIALIZED (SELECT seeds FROM walk ORDER BY k DESC LIMIT 1), "
    f"member AS (SELECT doc_id, CASE WHEN list_contains(seeds, doc_id) THEN doc_id ELSE list_min(list_intersect(before, seeds)) END AS c, {_REL} AS relevance FROM turn JOIN meta USING (doc_id) CROSS JOIN seeds), "
    "ranked AS (SELECT *, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY relevance DESC, (doc_id = c) DESC, doc_id) AS r FROM member), "
    "clusters AS (SELECT doc_id, CASE WHEN n > 1 THEN c ELSE -1 END AS cluster_id, r = 1 AS keep FROM ranked)"
)


@query(f"WITH RECURSIVE {_STARS} SELECT doc_id, cluster_id, keep FROM clusters")
def dedup_clusters(spark, d):
    return _clusters(spark, d)[1]


@query(f"WITH RECURSIVE {_STARS} SELECT doc_id, coalesce(cluster_id, -1) AS dedup_cluster_id FROM meta LEFT JOIN clusters USING (doc_id) WHERE coalesce(keep, true)")
def dedup_keep(spark, d):
    return dedup.with_clusters(*_clusters(spark, d)).select("doc_id", "dedup_cluster_id")


@query(f"WITH RECURSIVE {_STARS}, s AS (SELECT (SELECT count(*) FROM documents) AS total, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters, count(*) FILTER (NOT keep) AS removed FROM clusters) SELECT *, total - removed AS remaining, round(removed / total::DOUBLE, 6) AS rate FROM s")
def dedup_stats(spark, d):
    return dedup.cluster_stats(*_clusters(spark, d))


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(text, 1, 50)")
def dedup_prefix(spark, d):
    return dedup.first_by(_docs(spark, d), F.substring("text", 1, 50)).select("doc_id")


@query("SELECT min(page_id) AS page_id FROM pages GROUP BY url")
def dedup_url(spark, d):
    return dedup.first_by(_table(spark, d, "pages"), F.col("url"), "page_id").select("page_id")


@query(_meta(f"SELECT doc_id, lang, round({_REL}, 6) AS relevance FROM meta QUALIFY row_number() OVER (PARTITION BY substr(text, 1, 30) ORDER BY {_REL} DESC, doc_id % 2 DESC, doc_id) = 1"))
def keep_best(spark, d):
    members = _scored(spark, d).select("doc_id", "lang", scores.web_relevance(F.col("topic_scores"), F.col("complexity")).alias("relevance"), (F.col("doc_id") % 2 == 1).alias("is_seed"), F.substring("text", 1, 30).alias("cluster_id"))
    return dedup.keep_best(members).select("doc_id", "lang", F.round("relevance", 6).alias("relevance"))


# Metrics.


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).join(_table(spark, d, "labels").withColumnRenamed("quality", "label"), "doc_id")


_J = "j AS (SELECT meta.*, l.quality AS label, l.toxic FROM meta JOIN labels l USING (doc_id))"


@query(f"WITH {META}, {_J}, " + """b AS (SELECT 'quality' AS label, label = 1 AS t, ts[1] >= 0.3::FLOAT AS g FROM j UNION ALL SELECT 'toxic', toxic = 1, ts[2] >= 0.3::FLOAT FROM j),
n AS (SELECT label, count(*) FILTER (t AND g) AS tp, count(*) FILTER (g AND NOT t) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM b GROUP BY label UNION ALL SELECT 'micro', count(*) FILTER (t AND g), count(*) FILTER (g AND NOT t), count(*) FILTER (t AND NOT g) FROM b),
r AS (SELECT label, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0) AS r, tp + fn AS support FROM n),
f AS (SELECT label, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1, support FROM r)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f WHERE label <> 'micro'""")
def f1_multilabel(spark, d):
    hot = F.array(*[F.get("topic_scores", i) >= scores.f32(0.3) for i in range(2)])
    rows = _judged(spark, d).select(F.array(F.col("label") == 1, F.col("toxic") == 1).alias("truth"), hot.alias("guess"))
    return metrics.multi_label_scores(rows, "truth", "guess", ["quality", "toxic"])


@query(f"WITH {META}, {_J} SELECT round(avg((label - quality::DOUBLE) * (label - quality::DOUBLE)), 6) AS mse, round(avg(abs(label - quality::DOUBLE)), 6) AS mae, round(avg((round_even(greatest(1, least(4, quality::DOUBLE)), 0) = label)::INT), 6) AS accuracy FROM j")
def regression_metrics(spark, d):
    return metrics.regression(_judged(spark, d), "label", "quality", 1, 4)


@query(f"WITH {META}, {_J}, x AS (SELECT label AS t, CAST(greatest(0, least(4, round_even(quality::DOUBLE, 0))) AS INT) AS g FROM j), n AS (SELECT level, count(*) FILTER (t = level AND g = level) AS hit, count(*) FILTER (t = level) AS support, count(*) FILTER (g = level) AS found FROM range(0, 5) r(level), x GROUP BY level) SELECT level, coalesce(round(hit / nullif(found, 0)::DOUBLE, 6), 0) AS precision, coalesce(round(hit / nullif(support, 0)::DOUBLE, 6), 0) AS recall, coalesce(round(2 * hit / nullif(support + found, 0)::DOUBLE, 6), 0) AS f1, support FROM n")
def level_report(spark, d):
    return metrics.by_level(_judged(spark, d), "label", "quality", 0, 4)


_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"WITH {META}, {_J} SELECT round(corr(a, b), 6) AS spearman FROM (SELECT {_RANK.format('label')} AS a, {_RANK.format('quality')} AS b FROM j)")
def spearman(spark, d):
    return metrics.spearman(_judged(spark, d), "label", "quality")


@query(f"WITH {META}, {_J}, x AS (SELECT label AS t, CASE WHEN quality >= 2.0::FLOAT THEN 1 ELSE 0 END AS g FROM j), c AS (SELECT c, sum(a) AS a, sum(b) AS b, sum(h) AS h FROM (SELECT t AS c, 1 AS a, 0 AS b, (t = g)::INT AS h FROM x UNION ALL SELECT g, 0, 1, 0 FROM x) GROUP BY c) SELECT round(sum(h) / sum(a)::DOUBLE, 6) AS accuracy, round(avg(2.0::DOUBLE * h / (a + b)), 6) AS macro_f1 FROM c")
def multiclass_metrics(spark, d):
    return metrics.multi_class(_judged(spark, d).withColumn("guess", F.when(F.col("quality") >= scores.f32(2.0), 1).otherwise(0)), "label", "guess")


# Splits, packing, shuffles.


@query("SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents")
def length_batches(spark, d):
    return selection.length_batches(_docs(spark, d).select("doc_id", "lang", "n_chars"), F.col("n_chars"), 32, "lang").select("doc_id", "lang", "batch")


def _split_sql(part: str) -> str:
    over = f"PARTITION BY {part}" if part else ""
    return f"SELECT doc_id, CASE WHEN r <= ceil(n * 0.1::DOUBLE) THEN 'test' WHEN r <= ceil(n * 0.1::DOUBLE) + ceil((n - ceil(n * 0.1::DOUBLE)) * (0.1::DOUBLE / (1 - 0.1::DOUBLE))) THEN 'validation' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER ({over} ORDER BY {_HASH}, doc_id) AS r, count(*) OVER ({over}) AS n FROM labels)"


@query(_split_sql(""))
def split_random(spark, d):
    return selection.split(_table(spark, d, "labels").select("doc_id"))


@query(_split_sql("quality"))
def split_stratified(spark, d):
    return selection.split(_table(spark, d, "labels"), "quality").select("doc_id", "part")


_SHARDS = "(SELECT CAST(range AS BIGINT) AS shard FROM range(0, 23))"


@query(f"SELECT shard, ntile(5) OVER (ORDER BY shard) - 1 AS worker FROM {_SHARDS}")
def worker_split(spark, d):
    return packing.worker_of(spark.range(23).select(F.col("id").alias("shard")), 5)


@query(f"SELECT shard, row_number() OVER (ORDER BY shard DESC) <= 2 AS is_eval FROM {_SHARDS}")
def eval_holdout(spark, d):
    return packing.held_out(spark.range(23).select(F.col("id").alias("shard")))


def _tokens(df: DataFrame, n: int = 64) -> DataFrame:
    """A stand-in for a tokenizer: one id for each word, from its md5, and an end marker."""
    ids = F.transform(text.words(F.col("text")), lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % 50_000))
    toks = F.concat(ids, F.array(F.lit(C.END_OF_TEXT)))
    return df.select("doc_id", "lang", toks.alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("long")).withColumnRenamed("lang", "source")


_TOK = f"tok AS MATERIALIZED (SELECT doc_id, lang AS source, list_append(list_transform({_WORDS.format('text')}, lambda w: ('0x' || substr(md5(w), 1, 4))::BIGINT % 50000), 50256) AS tokens FROM documents)"


_PACKED = f"WITH {_TOK}, flat AS MATERIALIZED (SELECT source, doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS k FROM tok), spots AS (SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY doc_id, k) - 1 AS spot FROM flat), seqs AS (SELECT source, spot // 256 AS seq, list(t ORDER BY spot) AS l FROM spots GROUP BY source, spot // 256), packed AS (SELECT source, seq, md5(array_to_string(list_concat(l, list_transform(range(0, 256 - len(l)), lambda i: 50256)), ',')) AS digest FROM seqs WHERE len(l) >= 128)"


@query(f"{_PACKED} SELECT source, seq, digest FROM packed")
def pack_sequences(spark, d):
    seqs = packing.pack(packing.offsets(_tokens(_docs(spark, d))), context=256)
    return seqs.select("source", "seq", F.md5(F.array_join("tokens", ",").cast("binary")).alias("digest"))


# Small functions, sinks and sources, each by a round trip or a column.


@query("SELECT DISTINCT 'slice_' || lang AS name, 'Slice ' || upper(lang[1]) || lower(substr(lang, 2)) AS shown FROM documents")
def display_names(spark, d):
    names = _docs(spark, d).select(F.concat(F.lit("slice_"), "lang").alias("name")).distinct()
    return names.select("name", text.display_name(F.col("name")).alias("shown"))


@query("SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6) WHEN n >= 1000 THEN printf('%.1fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown FROM (SELECT doc_id, n_chars * (1 + doc_id % 997) // 100 * 100 + 10 AS n FROM documents)")
def short_numbers(spark, d):
    n = F.floor(F.col("n_chars") * (1 + F.col("doc_id") % 997) / 100) * 100 + 10
    return _docs(spark, d).select("doc_id", scores.short_number(n).alias("shown"))


@query("SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN left(text, 20) END, source) AS body FROM documents")
def text_column_fallback(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("lang") != "en", F.substring("text", 1, 20)).alias("text"), F.col("source").alias("content"))
    return rows.select("doc_id", text.fallback_text(rows).alias("body"))


@query(r"SELECT doc_id FROM (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN ' ' || chr(9) || chr(10) ELSE text END AS text FROM documents) WHERE regexp_matches(text, '\S')")
def not_blank_rows(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("n_chars") % 3 == 0, F.lit(" \t\n")).otherwise(F.col("text")).alias("text"))
    return filters.not_blank(rows).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def unfinished_rows(spark, d):
    return filters.unfinished(_docs(spark, d).select("doc_id").join(_table(spark, d, "labels"), "doc_id", "left"), "quality").select("doc_id")


@query(f"WITH {_TOK} SELECT doc_id, md5(array_to_string(tokens[1:len(tokens) - 1], ',')) AS inputs, md5(array_to_string(tokens[2:], ',')) AS targets FROM tok")
def next_token_pairs(spark, d):
    digest = lambda c: F.md5(F.array_join(c, ",").cast("binary")).alias(c)
    return packing.next_token_pairs(_tokens(_docs(spark, d))).select("doc_id", digest("inputs"), digest("targets"))


@query("SELECT " + ", ".join(f"round(sum({c}::DOUBLE) * 100.0 / sum(l_quantity::DOUBLE + l_discount::DOUBLE + l_tax::DOUBLE), 2) AS {c}" for c in ("l_quantity", "l_discount", "l_tax")) + " FROM lineitem")
def phase_shares(spark, d):
    phases = ["l_quantity", "l_discount", "l_tax"]
    return stats.phase_shares(_table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in phases]), phases)


@query("SELECT doc_id, lang, text FROM documents")
def validated_shards(spark, d):
    path = tables.new_path(spark, "validated")
    writers.validated_write(_docs(spark, d).select("doc_id", "lang", "text"), path)
    return readers.scan(spark, path)


@query("SELECT doc_id, lang, n_chars FROM documents")
def rolling_shards(spark, d):
    """Files of 50 rows at most, with a fixed schema."""
    path = tables.new_path(spark, "rolling")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
    writers.write_shards(_docs(spark, d), path, schema, rows=50)
    return readers.scan(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def json_lines(spark, d):
    path = tables.new_path(spark, "lines") + ".jsonl"
    writers.write_any(_docs(spark, d).select("doc_id", "text", "lang"), path)
    return readers.read_any(spark, path, "doc_id long, text string, lang string")


def _sharded(spark: SparkSession, d: str) -> str:
    spark.dataSource.register(tkds.TokenSource)
    path = tables.new_path(spark, "token_shards")
    tokens = tables.written(_tokens(_docs(spark, d)), "tokens")  # read three times: words are hashed once
    seqs = packing.pack(packing.offsets(tokens), context=256)
    seqs.select(F.lit("").alias("shard"), F.col("seq").alias("seq_id"), "tokens").write.format("tkds").mode("append").option("sequencesPerShard", 40).save(path)
    tables.drop(tokens)
    return path


@query(f"{_PACKED} SELECT digest FROM packed")
def token_shards(spark, d):
    return spark.read.format("tkds").load(_sharded(spark, d)).select(F.md5(F.array_join("tokens", ",").cast("binary")).alias("digest"))


@query(f"{_PACKED} SELECT count(*) AS sequences, 256 AS context FROM packed")
def token_shard_headers(spark, d):
    heads = spark.read.format("tkds").option("headerOnly", "true").load(_sharded(spark, d))
    return heads.agg(F.sum("sequences").alias("sequences"), F.max("context").cast("long").alias("context"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, coalesce(sum(n_chars // 4) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM documents) WHERE run < 20000")
def pack_budget(spark, d):
    return selection.in_order_to_budget(_scored(spark, d), F.lit(20_000), ["lang"]).select("doc_id", "lang")


@query("WITH t AS (SELECT lang AS source, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM documents GROUP BY lang), s AS (SELECT *, tokens // 2048 + CASE WHEN tokens % 2048 >= 1024 THEN 1 ELSE 0 END AS sequences FROM t) SELECT source, tokens, sequences, round(sequences * 100.0::DOUBLE / (SELECT sum(sequences) FROM s), 4) AS pct FROM s")
def mix_report(spark, d):
    return packing.mix_report(_docs(spark, d).select(F.col("lang").alias("source"), F.floor(F.col("n_chars") / 4).alias("n_tokens")))


@query(f"SELECT doc_id, CAST(k // 30 AS BIGINT) AS shard, k % 30 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}) - 1 AS k FROM documents)")
def exact_reshard(spark, d):
    return packing.resharded(_docs(spark, d).select("doc_id"), F.col("doc_id"), 30)


@query(f"SELECT doc_id, CAST(s AS BIGINT) AS shard, row_number() OVER (PARTITION BY s ORDER BY {_HASH}) - 1 AS place FROM (SELECT doc_id, ('0x' || substr({_HASH}, 1, 8))::BIGINT % 7 AS s FROM documents)")
def global_shuffle(spark, d):
    return packing.shuffled(_docs(spark, d).select("doc_id"), F.col("doc_id"), 7)


@query("SELECT doc_id, doc_id % 5 AS shard, md5((doc_id % 5) || ':45') AS shard_key, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY md5(doc_id || ':45')) - 1 AS place FROM documents")
def epoch_shuffle(spark, d):
    return packing.epoch_order(_docs(spark, d).select("doc_id", (F.col("doc_id") % 5).alias("shard")), 3, seq="doc_id")


@query("SELECT user_id, count(*) AS n, list_aggregate(list_sort(list_distinct(list(event_type))), 'string_agg', ',') AS kinds FROM events GROUP BY user_id")
def distinct_sets(spark, d):
    return _table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("(SELECT DISTINCT source FROM documents WHERE lang = 'en' INTERSECT SELECT DISTINCT source FROM documents WHERE lang = 'fr') EXCEPT SELECT 'src0'")
def partition_key_sets(spark, d):
    docs = _docs(spark, d)
    both = docs.where("lang = 'en'").select("source").intersect(docs.where("lang = 'fr'").select("source"))
    return both.subtract(spark.createDataFrame([("src0",)], "source string"))


# Whole programmes.


@query(_w("SELECT topic_group, cbin, count(*) AS docs, CAST(sum(token_count) AS BIGINT) AS tokens, round(max(relevance), 5) AS best FROM (SELECT unnest(groups) AS topic_group, * FROM (" + _cut_sql("web", "cbin", "relevance DESC, doc_id", "(CASE cbin " + " ".join(f"WHEN '{b[0]}' THEN {b[3]}::DOUBLE" for b in C.COMPLEXITY_BINS) + " END * 300000.0::DOUBLE)", "*") + ")) GROUP BY topic_group, cbin"))
def curation_end_to_end(spark, d):
    chosen = selection.with_complexity_targets(_web(spark, d), F.lit(300_000.0))
    rows = chosen.select(F.explode("assigned_groups").alias("topic_group"), "cbin", "token_count", "relevance")
    return rows.groupBy("topic_group", "cbin").agg(F.count(F.lit(1)).alias("docs"), F.sum("token_count").alias("tokens"), F.round(F.max("relevance"), 5).alias("best"))


@query()
def web_programme(spark, d):
    return curation.web(_scored(spark, d), _TARGET).select("doc_id", F.array_join("assigned_groups", ",").alias("groups"), F.round("relevance", 6).alias("relevance"), "dedup_cluster_id")


@query()
def code_programme(spark, d):
    return curation.code(_scored(spark, d), _SLICE_TARGETS).select("doc_id", "language_slice", "dedup_cluster_id")


@query("SELECT window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type FROM events) GROUP BY ALL")
def windowed_events(spark, d):
    return _table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
