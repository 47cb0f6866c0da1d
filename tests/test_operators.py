import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswright import constants as C
from corpuswright.functions import scores, text
from corpuswright.operators import dedup, joins, packing, selection, stats
from corpuswright.plans import curation, scoring
from corpuswright.sources import readers, tkds, writers
from corpuswright.streaming import shards


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 1.0, 1.75, 2.5, 3.25, 4.0, 4.2, float("nan"))], "x float")
    assert [r[0] for r in rows(df.select(scores.complexity_bin(F.col("x"))))] == ["L1", "L1", "L2", "L3", "L4", "L4", "L4", "L1"]
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.5, 1.5, 2.5, 3.0, 3.6)], "x float")
    assert [r[0] for r in rows(df.select(scores.sd_bin(F.col("x"))))] == ["SD0", "SD1", "SD2", "SD3", "SD3", "SD3"]


def test_constants():
    assert len(C.TOPIC_LABELS) == 17 and len(C.KEYWORDS) == 29 and len(C.GENERAL_LANGUAGES) >= 75
    assert abs(sum(g[2] for g in C.GROUPS) - 1) < 1e-9 and sum(s[1] for s in C.SOURCES) == 20_000_000_000
    assert sorted(i for g in C.GROUPS for i in g[1]) == list(range(17))


def cut(tokens, target):
    """The rule in numbers: rows up to and including the one that crosses."""
    return int(np.searchsorted(np.cumsum(tokens), target, side="right")) + 1


@pytest.mark.parametrize("seed", range(6))
def test_budget_cut_matches_running_sums(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.randint(1, 50), round(rng.random() * 2, rng.choice((1, 6)))) for i in range(rng.randint(1, 120))]
    target = rng.choice((0, 1, 200, sum(d[1] for d in data), 10**6))
    df = spark.createDataFrame(data, "doc_id long, token_count long, relevance double")
    got = {r[0] for r in rows(selection.relevance_to_budget(df, F.lit(target)).select("doc_id"))}
    order = sorted(data, key=lambda d: (-d[2], d[0]))
    assert got == {d[0] for d in order[: cut([d[1] for d in order], target)]}


@pytest.mark.parametrize("seed", range(3))
def test_budget_cut_cuts_buckets_again(spark, seed, monkeypatch):
    """Values that pile up, null parts, and buckets that are cut several times."""
    monkeypatch.setattr(selection, "BUCKETS", 4)
    monkeypatch.setattr(selection, "SORTED_ROWS", 3)
    rng = random.Random(seed)
    data = [(i, rng.randint(0, 50), rng.choice((1.0, 1.0, 0.5, rng.random(), None)), rng.choice(("a", "b", None))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, token_count long, relevance double, p string")
    budget = F.when(F.col("p") == "a", 900).when(F.col("p").isNull(), 1300)
    got = {r[0] for r in rows(selection.relevance_to_budget(df, budget, ["p"]).select("doc_id"))}
    want = set()
    for part, most in (("a", 900), (None, 1300)):
        order = sorted((d for d in data if d[3] == part), key=lambda d: (d[2] is None, -(d[2] or 0), d[0]))
        want |= {d[0] for d in order[: cut([d[1] for d in order], most)]}
    assert got == want
    parts = {r["doc_id"]: r["part"] for r in selection.split(df.select("doc_id"), test=0.1, validation=0.2).collect()}
    assert [list(parts.values()).count(x) for x in ("test", "validation", "train")] == [30, 61, 209]


def test_budget_edges(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0), (3, 10, float("nan")), (4, 10, None)], "doc_id long, token_count long, relevance double")
    pick = lambda t: sorted(r[0] for r in rows(selection.relevance_to_budget(df, F.lit(t)).select("doc_id")))
    assert pick(0) == [1] and pick(9) == [1] and pick(10) == [1, 2] and pick(20) == [1, 2, 3] and pick(100) == [1, 2, 3, 4]
    assert selection.relevance_to_budget(df.limit(0), F.lit(5)).count() == 0
    strict = selection.in_order_to_budget(df.withColumn("p", F.lit("a")), F.lit(10), ["p"])
    assert [r[0] for r in rows(strict.select("doc_id"))] == [1]


def test_priority_sample_takes_members_only(spark):
    meta = curation.web_meta(scoring.hashed_scores(spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") * 7 + 400).alias("n_chars"), F.lit("s").alias("source"))))
    chosen, report = selection.priority_sample(meta, 20_000)
    assert chosen.groupBy("doc_id").count().where("count > 1").isEmpty()
    joined = chosen.join(meta, "doc_id")
    assert joined.where(~F.array_contains("assigned_groups", F.col("taken_by"))).isEmpty()
    assert [r["group"] for r in report][-1] == "general" and {r["status"] for r in report} <= {"ok", "shortfall", "filled_by_overlap", "no_candidates", "empty"}


def test_shingles(spark):
    def count(n, f, glue):
        df = spark.createDataFrame([(glue.join(f"w{i}" for i in range(n)),)], "t string")
        return rows(df.select(F.size(f(F.col("t")))))[0][0]

    assert [count(n, text.word_shingles, " ") for n in (0, 1, 12, 13, 14)] == [0, 1, 1, 1, 2]
    assert [count(n, text.line_shingles, "\r\n \n") for n in (0, 4, 5, 6)] == [0, 1, 1, 2]


def test_text_functions(spark):
    long = "x" * 90
    conv = spark.createDataFrame([([("user", long), ("", "a"), ("assistant", "ok, that is it")],), ([("user", "hi")],)], "messages array<struct<role:string,content:string>>")
    assert [r[0] for r in rows(conv.select(text.conversation(F.col("messages"))))] == [f"USER: {long}\n\nASSISTANT: ok, that is it", None]
    qa = spark.createDataFrame([(long, [("a", 2), ("first", 3), ("second", 3)]), (long, [("a", 2)]), (long, [])], "q string, a array<struct<text:string,pm_score:int>>")
    assert [r[0] for r in rows(qa.select(text.best_answer(F.col("q"), F.col("a"))))] == [f"QUESTION: {long}\n\nANSWER: first", None, None]
    box = json.dumps({"has_parts": [{"type": "field", "name": "n", "value": "é"}, {"type": "section", "has_parts": [{"type": "field", "name": "n", "value": "z"}]}]})
    df = spark.createDataFrame([(box,), (None,)], "b string")
    assert [r[0] for r in rows(df.select(text.infobox_json(F.col("b"))))] == ['{"n": "z"}', None]
    z = spark.createDataFrame([("",), ("a" * 10_000,)], "t string")
    assert [r[0] for r in rows(z.select(text.compression_ratio(F.col("t"))))] == [0.0, len(zlib.compress(b"a" * 10_000)) / 10_000]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in ("x.org/a", "http://u:p@h.org:80/x", "https://h.org?q", "", None)], "u string")
    assert [r[0] for r in rows(df.select(text.netloc(F.col("u"))))] == [None, "u:p@h.org:80", "h.org", None, None]


def test_content_hash_and_repair(spark):
    raw = spark.createDataFrame([("abc", "c"), ("abc", "rust"), ("y" * 2000, "go")], "content string, lang string")
    got = joins.repair_language(spark.createDataFrame([("abc", "unknown"), ("", "unknown"), ("y" * 2000, "java")], "content string, lang string"), raw)
    assert sorted(rows(got)) == [("", "unknown"), ("abc", "rust"), ("y" * 2000, "java")]


def greedy(bands, relevance):
    """Brute force: documents in order, each taking its free neighbours."""
    where = {}
    for k, b in bands:
        where.setdefault(k, set()).add(b)
    seen, out = set(), {}
    for seed in sorted(where):
        if seed in seen:
            continue
        group = [seed] + [k for k in sorted(where) if k != seed and k not in seen and where[k] & where[seed]]
        seen |= set(group)
        best = max(group, key=lambda k: (relevance[k], k == seed, -k))
        out |= {k: (seed if len(group) > 1 else -1, k == best) for k in group}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_star_clusters(spark, seed):
    rng = random.Random(seed)
    bands = sorted({(rng.randrange(30), rng.randrange(25)) for _ in range(60)})
    relevance = {k: rng.choice((0.1, 0.5, 0.9)) for k in range(30)}
    keys = spark.createDataFrame([(k, b % 4, str(b)) for k, b in bands], "doc_id long, band int, bucket string")
    meta = spark.createDataFrame(list(relevance.items()), "doc_id long, relevance double")
    got = {k: (c, keep) for k, c, keep in rows(dedup.star_clusters(dedup.shared_buckets(keys), meta))}
    want = greedy([(k, (b % 4, b)) for k, b in bands], relevance)
    assert {k: v for k, v in want.items() if v[0] >= 0 or k in got} == got


def test_bands_must_divide():
    with pytest.raises(ValueError):
        dedup.band_keys(None, bands=7)


@pytest.mark.parametrize("seed", range(4))
def test_packing_keeps_the_stream(spark, seed):
    rng = random.Random(seed)
    docs = [(i, "s", [rng.randrange(100) for _ in range(rng.choice((1, 5, 40)))]) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens array<int>").withColumn("n_tokens", F.size("tokens"))
    got = {s: t for _, s, t in rows(packing.pack(packing.offsets(df), context=16, end=-1))}
    stream = [t for _, _, d in docs for t in d]
    want = {i // 16: stream[i : i + 16] for i in range(0, len(stream), 16)}
    want = {k: v + [-1] * (16 - len(v)) for k, v in want.items() if len(v) >= 8}
    assert got == want


def test_tkds_round_trip(spark, tmp_path):
    spark.dataSource.register(tkds.TokenSource)
    df = spark.range(10).select(F.array(*[(F.col("id") + k).cast("int") for k in range(8)]).alias("tokens")).coalesce(2)
    df.write.format("tkds").option("path", str(tmp_path / "t")).option("sequencesPerShard", 3).mode("append").save()
    back = spark.read.format("tkds").option("path", str(tmp_path / "t")).load()
    assert sorted(r[0] for r in rows(back.select("tokens"))) == sorted(r[0] for r in rows(df))
    heads = spark.read.format("tkds").option("path", str(tmp_path / "t")).option("headerOnly", "true").load()
    assert sum(r.sequences for r in heads.collect()) == 10 and all(r.sequences <= 3 and r.context == 8 for r in heads.collect())
    (tmp_path / "bad.bin").write_bytes(b"nope" * 8)
    with pytest.raises(Exception, match="not a token shard"):
        spark.read.format("tkds").option("path", str(tmp_path / "bad.bin")).load().collect()


def test_request_files_are_greedy(spark):
    lines = spark.createDataFrame([(f"{i:03d}", "x" * n) for i, n in enumerate((9, 9, 30, 4, 4))], "custom_id string, line string")
    got = rows(writers.request_files(lines, 20).orderBy("custom_id").select("file"))
    assert [r[0] for r in got] == [0, 0, 1, 2, 2]


def test_scans_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x", "c", 9)], "content string, lang string, size long")
    b = spark.createDataFrame([("yé", "go")], "content string, language string")
    c = spark.createDataFrame([("z",)], "content string")
    for name, df in (("a", a), ("b", b), ("rust", c), ("none", spark.range(1))):
        df.write.parquet(str(tmp_path / name))
    got = readers.scan_code(spark, [str(tmp_path / n) for n in ("a", "b", "rust", "none")])
    assert sorted(rows(got)) == [("x", "c", 9), ("yé", "go", 3), ("z", "rust", 1)]
    for suffix in ("parquet", "csv", "jsonl"):
        writers.write_any(a, str(tmp_path / f"o.{suffix}"))
        assert readers.read_any(spark, str(tmp_path / f"o.{suffix}")).count() == 1
    assert writers.validated_write(spark.range(5), str(tmp_path / "v")) == 5
    writers.write_manifest(spark, str(tmp_path / "m.json"), ["b1", "b2"], {"k": "v"})
    assert readers.read_manifest(spark, str(tmp_path / "m.json")) == ["b1", "b2"] and readers.read_manifest(spark, "b9") == ["b9"]
    assert "| docs |" in writers.dataset_card("T", {"s": spark.createDataFrame([(1,)], "docs int")})


def test_streams_resume(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(5).write.parquet(source)
    score = lambda df: df.withColumn("s", F.col("id") * 2)
    shards.score_stream(spark, source, "id long", score, sink, mark)
    spark.range(5, 8).write.mode("append").parquet(source)
    shards.score_stream(spark, source, "id long", score, sink, mark)
    assert sorted(rows(spark.read.parquet(sink))) == [(i, 2 * i) for i in range(8)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.1,)], "x double")
    assert sorted(rows(stats.histogram(df, "x", 0.0, 1.0, 50))) == [(0, 1), (25, 1), (49, 1)]


def test_checkpoints():
    assert packing.retained_checkpoints([1000, 10_000, 11_000, 12_000, 13_000]) == [10_000, 11_000, 12_000, 13_000]


def test_packing_keeps_null_sources(spark):
    df = spark.createDataFrame([(1, None, [1] * 5), (2, None, [2] * 5), (3, "a", [3] * 4)], "doc_id long, source string, tokens array<int>").withColumn("n_tokens", F.size("tokens"))
    got = {(r["source"], r["seq"]): r["tokens"] for r in packing.pack(packing.offsets(df), context=4, end=0).collect()}
    assert got == {(None, 0): [1, 1, 1, 1], (None, 1): [1, 2, 2, 2], (None, 2): [2, 2, 0, 0], ("a", 0): [3, 3, 3, 3]}


def test_any_tokenizer_packs(spark):
    df = spark.createDataFrame([(1, "s", "abc"), (2, "s", None)], "doc_id long, source string, text string")
    got = packing.tokenized(df, lambda: lambda texts: [list(t.encode()) for t in texts], end=7)
    assert {r["doc_id"]: (r["tokens"], r["n_tokens"]) for r in got.collect()} == {1: ([97, 98, 99, 7], 4), 2: ([7], 1)}


def test_repair_takes_the_last_language_in_the_order(spark):
    raw = spark.createDataFrame([("same", "typescript"), ("same", "java"), ("same", "klingon"), ("other", "klingon")], "content string, lang string")
    shards = spark.createDataFrame([("same", "unknown"), ("same", "c"), ("other", "unknown"), ("", "unknown")], "content string, lang string")
    assert sorted(map(tuple, joins.repair_language(shards, raw).collect())) == [("", "unknown"), ("other", "unknown"), ("same", "c"), ("same", "java")]


def test_token_ids_beyond_16_bits_are_refused():
    import numpy as np

    from corpuswright.sources import tkds

    with pytest.raises(ValueError, match="16 bits"):
        tkds.pack_shard(np.array([[1, 70_000]]), 100_000)


def test_selection_is_resumed(spark, tmp_path):
    from corpuswright.sources import readers, writers

    wide = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "doc_id long, text string")
    ids, out = str(tmp_path / "ids"), str(tmp_path / "out")
    writers.save_selection(wide.where("doc_id < 4"), ids)
    wide.write.parquet(out)  # what an earlier attempt left
    assert writers.resume_write(wide, ids, out) == 4 and spark.read.parquet(out).count() == 4
    with pytest.raises(RuntimeError, match="lacks 2"):
        writers.resume_write(wide.where("doc_id < 2"), ids, out)
    writers.write_shards(wide, str(tmp_path / "new"))
    writers.swap(spark, str(tmp_path / "new"), out)
    assert spark.read.parquet(out).count() == 10 and not (tmp_path / "out.old").exists() and not (tmp_path / "new").exists()
    with pytest.raises(RuntimeError):
        writers.swap(spark, str(tmp_path / "none"), out)
    assert spark.read.parquet(out).count() == 10
    writers.merge_shards(wide.repartition(5), str(tmp_path / "merged"))
    assert len(list((tmp_path / "merged").glob("*.parquet"))) == 1
    sources = [{"name": "a", "repo": "x/a"}, {"name": "b", "repo": "x/b"}]
    assert readers.with_overrides(sources, {"a": "y/a", "b": None}) == [{"name": "a", "repo": "y/a"}, {"name": "b", "repo": "x/b"}]
    with pytest.raises(ValueError):
        readers.with_overrides(sources, {"c": "z"})


def test_streamed_packing(spark, tmp_path):
    from corpuswright.streaming.packer import packed_stream

    def feed(k, data):
        spark.createDataFrame(data, "source string, tokens array<int>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, tokens array<int>").parquet(str(tmp_path / "in"))
        q = packed_stream(stream, context=4).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        q.awaitTermination(120)
        return sorted((r.source or "", r.seq, r.tokens) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert feed(1, [("a", [1, 1, 1]), ("a", [2, 2, 2]), (None, [9])]) == [("a", 0, [1, 1, 1, 2])]
    # The buffer goes on over a restart.
    assert feed(2, [("a", [3, 3, 3]), (None, [8, 8, 8, 8])]) == [("", 0, [9, 8, 8, 8]), ("a", 0, [1, 1, 1, 2]), ("a", 1, [2, 2, 3, 3])]


def test_star_clusters_of_a_chain_match_the_greedy_rule(spark, monkeypatch):
    """Chains in the order of keys, longer than the rounds reach."""
    monkeypatch.setattr(dedup, "ROUNDS", 2)
    rng = random.Random(2)
    data = [(i, 0, f"b{i}") for i in range(12)] + [(i + 1, 0, f"b{i}") for i in range(12)] + [(rng.randrange(100, 130), 1, f"c{rng.randrange(12)}") for _ in range(60)]
    data = sorted(set(data))
    keys = spark.createDataFrame(data, "doc_id long, band int, bucket string")
    meta = spark.createDataFrame([(i, float(i % 7)) for i in sorted({d[0] for d in data})], "doc_id long, relevance double")
    held, members = {}, {}
    for i, band, b in data:
        held.setdefault(i, set()).add((band, b))
    free = sorted(held)
    while free:
        first = free[0]
        members[first] = [k for k in free if k == first or held[k] & held[first]]
        free = [k for k in free if k not in members[first]]
    want = {}
    for first, group in members.items():
        best = max(group, key=lambda k: (k % 7, k == first, -k))
        want |= {k: (first if len(group) > 1 else -1, k == best) for k in group}
    got = {r["doc_id"]: (r["cluster_id"], r["keep"]) for r in dedup.star_clusters(keys, meta).collect()}
    assert got == want


@pytest.mark.parametrize("limit", (1, 20, 90, 4000))
def test_request_files_spread_over_tasks(spark, limit):
    """Greedy files that reach over blocks, for which no part's lines meet in one task."""
    rng = random.Random(limit)
    data = [(f"{i:04d}", rng.choice(("a", "a", "a", "b", None)), None if i == 7 else "é" * rng.choice((0, 3, 9, 30))) for i in range(600)]
    lines = spark.createDataFrame(data, "custom_id string, p string, line string")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        out = writers.request_files(lines, limit, "p")
        got = {r["custom_id"]: r["file"] for r in out.collect()}
        most = out.groupBy("part", F.spark_partition_id()).count().where("part = 'a'").agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset(name)
    want = {}
    for part in ("a", "b", None):
        file, held = 0, 0
        for i, p, line in data:
            if p == part:
                n = len((line or "").encode()) + 1
                file, held = (file + 1, n) if held and held + n > limit else (file, held + n)
                want[i] = file
    assert got == want and most < sum(p == "a" for _, p, _ in data)


def test_small_token_shards_share_a_task(spark, tmp_path, monkeypatch):
    """The number of tasks goes by bytes, not by files."""
    spark.dataSource.register(tkds.TokenSource)
    df = spark.range(200).select(F.array(*[(F.col("id") + k).cast("int") for k in range(8)]).alias("tokens")).coalesce(2)
    df.write.format("tkds").option("path", str(tmp_path / "t")).option("sequencesPerShard", 2).mode("append").save()
    assert len(list((tmp_path / "t").glob("*.bin"))) == 100
    for heads in ("false", "true"):
        back = spark.read.format("tkds").option("path", str(tmp_path / "t")).option("headerOnly", heads).load()
        assert back.rdd.getNumPartitions() == 1 and back.count() == (100 if heads == "true" else 200) and back.select("shard").distinct().count() == 100
    monkeypatch.setattr(tkds, "TASK_BYTES", 3 * (tkds.OPEN_BYTES + 48))
    parts = tkds.TokenReader({"path": str(tmp_path / "t")}).partitions()
    assert [len(p.paths) for p in parts] == [3] * 33 + [1]


def test_grid_is_one_task(spark):
    """Cross joins of local tables would make as many tasks as cores to the fourth power."""
    from corpuswright import queries

    grid = queries.queries()["grid_configs"](spark, "")
    assert grid.rdd.getNumPartitions() == 1 and grid.count() == 18


def test_signatures_hold_little_beside_a_batch(spark):
    """Hashes of four bytes, and signatures that leave the task by some documents."""
    from pyspark.sql import types as T

    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("a b "), F.col("id").cast("string"))).alias("text"))
    hashes = dedup.shingle_hashes(text.word_shingles(F.col("text")))
    assert df.select(hashes.alias("h")).schema["h"].dataType.elementType == T.IntegerType()
    got = {r["doc_id"]: (r["signature"], r["h"]) for r in dedup.signatures(df, text.word_shingles(F.col("text"))).join(df.select("doc_id", hashes.alias("h")), "doc_id").collect()}
    assert len(got) == 1200
    for sig, h in got.values():
        assert sig == ([min((a * x + b) % dedup.PRIME for x in h) for a, b in dedup.coefficients()] if h else None)


def test_values_are_mapped_one_by_one(spark, monkeypatch):
    """No batch of texts becomes Python strings at once."""
    import inspect

    df = spark.createDataFrame([("é" * 50,), ("",), (None,), ("xyz" * 9,)], "t string")
    want = [len(zlib.compress(t.encode())) / len(t.encode()) if t else 0.0 for (t,) in rows(df)]
    assert [r[0] for r in rows(df.select(text.compression_ratio(F.col("t"))))] == want
    assert "pandas" not in inspect.getsource(text)


def test_web_programme_scores_its_input_once(spark):
    """What follows the selection reads the rows chosen, not the whole input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = curation.web(scoring.hashed_scores(docs), 20_000)
    assert got.count() > 0 and not [f for f in got.inputFiles() if "testdata" in f]
