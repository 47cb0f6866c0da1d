"""Token store, length histogram, BPE and media against the libraries they stand for."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from corpuswright import tables
from corpuswright.llm import bpe, media, pieces, token_counts, token_store
from corpuswright.llm.queries import tokenizer_path, tokenizer_pattern

from .helpers import TEXTS, frame

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    return lambda text: e.encode_ordinary(text or "")


def noise(seed, n=400):
    rng = random.Random(seed)
    alphabet = "ab '’sltré\n\t  　漢12.!,\x1c\x85 %|\0"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_pieces_join_to_the_whole(library):
    texts = noise(1) + [t or "" for _, t in TEXTS]
    assert [b"".join(v) for v in pieces.library_encoder(PATH, True).values(texts)] == [packed(library(t)) for t in texts]
    assert [sum(v) for v in pieces.library_encoder(PATH, False).values(texts)] == [len(library(t)) for t in texts]


def test_cache_starts_anew():
    p = pieces.Pieces(lambda new: (list(new), [len(x) % 2 == 0 for x in new]), most=3)
    assert ["".join(v) for v in p.values(["a b c d e", "a f"])] == ["a b c d e", "a f"] and ["".join(v) for v in p.values(["g h"])] == ["g h"]


def test_words_are_met_once():
    """Line ends and marks make no new words, all white space is told apart, and words that come up again are kept."""
    met = []
    w = pieces.Words(lambda new: met.extend(new) or [x.encode() for x in new], 1, most=6)
    texts = ["one two.\none two,\ntwo", None, "", "one\u2003 two", " two\n", "two!"]
    for _ in range(2):
        ((data, begin, end),) = w.joined(pa.array(texts))
        assert [bytes(data[i:j]).decode() for i, j in zip(begin, end, strict=True)] == [t or "" for t in texts]
    assert len(met) == len(set(met)) and {x for x in met if "two" in x} == {"two", " two", "\ntwo", "one\u2003 two"}
    for k in range(40):
        list(w.values([f"one {k}"]))
    assert met.count("one") == 1 and len(w.now) + len(w.before) < 3 * 6 + 20 and len(met) == len(set(met))
    spaces = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert pc.match_substring_regex(pa.array([c * 2 for c in spaces]), pieces._TWO_ARROW).to_pylist() == [True] * len(spaces)


def test_library_words(library):
    texts = ["a b.\nc d", "\n", "\n\n", " \n", "\nabc\n", "a \nb\n c", "it's\n's,\n'll", "<|endoftext|>\nx", "x\r\ny\tz\n", None, "", " "] + noise(7, 1500)
    ((data, begin, end),) = pieces.library_encoder(PATH, True).joined(pa.array(texts))
    assert [bytes(data[i:j]) for i, j in zip(begin, end, strict=True)] == [packed(library(t)) for t in texts]


def test_levels_give_any_token():
    rng = np.random.default_rng(3)
    ids = rng.choice([0, 5, 255, 256, 50_000, 70_000, 2**32 - 1], 3000).astype(np.uint32)
    levels = token_store.Levels(token_store.pack_levels(ids))
    assert all(levels.token(i) == ids[i] for i in rng.integers(0, 3000, 300))
    assert all((levels.slice(a, b) == ids[a:b]).all() for a, b in ((0, 3000), (0, 0), (7, 9), (511, 1025), (2999, 3000), (3000, 3000)))
    assert len(token_store.Levels(token_store.pack_levels(ids[:0]))) == 0
    with pytest.raises(ValueError):
        token_store.Segment(b"nope" * 10)


def test_token_store(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 50)
    df = frame(spark)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.write_and_read(df, PATH, 2).collect()))
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = [*library(t), 2]
        want.append((at, i, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    assert got == want
    assert token_store.write_and_read(df.limit(0), PATH, 2).count() == 0


def test_any_token_from_the_files(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_TOKENS", 2000)
    texts = [(i, t) for i, t in TEXTS if i not in (None, 1)]
    path = tables.new_path(spark, "tokens")
    token_store.write(token_store.encode(frame(spark, texts).repartition(3), PATH, 2), path)
    listed = token_store.manifest(spark, path).collect()
    assert len(listed) > 2 and sum(r.n_docs for r in listed) == len(texts)
    rng = random.Random(4)
    for i, t in texts:
        ids = [*library(t), 2]
        (name,) = [r.path for r in listed if r.n_docs and r.first <= i <= r.last]
        s = token_store.StoredSegment(spark, name)
        k = s.find(i)
        assert s.doc_id(k) == i and s.length(k) == len(ids) and s.find(10**9) is None
        before = s.bytes_read
        for at in {0, len(ids) - 1, *(rng.randrange(len(ids)) for _ in range(10))}:
            assert s.token(k, at) == ids[at]
        assert s.bytes_read - before < 12 * 300  # never a whole document
        with pytest.raises(IndexError):
            s.token(k, len(ids))
        s.close()


def test_length_histogram(spark, library):
    df = frame(spark)
    table = token_counts.suffix_table(tables.written(token_counts.histogram(token_counts.lengths(df, PATH)), "h"))
    lengths = [len(library(t)) for _, t in TEXTS]
    for r in table.collect():
        n = r.n_tokens
        assert r.docs == lengths.count(n) and r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and abs(r.share_at_most - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    assert sorted(r.n_tokens for r in table.collect()) == sorted(set(lengths))
    found = {(r.kind, r["at"]): r.value for r in token_counts.answers(table, [4, 100], [0.5, 1.0]).collect()}
    assert found == {("truncated_total", 4.0): sum(min(x, 4) for x in lengths), ("truncated_total", 100.0): sum(min(x, 100) for x in lengths), ("quantile", 0.5): sorted(lengths)[(len(lengths) + 1) // 2 - 1], ("quantile", 1.0): max(lengths)}
    assert token_counts.suffix_table(token_counts.histogram(token_counts.lengths(df.limit(0), PATH))).count() == 0


def test_bpe_matches_the_library(spark, tik):
    df = frame(spark)
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    got = sorted(((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_and_decode(df, path, tokenizer_pattern()).collect()))
    want = sorted((i or -1, len(tik(t)), hashlib.sha256(packed(tik(t))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert got == want and bpe.encode_and_decode(df.limit(0), path, tokenizer_pattern()).count() == 0
    kept = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode_and_decode(df.where("doc_id = 7"), path, tokenizer_pattern(), keep=True).collect()}
    assert kept == {7: (tik(TEXTS[7][1]), TEXTS[7][1].encode())}


def test_bpe_words(tik):
    w = bpe.worker(tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())
    texts = noise(2)
    assert [b"".join(x[0] for x in v) for v in w.values(texts)] == [packed(tik(t)) for t in texts]
    coder = bpe.WordEncoder(bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abcderst") for _ in range(rng.randint(2, 60))) for _ in range(300)})
    by_query, by_rounds = coder._recursive(words), coder._recursive_long(words)
    assert [x.tolist() for x in by_query] == [x.tolist() for x in by_rounds] and coder.decode(by_query) == words


def test_bpe_queries_recurring_words_once(tik, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(pieces, "_loaded", {})
    queried, plain = [], bpe.WordEncoder.encode
    monkeypatch.setattr(bpe.WordEncoder, "encode", lambda self, words: queried.extend(words) or plain(self, words))
    w = bpe.worker(tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())
    for k in range(60):
        text = f"{'ab' * k}x,\nthe,\nit's  {'ba' * k}y\n\n thé!"
        ((ids, decoded),) = next(w.values([text]))
        assert ids == packed(tik(text)) and decoded == text.encode()
    assert queried.count(b"the") == 1


def test_bpe_words_of_any_length(tik, monkeypatch):
    """Across the length from which the second recursive query works, and over several runs of it."""
    import tiktoken

    ranks = bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    some = lambda chars, n: bytes(rng.choice(chars) for _ in range(n))
    words = [some(b"abcdefghijklmnopqrstuvwxyz", n) for n in (399, 400, 401, 900)] + [b"a" * 5000, b"a" * 40_001, b"ab" * 400 + b"a" * 77, some(b"aeth", 1500), "é漢".encode() * 300, b"ha" * 300 + b"the" * 200]
    monkeypatch.setattr(bpe, "QUERY_ROWS", 30_000)
    coder = bpe.WordEncoder(ranks)
    got = coder.encode(words)
    assert [x.tolist() for x in got] == [library.encode_ordinary(x.decode()) for x in words] and coder.decode(got) == words


@pytest.mark.parametrize("n", (1, 2, 16, 17, 33))
def test_streams_round_trip(n):
    payload = bytes(np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8))
    s = media.parse(media.mux(payload))
    assert s.payload == payload and s.discontinuities == 0 and s.programmes == {1: media.PMT_PID} and s.streams == {media.STREAM_PID: media.PRIVATE_DATA}
    assert [p[1] for p in s.access_points] == list(range(0, len(payload), 576 * 16)) and s.timestamps == [k * 16 * media.UNIT_TICKS for k in range(len(s.timestamps))]
    assert media.seek(b"", s, s.timestamps[-1] + 5) == s.access_points[-1] and media.points_of(len(payload)) == s.access_points
    # A packet without a payload stands between others and repeats the counter before it.
    m, p = media.mux(payload), media.PACKET
    blank = bytes([0x47, media.STREAM_PID >> 8, media.STREAM_PID & 255, 0x20 | m[2 * p + 3] & 15, 183, 0]).ljust(p, b"\xff")
    assert media.parse(m[: 3 * p] + blank + m[3 * p :]).discontinuities == 0


def test_broken_streams_are_refused():
    m = media.mux(bytes(576 * 20))
    for bad in (b"", m[:-1], b"\0" + m[1:], m[:6] + b"\7" + m[7:]):
        with pytest.raises(ValueError):
            media.parse(bad)
    p = media.PACKET
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7
    with pytest.raises(ValueError, match="length"):
        media.parse(m[: 4 * p] + m[5 * p :])


def test_media(spark):
    df = frame(spark)
    got = media.write_and_read(df).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        text = next((t or "") for i, t in TEXTS if i == r.doc_id)
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(payload)), hashlib.sha256(media.mux(payload)).hexdigest())
        by.setdefault(text, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values()) and media.write_and_read(df.limit(0)).count() == 0
