"""Texts as sequences of space-delimited pieces, encoded once per distinct piece.

A single space between two characters that aren't white space always starts a pre-token of the
byte-level pattern, whatever stands around it. So a text can be cut before each such space, the
pieces encoded apart, and the ids joined: the result is that of the whole text. Most pieces recur,
so each worker keeps the results of the latest ones in a cache of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TWO = re.compile(r"\s\s")
#: The same for Arrow, whose own \s is that of ASCII.
_TWO_ARROW = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_CUT_LINES = re.compile(r"(?<=\S)(?=[ \n]\S)")


def split(text: str) -> list[str]:
    """Keys of the pieces of text. Each piece but the first begins with a space, which its key lacks;
    the first one's key has a space more. No other key begins with one."""
    parts = _CUT.split(text) if _TWO.search(text) else text.split(" ")
    parts[0] = " " + parts[0]
    return parts


class Pieces:
    """encode(pieces) -> for each, its value and whether it is worth keeping; called with distinct unseen pieces.
    most: entries kept; the cache starts anew beyond that. Most pieces of natural text never come
    again, so that an encoder keeps one only when it has met its word before."""

    def __init__(self, encode: Callable[[list[str]], tuple[list, list[bool]]], most: int = 500_000):
        self.encode, self.most, self.known = encode, most, {}
        # Millions of strings come and go here, and no cycles: seldom look for those.
        gc.set_threshold(200_000, 50, 100)

    def values(self, texts: list[str]) -> Iterator[Iterator]:
        """The values of each text's pieces, in order."""
        parts = [split(t) for t in texts]
        wanted, known = set().union(*parts), self.known
        # Each piece comes up several times here: they are looked up in a table that fits the processor's cache.
        here = {k: known[k] for k in wanted if k in known}
        new = [k for k in wanted if k not in here]
        if new:
            values, keep = self.encode([k[1:] if k[:1] == " " else " " + k for k in new])
            here.update(zip(new, values, strict=True))
            if len(known) + len(new) > self.most:
                known.clear()
            known.update(x for x, k in zip(zip(new, values, strict=True), keep, strict=True) if k)
        find = here.__getitem__
        for p in parts:
            yield map(find, p)


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of texts (no nulls), cut before single line ends too: the pieces; which of them stand one after another
    in the texts; where each text begins and ends among those. Few pieces are listed twice.

    A line end between two characters that aren't white space is a pre-token of its own, as nothing but a space can
    begin a longer one."""
    odd = pc.match_substring_regex(texts, _TWO_ARROW).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    parts = [_CUT_LINES.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    keys, sizes = plain.flatten(), np.empty(len(texts), np.int64)
    sizes[~odd], sizes[odd] = pc.list_value_length(plain).to_numpy(), [len(p) for p in parts]
    order = np.argsort(odd, kind="stable")
    end = np.empty(len(texts), np.int64)
    end[order] = np.cumsum(sizes[order])
    begin = end - sizes
    coded = keys.dictionary_encode()
    # A text's first piece, and those cut one by one, stand for themselves; others lack their space.
    whole = pa.concat_arrays([keys.take(pa.array(begin[~odd])), pa.array([x for p in parts for x in p], texts.type)]).dictionary_encode()
    which = np.concatenate([coded.indices.to_numpy(), np.empty(len(whole) - int((~odd).sum()), np.int32)])
    own = np.concatenate([begin[~odd], np.arange(len(keys), len(which))])
    which[own] = whole.indices.to_numpy() + len(coded.dictionary)
    used = np.zeros(len(coded.dictionary) + len(whole.dictionary), bool)
    used[which] = True
    rest = coded.dictionary
    pieces = pa.concat_arrays([pc.if_else(pc.starts_with(rest, "\n"), rest, pc.binary_join_element_wise(pa.scalar("", rest.type), rest, pa.scalar(" ", rest.type))), whole.dictionary])
    return pieces.filter(pa.array(used)), (np.cumsum(used) - 1)[which], begin, end


def heads_and_tails(pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the pieces; which of them each piece begins with; which mark at a piece's end is apart (else the last
    word, which is empty). Marks after a letter begin a pre-token."""
    heads = pc.utf8_rtrim(pieces, characters=MARKS)
    apart = pc.and_(pc.less(pc.binary_length(heads), pc.binary_length(pieces)), pc.utf8_is_alpha(pc.utf8_slice_codeunits(heads, -1)))
    tails = pc.replace_substring_regex(pieces.filter(apart), r"(?s)\A.*[^" + re.escape(MARKS) + "]", "")
    coded = pa.concat_arrays([pc.if_else(apart, heads, pieces), tails]).dictionary_encode()
    which = coded.indices.to_numpy()
    words = pa.concat_arrays([coded.dictionary, pa.array([""], pieces.type)])
    ends = np.full(len(pieces), len(words) - 1)
    ends[apart.to_numpy(zero_copy_only=False)] = which[len(pieces) :]
    return words, which[: len(pieces)], ends


class Words:
    """encode(words) -> for each, a byte string, or a tuple of as many as there are fields; called with distinct words.

    Arrow cuts texts into pieces and pieces into words, tells equal ones apart and joins their values, so that Python
    meets only the distinct words of some texts at a time. Values of the latest words are kept, between most and
    twice as many: those that come up again outlive the others."""

    def __init__(self, encode: Callable[[list[str]], list], fields: int, most: int):
        self.encode, self.fields, self.most = encode, fields, most
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}
        # Millions of strings come and go here, and no cycles: seldom look for those.
        gc.set_threshold(200_000, 50, 100)

    def _values(self, words: list[str]) -> list:
        values = list(map(self.now.get, words))
        missing = [n for n, v in enumerate(values) if v is None]
        unseen = []
        for n in missing:
            values[n] = self.before.get(words[n])
            if values[n] is None:
                unseen.append(n)
        for n, v in zip(unseen, self.encode([words[n] for n in unseen]) if unseen else (), strict=True):
            values[n] = v
        if len(self.now) + len(missing) > self.most:
            self.now, self.before = {}, self.now
        self.now.update((words[n], values[n]) for n in missing)
        return values

    def joined(self, texts: pa.Array) -> list[tuple[memoryview, list[int], list[int]]]:
        """For each field, the bytes of all texts, and where each text's begin and end in them. A null counts as empty."""
        pieces, which, begin, end = numbered(pc.fill_null(texts, ""))
        words, heads, tails = heads_and_tails(pieces)
        *names, _ = words.to_numpy(zero_copy_only=False).tolist()
        values, out = self._values(names), []
        for column in [values] if self.fields == 1 else zip(*values, strict=True):
            coded = pa.array([*column, b""], pa.large_binary())
            whole = pc.binary_join_element_wise(coded.take(pa.array(heads)), coded.take(pa.array(tails)), pa.scalar(b"", pa.large_binary()))
            taken = whole.take(pa.array(which))
            _, places, data = taken.buffers()
            at = np.frombuffer(places, np.int64, len(taken) + 1)
            out.append((memoryview(data or b""), at[begin].tolist(), at[end].tolist()))
        return out

    def values(self, texts: list[str]) -> Iterator[Iterator]:
        """Each text's value, as its only piece: the bytes themselves if there is one field."""
        columns = [[bytes(data[i:j]) for i, j in zip(begin, end, strict=True)] for data, begin, end in self.joined(pa.array(texts, pa.string()))]
        for v in zip(*columns, strict=True):
            yield iter(v if self.fields == 1 else (v,))


def chunks(texts: list[str] | pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Slices of texts that hold about so many characters (bytes, of an array); one text at least."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else map(len, texts)):
        size += n
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


#: Characters that are neither letters, numbers nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pre-tokens whose counts a worker keeps, and half as many as those whose codes it keeps.
WORDS = 700_000
RECENT_WORDS = 600_000
_loaded: dict = {}


def forget() -> None:
    """Give back the memory of this Python worker's encoders. Workers outlive stages, so that stages
    that need none of them call this first."""
    if _loaded:
        _loaded.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps what it has
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def library_encoder(path: str, ids: bool) -> Pieces | Words:
    """Pieces by the tokenizers library, one for each Python worker: their ids as little-endian
    unsigned 32-bit integers, or just how many there are.

    Marks at a piece's end are encoded apart from the word before them. Unseen words are joined and
    encoded together; as each begins a pre-token, the bytes that the tokens stand for tell which ids
    belong to which word."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, ids) not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # a text that holds their strings holds ordinary text
        # A byte-level token is written with one character for each of its bytes.
        width = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])

        words: dict[str, int] = {}

        def coded(new: list[str]) -> Iterator[tuple[str, bytes, int, int]]:
            """Each word with a string of ids, and the first and last (exclusive) of its own there."""
            joined = [x for x in new if x[:1] in (" ", "\n") and x.strip() == x[1:] and len(x) > 1]
            groups = [joined[k : k + 500] for k in range(0, len(joined), 500)] + [[x] for x in set(new).difference(joined)]
            for group, e in zip(groups, tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False), strict=True):
                found = np.array(e.ids, "<u4")
                data, begin = found.tobytes(), 0
                cuts = np.searchsorted(np.cumsum(width[found]), np.cumsum([len(x.encode()) for x in group])) + 1 if len(group) > 1 else np.array([len(found)])
                for x, end in zip(group, cuts.tolist(), strict=True):
                    yield x, data, begin, end
                    begin = end

        def add(new: list[str]) -> None:
            words.update((x, end - begin) for x, _, begin, end in coded(new))

        def encode_ids(new: list[str]) -> list[bytes]:
            found = {x: data[4 * begin : 4 * end] for x, data, begin, end in coded(new)}
            return [found[x] for x in new]

        def encode(new: list[str]) -> tuple[list, list[bool]]:
            heads, tails = [], []
            for x in new:
                head = x.rstrip(MARKS)
                if len(head) < len(x) and head and head[-1].isalpha():  # marks after a letter begin a pre-token
                    heads.append(head)
                    tails.append(x[len(head) :])
                else:
                    heads.append(x)
                    tails.append("")
            wanted = {*heads, *tails}
            unseen = {w for w in wanted if w not in words}
            if len(words) + len(unseen) > WORDS:
                words.clear()
                unseen = wanted
            add(list(unseen))
            words[""] = 0
            get = words.__getitem__
            return [get(h) + get(t) if t else get(h) for h, t in zip(heads, tails, strict=True)], [h not in unseen for h in heads]

        _loaded[path, ids] = Words(encode_ids, 1, RECENT_WORDS) if ids else Pieces(encode)
    return _loaded[path, ids]
