"""Brute-force versions of the contracts, in plain Python."""

import re

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: id, text, and columns that clash with names that operators use inside.
TEXTS = [
    (1, "One two three four five six seven, eight nine ten."), (2, None), (3, ""), (4, "   "), (5, "One two three four five six seven, eight nine ten."),
    (1, "One two three four five six seven, eight nine ten."), (6, "word"), (7, "é漢字 <|endoftext|> ünïcode   \u0085x  y   z \n\n q"), (8, "lorem ipsum dolor " * 9000),
    (9, "a" * 30_000), (10, "mail a@b.c_d@e.f or 10.0.0.256, 10.0.0.1, +1 (233) 555-1234 4111 1111-1111 1111 4111111111111112"), (None, "no id at all"),
]


def frame(spark, texts=TEXTS):
    data = [(i, t, "src", "en", len(t or ""), f"g{k}", k, 0.5, 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, lang string, n_chars long, group string, shard long, score double, node int")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(texts, width, percent=80):
    """doc_id -> least doc_id reachable, by all pairs."""
    sets = {i: shingles(t, width) for i, t in texts if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}
