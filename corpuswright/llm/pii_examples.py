"""Labelled examples of personal data and of what merely looks like it, made by rule.

No corpus says where its personal data stands. So the trees learn from lines made here: values in many
formats, with and without words that announce them, against dates, versions, prices, order numbers, hashes
and identifiers. A label is what the line was made to hold, never what the base rules say of it."""

from __future__ import annotations

import random
from collections.abc import Callable

#: Lines made; SEED makes them the same everywhere.
EXAMPLES, SEED = 6_000, 20240301

CUES = {
    "phone": ("call", "phone:", "tel.", "Tel:", "mobile", "fax:", "ring me at", "Telefon", "Anruf unter", "llame al", "teléfono", "appelez le"),
    "card": ("card", "Visa", "credit card:", "my card number is", "Karte", "tarjeta", "carte bancaire"),
    "email": ("mail", "contact", "write to", "e-mail:", "Kontakt:", "correo", "reach me:"),
    "secret": ("api_key =", "secret:", "token =", "password=", 'password: "', "export ACCESS_KEY=", "Authorization: Bearer", "pwd=", "client_secret="),
    "number": ("order", "invoice no.", "version", "page", "ISBN", "on", "in", "commit", "sha256:", "id", "build", "part number", "section", "about", "costs", "between"),
}


def _luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def _filler(rng: random.Random) -> str:
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "is", "re", "ha", "to", "st", "ei", "ue", "la", "o", "a", "e")) for _ in range(rng.randint(1, 4)))
    return " ".join(word() for _ in range(rng.randint(1, 7))) + rng.choice(("", "", ",", "."))


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def _phone(rng: random.Random) -> str:
    n = lambda k: _number(rng, k)
    sep = rng.choice((" ", "-", ".", " - ", "/"))
    return rng.choice((
        f"({n(3)}) {n(3)}-{n(4)}", f"({n(3)}){n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(2)}/{n(7)}", f"0{n(3)} {n(3)} {n(4)}", f"(0{n(2)}) {n(4)} {n(4)}", f"+{n(2)} {n(3)} {n(3)} {n(3)}",
        f"+1 ({n(3)}) {n(3)}-{n(4)}", f"00{n(2)} {n(2)} {n(4)} {n(4)}", f"1-{n(3)}-{n(3)}-{n(4)}", "0" + _grouped(n(9), (1, 2, 2, 2, 2), rng.choice(" .")),
    ))


def _card(rng: random.Random, valid: bool = True) -> str:
    n = rng.choice((15, 16, 16, 16, 19))
    body = ("3" if n == 15 else rng.choice("456")) + "".join(rng.choice("0123456789") for _ in range(n - 2))
    last = _luhn_digit(body)
    digits = body + (last if valid else str((int(last) + rng.randint(1, 9)) % 10))
    sizes = (4, 6, 5) if n == 15 else (4, 4, 4, 4, 3)[: 4 + (n > 16)]
    return _grouped(digits, sizes, rng.choice((" ", "-", ".", "  ", "/", "")))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) + rng.choice(("", "", ".", "_", "-")) + rng.choice(("", "smith", "maria", "k", "42"))


def _email(rng: random.Random) -> str:
    name, host, tld = _name(rng).rstrip("._-"), _name(rng).strip("._-"), rng.choice(("com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk"))
    at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" {at} ", " {dot} "), ("(at)", "."), (" [at] ", "."), ("@", ".")))
    if at == "@":
        return f"{name}@{host}{rng.choice('üéñö')}x.{tld}" if rng.random() < 0.5 else f"{name}@{host}.{tld}"
    return f"{name}{at}{host}{dot}{tld.replace('.', dot)}"


def _secret(rng: random.Random, cued: bool) -> str:
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    vendor = [lambda: "AKIA" + some(up + dig, 16), lambda: "ghp_" + some(up + low + dig, 36), lambda: "sk-" + some(up + low + dig, rng.choice((32, 48))), lambda: "xoxb-" + some(dig, 11) + "-" + some(up + low + dig, 24)]
    if not cued:
        return rng.choice(vendor)()
    plain = [lambda: some(dig + "abcdef", rng.choice((16, 18, 32, 40))), lambda: some(up + low + dig, rng.choice((16, 20, 24, 32))), lambda: some(up + low + dig + "+/", 40), lambda: some(low + dig + "!#%", rng.randint(8, 14)) + some(dig, 2)]
    return rng.choice(vendor + plain + plain)()


def _other(rng: random.Random) -> tuple[str, str]:
    """What is no personal data: (what kind of words stand before it, value)."""
    n = lambda k: _number(rng, k)
    date = lambda sep: f"{rng.randint(1900, 2030)}{sep}{rng.randint(1, 12):02}{sep}{rng.randint(1, 28):02}"
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    words = lambda: rng.choice(("_", "-")).join(rng.choice(("very", "long", "name", "value", "section", "internal", "config", "handler", "default", "layout", "version", "part")) for _ in range(rng.randint(3, 5)))
    return "number", rng.choice((
        date("-"), date("/"), date("."), f"{date('-')} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)}", date("-").replace("-", ""),
        f"{rng.randint(1900, 1990)}-{rng.randint(1991, 2030)}", f"{rng.randint(1900, 1990)} {rng.randint(1991, 2030)} {rng.randint(1991, 2030)}", n(7), n(8), n(9), n(10), n(12), n(14), f"{n(3)}.{n(6)}", f"0.{n(9)}", f"3.{n(12)}",
        f"{n(1)} {n(3)} {n(3)}", f"{n(2)}.{n(3)}.{n(3)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(1)}.{n(2)}.{n(1)}.{n(4)}", f"{n(3)}.{n(3)}.{n(3)}.{rng.randint(256, 999)}", f"{n(4)} {n(4)}", f"{n(2)} {n(2)} {n(2)} {n(2)}", f"{n(5)}-{n(4)}",
        _card(rng, False), _card(rng, False), f"{n(4)}-{n(4)}-{n(4)}", hexa(32), hexa(40), hexa(64), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", words() + n(1), words() + "_" + n(2), f"{words()}/{n(4)}/{n(2)}/{words()}",
        f"{_name(rng)}@localhost", f"{_name(rng)} @ {n(1)}.{n(2)}", f"@{_name(rng)}", f"{_name(rng)} at {_name(rng)} dot {_name(rng)}xyz", f"{n(2)} at {n(3)} dot", "CamelCaseName" + n(2) + "WithMoreWords", f"x{n(16)}y", f"${n(3)},{n(3)},{n(3)}",
    ))


def examples() -> list[dict]:
    """text, start, end, label (1: the span is personal data). Half of what is personal has no cue before it."""
    rng, out = random.Random(SEED), []
    makers: dict[str, Callable[[bool], str]] = {"phone": lambda _: _phone(rng), "card": lambda _: _card(rng), "email": lambda _: _email(rng), "secret": lambda cued: _secret(rng, cued)}
    for k in range(EXAMPLES):
        label = k % 2
        if label:
            kind, cued = rng.choice(tuple(makers)), rng.random() < 0.5
            value = makers[kind](cued)
            cue = rng.choice(CUES[kind]) if cued else ""
        else:
            kind, value = _other(rng)
            cue = rng.choice(CUES["number"]) if rng.random() < 0.5 else ""
        joint = "" if cue.endswith(("=", '"')) and rng.random() < 0.7 else " " if cue else ""
        before = f"{_filler(rng)} {cue}{joint}"
        out.append({"text": f"{before}{value} {_filler(rng)}", "start": len(before), "end": len(before) + len(value), "label": label})
    return out
