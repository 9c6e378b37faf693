"""Labelled example sentences from which the trees of :mod:`tidemark.llm.pii` are fitted, made by a rule."""

from __future__ import annotations

import random


def _card(rng: random.Random, right: bool) -> str:
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
    check = -total % 10 if right else (-total + rng.randrange(1, 10)) % 10
    text = "".join(map(str, [*digits, check]))
    return rng.choice(" ./_-").join(text[i : i + 4] for i in range(0, 16, 4))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("aeiounrstlmdk") for _ in range(rng.randrange(3, 9)))


def _phone(rng: random.Random) -> str:
    a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])


def _mail(rng: random.Random) -> str:
    at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" @ ", "."), (" [at] ", " [dot] ")])
    return f"{_word(rng)}.{_word(rng)}{at}{_word(rng)}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es'])}"


def examples(n: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]], bool]]:
    """Sentences with the places of personal data and whether they are held out of fitting."""
    rng = random.Random(seed)
    for_kind = {
        "card": ["card number", "paid with visa", "credit card:", "Karte", "carte", "tarjeta"],
        "phone": ["call", "phone:", "tel.", "mobile", "Telefon", "fax"],
        "email": ["mail", "e-mail:", "contact", "write to", "Kontakt"],
        "ip": ["host", "server", "ip", "login from"],
    }
    against = ["order", "invoice", "version", "ISBN", "serial", "ref", "part", "build", "sku", "ticket"]
    make = {
        "card": lambda: _card(rng, True),
        "phone": lambda: _phone(rng),
        "email": lambda: _mail(rng),
        "ip": lambda: ":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8)),
    }
    out = []
    for k in range(n):
        kind = ["card", "phone", "email", "ip"][k % 4]
        sort = rng.randrange(6)
        lead, tail = f"{_word(rng)} {_word(rng)}", f"{_word(rng)} {_word(rng)}."
        if sort < 3:  # personal, mostly with a word that says so
            cue = rng.choice(for_kind[kind]) if sort < 2 or kind in ("card", "phone") else _word(rng)
            text, personal = make[kind](), True
        elif sort == 3:  # numbers of other things
            cue, personal = rng.choice(against), False
            text = make["phone" if kind == "email" else kind]() if kind != "card" else _card(rng, False)
            if kind == "ip":
                text = ":".join(f"{rng.randrange(10, 60)}" for _ in range(8))
        elif sort == 4:  # no word says what it is
            cue, personal = _word(rng), False
            text = _card(rng, False) if kind in ("card", "email") else _phone(rng) if kind == "phone" else ":".join(f"{rng.randrange(10, 60)}" for _ in range(8))
        else:  # parts of something else
            cue, personal = rng.choice(against), False
            text = {"card": " ".join(f"{rng.randrange(100, 9999)}" for _ in range(4)), "phone": f"{rng.randrange(10, 99)}/{rng.randrange(100, 999)}/{rng.randrange(1000, 9999)}", "email": f"{_word(rng)} @ {_word(rng)}.{rng.randrange(10)}", "ip": ":".join(["0"] * 8)}[kind]
        before = f"{lead} {cue} "
        out.append((f"{before}{text} {tail}", [(kind, len(before), len(before) + len(text))] if personal else [], k // 4 % 3 == 0))
    return out
