"""A bounded, labelled set of texts for the personal-data trees, generated from rules.

Every surface form of a kind occurs in both classes. An item passes its kind's
checks and stands in telling or plain surroundings; a look-alike of the same form
fails a check, stands in misleading surroundings, or is a date, version, time,
measure, hash or slug. Forms that say nothing by themselves (a bare run of digits, a
bare hash, a name at a host without a domain) are items in telling surroundings only.
"""

from __future__ import annotations

import random
import string

PLAIN = ("the and with for that this then here lorem ipsum nova item value house river green often later under paper light stone "
         "und von para los une des was were have will some many each into over").split()
BEFORE = {
    "email": ["mail: ", "email me: ", "contact ", "write to ", "reach us: ", "Email ", "send it to ", "e-mail = "],
    "ip": ["host ", "server ", "ip: ", "IP address ", "gateway = ", "ping ", "connect to ", "dns ", "login from "],
    "card": ["card ", "visa ", "credit card: ", "card number ", "paid with ", "amex ", "debit card ", "charged to "],
    "phone": ["call ", "phone: ", "tel. ", "mobile ", "fax ", "dial ", "call me on ", "phone number ", "whatsapp "],
    "secret": ["token = ", "api_key: ", "secret = ", "password is ", "key: ", "auth token ", "access key = ", "bearer ", "token: "],
}
AGAINST = ["order ", "order no. ", "version ", "serial no. ", "invoice ", "isbn ", "build ", "part no. ", "tracking id ", "ref. ", "ticket #", "batch ", "sku ", "section ", "model "]
AGAINST_OF = {"email": ["meet ", "look ", "arrived ", "stayed ", "file "], "secret": ["commit ", "sha1 ", "checksum ", "md5 ", "file ", "image ", "slug ", "uuid ", "digest ", "hash "], "ip": ["version ", "section ", "time ", "mac ", "ratio ", "release "]}
AFTER = ["", ".", ",", " ", ";", ")", "!"]


def _digits(r: random.Random, n: int, first: str = "0123456789") -> str:
    return r.choice(first) + "".join(r.choices(string.digits, k=n - 1)) if n else ""


def _sum(number: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10


def card_number(r: random.Random, good: bool) -> str:
    body = _digits(r, r.choice([12, 13, 14, 15, 15, 15, 15, 18]), "3456")
    right = next(c for c in string.digits if _sum(body + c) == 0)
    return body + (right if good else r.choice([c for c in string.digits if c != right]))


def _card(r: random.Random, good: bool) -> tuple[str, bool]:
    n = card_number(r, good)
    form = r.randrange(5)
    mark = r.choice([".", "_", "/", "  ", " - ", "-"])[:2]
    if len(n) == 15 and form < 3:
        return mark.join((n[:4], n[4:10], n[10:])), False
    if form == 4 and len(n) < 16:
        return n, False
    return (r.choice(["._/"[k] for k in range(3)]) if len(n) >= 16 else mark).join(n[i : i + 4] for i in range(0, len(n), 4)), False


def _phone(r: random.Random, good: bool) -> tuple[str, bool]:
    a, b, c = _digits(r, 3, "23456789"), _digits(r, 3, "23456789"), _digits(r, 4)
    forms = [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} {b}-{c}", f"1-{a}-{b}-{c}", f"{a}/{b}-{c}",
             f"0{_digits(r, 2)} {_digits(r, 7)}", f"0{_digits(r, 3)}/{_digits(r, 6)}", f"00{_digits(r, 2, '123456789')} {_digits(r, 2)} {_digits(r, 7)}", f"0{_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"0{_digits(r, 1)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}"]
    if r.random() < 0.15:
        return _digits(r, r.choice([8, 10, 11])), True
    return r.choice(forms), False


def _not_phone(r: random.Random) -> str:
    y, m, d = r.randrange(1900, 2040), r.randrange(1, 13), r.randrange(1, 29)
    k = r.choice("-./")
    return r.choice([f"{y}{k}{m:02}{k}{d:02}", f"{d:02}{k}{m:02}{k}{y}", f"{d}{k}{m}{k}{y}", f"{y}-{y + 3}", f"{y}/{y + 1}", f"{r.randrange(1, 99)}.{r.randrange(10, 99)}", f"{r.randrange(100, 999)} {r.randrange(100, 999)}",
                     f"{r.randrange(1, 9)} {r.randrange(100, 999)} {r.randrange(100, 999)}", f"978-{r.randrange(1, 9)}-{_digits(r, 2)}-{_digits(r, 6)}-{r.randrange(9)}", f"{_digits(r, 2)} {_digits(r, 2)}", f"{_digits(r, 4, '1')}-{_digits(r, 4, '1')}", f"{_digits(r, 2)}/{_digits(r, 2)}", f"{_digits(r, 5)}-{_digits(r, 4)}"])


def _name(r: random.Random) -> str:
    word = lambda: "".join(r.choices(string.ascii_lowercase, k=r.randrange(3, 9)))
    return r.choice([f"{word()}.{word()}", f"{word()}{r.randrange(10, 99)}", f"{word()}_{word()}", f"{word()[0]}.{word()}", word(), f"{word()}.{r.randrange(10, 99)}"])


def _email(r: random.Random, good: bool) -> tuple[str, bool]:
    host, end = "".join(r.choices(string.ascii_lowercase, k=r.randrange(3, 10))), r.choice(["com", "org", "net", "de", "fr", "es", "io", "edu", "info"])
    at, dot = r.choice([" at ", " [at] ", "[at]", " (at) ", "(at)", " {at} ", " <at> ", " AT ", " @ "]), r.choice([".", " dot ", " [dot] ", "[dot]", " (dot) ", "(dot)"])
    if at.strip().lower() in ("at", "@"):
        dot = "." if at == " @ " else r.choice([".", " dot "])
    elif dot == " dot ":
        dot = "."
    if r.random() < 0.12:
        return f"{_name(r)}@{host}", True
    own = _name(r)
    return f"{own}{at}{host}{dot}{end}", at == " at " and dot == "." and own.isalpha()


def _not_email(r: random.Random) -> str:
    w = r.choice(PLAIN)
    return r.choice([f"{w} at {r.choice(PLAIN)}.{r.choice(PLAIN)}", f"{w} (at) {r.choice(PLAIN)} (dot) {r.choice(PLAIN)}", f"5 @ {r.randrange(2, 99)}", f"{w} [at] {r.choice(PLAIN)}.{r.choice(PLAIN)}", f"{w} @ {r.choice(PLAIN)}", f"{r.randrange(2, 30)} at {r.randrange(2, 90)}.{r.randrange(10, 90)}", f"{w} at {r.choice(PLAIN)} dot {r.choice(PLAIN)}"])


def _ip(r: random.Random, good: bool) -> tuple[str, bool]:
    h = lambda: f"{r.randrange(1, 65536):x}"
    if r.random() < 0.4:
        q = [str(r.randrange(1, 256)) for _ in range(4)]
        if not good:
            q[r.randrange(4)] = str(r.randrange(256, 999))
        return r.choice(["[.]", " . ", ". ", " [.] "]).join(q), False
    if not good:
        return _not_ip(r), False
    return r.choice([":".join(h() for _ in range(8)), ":".join(f"{r.randrange(65536):04x}" for _ in range(8)), f"fe80::{h()}:{h()}", f"2001:db8::{h()}", f"{h()}:{h()}::{h()}", f"2001:{h()}:{h()}::{h()}:{h()}"]), False


def _not_ip(r: random.Random) -> str:
    two = lambda: f"{r.randrange(256):02x}"
    return r.choice([f"{r.randrange(24):02}:{r.randrange(60):02}:{r.randrange(60):02}", ":".join(two() for _ in range(6)), f"{r.randrange(9)}:{r.randrange(9)}:{r.randrange(9)}", "a::b", "std::", f"{r.randrange(100)}:{r.randrange(60):02}:{r.randrange(60):02}:{r.randrange(30):02}", f"{two()}::{r.choice('abcdef')}"])


def _secret(r: random.Random, good: bool) -> tuple[str, bool]:
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    if r.random() < 0.3:
        return r.choice([f"AKIA{some(string.ascii_uppercase + string.digits, 16)}", f"ghp_{some(mixed, 36)}", f"sk-{some(mixed, 40)}", f"xoxb-{some(string.digits, 11)}-{some(mixed, 24)}", f"eyJ{some(mixed, 40)}"]), False
    return r.choice([some(hexes, 32), some(hexes, 40), some(hexes, 64), some(mixed, r.randrange(20, 48)), some(mixed, 22) + "==", some(mixed, 18) + some(string.digits, 3)]), True


def _not_secret(r: random.Random) -> str:
    w = lambda: r.choice(PLAIN)
    return r.choice(["-".join([w(), w(), w(), w(), str(r.randrange(1990, 2030))]), f"{w()}_{w()}_{w()}_{r.randrange(100)}.txt", f"www.{w()}{w()}.com/{w()}/{w()}/{r.randrange(100)}", f"{w()}-{w()}-{w()}-{r.randrange(10)}", f"{w()}{w()}{w()}{w()}{r.randrange(100)}"])


MAKE = {"email": (_email, _not_email), "ip": (_ip, _not_ip), "card": (_card, None), "phone": (_phone, _not_phone), "secret": (_secret, _not_secret)}


def labelled(n: int, seed: int) -> list[tuple[str, int | None, int | None, int | None]]:
    """Texts with the kind (place in ``MAKE``) and the limits of the one item in them, or None."""
    r, out = random.Random(seed), []
    for _ in range(n):
        k = r.choice((0, 0, 1, 2, 3, 3, 4))  # names and telephone numbers have most forms
        kind = list(MAKE)[k]
        make, other = MAKE[kind]
        label = r.random() < 0.5
        lead = " ".join(r.choices(PLAIN, k=r.randrange(2, 7))) + " "
        if label:
            item, says_nothing = make(r, True)
            before = r.choice(BEFORE[kind]) if says_nothing or r.random() < 0.5 else ""
        elif other and r.random() < 0.35:
            item = other(r)
            before = r.choice(AGAINST + AGAINST_OF.get(kind, []) + BEFORE[kind]) if r.random() < 0.5 else ""
        else:
            bad = kind in ("card", "ip") and r.random() < 0.7
            item, says_nothing = make(r, not bad)
            # A number of a form that says nothing is none in plain surroundings either.
            before = r.choice(AGAINST_OF.get(kind, AGAINST)) if not bad and not (says_nothing and r.random() < 0.5) else r.choice(["", *BEFORE[kind]]) if bad else ""
        quote = r.choice(['"', "'"]) if kind == "secret" and r.random() < 0.5 else ""
        text = lead + before + quote + item + quote + r.choice(AFTER)
        end = text.rindex(item) + len(item) if item else 0
        if r.random() < 0.8:
            text += " " + " ".join(r.choices(PLAIN, k=r.randrange(1, 6)))
        out.append((text, k, end - len(item), end) if label else (text, None, None, None))
    return out
