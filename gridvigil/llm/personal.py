"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, link schemes
and words that announce an account. A parser for each kind then grows a span from its
anchor, and checks it (number ranges, digit counts, Luhn and mod-97 sums). Texts are
handled one by one, so nothing is shuffled.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``; the method adds ``link_login``
(user and password in a link), ``mail_link``, ``iban`` and ``account`` (a number behind its cue).

Defined results: a null or empty text has no spans; repeated rows each get a row; other
columns play no part; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame

from gridvigil.llm.common import map_rows, sql_type

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "link_login", "mail_link", "iban", "account")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
MAIL_SCHEMES = ("mailto:", "sip:", "xmpp:")
ACCOUNT_CUES = (
    "account number", "account no", "acct no", "account #", "passport no", "passport number",
    "ssn", "social security number", "tax id", "customer number", "kontonummer", "numéro de compte",
    "número de cuenta",
)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
WORD = re.compile(r"\w")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/@:?#\"'<>]+@[A-Za-z0-9.-]+")
#: short groups with a digit each, joined by spaces or hyphens; or groups of any kind joined by hyphens
_GROUP = r"(?=[A-Z]{0,5}[0-9])[0-9A-Z]"
ACCOUNT = re.compile(
    rf"(?:\.|:|#|\s|is|ist){{0,4}}({_GROUP}{{1,6}}(?:[ -]{_GROUP}{{1,6}}(?![0-9A-Za-z])){{1,8}}"
    r"|[0-9A-Z]{1,34}(?:-[0-9A-Z]{1,34}){0,8})(?![0-9A-Za-z])"
)
#: cues whose number has a fixed form
FORMS = {cue: re.compile(r"(?:\.|:|#|\s|is){0,4}([0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4})(?![0-9A-Za-z])") for cue in ("ssn", "social security number")}
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: characters of an IBAN by country
IBAN_SIZES = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 "
        "EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
        "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
        "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "
    ).split()
}


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for digit in sorted(DIGITS):
        found.add_word(digit, ("digit", 1))
    for cue in SCHEMES:
        found.add_word(cue, ("link_login", len(cue)))
    for cue in MAIL_SCHEMES:
        found.add_word(cue, ("mail_link", len(cue)))
    for cue in ("IBAN", "iban", "Iban"):
        found.add_word(cue, ("iban", len(cue)))
    for cue in ACCOUNT_CUES:
        for spelt in {cue, cue.capitalize(), cue.title(), cue.upper()}:
            found.add_word(spelt, ("account", len(spelt)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = value * 2 - 9 * (value > 4)
        total += value
    return total % 10 == 0


def small_part(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def mod_97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """Where the IBAN at ``at`` ends: at its country's length, else the last end of a word that passes the check."""
    m = IBAN.match(text, at)
    if not m:
        return None
    size = IBAN_SIZES.get(m[0][:2])
    for end in range(m.end(), at, -1):
        if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
            continue
        code = text[at:end].replace(" ", "")
        if (len(code) == size if size else len(code) >= 15) and mod_97(code):
            return end
    return None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last match of a kind, kept or dropped, ended

    def take(kind: str, start: int, end: int, good: bool) -> None:
        done[kind] = end
        if good:
            found[kind].append((start, end))

    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if kind == "digit":
            if start and text[start - 1] in DIGITS:
                continue  # a span that holds this digit begins at the run's first one
            if start >= done["ip"] and (m := IP.match(text, start)):
                take("ip", start, m.end(), all(map(small_part, m[0].split("."))))
            if start >= done["card"] and (m := CARD.match(text, start)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", start, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif kind == "email":
            first = start
            while first > done["email"] and text[first - 1] in LOCAL:
                first -= 1
            if first < start and start >= done["email"] and (m := DOMAIN.match(text, start + 1)):
                take("email", first, m.end(), True)
        elif kind == "phone":
            if start >= done["phone"] and (m := PHONE.match(text, start)):
                take("phone", start, m.end(), 8 <= sum(map(DIGITS.__contains__, m[0])) <= 15)
        elif start < done[kind] or start and kind != "link_login" and WORD.match(text[start - 1]):
            continue
        elif kind == "link_login":
            if m := LOGIN.match(text, last + 1):
                take(kind, start, m.end(), True)
        elif kind == "mail_link":
            end = last + 1
            while end < len(text) and text[end] in LOCAL:
                end += 1
            if end > last + 1 and text[end : end + 1] == "@" and (m := DOMAIN.match(text, end + 1)):
                take(kind, start, m.end(), True)
        elif kind == "iban":
            at = last + 1
            while at < len(text) and at < last + 5 and text[at] in " :.#":
                at += 1
            if (end := iban_end(text, at)) is not None:
                take(kind, at, end, True)
        elif m := FORMS.get(text[start : last + 1].lower(), ACCOUNT).match(text, last + 1):
            take(kind, m.start(1), m.end(1), sum(map(DIGITS.__contains__, m[1])) >= 6)
    return [(kind, *span) for kind in KINDS for span in found[kind]]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every document as an array of (kind, start, end)."""

    def run(rows):
        found = [spans(text) for text in rows[text_col]]
        return {id_col: rows[id_col], "found": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]}

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_rows(docs, [id_col, text_col], run, f"`{id_col}` {sql_type(docs, id_col)}, found {kind}")


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()
