"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, ``://`` and the cues of
identifiers.  Around an anchor, small deterministic parsers walk to the boundaries of the value and
validate it, so text without anchors is never looked at twice.

Kinds, in this order: email, ip, card, phone (their grammar is fixed below), then what the method adds:
``login`` (user data in front of the host of a URL, ``scheme://user:password@``), ``iban`` (check digits
valid) and ``secret`` (a cue such as ``token =`` or ``password:`` with its quoted or bare value).

Spans are in code points, ends exclusive; matches of one kind never overlap.  Null text is empty; rows are
independent; parsers look at each run of characters once, so long texts take time in proportion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import portions

KINDS = ("email", "ip", "card", "phone", "login", "iban", "secret")
BASE_KINDS = KINDS[:4]
# The grammar of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Cues of secrets, of passwords and of account numbers.
SECRET_CUES = ("api_key", "api-key", "apikey", "access_key", "access-key", "secret", "token")
PASSWORD_CUES = ("passwd", "password")
IBAN_CUES = ("iban",)
# Characters of an account number by its country, from the public registry of ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IP_RUN, _CARD_RUN, _PHONE_RUN = (re.compile(x) for x in (r"[0-9.]+", r"[0-9\x20-]+", r"[\x20().0-9-]+"))
# a quoted value of 8 characters or more, or a bare one of 16 (a password's of 8)
_SECRET_VALUE, _PASSWORD_VALUE = (re.compile(r"""["']?[ ]{0,4}[:=][ ]{0,4}(?:"([^"\s]{8,}+)"|'([^'\s]{8,}+)'|([A-Za-z0-9_+/.-]{%d,}+))""" % n) for n in (16, 8))
_IBAN_START = re.compile(r"(?: (?:is|no|nr|number)\.?)?[ :#=(]{1,4}(?=[A-Z]{2}[0-9]{2})")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[A-Za-z0-9._~%!$&'()*+,;=-]+@(?=[A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    v = value.replace(" ", "")
    return IBAN_LENGTHS.get(v[:2]) == len(v) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int:
    """Where the account number that begins at ``at`` ends: as many characters as its country has, single spaces
    between them, and no letter or digit right behind; 0 if there is none or its check digits are wrong."""
    left, i = IBAN_LENGTHS.get(text[at : at + 2], 0), at
    while left and i < len(text):
        c = text[i]
        if c == " " and text[i - 1] != " ":
            i += 1
            continue
        if not ("0" <= c <= "9" or "A" <= c <= "Z"):
            break
        i, left = i + 1, left - 1
    if i == at or left or re.match(r"[A-Za-z0-9]", text[i : i + 1]) or not iban_valid(text[at:i]):
        return 0
    return i


def automaton():
    """Anchors of all kinds; matching is on a text whose A-Z are lower-cased."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("d", 1))
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    a.add_word("://", ("u", 3))
    for cue in SECRET_CUES:
        a.add_word(cue, ("s", len(cue)))
    for cue in PASSWORD_CUES:
        a.add_word(cue, ("p", len(cue)))
    for cue in IBAN_CUES:
        a.add_word(cue, ("i", len(cue)))
    a.make_automaton()
    return a


_UPPER = {i: i + 32 for i in range(65, 91)}


def _in_run(text: str, seen: int, run: re.Pattern, at: int, allowed: str) -> tuple[int, int]:
    """The maximal run of ``allowed`` characters around ``at``, not before ``seen``."""
    lo = at
    while lo > seen and text[lo - 1] in allowed:
        lo -= 1
    return lo, run.match(text, at).end()


def _addresses(dotted: str, at: int) -> Iterator[tuple[int, int]]:
    """Spans of the addresses in numbers joined by single dots: four by four from the left, each number seen once."""
    if dotted.count(".") < 3:
        return
    numbers = dotted.split(".")
    for i in range(0, len(numbers) - 3, 4):
        four = numbers[i : i + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            yield at, end
        at = end + 1


def find(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind that ``text`` holds; ``anchors`` is the automaton."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = ip_seen = card_seen = phone_end = login_end = secret_end = account_end = 0
    for last, (kind, length) in anchors.iter(text.translate(_UPPER)):
        if kind == "d":
            # digits: one look at each run of digits with the separators of its kind
            if last >= ip_seen:
                lo, hi = _in_run(text, ip_seen, _IP_RUN, last, "0123456789.")
                ip_seen = hi
                for m in DOTTED.finditer(text, lo, hi):
                    found["ip"] += _addresses(m[0], m.start())
            if last >= card_seen:
                lo, hi = _in_run(text, card_seen, _CARD_RUN, last, "0123456789 -")
                card_seen = hi
                for m in CARD.finditer(text, lo, hi):
                    if m.end() - m.start() >= 16:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            found["card"].append(m.span())
        elif kind == "@":
            lo = last
            while lo > email_end and text[lo - 1] in LOCAL:
                lo -= 1
            m = DOMAIN.match(text, last + 1) if lo < last else None
            if m:
                email_end = m.end()
                found["email"].append((lo, email_end))
        elif kind == "+":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "u":
            if last >= login_end and (m := _USERINFO.match(text, last + 1)):
                login_end = m.end()
                found["login"].append((m.start(), m.end() - 1))
        elif kind in "sp":
            # values of any length: cues inside a found one are skipped, and a value ends before the next one's quote or separator
            if last + 1 >= secret_end and (m := (_SECRET_VALUE if kind == "s" else _PASSWORD_VALUE).match(text, last + 1)) and any(c.isdigit() for c in m[m.lastindex]):
                secret_end = m.end()
                found["secret"].append(m.span(m.lastindex))
        else:
            m = _IBAN_START.match(text, last + 1)
            if m and m.start() >= account_end and (end := iban_end(text, m.end())):
                account_end = end
                found["iban"].append((m.end(), end))
    return found


def _joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, spans in found.items() for a, b in spans):
        if a >= at:
            out += (text[at:a], f"<{k}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, with_redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found (spans of all kinds); with the redacted text if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for keys, texts in portions(batches):
            rows = [find(t, anchors) for t in texts]
            cells = [
                pa.array(keys, pa.int64()),
                *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in BASE_KINDS),
                pa.array([hashlib.sha256(_joined(r, BASE_KINDS).encode()).hexdigest() for r in rows]),
                pa.array([_joined(r, KINDS) for r in rows]),
                *(pa.array([sum(len(r[k]) for k in kinds) for r in rows], pa.int64()) for kinds in (KINDS[4:], KINDS)),
            ]
            names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added", "n_found"]
            if with_redacted:
                cells.append(pa.array([redact(t, r) for t, r in zip(texts, rows, strict=True)]))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cells, names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema + ", redacted string" * with_redacted)
