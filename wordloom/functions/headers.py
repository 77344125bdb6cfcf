"""Mail headers: unfolding, conformance to the message standards, addresses and dates.

Grammars are regular expressions built from the standards' terms, read in linear time. Each header is tried under RFC 822,
RFC 821, RFC 2822 (strict, obsolete, lax) and RFC 2821 (strict, lax).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .mail import _unfolded

# The headers that are analysed, by kind.
KINDS = {
    "address": ("from", "to", "cc", "bcc", "reply-to", "resent-from", "resent-to", "resent-cc", "resent-bcc", "resent-reply-to"),
    "mailbox": ("sender", "resent-sender"),
    "date": ("date", "resent-date"),
    "ids": ("message-id", "in-reply-to", "references", "resent-message-id"),
    "phrases": ("keywords",),
    "text": ("subject", "comments"),
    "path": ("return-path",),
    "received": ("received",),
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names}
ZONES = {"ut": 0, "gmt": 0, "utc": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "mon tue wed thu fri sat sun".split()

# Quantifiers are possessive wherever what follows can't begin with what they repeat, so no value is read
# over and over. Comments, which nest, become a blank before a structured value is matched.
_ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
_ATOM822 = r"[^\x00-\x20()<>@,;:\\\".\[\]\x7F]++"
_QUOTED = r"\"(?:[^\"\\\r]|\\.)*+\""
_WS = r"[ \t\r\n]*+"


def without_comments(value: str) -> str | None:
    """The value with a blank for each comment, however deep; None if a parenthesis has no partner."""
    out, depth, quoted, at = [], 0, False, 0
    for m in _MARKS.finditer(value):
        x = m[0]
        if x == '"' and not depth:
            quoted = not quoted
        elif x == "(" and not quoted:
            if not depth:
                out.append(value[at : m.start()])
            depth += 1
        elif x == ")" and not quoted:
            depth -= 1
            if depth < 0:
                return None
            if not depth:
                out.append(" ")
                at = m.end()
    return None if depth else "".join([*out, value[at:]])


_MARKS = re.compile(r'\\.|["()]', re.S)


def _grammar(atom: str, dots_in_phrase: bool, route: bool, group_empty: bool) -> dict[str, re.Pattern]:
    word = rf"(?:{atom}|{_QUOTED})"
    local = rf"{word}(?:{_WS}\.{_WS}{word})*+" if route else rf"(?:{atom}(?:\.{atom})*+|{_QUOTED})"
    domain = rf"(?:{atom}(?:{_WS}\.{_WS}{atom})*+|\[[^\[\]\\]*+\])" if route else rf"(?:{atom}(?:\.{atom})*+|\[[^\[\]\\]*+\])"
    spec = rf"{local}{_WS}@{_WS}{domain}"
    phrase = rf"{word}(?:{_WS}(?:{word}{r'|\.' if dots_in_phrase else ''}))*+"
    hops = rf"(?:@{domain}(?:{_WS},{_WS}@{domain})*+{_WS}:{_WS})?+" if route else ""
    angle = rf"<{_WS}{hops}{spec}{_WS}>"
    mailbox = rf"(?:{spec}|(?:{phrase})?+{_WS}{angle})"
    boxes = rf"{mailbox}(?:{_WS},{_WS}{mailbox})*+"
    group = rf"{phrase}{_WS}:{_WS}(?:{boxes})?+{_WS};"
    address = rf"(?>{mailbox}|{group})"
    ident = rf"<{local}@{domain}>"
    day = "|".join(DAYS)
    month = "|".join(MONTHS)
    zone = r"(?:[+-][0-9]{4}|[A-Za-z]{1,3})" if route else r"[+-][0-9]{4}"
    year = r"[0-9]{2,4}" if route else r"[0-9]{4}"
    date = rf"(?:(?:{day})\s*+,\s*+)?[0-9]{{1,2}}\s++(?:{month})\s++{year}\s++[0-9]{{2}}:[0-9]{{2}}(?::[0-9]{{2}})?\s++{zone}"
    empty = rf"(?:{_WS},)*+{_WS}" if group_empty else ""
    rules = {
        "address": rf"{empty}{address}(?:{_WS},{_WS}{'(?:,' + _WS + ')*+' if group_empty else ''}{address})*+",
        "mailbox": mailbox,
        "date": date,
        "ids": rf"(?:{ident}|{phrase})(?:{_WS}(?:{ident}|{phrase}))*+" if route else rf"{ident}(?:{_WS}{ident})*+",
        "phrases": rf"{phrase}(?:{_WS},{_WS}{phrase})*+",
        "text": r"[^\x00\r\n]*+",
        "path": rf"(?:{angle}|<{_WS}>|{spec})" if route else rf"(?:<{_WS}{spec}{_WS}>|<{_WS}>)",
        "received": rf"(?:[A-Za-z0-9-]++\s++[^\s;]++\s*+)++;\s*+{date}",
    }
    return {k: re.compile(rf"{_WS}{r}{_WS}", re.I | re.S) for k, r in rules.items()}


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*+(?<!-))?+"
_SMTP_DOMAIN = rf"(?:{_LABEL}(?:\.{_LABEL})*+|\[[0-9A-Fa-f.:]++\])"
_SMTP_PATH = rf"<(?:@{_SMTP_DOMAIN}(?:,@{_SMTP_DOMAIN})*+:)?+(?:{_ATEXT}++(?:\.{_ATEXT}++)*+|{_QUOTED})@{_SMTP_DOMAIN}>|<>"
_DAY_AND_TIME = re.compile(r"(?<![0-9])[0-9]{1,2}\s++[A-Za-z]{3}\s++[0-9]{2,4}\s++[0-9:]{5,8}")


class _Stamp:
    """A trace header: from .. by .., and a date behind the first semicolon."""

    def __init__(self, head: str):
        self.head = re.compile(head, re.I)

    def fullmatch(self, value: str) -> bool:
        head, mark, rest = value.partition(";")
        return bool(mark and self.head.match(head) and _DAY_AND_TIME.search(rest))


class _Said:
    """A trace header that names who received it, before a semicolon."""

    def fullmatch(self, value: str) -> bool:
        return bool(re.search(r"\bby\b", value.rpartition(";")[0], re.I))


GRAMMARS = {
    "rfc822": _grammar(_ATOM822, False, True, True),
    "rfc821": {"path": re.compile(_SMTP_PATH), "received": _Stamp(r"from\s++\S++\s++by\s++\S")},
    "rfc2822": _grammar(rf"{_ATEXT}++", False, False, False),
    "rfc2822-obs": _grammar(rf"{_ATEXT}++", True, True, True),
    "rfc2822-lax": _grammar(r"[^\x00-\x20()<>@,;:\\\".\[\]]++", True, True, True),
    "rfc2821": {"path": re.compile(_SMTP_PATH), "received": _Stamp(r"from\s++\S++(?:\s++\([^()]*+\))?+\s++by\s++\S")},
    "rfc2821-lax": {"path": re.compile(r"<?[^<>\s]*+>?"), "received": _Said()},
}


def conforms(name: str, value: str) -> list[str]:
    """The standards that the header keeps to; none for headers that aren't analysed. Linear in the value's length."""
    kind = KIND_OF.get(name.lower())
    if kind is None:
        return []
    plain = value.strip()
    bare = plain if kind == "text" else without_comments(plain)
    found = []
    for g, rules in GRAMMARS.items():
        seen = plain if g.startswith(("rfc821", "rfc2821")) else bare
        if kind in rules and seen is not None and rules[kind].fullmatch(seen):
            found.append(g)
    return found


def addresses(value: str) -> list[str]:
    """Addresses of a list: what angle brackets hold, else the bare word with an @."""
    bare = without_comments(value)
    bare = value if bare is None else bare
    return [a or b for a, b in re.findall(r"<\s*(?:@[^:<>]*:)?([^<>\s]+@[^<>\s]+)\s*>|(?<![^\s<>,;:\"])([^\s<>,;:\"]+@[^\s<>,;:\"]+)", bare)]


_DATE = re.compile(rf"([0-9]{{1,2}})\s+({'|'.join(MONTHS)})[a-z]*\.?\s+([0-9]{{2,4}})\s+([0-9]{{1,2}}):([0-9]{{2}})(?::([0-9]{{2}}))?\s*([+-][0-9]{{4}}|[A-Za-z]{{1,4}})?", re.I)


def epoch(value: str) -> int | None:
    """Seconds since 1970 of a date header; two-digit years are of 1950 to 2049; unknown zones are UTC."""
    m = _DATE.search(value)
    if not m:
        return None
    day, month, year, hour, minute, second, zone = m.groups()
    y = int(year)
    y += 0 if y > 999 else 1900 if y >= 100 else 2000 if y < 50 else 1900
    if not 1900 <= y <= 2032:
        return None
    z = (zone or "").lower()
    off = timedelta(hours=ZONES.get(z, 0)) if not z[:1] in ("+", "-") else (1 if z[0] == "+" else -1) * timedelta(hours=int(z[1:3]), minutes=int(z[3:5]))
    try:
        t = datetime(y, MONTHS.index(month.lower()) + 1, int(day), int(hour), int(minute), min(59, int(second or 0)), tzinfo=timezone.utc)
    except ValueError:
        return None
    return int((t - off).timestamp())


def analyse(block: str | None) -> list[dict]:
    """Every header of a block up to its first empty line, the last one too."""
    head = (block or "").replace("\r\n", "\n").partition("\n\n")[0]
    out = []
    for i, (tag, value) in enumerate(_unfolded(head.split("\n"))):
        kind = KIND_OF.get(tag)
        out.append({"idx": i, "tag": tag, "conforms": conforms(tag, value), "addresses": addresses(value) if kind in ("address", "mailbox", "path") else [], "epoch": epoch(value) if kind in ("date", "received") else None})
    return out


HEADERS = T.ArrayType(
    T.StructType(
        [
            T.StructField("idx", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("conforms", T.ArrayType(T.StringType())),
            T.StructField("addresses", T.ArrayType(T.StringType())),
            T.StructField("epoch", T.LongType()),
        ]
    )
)


@F.pandas_udf(HEADERS)
def headers_udf(raw: pd.Series) -> pd.Series:
    return raw.map(analyse)
