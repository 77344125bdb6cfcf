"""Mail: mailbox splitting, and the text lines of a message with the medium each belongs to.

Header lines are chosen by policy, bodies and attachments are decoded (base64 and quoted-printable,
leniently), parts that aren't text are dropped or reduced to their printable runs, armoured and
encoded blocks are skipped, and HTML parts are reduced to their visible text. Nested messages are read
as further headers and bodies.
"""

from __future__ import annotations

import base64
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import clean, decode_entities
from .slices import text_udf

# Media, and names of headers by their group.
MEDIA = {"body": 1, "subject": 2, "from": 3, "to": 4, "header": 5, "trace": 6, "mime": 7, "html": 8, "attachment": 9, "xheader": 10}
STANDARD = ("from", "to", "message-id", "in-reply-to", "subject")
TRACE = ("return-path", "received")
DATED = ("date", "path", "posted", "expires", "received", "resent-date", "delivery-date")  # left out even where all headers are asked for
EXTENDED = ("sender", "reply-to", "bcc", "cc", "references")
OPTIONS = ("plain", "noplain", "headers", "noheaders", "theaders", "xheaders", "atts", "links", "alt", "forms", "scripts", "styles", "comments")

_WORD = re.compile(r"=\?[^?\s]+\?([bBqQ])\?([^?]*)\?=(?:\s+(?==\?))?")
_URL = re.compile(r"(https?://[^\s<>\"?;#]*)[?;#][^\s<>\"]*", re.I)


def base64_lenient(data: str) -> bytes:
    """Characters outside the alphabet are skipped; NUL becomes a tab."""
    kept = re.sub(r"[^A-Za-z0-9+/]", "", data.split("=")[0] if data.count("=") <= 2 else data.replace("=", ""))
    kept = kept[: len(kept) - (len(kept) % 4 == 1)]
    return base64.b64decode(kept + "=" * (-len(kept) % 4)).replace(b"\0", b"\t")


def quoted_printable(data: str) -> bytes:
    """Soft breaks join lines; only upper-case hexadecimal escapes are decoded."""
    joined = re.sub(r"=[ \t]*\r?\n", "", data)
    raw = joined.encode("utf-8", "replace")
    return re.sub(rb"=([0-9A-F]{2})", lambda m: bytes([int(m.group(1), 16)]), raw)


def encoded_words(line: str) -> str:
    """Encoded words of header lines, whatever their charset claims: as UTF-8, else as Latin-1."""

    def one(m):
        kind, data = m.groups()
        raw = base64_lenient(data) if kind in "bB" else quoted_printable(data.replace("_", " "))
        return _text(raw)

    return _WORD.sub(one, line)


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def plain_line(line: str) -> str:
    """Escapes and entities decoded, query parts of links cut."""
    line = _URL.sub(r"\1 ", line)
    return decode_entities(unquote(line, errors="replace") if "%" in line else line)


def _unfolded(lines: list[str]) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for x in lines:
        if x[:1] in " \t" and out:
            out[-1][1] += " " + x.strip()
        else:
            name, colon, value = x.partition(":")
            if colon and not re.search(r"\s", name.strip()):
                out.append([name.strip().lower(), value.strip()])
    return [tuple(x) for x in out]


def _header_lines(headers: list[tuple[str, str]], opts: frozenset[str]):
    for name, value in headers:
        value = encoded_words(value)
        if "noheaders" in opts:
            if name == "subject":
                yield value, MEDIA["body"]
            continue
        if "xheaders" in opts:
            if name in TRACE and "theaders" in opts:
                yield f"{name}: {value.split(';')[0]}", MEDIA["trace"]
            elif name not in DATED:
                yield f"{name}: {value}", MEDIA.get(name, MEDIA["header"] if name in STANDARD + EXTENDED + TRACE else MEDIA["mime"] if name.startswith("content-") else MEDIA["xheader"])
            continue
        if name in STANDARD:
            yield f"{name}: {value}", MEDIA.get(name, MEDIA["header"])
        elif name in TRACE:
            if "theaders" in opts:
                yield f"{name}: {value.split(';')[0]}", MEDIA["trace"]
        elif name.startswith("content-"):
            if "headers" in opts:
                yield f"{name}: {value}", MEDIA["mime"]
        elif name in EXTENDED:
            if "headers" in opts:
                yield f"{name}: {value}", MEDIA["header"]


def _without_armour(text: str) -> list[str]:
    out, inside, uu, yenc = [], False, False, False
    for x in text.split("\n"):
        x = x.rstrip("\r")
        if x.startswith("-----BEGIN PGP"):
            inside = True
        elif x.startswith("-----END PGP"):
            inside = False
        elif re.match(r"begin [0-7]{3,4} ", x):
            uu = True
        elif uu and x.strip() == "end":
            uu = False
        elif x.startswith("=ybegin "):
            yenc = True
        elif x.startswith("=yend"):
            yenc = False
        elif not (uu or yenc or (inside and re.fullmatch(r"[A-Za-z0-9+/=]{20,}|=[A-Za-z0-9+/]{4}", x.strip()))):
            out.append(x)
    return out


class _Nested(str):
    """A message or part within another one, still to be read."""


_MIME_LINE = re.compile(r"content-(?:type|transfer-encoding|disposition|id|description|location|base|length)\s*:", re.I)
_DASHES = re.compile(r"(?m)^(?:-{30}|-{70})\r?$\n?")


def _recovered(body: str, opts: frozenset[str]) -> tuple[str, str]:
    """The body up to a part that isn't announced by its boundary, and that part.

    A Content- line after an empty line begins one. So does one in the five lines after a line of two dashes that follows
    an empty line, unless everything is read as plain text: such a line may be a damaged boundary.
    """
    empty, check, at = False, 0, 0
    for line in body.splitlines(keepends=True):
        if empty and line.startswith("--") and not line.startswith("-----BEGIN ") and "plain" not in opts:
            check = 5
        elif (empty or check > 0) and _MIME_LINE.match(line):
            return body[:at], body[at:]
        elif not empty and check > 0:
            check -= 1
        empty = not line.strip()
        at += len(line)
    return body, ""


def _body(headers: list[tuple[str, str]], body: str, opts: frozenset[str]):
    fields = dict(reversed(headers))
    kind = fields.get("content-type", "text/plain").lower()
    encoding = fields.get("content-transfer-encoding", "7bit").lower().strip()
    boundary = re.search(r"boundary\s*=\s*(?:\"([^\"]{1,70})\"|([^\s;]{1,70}))", fields.get("content-type", ""), re.I)
    if kind.startswith("multipart/") and boundary:
        mark = boundary.group(1) or boundary.group(2)
        parts = re.split(rf"(?m)^--{re.escape(mark)}(?:--)?[ \t]*\r?$\n?", body)
        first, lost = _recovered(parts[0], opts) if len(parts) == 1 else (parts[0], "")
        for x in first.split("\n"):
            if x.strip():
                yield plain_line(x.rstrip("\r")), MEDIA["body"]
        yield from map(_Nested, [lost, *parts[1:]])
        return
    if kind.startswith("message/rfc822"):
        yield _Nested(body)
        return
    body, lost = _recovered(body, opts) if headers else (body, "")
    digest: list[str] = []
    if kind.startswith("text/plain") and headers:
        body, *digest = _DASHES.split(body)
    if encoding == "base64":
        body = _text(base64_lenient(body))
    elif encoding == "quoted-printable":
        body = _text(quoted_printable(body))
    if kind.startswith(("image/", "audio/", "video/", "model/")):
        pass
    elif kind.startswith("application/"):
        for x in re.findall(r"[ -~]{4,}", body) if "atts" in opts else ():
            yield x, MEDIA["attachment"]
    elif kind.startswith("text/html") and "plain" not in opts:
        for x in clean(body, opts).split("\n"):
            yield x.rstrip("\r"), MEDIA["html"]
    else:
        if "noplain" in opts:  # plain text may hold markup too
            body = re.sub(r"<[^>]*>", "", body)
        for x in _without_armour(body):
            yield plain_line(x), MEDIA["body"]
    yield from (_Nested(x.lstrip("\n")) for x in digest)
    yield _Nested(lost)


def _one(raw: str, opts: frozenset[str]):
    raw = raw.replace("\r\n", "\n")
    head, sep, body = raw.partition("\n\n")
    lines = head.split("\n")
    if lines and lines[0].startswith("From "):
        lines = lines[1:]
    headers = _unfolded(lines)
    if not headers:  # no header block: all is body
        head, body = "", raw.lstrip("\n")
    if raw.startswith("\n"):
        headers, body = [], raw[1:]
    yield from _header_lines(headers, opts)
    yield from _body(headers, body, opts)


def message_lines(raw: str | None, opts: frozenset[str] = frozenset()):
    """(line, medium) of a message, with those of its parts however deep. Null and empty messages have no lines."""
    open_ = [_one(raw, opts)] if raw else []
    while open_:
        x = next(open_[-1], None)
        if x is None:
            open_.pop()
        elif not isinstance(x, _Nested):
            yield x
        elif x:
            open_.append(_one(str(x), opts))


LINES = T.ArrayType(T.StructType([T.StructField("line", T.StringType()), T.StructField("cls", T.IntegerType())]))


def lines_udf(opts: tuple[str, ...] = ()):
    unknown = set(opts) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    names = frozenset(opts)
    return text_udf(lambda r: [{"line": x, "cls": c} for x, c in message_lines(r, names)], LINES)


def split_mbox(text: Column) -> Column:
    """Array of messages: a line "From ..." at the start or after an empty line begins one."""
    return F.filter(F.split(text, r"(?:\A|(?<=\n\n))(?=From )"), lambda m: F.length(m) > 0)
