"""Visible text of HTML, and plain tag removal.

clean() walks one text in a single pass. Hidden regions (scripts, styles, comments, no-script and
no-frames parts) are left out, breaks become newlines, other tags leave nothing; options bring some of it back.
"""

from __future__ import annotations

import html.entities
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .slices import text_udf

# Names of elements and attributes by what becomes of them.
HIDDEN = {"script": "scripts", "style": "styles", "comment": "comments", "noframes": "alt", "nolayer": "alt", "noscript": "alt", "noembed": "alt"}
BREAKS = {"br", "hr"}
SHOWN = {"links": {"href", "src", "data", "urn"}, "alt": {"alt", "title"}, "forms": {"action", "value"}, "styles": {"style", "class"}}
OPTIONS = ("links", "alt", "forms", "scripts", "styles", "comments")

_PIECE = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:_-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ENTITY = re.compile(r"&(?:#[xX]([0-9A-Fa-f]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{1,31}));?")
_NAMED = sorted(html.entities.name2codepoint, key=len, reverse=True)


def _entity(m: re.Match) -> str:
    hexa, deci, name = m.groups()
    rest = ""
    if name:
        found = next((n for n in _NAMED if name.startswith(n)), None)
        if found is None:
            return m.group(0)
        code, rest = html.entities.name2codepoint[found], name[len(found) :]
    else:
        code = int(hexa, 16) if hexa else int(deci)
    if code <= 3 or code == 160:
        return " " + rest
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return rest
    c = chr(code)
    return {"<": "(", ">": ")"}.get(c, c) + rest


def decode_entities(text: str) -> str:
    """Numbers and names (also without a semicolon, by the longest name that begins one); angle brackets become round."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def uri_words(value: str) -> str:
    """A link with its escapes decoded and its parts apart."""
    return " ".join(re.split(r"[/?&;#=:]+", unquote(value, errors="replace").strip())).strip()


def clean(text: str | None, show: frozenset[str] = frozenset(), smart: bool = False) -> str:
    """Visible text. show: names of OPTIONS. smart: nothing shows before the first tag.

    Null is empty; an open tag at the end is text; an unclosed hidden region hides the rest.
    """
    text = text or ""
    out: list[str] = []
    at, seen = 0, not smart
    while m := _PIECE.search(text, at):
        if seen:
            out.append(decode_entities(text[at : m.start()]))
        seen, at = True, m.end()
        name = (m.group("name") or "").lower()
        if m.group("comment") is not None and "comments" in show:
            out.append(f" {m.group('comment')} ")
        if not name or m.group("end"):
            continue
        if name in BREAKS:
            out.append("\n")
        for key, *values in _ATTRIBUTE.findall(m.group("rest")):
            out += _attribute(key.lower(), next((x for x in values if x), ""), show)
        if name in HIDDEN and not m.group("rest").endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(text, at)
            if HIDDEN[name] in show:
                out.append(text[at : close.start() if close else len(text)])
            at = close.end() if close else len(text)
    if seen:
        out.append(decode_entities(text[at:]))
    return "".join(out)


def _attribute(key: str, value: str, show: frozenset[str]) -> list[str]:
    if any(key in SHOWN[o] for o in ("alt", "forms", "styles") if o in show):
        return [f" {decode_entities(value)} "]
    if key in SHOWN["links"]:
        if value.lower().startswith("javascript:"):
            return [f" {value[11:]} "] if "scripts" in show else []
        return [f" {uri_words(decode_entities(value))} "] if "links" in show else []
    return [f" {value} "] if key.startswith("on") and "scripts" in show else []


def clean_udf(show: tuple[str, ...] = (), smart: bool = False):
    unknown = set(show) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown options {sorted(unknown)}")
    names = frozenset(show)
    return text_udf(lambda t: clean(t, names, smart), StringType())


def strip_tags(text: Column) -> Column:
    """Angle markup cut out, and nothing else."""
    return F.regexp_replace(text, "<[^>]*>", "")


def links(html_: Column) -> Column:
    """Array of the double-quoted link targets."""
    return F.regexp_extract_all(html_, F.lit(r'(?i)\b(?:href|src)="([^"]*)"'), F.lit(1))
