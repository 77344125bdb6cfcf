"""Tokenizers and n-grams as Column expressions.

alpha, alnum, graph and char tokens are runs of ASCII character classes; adp, cef and cef2 are made for
mail: adp cuts letters and digits with the marks after them, and runs of marks; cef takes words joined by
' - or ., letters with digits, repeated marks, prices and the parts of <addresses>; cef2 takes the atoms
of mail headers, joined by dots or by colons. A token has at most MAX_TOKEN characters: a longer run
goes on in the next token. Letters A-Z are folded first unless the tokenizer is case-sensitive.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TOKEN = 30
CLASSES = {"alpha": ("a-z", "a-zA-Z"), "alnum": ("a-z0-9", "a-zA-Z0-9"), "graph": ("!-~", "!-~"), "char": ("!-~", "!-~")}


def fold(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _lowered(c: Column) -> Column:
    """As fold() to tokenizers of ASCII classes, and many times faster. Other letters become small, too; of these, K (Kelvin) and I with a dot alone give ASCII ones."""
    return F.when(c.contains("\u212A") | c.contains("\u0130"), fold(c)).otherwise(F.lower(c))


def char_class(tokenizer: str, case_sensitive: bool = False) -> str:
    return CLASSES[tokenizer][bool(case_sensitive)]


MARK = r"!-/:-@\[-`{-~"
_LETTER = "a-zA-Z"
_ATOM = r"!#$%&*+\-0-9=?A-Z^_`a-z{|}~"
RULES = {
    "adp": rf"[{_LETTER}0-9]+[{MARK}]*|[{MARK}]+|[^\x00-\xA0]",
    "cef": rf"(?<=<)[^\s<>@]+(?=[^\s<>]*>)|(?<=@)[^\s<>@]+(?=>)|[{_LETTER}]+(?:['.-][{_LETTER}]+)+|[{_LETTER}]+[0-9]*|[0-9][{_LETTER}]+"
    rf"|[$\u00A3][0-9]+(?:[.,][0-9]+)*|([{MARK}])\1+|[^\x00-\xA0]",
    "cef2": rf"[{_ATOM}]+(?:(?:\.[{_ATOM}]+)+|(?::[{_ATOM}]+)+)?|[^\x00-\xA0]",
}


def _pieces(t: Column) -> Column:
    """Runs of at most MAX_TOKEN characters."""
    return F.regexp_extract_all(t, F.lit(rf"[\s\S]{{1,{MAX_TOKEN}}}"), F.lit(0))


def _ruled(text: Column, tokenizer: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(RULES[tokenizer]), F.lit(0))
    if tokenizer == "adp":  # a letter or mark that goes on is kept twice, three times at the start
        found = F.transform(found, lambda t: F.regexp_replace(t, rf"(?<=.)([{_LETTER}{MARK}])\1{{2,}}", "$1$1"))
    if tokenizer == "cef":
        found = F.transform(found, lambda t: F.regexp_replace(t, rf"^([{MARK}])\1{{2,}}$", "$1$1$1"))
    return F.flatten(F.transform(found, _pieces))


def tokens(text: Column, tokenizer: str = "alpha", case_sensitive: bool = False) -> Column:
    """Array of the tokens of a line or a whole text; newlines belong to no class."""
    if tokenizer in RULES:
        return _ruled(text if case_sensitive else fold(text), tokenizer)
    size = "" if tokenizer == "char" else f"{{1,{MAX_TOKEN}}}"
    pattern = f"[{char_class(tokenizer, case_sensitive)}]{size}"
    return F.regexp_extract_all(text if case_sensitive else _lowered(text), F.lit(pattern), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def closed_tokens(line: Column, tokenizer: str = "alpha", case_sensitive: bool = False) -> Column:
    """Tokens of a line, with an empty one at the end if other characters follow the last token."""
    if tokenizer == "char":
        open_end = F.lit(True)
    elif tokenizer in RULES:
        open_end = (F.length(line) > 0) & ~line.rlike(rf"(?:{RULES[tokenizer]})\z")
    else:
        open_end = line.rlike(f"[^{char_class(tokenizer, True)}]\\z")  # both cases: as of the folded line
    t = tokens(line, tokenizer, case_sensitive)  # found once: the same expression; a function of a variable would keep Spark from making a shuffle once that is read twice
    return F.when((F.size(t) > 0) & open_end, F.concat(t, F.array(F.lit("")))).otherwise(t)


def grams(toks: Column, order: int) -> Column:
    """Array of struct(ord, gram): at each token the runs of up to `order` tokens that end there.

    Tokens of a gram are joined by a space; a lone empty token is no gram.
    """
    def at(t, i):
        runs = F.transform(F.sequence(F.lit(1), F.least(i + 1, F.lit(order))), lambda k: F.struct(k.alias("ord"), F.array_join(F.slice(toks, i + 2 - k, k), " ").alias("gram")))
        return F.filter(runs, lambda x: ~((x["ord"] == 1) & (t == "")))

    return F.flatten(F.transform(toks, at))


def matches(line: Column, pattern: str, groups: list[int], case_sensitive: bool = False) -> Column:
    """Grams of a user's pattern: one for each place of the line where it matches, also where matches overlap.

    The chosen groups (the whole match if there are none) make the gram; the pattern sees the line as it
    is, and letters are folded afterwards.
    """
    whole = F.regexp_extract_all(line, F.lit(f"(?=({pattern}))"), F.lit(1))
    if not groups:
        out = whole
    else:
        parts = [F.regexp_extract_all(line, F.lit(f"(?=({pattern}))"), F.lit(1 + g)) for g in groups]
        out = F.transform(F.arrays_zip(*[p.alias(f"g{k}") for k, p in enumerate(parts)]), lambda z: F.concat_ws(" ", *[z[f"g{k}"] for k in range(len(parts))]))
    out = F.filter(out, lambda t: F.length(t) > 0)
    return out if case_sensitive else F.transform(out, fold)


def all_matches(line: Column, patterns: list[tuple[str, list[int]]], case_sensitive: bool = False) -> Column:
    """Grams of several patterns, one pattern after the other."""
    return F.flatten(F.array(*[matches(line, p, groups, case_sensitive) for p, groups in patterns]))


def default_tokenizer(form: str) -> str:
    """For mail adp, for all else alpha."""
    return "adp" if form == "email" else "alpha"


def is_binary(line: Column) -> Column:
    """Whether a line holds control characters other than white space."""
    return F.coalesce(line.rlike(r"[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]"), F.lit(False))


def indented(lines_: Column) -> Column:
    """Of an array of lines those that begin with a space, without it."""
    return F.transform(F.filter(lines_, lambda x: x.startswith(" ")), lambda x: F.substring(x, 2, 1 << 30))


def printable_runs(text: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[ -~]{{{least},}}"), F.lit(0))


def truncated(x: Column) -> Column:
    """Towards zero to a multiple of 1/32, of size 65535/32 at most."""
    size = F.least(F.floor(F.abs(x) * 32), F.lit(65535)) / 32.0
    return F.when(x < 0, -size).otherwise(size)


def trunc32(x: float) -> float:
    size = min(int(abs(x) * 32), 65535) / 32.0
    return -size if x < 0 else size
