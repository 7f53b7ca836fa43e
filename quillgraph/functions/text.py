"""Column helpers with the reference semantics of strings: Unicode strip, case folding, tokens, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a Unicode-aware strip removes, as a Java character class.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
#: What ends a line, the longest first.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
WORD = r"[\p{L}\p{N}]+"
WORD_PATH = r"[\p{L}\p{N}_/-]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(c: Column) -> Column:
    """Case folding: lower case, and ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({pattern})"), F.lit(1))


def terms(c: Column) -> Column:
    """Distinct folded words of three characters or more, as an array."""
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda t: F.length(t) > 2), fold))


def lower_terms(c: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(tokens(c), lambda t: F.length(t) > 2), F.lower))


def search_terms(c: Column) -> Column:
    """Distinct lower-cased path-like words of three characters or more."""
    return F.array_distinct(F.transform(F.filter(tokens(c, WORD_PATH), lambda t: F.length(t) > 2), F.lower))


def title_key(c: Column) -> Column:
    return F.array_join(F.array_sort(terms(c)), " ")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, unless the name starts or ends with that dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def parent(path: Column) -> Column:
    """The folder without its last slash; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def lines(text: Column) -> Column:
    """Lines without their ends, as an array; an end at the end of the text makes no empty line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def extract_title(text: Column) -> Column:
    """The first heading anywhere, else the first line with text, at most 80 characters, else Untitled."""
    head = F.regexp_extract(text, r"(?md)^#{1,6}\s+(.+?)\s*#*\s*$", 1)
    first = F.try_element_at(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(1))
    plain = F.substring(strip(F.regexp_replace(first, "^#+", "")), 1, 80)
    return F.when(text.rlike(r"(?md)^#{1,6}\s+(.+?)\s*#*\s*$"), strip(head)).otherwise(F.coalesce(plain, F.lit("Untitled")))


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path is one of the patterns or lies below one."""
    found = F.lit(False)
    for p in patterns:
        p = p.strip("/")
        found = found | (path == p) | path.startswith(p + "/")
    return found


def glob_regex(pattern: str) -> str:
    """An anchored Java regex of a shell pattern; * crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (j := pattern.find("]", i + 1)) > 0:
            body = pattern[i:j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j + 1
        else:
            out += "\\" + c if not c.isalnum() and ord(c) < 128 else c
    return f"(?s)^{out}$"


def matches_patterns(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the name or the path fits a pattern; without patterns all do."""
    if not patterns:
        return F.lit(True)
    found = F.lit(False)
    for p in patterns:
        r = glob_regex(p)
        found = found | file_name(path).rlike(r) | path.rlike(r)
    return found
