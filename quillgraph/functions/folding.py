"""The search tokenizer's folding: lower case, Latin letters without diacritics, combining marks dropped;
letters of other scripts stay as they are. The table is made by rule from the Unicode decompositions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table() -> tuple[str, str]:
    source, target = "", ""
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))[0].lower()
        if base != chr(c) and "a" <= base <= "z":
            source += chr(c)
            target += base
    return source, target


FROM, TO = _table()
#: Combining marks, which have no counterpart in TO and so are dropped.
MARKS = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))


def search_fold(c: Column) -> Column:
    return F.translate(F.lower(c), FROM + MARKS, TO)
