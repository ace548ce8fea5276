"""Text routines that need a cursor or a stack, as Arrow batch functions.

Each takes and gives whole columns; null gives null. They are for what column expressions
cannot say: canonical composition, nested quotations, claims on spans, alignments.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

QUANTITY = r"[+＋\-－−]?[0-9０-９]+(?:[,，][0-9０-９]{3})*(?:[.．][0-9０-９]+)?"
UNIT = r"(?:時間|か月|ヶ月|[%％円年月日時分秒個枚人回点件歳才台度℃]|kg|km|cm|mm)?"
# Kinds of protected values in the order in which they claim their spans.
PROTECTED = [
    ("url", re.compile(r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+", re.I)),
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
    ("anchor", re.compile(r"(?:>>|＞＞)\s*(?:[0-9０-９]+|[A-Za-zぁ-んァ-ヶ一-龠々ー]{1,20}(?=\s|$))")),
    ("identifier", re.compile(r"(?<![A-Za-zＡ-Ｚａ-ｚ0-9０-９_-])[A-Za-zＡ-Ｚａ-ｚ][A-Za-zＡ-Ｚａ-ｚ0-9０-９_-]*")),
    ("quantity", re.compile(QUANTITY + UNIT)),
]
# What compares a quantity.
COMPARATORS = {"以上": "ge", "以下": "le", "未満": "lt", "超": "gt", ">=": "ge", "<=": "le", ">": "gt", "<": "lt", "≧": "ge", "≦": "le", "≥": "ge", "≤": "le"}
SPAN = "array<struct<kind:string,raw:string,start:int,end:int>>"
QUANTITIES = "array<struct<raw:string,start:int,end:int,sign:string,decimal:string,unit:string,comparator:string,parent:int>>"


def _each(f, kind):
    """A column function that applies ``f`` to each value that is not null in all columns.

    The batch function is made when it is used, as its type needs a running session."""

    def over(*columns):
        @F.pandas_udf(kind)
        def batch(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*series)], dtype=object)

        return batch(*columns)

    return over


def nfkc(c):
    """Compatibility form, a whole batch at once."""

    @F.arrow_udf("string")
    def batch(texts: pa.Array) -> pa.Array:
        return pc.utf8_normalize(texts, "NFKC")

    return batch(c)


_QUOTE_SIGNS = re.compile("[「『」』\n]")
_CLOSING = {"「": "」", "『": "』"}


def _outside_quotes(text: str) -> str:
    """The stretches between quotation signs are kept or blanked as wholes: a stretch is open
    where no quotation is pending and its line does not begin with a reply sign."""
    out, pending, at, quoted_line = [], "", 0, re.match(r"\s*[>＞]", text.split("\n", 1)[0]) is not None
    for m in [*_QUOTE_SIGNS.finditer(text), None]:
        stop = m.start() if m else len(text)
        out.append(" " * (stop - at) if pending or quoted_line else text[at:stop])
        if m is None:
            break
        sign, at = m.group(0), m.end()
        if sign == "\n":
            quoted_line = re.compile(r"[^\S\n]*[>＞]").match(text, at) is not None
            out.append(sign)
            continue
        # A closing sign with nothing pending is text like any other.
        out.append(sign if sign not in _CLOSING and not pending and not quoted_line else " ")
        if sign in _CLOSING:
            pending += _CLOSING[sign]
        elif pending.endswith(sign):
            pending = pending[:-1]
    return "".join(out)


#: Nested quotations and quoted lines as blanks, every offset kept.
outside_quotes = _each(_outside_quotes, "string")


def protected_spans(text: str) -> list[tuple[str, str, int, int]]:
    """Occurrences by kind, those of earlier kinds first; none overlaps another."""
    claimed, found = bytearray(len(text)), []
    for kind, pattern in PROTECTED:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(claimed[a:b]):
                claimed[a:b] = b"\x01" * (b - a)
                found.append((kind, m.group(0), a, b))
    return sorted(found, key=lambda x: x[2])


protected = _each(protected_spans, SPAN)


def _value(k: str) -> str:
    """A signed number and its unit, in groups named after ``k``."""
    return rf"(?P<{k}_sign>[+＋\-－−])?(?P<{k}_number>[0-9０-９]+(?:[,，][0-9０-９]{{3}})*(?:[.．][0-9０-９]+)?)(?P<{k}_unit>{UNIT})"


_QUANTITY_OR_RANGE = re.compile(rf"(?P<mark>[<>＜＞]=?|[≧≦≥≤])?(?P<one>{_value('one')})(?:[〜～~](?P<two>{_value('two')}))?(?P<word>以上|以下|未満|超)?")


def quantities_of(text: str) -> list[tuple]:
    """Quantities with sign, decimal as it is spelled, unit and comparator; the two ends of a
    range point to the place of their range in the list, all else to -1."""
    fold = lambda x: unicodedata.normalize("NFKC", x or "").replace("−", "-")
    table: list[tuple] = []

    def add(m, k, whole, comparator, parent):
        table.append((m[whole], m.start(whole), m.end(whole), fold(m[f"{k}_sign"]) or "+", fold(m[f"{k}_number"]).replace(",", ""), fold(m[f"{k}_unit"]), comparator, parent))

    for m in _QUANTITY_OR_RANGE.finditer(text):
        if m["two"]:
            place = len(table)
            table.append((m[0], *m.span(), None, None, None, "range", -1))
            add(m, "one", "one", "eq", place)
            add(m, "two", "two", "eq", place)
        else:
            add(m, "one", 0, COMPARATORS.get(fold(m["mark"]) or fold(m["word"]), "eq"), -1)
    return table


quantities = _each(quantities_of, QUANTITIES)


def dictionary_once(rules: list[tuple[str, str]]):
    """Longest match, one pass: what a rule put in is never matched again; protected values
    and quotations stay. Of rules of equal length the earlier holds."""
    table = dict(reversed([(a, b) for a, b in rules if a]))
    pattern = re.compile("|".join(re.escape(a) for a in sorted(table, key=len, reverse=True))) if table else None

    def apply(text: str) -> str:
        if pattern is None:
            return text
        kept = bytearray(len(text))
        for *_, a, b in protected_spans(text):
            kept[a:b] = b"\x01" * (b - a)
        for m in re.finditer("「[^」]*」|『[^』]*』", text):
            kept[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
        out, at = [], 0
        while at < len(text):
            m = pattern.match(text, at)
            # A longer word that touches a protected span gives way to a shorter one.
            while m and any(kept[at : m.end()]):
                shorter = [a for a in table if len(a) < m.end() - at and text.startswith(a, at) and not any(kept[at : at + len(a)])]
                best = max(shorter, key=len, default=None)
                m = re.compile(re.escape(best)).match(text, at) if best else None
            if m:
                out.append(table[m.group(0)])
                at = m.end()
            else:
                out.append(text[at])
                at += 1
        return "".join(out)

    return _each(apply, "string")


def lcs_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places matched by a longest common subsequence; equal ends are matched first, so
    that the table covers only what differs."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = [(k, k) for k in range(head)]
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def edits_of(before: str, after: str) -> list[tuple[str, str, str]]:
    """Runs of (same, replace, remove or insert; before; after) over words and signs."""
    words = lambda t: re.findall(r"\w+|\s+|[^\w\s]", t)
    a, b = words(before), words(after)
    out, i, j = [], 0, 0
    for x, y in [*lcs_pairs(a, b), (len(a), len(b))]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "remove" if i < x else "insert", "".join(a[i:x]), "".join(b[j:y])))
        if x < len(a):
            if out and out[-1][0] == "same":
                out[-1] = ("same", out[-1][1] + a[x], out[-1][2] + b[y])
            else:
                out.append(("same", a[x], b[y]))
        i, j = x + 1, y + 1
    return out


edits = _each(edits_of, "array<struct<kind:string,before:string,after:string>>")


def lcs_length(x: str, y: str) -> int:
    """Length of a longest common subsequence, all places of ``x`` at once as the bits of one
    number."""
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(x)) - 1
    free = every
    for c in y:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & every
    return len(x) - free.bit_count()


def indel_of(x: str, y: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty texts."""
    return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0


indel_ratio = _each(indel_of, "double")
