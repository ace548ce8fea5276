"""Problem 6: visually identical text with different characters.

A batch of texts is one flat array of code points. A table lookup gives each code point the
code points it is folded to (none, one or several), expansion offsets place them, marks are
put in canonical order and composed pass by pass over all texts at once; no string function
runs per row. The table is made by rule from the character database.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators.lineage import cut, read_table

# Letters drawn like a Latin letter, each with that letter.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁԛԝһӏАВЕКМНОРСТУХІЈЅԌԚԜҮӀ" "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳ" "ɑɡ",
        "aeopcyxijsdqwhlABEKMHOPCTYXIJSGQWYI" "oABEZHIKMNOPTYXcj" "ag",
    )
)
# Kana drawn like an ideograph or like a sign of the other kana.
LOOKALIKES |= dict(zip("力口二夕卜工八一へ", "カロニタトエハーヘ"))
# Other signs drawn alike.
LOOKALIKES |= {"‐": "-", "〜": "~"}

_LAST = 0x110000
_tables: list = []


def _plain(cp: int) -> bool:
    """Whether a compatibility character is drawn as what it stands for."""
    kind = unicodedata.decomposition(chr(cp)).split(" ", 1)[0]
    if kind in ("<wide>", "<narrow>", "<noBreak>"):
        return True
    # Radicals drawn as the ideograph, and Latin ligatures.
    return kind == "<compat>" and (0x2E80 <= cp <= 0x2FD5 or 0xFB00 <= cp <= 0xFB06)


def _fold(cp: int) -> list[int]:
    c = chr(cp)
    category = unicodedata.category(c)
    # Invisible: format characters, the grapheme joiner, variation selectors, Hangul fillers.
    if category == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return []
    if category == "Zs" or c == "\t":
        return [0x20]
    parts = unicodedata.decomposition(c)
    if parts and (not parts.startswith("<") or _plain(cp)):
        return [x for p in parts.split() if not p.startswith("<") for x in _fold(int(p, 16))]
    if 0xAC00 <= cp <= 0xD7A3:
        s = cp - 0xAC00
        return [0x1100 + s // 588, 0x1161 + s % 588 // 28] + ([0x11A7 + s % 28] if s % 28 else [])
    return [ord(LOOKALIKES.get(c, c))]


def tables():
    """(first code point folded to, number of them, start of the others, others, class of
    combination, composing pairs in order, their compositions); made once per process."""
    if not _tables:
        first, count, start = np.arange(_LAST, dtype=np.uint32), np.ones(_LAST, np.uint8), np.zeros(_LAST, np.uint32)
        combining, others, pairs = np.zeros(_LAST, np.uint8), [], {}
        for cp in range(_LAST):
            if (0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF) and chr(cp) not in LOOKALIKES or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xE00FF or cp >= 0xE01F0:
                continue
            to = _fold(cp)
            combining[cp] = unicodedata.combining(chr(cp))
            count[cp] = len(to)
            if len(to) == 1:
                first[cp] = to[0]
            elif to:
                start[cp] = len(others)
                others += to
            parts = unicodedata.decomposition(chr(cp)).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
        keys = np.array(sorted(pairs), np.int64)
        _tables.append((first, count, start, np.array(others, np.uint32), combining, keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)))
    return _tables[0]


def _composed(a: np.ndarray, b: np.ndarray, keys, values) -> np.ndarray:
    """The composition of each pair, 0 where there is none."""
    pair = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    out = np.where(keys[at] == pair, values[at], 0).astype(np.uint32)
    l, v = a.astype(np.int64) - 0x1100, b.astype(np.int64) - 0x1161
    out = np.where((l >= 0) & (l < 19) & (v >= 0) & (v < 21), 0xAC00 + (l * 21 + v) * 28, out)
    s, t = a.astype(np.int64) - 0xAC00, b.astype(np.int64) - 0x11A7
    return np.where((s >= 0) & (s < 11172) & (s % 28 == 0) & (t > 0) & (t < 28), a.astype(np.int64) + t, out).astype(np.uint32)


def fold_points(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold flat code points with ``rows``, the row of each; both in their new form."""
    first, count, start, others, combining, keys, values = tables()
    n = count[points]
    if (n != 1).any():
        ends = np.cumsum(n, dtype=np.int64)
        source = np.repeat(np.arange(len(points)), n)
        inside = np.arange(len(source)) - (ends - n)[source]
        old = points[source]
        many = n[source] > 1
        points = first[old]
        points[many] = others[start[old[many]] + inside[many]]
        rows = rows[source]
    else:
        points = first[points]
    if not len(points):
        return points, rows
    cc = combining[points]
    # Starters that compose too: vowels and final consonants of Hangul.
    jamo = (points >= 0x1161) & (points <= 0x11C2)
    follows = (cc > 0) | jamo
    follows[0] = False
    follows[1:] &= rows[1:] == rows[:-1]
    if not follows.any():
        return points, rows
    # Marks in canonical order: a stable sort by class within each run of marks.
    base = np.maximum.accumulate(np.where((cc > 0) & follows, 0, np.arange(len(points))))
    marks = np.flatnonzero(cc > 0)
    order = marks[np.lexsort((marks, cc[marks], base[marks]))]
    points[marks], cc[marks] = points[order], cc[order]
    # Each pass composes the k-th follower of every starter.
    starter = np.maximum.accumulate(np.where(follows, 0, np.arange(len(points))))
    depth = np.arange(len(points)) - starter
    gone = np.zeros(len(points), bool)
    head = starter.copy()
    blocked = np.zeros(len(points), np.int64)
    at = np.flatnonzero(depth == 1)
    k = 1
    while len(at):
        own = head[at]
        made = _composed(points[own], points[at], keys, values)
        fits = (made > 0) & ((blocked[own] < cc[at]) | (blocked[own] == 0))
        points[own[fits]] = made[fits]
        gone[at[fits]] = True
        kept = at[~fits]
        blocked[head[kept]] = np.where(cc[kept] > 0, cc[kept], 255)
        # A follower that is a starter itself and stays heads what comes after it.
        k += 1
        nxt = np.flatnonzero(depth == k)
        new_head = kept[cc[kept] == 0]
        if len(new_head):
            lead = np.arange(len(points))
            mark = np.zeros(len(points), bool)
            mark[new_head] = True
            sure = nxt[mark[nxt - 1]]
            head[sure] = lead[sure - 1]
            rest = nxt[~mark[nxt - 1]]
            head[rest] = head[rest - 1]
        elif len(nxt):
            head[nxt] = head[nxt - 1]
        at = nxt
    keep = ~gone
    return points[keep], rows[keep]


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of a text column and the row of each; null counts as empty."""
    full = texts.cast(pa.large_string()).fill_null("")
    n = len(full)
    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + n + 1]
    raw = np.frombuffer(full.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, np.repeat(np.arange(n, dtype=np.int32), np.diff(begins[offsets - offsets[0]]))


def fold_texts(texts: pa.Array) -> pa.Array:
    """One consistent form of each text; null stays null."""
    n, valid = len(texts), np.asarray(texts.is_valid())
    out, rows = fold_points(*_points(texts))
    # UTF-8 of the folded points, whole batch at once.
    size = 1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)
    per_row = np.bincount(rows, size, n).astype(np.int64) if n else np.zeros(0, np.int64)
    data = out.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    bounds = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    mask = pa.array(valid).buffers()[1] if not valid.all() else None
    return pa.Array.from_buffers(pa.large_string(), n, [mask, pa.py_buffer(bounds), pa.py_buffer(data)])


def _mixed(n: int, seed: int) -> np.ndarray:
    """A fixed random odd multiplier for each position."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def _digests(points: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A 16-byte digest of each row's code points, by sums over the flat array."""
    starts = np.searchsorted(rows, np.arange(n))
    lengths = np.diff(np.append(starts, len(rows)))
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(lengths)
    if len(some):
        at = np.arange(len(rows)) - np.repeat(starts, lengths)
        wide = points.astype(np.uint64) + np.uint64(1)
        for k, seed in enumerate((1 << 20, 1 << 50)):
            out[some, k] = np.add.reduceat(wide * _mixed(int(lengths.max()), seed)[at], starts[some])
        out[:, 1] ^= lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return pa.array([x.tobytes() for x in out], pa.binary())


def with_folded(rows: DataFrame, text: str, out: str = "folded") -> DataFrame:
    """``rows`` and its text in one consistent form; null stays null, empty stays empty."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    place = rows.columns.index(text)

    def fold(batches):
        for batch in batches:
            folded = fold_texts(batch.column(place)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, folded], names=[*batch.schema.names, out])

    return rows.mapInArrow(fold, schema)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, text) of posts and sections."""
    posts = read_table(spark, sf_dir, "posts").select(F.lit("posts").alias("src"), F.col("id").alias("id"), F.col("content").alias("text"))
    sections = read_table(spark, sf_dir, "sections").select(F.lit("sections").alias("src"), F.col("line").cast("string").alias("id"), "text")
    return posts.unionByName(sections)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, raw, key): digests of each text of posts and sections and of its form."""
    return digests(_texts(spark, sf_dir).filter("id is not null and text is not null"))


def digests(rows: DataFrame) -> DataFrame:
    """(src, id, raw, key) of ``rows`` (src, id, text); blank and invisible texts left out."""

    def digest(batches):
        for batch in batches:
            n = len(batch)
            points, of = _points(batch.column(2))
            folded, of_folded = fold_points(points, of)
            seen = np.bincount(of_folded, (folded > 0x20) & (folded != 0x85), n) > 0
            keep = pa.array(seen)
            raw, key = _digests(points, of, n), _digests(folded, of_folded, n)
            yield pa.record_batch([c.filter(keep) for c in (batch.column(0), batch.column(1), raw, key)], names=["src", "id", "raw", "key"])

    return rows.select("src", "id", "text").mapInArrow(digest, "src string, id string, raw binary, key binary")


def alike_members(rows: DataFrame) -> DataFrame:
    """(src, key, raw, id), distinct, of the classes whose texts look the same and differ."""
    rows = cut(rows)
    several = rows.groupBy("src", "key").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("src", "key")
    return rows.join(several, ["src", "key"], "left_semi").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of one table whose texts look the same but differ.

    Pairs are formed between the different texts of a class, then between their records,
    so copies of one text are never compared with each other."""
    members = cut(alike_members(keyed(spark, sf_dir)))
    texts = members.select("src", "key", "raw").distinct()
    pairs = texts.join(texts.select("src", "key", F.col("raw").alias("other")), ["src", "key"]).filter("raw < other").select("src", "raw", "other")
    one = members.select("src", "raw", F.col("id").alias("x"))
    two = members.select("src", F.col("raw").alias("other"), F.col("id").alias("y"))
    return pairs.join(one, ["src", "raw"]).join(two, ["src", "other"]).filter("x <> y").select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has a lookalike: its class and how many records it is linked
    to, all counted without forming pairs."""
    members = cut(alike_members(keyed(spark, sf_dir)))
    in_class = members.groupBy("src", "key").agg(F.countDistinct("id").alias("n"))
    in_text = members.groupBy("src", "key", "raw").agg(F.countDistinct("id").alias("m"))
    return members.join(in_text, ["src", "key", "raw"]).join(in_class, ["src", "key"]).select("src", "id", F.hex("key").alias("class_id"), (F.col("n") - F.col("m")).alias("n_links"))


def p6_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, folded): every post's content and every section's text in the consistent form."""
    return with_folded(_texts(spark, sf_dir), "text").select("src", "id", "folded")
