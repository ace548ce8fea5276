"""Given texts found inside other texts, exact, without a row for each pair that might match.

A window's fingerprint comes from two prefix sums, whatever its length. A task looks up the
first signs at each place, then the longest head of 6, 12, 24 ... signs, then the whole, so that
texts that begin alike cost no more than their different lengths. What is found leaves the task
as text and is compared with the given texts themselves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpuskit.operators.lineage import stored

#: Signs of the shortest text that is looked for.
SHORTEST = 6
#: Signs and windows that a task looks at together, found texts that it holds and their signs.
CHARS, WINDOWS, HELD, HELD_CHARS = 1_000_000, 2_000_000, 100_000, 10_000_000

_ODD, _TURN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _windows(text: str):
    """A function of places and lengths that gives the fingerprints of these windows."""
    x = (np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_TURN)
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(x), base % 2**64, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x ^ (x >> np.uint64(32))) * power(_TURN)[:-1], dtype=np.uint64)])
    back = power(pow(_TURN, -1, 2**64))
    return lambda at, n: (sums[at + n] - sums[at]) * back[at]


def _head(n: np.ndarray) -> np.ndarray:
    """The longest of the lengths 6, 12, 24 ... that is not above n."""
    out = np.full(len(n), SHORTEST, np.int64)
    while (more := 2 * out <= n).any():
        out[more] *= 2
    return out


def _whole(prints: np.ndarray, n: np.ndarray) -> np.ndarray:
    return prints ^ (n.astype(np.uint64) * np.uint64(_ODD))


def _slot(prints: np.ndarray) -> np.ndarray:
    """A place among 2^22 for a fingerprint."""
    return ((prints ^ (prints >> np.uint64(31))) * np.uint64(_ODD)) >> np.uint64(42)


def chunks(lengths: np.ndarray, most: int):
    """Ranges of rows of at most ``most`` in sum, one row at least."""
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def fingerprints(texts: DataFrame) -> DataFrame:
    """(n, start, head, whole) of the one column of ``texts``, each of six signs or more."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for a, b in chunks(np.array([len(t) for t in rows]), CHARS):
                n = np.array([len(t) for t in rows[a:b]], np.int64)
                window, at = _windows("".join(rows[a:b])), np.cumsum(n) - n
                columns = n, *(window(at, k).view(np.int64) for k in (np.full(len(n), SHORTEST), _head(n))), _whole(window(at, n), n).view(np.int64)
                yield pa.record_batch([pa.array(c) for c in columns], names=["n", "start", "head", "whole"])

    return texts.mapInArrow(run, "n long, start long, head long, whole long")


def index(prints: pa.Table) -> dict:
    """What a task needs of a block of fingerprints."""
    n = prints.column("n").to_numpy()
    start, head, whole = (prints.column(c).to_numpy().view(np.uint64) for c in ("start", "head", "whole"))
    table = np.zeros(1 << 22, bool)
    table[_slot(start)] = True
    levels, w = {}, _head(n)
    for k in np.unique(w).tolist():
        own = np.unique(np.rec.fromarrays([head[w == k], n[w == k]], names="head,n"))
        heads, first = np.unique(own["head"], return_index=True)
        levels[k] = heads, np.append(first, len(own)), np.ascontiguousarray(own["n"])
    return {"table": np.packbits(table), "starts": np.unique(start), "levels": levels, "whole": np.unique(whole)}


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value in the sorted ``known`` and whether it is there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def _hits(block: dict, table: np.ndarray, text: str, left: np.ndarray):
    """(places, lengths) of windows whose fingerprint is that of a text of the block; ``left``
    are the signs from each place to the end of its text."""
    window = _windows(text)
    at = np.flatnonzero(left >= SHORTEST)
    prints = window(at, SHORTEST)
    some = np.flatnonzero(table[_slot(prints)])
    at = at[some[_among(prints[some], block["starts"])[1]]]
    for k, (heads, first, lengths) in block["levels"].items():
        fits = at[left[at] >= k]
        place, known = _among(window(fits, k), heads)
        fits, place = fits[known], place[known]
        many = first[place + 1] - first[place]
        for a, b in chunks(many, WINDOWS):
            m = many[a:b]
            own = np.repeat(fits[a:b], m)
            n = lengths[np.repeat(first[place[a:b]] - (np.cumsum(m) - m), m) + np.arange(len(own))]
            inside = n <= left[own]
            own, n = own[inside], n[inside]
            good = _among(_whole(window(own, n), n), block["whole"])[1]
            yield own[good], n[good]


def holders(rows: DataFrame, prints: pa.Table, k: int) -> DataFrame:
    """(text, ids): texts with the fingerprints ``prints`` that ``rows`` (id, content) hold, and
    of each task the first ``k`` ids of each; a text, and an id of it, may come in several rows.
    Stored, so that no two blocks are held. Fingerprints may lie, so the texts must be compared."""
    shared = rows.sparkSession.sparkContext.broadcast(index(prints))

    def run(batches):
        block = shared.value
        table, found, signs = np.unpackbits(block["table"]).view(bool), {}, 0

        def out():
            rows = [(t, heapq.nsmallest(k, ids)) for t, ids in found.items()]
            return pa.record_batch([pa.array([t for t, _ in rows], pa.string()), pa.array([ids for _, ids in rows], pa.list_(pa.string()))], names=["text", "ids"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(np.array([len(t) for t in texts]), CHARS):
                text, ends = "".join(texts[a:b]), np.cumsum([len(t) for t in texts[a:b]])
                of = np.repeat(np.arange(a, b), np.diff(ends, prepend=0))
                for places, lengths in _hits(block, table, text, ends[of - a] - np.arange(len(of))):
                    for at, n, row in zip(places.tolist(), lengths.tolist(), of[places].tolist()):
                        held = found.get(t := text[at : at + n])
                        if held is None:
                            held = found[t] = set()
                            signs += n
                        held.add(ids[row])
                        if len(held) > 16 * k:
                            found[t] = set(heapq.nsmallest(k, held))
                    if len(found) > HELD or signs > HELD_CHARS:
                        yield out()
                        found, signs = {}, 0
        if found:
            yield out()

    found = stored(rows.select("id", "content").mapInArrow(run, "text string, ids array<string>"))
    shared.destroy()
    return found
