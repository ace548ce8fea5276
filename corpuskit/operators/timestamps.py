"""Problem 3: mixed timestamp formats and time zones.

Every valid reading of a value is generated as an element of an array, by expressions
alone: the format patterns give calendar fields, the date order its possible orders, the
clock of the source its possible instants. The reading of each value is chosen by Viterbi
over its source's record order, with a cost for a change of format, for a jump back in time
and for an order other than the source's stated one. Whether the chosen reading fixes an
instant is asked last: an order that contradicts the stated one and a time that the clock
shows twice fix none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuskit.functions.text import let
from corpuskit.operators.lineage import cut, read_table

# Zone names with one meaning, in minutes east of UTC.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "HKT": 480, "ICT": 420, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "HST": -600,
}
# Month names in the languages of the archives.
MONTHS = [
    ["jan", "january", "januar", "jänner", "janvier", "janv"],
    ["feb", "february", "februar", "février", "fevrier", "févr"],
    ["mar", "march", "märz", "mrz", "maerz", "mars"],
    ["apr", "april", "avril", "avr"],
    ["may", "mai"],
    ["jun", "june", "juni", "juin"],
    ["jul", "july", "juli", "juillet", "juil"],
    ["aug", "august", "août", "aout"],
    ["sep", "sept", "september", "septembre"],
    ["oct", "october", "okt", "oktober", "octobre"],
    ["nov", "november", "novembre"],
    ["dec", "december", "dez", "dezember", "décembre", "decembre", "déc"],
]
# The year before the first of an era.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}

_TIME = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?"
_HALF = r"(?:\s*([AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?:\s*([Zz]|[+-]\d{1,2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,5}))?"
_DAY = r"(?:\s*[(（][^()（）]{1,4}[)）])?"
_NAME = r"([A-Za-zÀ-ÿ]{3,9})\.?"
_CLOCK = r"(午前|午後|上午|下午|오전|오후)?\s*(\d{1,2})\s*[時时시:]\s*(\d{1,2})(?:\s*[分분:]?\s*(\d{1,2})\s*秒?초?)?\s*[分분]?"

# Pattern and the group of each field: y, mo, d, h, mi, s, half, zone; "a", "b", "c" are
# the parts of a date whose order the pattern leaves open.
FORMATS = {
    "iso": (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_DAY}[Tt\s]\s*{_TIME}{_HALF}{_ZONE}$", "y mo d h mi s half zone"),
    "basic": (rf"^(\d{{4}})(\d\d)(\d\d)[Tt]?(\d\d)(\d\d)(\d\d)?(?:[.,]\d+)?{_ZONE}$", "y mo d h mi s zone"),
    "numeric": (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d\d){_DAY},?\s+{_TIME}{_HALF}{_ZONE}$", "a b c h mi s half zone"),
    "day_month": (rf"^(?:{_NAME},?\s+)?(\d{{1,2}})\.?[\s-]+{_NAME}[\s-]+(\d{{4}}),?\s+(?:à\s+|at\s+|um\s+)?{_TIME}{_HALF}{_ZONE}$", "w d name y h mi s half zone"),
    "month_day": (rf"^(?:{_NAME},\s+)?{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}}),?\s+(?:at\s+)?{_TIME}{_HALF}{_ZONE}$", "w name d y h mi s half zone"),
    "asctime": (rf"^{_NAME}\s+{_NAME}\s+(\d{{1,2}})\s+{_TIME}(?:\s+([A-Z]{{1,5}}))?\s+(\d{{4}})$", "w name d h mi s zone y"),
    "east": (rf"^(\d{{4}})\s*[年년]\s*(\d{{1,2}})\s*[月월]\s*(\d{{1,2}})\s*[日일]{_DAY}\s*{_CLOCK}$", "y mo d half h mi s"),
    "era": (rf"^(明治|大正|昭和|平成|令和)(元|\d{{1,2}})年\s*(\d{{1,2}})月\s*(\d{{1,2}})日{_DAY}\s*{_CLOCK}$", "era ey mo d half h mi s"),
}
EPOCHS = {"epoch_s": (r"^\d{9,10}$", 1), "epoch_ms": (r"^\d{12,13}$", 1_000), "epoch_us": (r"^\d{15,16}$", 1_000_000)}

EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
SWITCH_COST, BACK_COST, ORDER_COST = 1.0, 2.0, 100.0
READINGS = "array<struct<utc:bigint,form:string,cost:double,fixes:boolean>>"


def _tidy(value: Column) -> Column:
    """Full-width signs as ASCII, runs of any blanks as one, ends cut."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.trim(F.regexp_replace(F.translate(value, wide, plain), r"(?U)\s+", " "))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, null where there is none.

    By whole-number arithmetic: no function that could raise on a false date."""
    div = lambda a, b: F.floor(a / F.lit(b))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = (m + 9) % 12
    days = 365 * yy + div(yy, 4) - div(yy, 100) + div(yy, 400) + div(153 * mm + 2, 5) + d - 1 - 719468
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), days.cast("long"))


def _clock_seconds(h, mi, s, half) -> Column:
    """Seconds since midnight of a time of day, null if there is no such time."""
    pm, am = half.rlike("^([Pp]|午後|下午|오후)"), half.rlike("^([Aa]|午前|上午|오전)")
    latin = half.rlike("^[AaPp]")
    hour = F.when((pm | am) & (h > 12), None).when(latin & (h == 0), None).when(pm, h % 12 + 12).when(am, h % 12).otherwise(h)
    return F.when((hour <= 23) & (mi <= 59) & (s <= 59), hour * 3600 + mi * 60 + s)


def _instants(local: Column, zone: Column, clock: Column) -> Column:
    """The instants at which a clock shows ``local``: with a zone of its own at most one,
    on the clock ``clock`` none in a gap and two where the clock shows the time twice."""
    named = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)])
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.when(F.length(digits) == 3, F.substring(digits, 1, 1)).otherwise(F.substring(digits, 1, 2)).cast("int")
    tail = F.when(F.length(digits) >= 3, F.right(digits, F.lit(2)))
    minutes = F.coalesce(tail.try_cast("int"), F.lit(0))
    numeric = F.when((hours.try_cast("int") <= 15) & (minutes <= 59), sign * (hours.try_cast("int") * 60 + minutes))
    shift = F.when(zone.rlike("^[+-]"), numeric).otherwise(F.try_element_at(named, F.upper(zone)))
    seen = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), clock))
    # The offsets a day before and after; a clock changes at most once in between.
    before, after = local - 86400, local + 86400
    tries = F.array_distinct(F.array(local - (seen(before) - before), local - (seen(after) - after)))
    by_clock = F.when(clock.isNotNull(), F.filter(tries, lambda u: seen(u) == local))
    return F.when(zone != "", F.when(shift.isNotNull(), F.array(local - shift * 60))).otherwise(by_clock)


FIELDS = ("y", "mo", "d", "h", "mi", "s", "half", "zone", "a", "b", "c", "name", "era", "ey")
_SEP = "\u0001"


def with_readings(rows: DataFrame, value: str, clock: str, order: str) -> DataFrame:
    """``rows`` and a column ``readings``: all valid readings (utc, form, cost, fixes) of
    ``value``, an empty array if it has none.

    ``clock`` is the source's IANA zone and ``order`` its date order, either null if not
    known. A numeric date has a reading for every order in which it is a day of the calendar;
    those against a known order cost ORDER_COST and fix no instant. A time that the clock
    shows twice has two readings that fix none; one that it never shows has none, nor has a
    date without a time of day. A value is matched and taken apart by one pattern; what
    follows works on its fields.
    """
    v, form, part = F.col("_v"), F.col("_form"), F.col("_part")
    which, parts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (pattern, groups) in reversed(FORMATS.items()):
        at = {g: f"${i}" for i, g in enumerate(groups.split(), 1)}
        which = F.when(v.rlike(pattern), name).otherwise(which)
        parts = F.when(form == name, F.regexp_replace(v, pattern, _SEP.join(at.get(f, "") for f in FIELDS))).otherwise(parts)
    month = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for n in names for x in (n, i)])
    era = F.create_map(*[F.lit(x) for k, n in ERAS.items() for x in (k, n)])
    rows = rows.withColumn("_v", _tidy(F.col(value))).withColumn("_form", which)
    rows = rows.withColumn("_part", F.split(parts, _SEP))
    field = {f: F.try_element_at(part, F.lit(i)) for i, f in enumerate(FIELDS, 1)}
    number = lambda f: field[f].try_cast("int")
    rows = rows.withColumns(
        {
            "_y": F.when(form == "era", F.try_element_at(era, field["era"]) + F.when(field["ey"] == "元", 1).otherwise(number("ey"))).otherwise(number("y")),
            "_mo": F.when(form.isin("day_month", "month_day", "asctime"), F.try_element_at(month, F.lower(field["name"]))).otherwise(number("mo")),
            "_d": number("d"),
            "_t": _clock_seconds(number("h"), number("mi"), F.coalesce(number("s"), F.lit(0)), field["half"]),
            "_zone": field["zone"],
            **{f"_{x}": field[x] for x in "abc"},
        }
    )
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    year = lambda x: F.when(F.length(x) == 4, x.try_cast("int")).when(x.try_cast("int") < 70, x.try_cast("int") + 2000).otherwise(x.try_cast("int") + 1900)
    each = F.struct(form.alias("form"), (_days(F.col("_y"), F.col("_mo"), F.col("_d")) * 86400 + F.col("_t")).alias("local"), F.lit(True).alias("fits"))
    dated = [F.when(form != "numeric", each)]
    for name, (y, mo, d) in {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}.items():
        # A year has two or four digits and a day never four.
        may = (form == "numeric") & (F.length(d) <= 2) & F.length(y).isin(2, 4)
        local = _days(year(y), mo.try_cast("int"), d.try_cast("int")) * 86400 + F.col("_t")
        dated.append(F.when(may, F.struct(F.lit(f"numeric_{name}").alias("form"), local.alias("local"), (F.coalesce(F.col(order), F.lit(name)) == name).alias("fits"))))
    rows = rows.withColumn("_dated", F.when(form.isNotNull(), F.filter(F.array(*dated), lambda x: x["local"].isNotNull())))

    def reading(utc, form, cost, fixes):
        return F.struct(utc.cast("long").alias("utc"), form.alias("form"), cost.cast("double").alias("cost"), fixes.alias("fixes"))

    def instants(x):
        got = _instants(x["local"], F.col("_zone"), F.col(clock))
        return let(got, lambda g: F.transform(g, lambda u: reading(u, x["form"], F.when(x["fits"], 0.0).otherwise(ORDER_COST), x["fits"] & (F.size(g) == 1))))

    epochs = [
        F.when(v.rlike(pattern), reading(F.floor(v.try_cast("long") / unit), F.lit(name), F.lit(0.0), F.lit(True)))
        for name, (pattern, unit) in EPOCHS.items()
    ]
    none = F.array().cast(READINGS)
    found = F.concat(F.coalesce(F.flatten(F.filter(F.transform("_dated", instants), lambda x: x.isNotNull())), none), F.when(v.rlike("^[0-9]+$"), F.array_compact(F.array(*epochs))).otherwise(none))
    rows = rows.withColumn("readings", F.filter(found, lambda x: x["utc"].isNotNull()))
    return rows.drop(*[c for c in rows.columns if c in {"_v", "_form", "_part", "_dated", "_zone", "_t", "_y", "_mo", "_d", "_a", "_b", "_c"}])


# --- Viterbi over the record order ------------------------------------------------------


def _step(prev, cur):
    """Costs from each reading (utc, form) of a record to each of the next one."""
    return [[SWITCH_COST * (p[1] != c[1]) + BACK_COST * (c[0] < p[0]) for c in cur] for p in prev]


class Lattice:
    """The readings of sorted records as arrays of records by places, places beyond a
    record's readings at infinite cost. ``link`` says which record follows the one before it
    in the same source."""

    def __init__(self, source: np.ndarray, offsets: np.ndarray, utc, form, cost):
        n, sizes = len(source), np.diff(offsets)
        width = int(sizes.max(initial=1))
        at = np.repeat(np.arange(n), sizes), np.arange(len(utc)) - np.repeat(offsets[:-1] - offsets[0], sizes)
        self.sizes, self.link = sizes, np.concatenate([[False], source[1:] == source[:-1]])
        self.utc, self.form = np.zeros((n, width), np.int64), np.full((n, width), -1, np.int64)
        self.cost = np.full((n, width), np.inf)
        self.utc[at], self.form[at], self.cost[at] = utc, form, cost

    def step(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Costs from each reading of the records i to each of the records j, those of j included."""
        switch = self.form[i][:, :, None] != self.form[j][:, None, :]
        back = self.utc[j][:, None, :] < self.utc[i][:, :, None]
        return SWITCH_COST * switch + BACK_COST * back + self.cost[j][:, None, :]

    def levels(self, forward: bool):
        """Records in turns, all of a turn independent of each other: a record with one
        reading cuts the path, so its neighbours need not wait for it."""
        n = len(self.sizes)
        waits = self.link & (np.concatenate([[1], self.sizes[:-1]]) > 1) if forward else np.concatenate([self.link[1:] & (self.sizes[1:] > 1), [False]])
        begins = np.maximum.accumulate(np.where(~waits, np.arange(n), 0)) if forward else n - 1 - np.maximum.accumulate(np.where(~waits[::-1], np.arange(n), 0))[::-1]
        turn = np.abs(np.arange(n) - begins)
        order = np.argsort(turn, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(turn[order])) + 1) if n else []

    def backward(self, leave: dict[int, np.ndarray]) -> np.ndarray:
        """Least cost from each reading to the end of its source in this part; ``leave`` has
        what follows the last record of a source that goes on in another part."""
        out = np.zeros_like(self.cost)
        for i, after in leave.items():
            out[i, : len(after)] = after
        follows = np.concatenate([self.link[1:], [False]])
        for at in self.levels(False):
            i = at[follows[at] & (self.sizes[at] > 1)]
            if len(i):
                out[i] = (self.step(i, i + 1) + out[i + 1][:, None, :]).min(axis=2)
        return out

    def choose(self, enter: dict[int, np.ndarray], leave: dict[int, np.ndarray]) -> np.ndarray:
        """The place of the reading of each record on a path of least cost; of equal ones the
        first. ``enter`` has the costs of the first record of a source begun in another part."""
        after, out = self.backward(leave), np.zeros(len(self.sizes), np.int64)
        for at in self.levels(True):
            score = self.cost[at].copy()
            linked = self.link[at]
            j = at[linked]
            score[linked] = self.step(j - 1, j)[np.arange(len(j)), out[j - 1]]
            for k in np.flatnonzero(~linked):
                if at[k] in enter:
                    score[k, : len(enter[at[k]])] = enter[at[k]]
            out[at] = np.round(score + after[at], 6).argmin(axis=1)
        return out

    def through(self, first: int, last: int) -> np.ndarray:
        """Least costs from each reading of the record ``first`` to each of ``last``, but for a
        cost that all share; that of ``first`` itself is left out."""
        m = int(self.sizes[first])
        total = np.where(np.eye(m, self.cost.shape[1], dtype=bool), 0.0, np.inf)
        cuts = np.flatnonzero(self.sizes[first + 1 : last + 1] == 1) + first + 1
        if not len(cuts):
            return self._walk(total, first, last)[:, : self.sizes[last]]
        # From the first to the last record with one reading all paths cost the same, and a
        # cost that all share moves no choice.
        unit = np.where(np.arange(self.cost.shape[1]) == 0, 0.0, np.inf)[None, :]
        return self._walk(total, first, int(cuts[0]))[:, :1] + self._walk(unit, int(cuts[-1]), last)[:, : self.sizes[last]]

    def _walk(self, total, first, last):
        for i in range(first, last):
            total = (total[:, :, None] + self.step(np.array([i]), np.array([i + 1]))).min(axis=1)
        return total


def _lattices(batches):
    """The sorted records of one part: columns, lattice, names of sources and of the part."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held).combine_chunks()
    column = lambda k: table.column(k).combine_chunks() if table.num_rows else table.column(k)
    names, readings = column("source").dictionary_encode(), column("readings")
    flat = readings.flatten()
    form = flat.field("form").dictionary_encode()
    cost = flat.field("cost").to_numpy(zero_copy_only=False) if flat.type.get_field_index("cost") >= 0 else np.zeros(len(flat))
    lattice = Lattice(names.indices.to_numpy(), readings.offsets.to_numpy(), flat.field("utc").to_numpy(zero_copy_only=False), form.indices.to_numpy(zero_copy_only=False), cost)
    # Forms are compared across parts by name.
    return table, lattice, names, flat, form.dictionary.to_pylist()


_END = "part int, source string, last boolean, utc array<bigint>, form array<string>, cost array<double>, inner array<array<double>>"


def _ends(batches):
    """The sources at the beginning and at the end of a part, which others may share: first
    and last readings and the least costs between them; two rows at most."""
    got = _lattices(batches)
    if got is None:
        return
    table, g, names, _, forms = got
    starts = np.flatnonzero(~g.link)
    stops = np.concatenate([starts[1:] - 1, [table.num_rows - 1]])
    for k in dict.fromkeys((0, len(starts) - 1)):
        a, b = int(starts[k]), int(stops[k])
        inner = g.through(a, b)
        for i, last in ((a, False), (b, True)):
            m = int(g.sizes[i])
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "part": table.column("part")[0].as_py(), "source": names[a].as_py(), "last": last, "utc": g.utc[i, :m].tolist(), "form": [forms[f] for f in g.form[i, :m]], "cost": g.cost[i, :m].tolist(),
                        "inner": inner.tolist() if last else None,
                    }
                ],
                schema=pa.schema([("part", pa.int32()), ("source", pa.string()), ("last", pa.bool_()), ("utc", pa.list_(pa.int64())), ("form", pa.list_(pa.string())), ("cost", pa.list_(pa.float64())), ("inner", pa.list_(pa.list_(pa.float64())))]),
            )


def _between(p, c) -> np.ndarray:
    """Costs from each last reading of one part to each first reading of the next."""
    return np.array(_step(list(zip(p.utc, p.form)), list(zip(c.utc, c.form)))) + np.array(c.cost)[None, :]


def choose_readings(rows: DataFrame) -> DataFrame:
    """The further columns of ``rows`` (source, ord, row_id, readings, ...), readings not
    empty, and the fields of the reading on a path of least cost over the whole source.
    Readings without a field ``cost`` cost nothing by themselves.

    Sources are cut into sorted parts; the first and the last source of a part, which alone
    it can share with others, report the least costs between its ends, and with these each
    part is solved on its own. So the result is the same however a source is divided, no task
    holds more than one part, and the driver two sources of each part. Of equal paths each
    record takes the reading that comes first in its array.
    """
    spark = rows.sparkSession
    parts = cut(
        rows.withColumn("source", F.coalesce("source", F.lit("\u0000")))
        .repartitionByRange("source", "ord", "row_id")
        .sortWithinPartitions("source", "ord", "row_id")
        .withColumn("part", F.spark_partition_id())
    )
    chains: dict[str, list] = {}
    got = parts.select("source", "readings", "part").mapInArrow(_ends, _END).collect()
    for r in sorted(got, key=lambda r: (r.part, r.last)):
        if r.last:
            chains[r.source][-1].append(r)
        else:
            chains.setdefault(r.source, []).append([r])
    enter, leave = {}, {}
    for source, chain in chains.items():
        cost = None
        for (first, end), before in zip(chain, [None, *chain]):
            cost = np.array(first.cost) if before is None else (cost[:, None] + _between(before[1], first)).min(axis=0)
            if before is not None:
                enter[first.part, source] = cost
            cost = (cost[:, None] + np.array(end.inner)).min(axis=0)
        cost = None
        for (first, end), after in zip(reversed(chain), [None, *reversed(chain)]):
            cost = np.zeros(len(end.utc)) if after is None else (_between(end, after[0]) + cost[None, :]).min(axis=1)
            if after is not None:
                leave[end.part, source] = cost
            cost = (np.array(end.inner) + cost[None, :]).min(axis=1)
    bounds = spark.sparkContext.broadcast((enter, leave))
    from pyspark.sql.types import StructType

    fields = rows.schema["readings"].dataType.elementType.fields
    keep = [f for f in parts.schema.fields if f.name not in ("part", "readings", "source", "ord")]

    def solved(batches):
        got = _lattices(batches)
        if got is None:
            return
        table, g, names, flat, _ = got
        part = table.column("part")[0].as_py()
        starts = np.flatnonzero(~g.link)
        stops = np.concatenate([starts[1:] - 1, [table.num_rows - 1]])
        before, after = {}, {}
        for k in dict.fromkeys((0, len(starts) - 1)):
            key = part, names[int(starts[k])].as_py()
            if key in bounds.value[0]:
                before[int(starts[k])] = bounds.value[0][key]
            if key in bounds.value[1]:
                after[int(stops[k])] = bounds.value[1][key]
        place = g.choose(before, after)
        offsets = table.column("readings").combine_chunks().offsets.to_numpy()
        chosen = flat.take(pa.array(offsets[:-1] - offsets[0] + place))
        out = pa.table([*[table.column(f.name) for f in keep], *[chosen.field(f.name) for f in fields]], names=[f.name for f in (*keep, *fields)])
        yield from out.to_batches(max_chunksize=10_000)

    return parts.mapInArrow(solved, StructType([*keep, *fields]))


def normalise_dates(posts: DataFrame, boards: DataFrame) -> DataFrame:
    """(id, date, utc_second, form): every distinct (id, date, board) with its instant.

    Null, empty and unreadable dates have a null utc_second. Of a board with several rows one
    is taken; a post of another board is on no known clock. The record order of a board is that
    of the first ingestion; rows without a reading have no part in it.
    """
    clocks = boards.select("board", F.col("timeZone").alias("_clock"), F.col("dateOrder").alias("_order")).dropDuplicates(["board"])
    # Boards are a table of fixed size.
    rows = posts.select("id", "board", "date", "ingestedAt").join(F.broadcast(clocks), "board", "left")
    read = with_readings(rows, "date", "_clock", "_order").groupBy("id", "board", "date").agg(F.min("ingestedAt").alias("ord"), F.first("readings").alias("readings"))
    read = cut(read)
    row_id = F.concat_ws("\u0001", "id", F.coalesce("date", F.lit("")))
    several = read.filter(F.size("readings") > 0).select(F.col("board").alias("source"), "ord", row_id.alias("row_id"), "id", "date", "readings")
    chosen = choose_readings(several)
    chosen = chosen.select("id", "date", F.when(F.col("fixes"), F.col("utc")).alias("utc_second"), F.when(F.col("fixes"), F.col("form")).alias("form"))
    rest = read.filter(F.size("readings") == 0).select("id", "date", F.lit(None).cast("long").alias("utc_second"), F.lit(None).cast("string").alias("form"))
    return rest.unionByName(chosen).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose date fixes an instant and is not already in the canonical form."""
    dates = normalise_dates(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "boards"))
    return dates.filter(F.col("utc_second").isNotNull() & ~F.col("date").rlike(EXACT)).select("id", "utc_second").distinct()


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post's date in canonical form, null where it fixes no instant."""
    dates = normalise_dates(read_table(spark, sf_dir, "posts"), read_table(spark, sf_dir, "boards"))
    text = F.date_format(F.timestamp_seconds("utc_second"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return dates.select("id", "date", text.alias("utc"), "form")
