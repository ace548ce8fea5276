"""Problem 2: text garbled by a wrong character encoding.

A character bigram model with smoothing is trained on the records that show no trace of a
wrong decoding. Each other field is taken apart into the stretches that a wrong codec could
have produced; every chain of encoding by the wrong codec and decoding by the right one is
scored by the model, and the likeliest is accepted if it gains more than a margin. The margin
is validated: it lies below what the right chain gains on copies of all clean records that were
garbled on purpose, and in the gap that the gains of all traced records leave, above those
that are as they should be.
"""

from __future__ import annotations

import codecs
import re
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuskit.operators.lineage import cut, read_table

#: Bins of the model; a fixed size, whatever the corpus.
PAIR_BINS, CHAR_BINS = 1 << 20, 1 << 16
#: Least margin, in natural-log units.
LEAST_MARGIN = 4.0
FIELDS = ("content", "threadTitle")

SINGLE = ("cp1252", "cp437", "mac_roman", "cp1251", "cp850", "koi8_r")
MULTI = ("cp932", "gb18030")
LEGACY = ("cp932", "euc_jp", "gb18030", "euc_kr", "big5")


def _byte_table(codec: str) -> list[str]:
    """The character of each byte; bytes that the codec leaves open stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _once(name: str, make):
    """What ``make`` gives, made once per process. Functions travel by value, and with them a
    copy of this module's variables for each task, so it is kept in a module of its own."""
    kept = sys.modules.setdefault("_corpuskit_once", types.ModuleType("_corpuskit_once")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


class Codecs:
    """Tables and patterns of the wrong codecs, made once per process."""

    def __init__(self):
        self.to_byte, self.to_char, self.runs = {}, {}, {}
        for name in SINGLE:
            table = _byte_table(name)
            m = {c: i for i, c in enumerate(table)}
            if name == "cp1252":  # and Latin-1, which differs in the control characters
                m |= {chr(i): i for i in range(0x80, 0xA0)}
            self.to_byte[name] = {ord(c): chr(i) for c, i in m.items()}
            self.to_char[name] = {0xDC00 + i: table[i] for i in range(0x80, 256)}
            odd = "".join(re.escape(c) for c in m if c >= "\x80")
            # A run, and what it must hold; two patterns, so that neither looks back.
            # A third finds what ends the last run before a place.
            self.runs[name] = re.compile(f"[\\x20-\\x7e{odd}]+"), re.compile(f"[{odd}][{odd}]"), re.compile(f"(?s:.*)[^\\x20-\\x7e{odd}]")
        self.utf8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
        self.utf8_run = re.compile(rb"(?:(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})[\x20-\x7e]*)+")

        self.forbidden = re.compile(rb"\xe0[\x80-\x9f]|\xed[\xa0-\xbf]|\xf0[\x80-\x8f]|\xf4[\x90-\xbf]")
        # Bytes that are no UTF-8, and of them those that stand for a control character as well.
        self.escaped, self.of_two = re.compile("[\udc80-\udcff]"), re.compile("[\udc80-\udc9f]")
        self.partly = {name: codecs.getincrementaldecoder(name) for name in MULTI}
        # Whole characters of a double-byte codec by the form of their bytes, which no byte but
        # the first decides.
        self.whole = {
            "cp932": re.compile(rb"(?:[\x00-\x80\xa0-\xdf\xfd-\xff]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc])*+"),
            "gb18030": re.compile(rb"(?:[\x00-\x7f]|[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[\x30-\x39][\x81-\xfe][\x30-\x39]))*+"),
        }
        # ISO-2022-JP whose escape characters were dropped: pairs of printable ASCII.
        self.jis_run = re.compile(r"\$[B@]((?:[!-~]{2})+?)(?:\([BJ]|$)")
        half = "[\\x20-\\x7e｡-ﾟ一-龥\ufffd\uf8f0-\uf8f3]"
        self.half_run, self.half_kana = re.compile(f"{half}+"), re.compile("[｡-ﾟ]")

    @classmethod
    def get(cls) -> "Codecs":
        return _once("codecs", cls)


def _sane(s: str) -> bool:
    return not re.search("[\x00-\x08\x0b-\x1f\x7f-\x84\x86-\x9f�-͸͹]", s)


#: All bytes of ASCII.
_ASCII = bytes(range(0x80))
#: Each byte with its highest bit set.
_HIGH_BIT = bytes(b | 0x80 for b in range(256))


def read_jis(line: str) -> str:
    """The pairs of ASCII of ISO-2022-JP without its escapes, read."""

    def pairs(m):
        try:
            return m.group(1).encode("ascii").translate(_HIGH_BIT).decode("euc_jp")
        except UnicodeDecodeError:
            return m.group(0)

    return Codecs.get().jis_run.sub(pairs, line)


def candidates(line: str, bits: int | None = None, only: str = "") -> list[tuple[str, str]]:
    """(chain, text): what each encode-decode chain makes of a line, where it gives anything.
    ``bits`` are the line's of ``traces``; of a chain given as ``only`` all that encode as it does."""
    known, out = Codecs.get(), []
    if bits is None:
        bits = traces([line])[0][0]
    only = only.split(">")[0]
    for k, wrong in enumerate(SINGLE):
        if only not in ("", wrong) or not (bits >> (_SIDE_BY_SIDE + k) & 1 or wrong == "cp1252" and bits & (_SIGN | 1 << 6)):
            continue
        table = known.to_byte[wrong]
        run, pair, stop = known.runs[wrong]
        # Only the runs that hold a pair are looked at.
        runs, found = [], pair.search(line)
        while found:
            before = stop.match(line, runs[-1][1] if runs else 0, found.start())
            begin = before.end() if before else runs[-1][1] if runs else 0
            end = run.match(line, found.start()).end()
            runs.append((begin, end, line[begin:end].translate(table).encode("latin-1")))
            found = pair.search(line, end)
        # Sequences that are UTF-8 are replaced within the run, all else stays as it is.
        parts, at, changed = [], 0, False
        for begin, end, raw in runs:
            # All sequences of a run at once, other bytes by what stands for them, where these are
            # of one character only and no sequence is one that UTF-8 forbids.
            read = "" if known.forbidden.search(raw) else raw.decode("utf-8", "surrogateescape")
            if read and not (wrong == "cp1252" and known.of_two.search(read)):
                if len(read) < len(raw):
                    parts += [line[at:begin], read.translate(known.to_char[wrong]) if known.escaped.search(read) else read]
                    at, changed = end, True
                continue
            for x in known.utf8.finditer(raw):
                try:
                    new = x.group(0).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                parts += [line[at : begin + x.start()], new]
                at, changed = begin + x.end(), True
        if changed:
            out.append((f"{wrong}>utf-8", "".join(parts) + line[at:]))
        if wrong != "cp1252":
            continue
        # East Asian text has at least one byte in eight beyond ASCII.
        runs = [x for x in runs if 8 * len(x[2].translate(None, _ASCII)) >= len(x[2])]
        for right in LEGACY if runs else ():
            parts, at, changed = [], 0, False
            for begin, end, raw in runs:
                try:
                    new = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                parts += [line[at:begin], new]
                at, changed = end, True
            if changed:
                out.append((f"{wrong}>{right}", "".join(parts) + line[at:]))
    for k, (wrong, own) in enumerate(zip(MULTI, (_JIS | _LETTER | _HALF, _GB | _LETTER | _LEAD_4))):
        if only not in ("", wrong) or not (bits & own and bits >> (_BEGINS + k) & 1):
            continue
        # Lost characters stand as a byte that no UTF-8 sequence has.
        try:
            raw = line.replace("\ufffd", "\x00").encode(wrong)
        except UnicodeEncodeError:
            raw = line.replace("\ufffd", "\x00").encode(wrong, "replace")
        parts, at, whole = [], 0, 0
        for m in known.utf8_run.finditer(raw):
            # A stretch must begin and end where the wrong codec's characters do. Up to
            # ``whole`` they are told by their form from ``at`` on.
            begin, end = m.span()
            whole = known.whole[wrong].match(raw, whole, begin).end()
            if whole < begin:
                continue
            try:
                new = m.group(0).decode("utf-8")
                known.partly[wrong]().decode(raw[end : end + 16])
                before = raw[at:begin].decode(wrong)
            except UnicodeDecodeError:
                continue
            parts += [before, new]
            at = whole = end
        if at:
            try:
                out.append((f"{wrong}>utf-8", ("".join(parts) + raw[at:].decode(wrong)).replace("\x00", "\ufffd")))
            except UnicodeDecodeError:
                pass
    # EUC-JP read as Shift_JIS: half-width kana among ideographs.
    parts, at = [], 0
    for m in known.half_run.finditer(line) if bits & _HALF and only in ("", "cp932") else ():
        # A few half-width kana are no text of another encoding.
        if len(known.half_kana.findall(m.group(0))) < 3:
            continue
        raw = m.group(0).replace("�", "\x00").encode("cp932", "replace")
        try:
            new = raw.decode("euc_jp")
        except UnicodeDecodeError:
            new = raw.decode("euc_jp", "replace")
            if new.count("�") > len(new) // 4:
                continue
        parts += [line[at : m.start()], new.replace("\x00", "�")]
        at = m.end()
    if at:
        out.append(("cp932>euc_jp", "".join(parts) + line[at:]))
    if "$B" in line or "$@" in line:
        out.append(("ascii>iso2022_jp", read_jis(line)))
    return [(c, s) for c, s in out if s != line]


# --- The model ----------------------------------------------------------------------------


def _points(s: str) -> np.ndarray:
    return np.frombuffer(("\n" + s + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def _between_ends(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all lines with a line end before, between and after them, the line
    of each, the end before a line being its own, and where each line begins."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    return _points("\n".join(lines)), np.repeat(np.arange(len(lines)), sizes), np.cumsum(sizes) - sizes


def _pair_bins(p: np.ndarray) -> np.ndarray:
    return (((p[:-1].astype(np.uint64) << np.uint64(21) | p[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _char_bins(p: np.ndarray) -> np.ndarray:
    return np.where(p < CHAR_BINS, p, (p.astype(np.int64) * 0x9E3779B1) % CHAR_BINS)


class Model:
    """Interpolated character bigrams: pairs discounted towards single characters, and these
    towards an even spread over all characters. Digits count as one character."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        self.pairs, self.chars, self.total = pairs, chars, float(chars.sum())
        self._between: dict = {}
        #: Of each character met so far 2 if none may bring it in, 1 if it is unknown, else 0.
        self.kinds: dict = {}

    @staticmethod
    def fold(p: np.ndarray) -> np.ndarray:
        return np.where((p >= 0x30) & (p <= 0x39), 0x30, p).astype(np.uint32)

    def _steps(self, points: np.ndarray) -> np.ndarray:
        """Natural logarithm of the likelihood of each character after the one before."""
        p = self.fold(points)
        c = _char_bins(p)
        single = (self.chars[c[1:]] + 0.01) / (self.total + 0.01 * 1_114_112)
        before = self.chars[c[:-1]]
        return np.log((self.pairs[_pair_bins(p)] + 2.0 * single) / (before + 2.0))

    def between(self, wrong: str, table: np.ndarray) -> np.ndarray:
        """The steps from the character of each byte to that of each, by 256 times the one plus the other."""
        if wrong not in self._between:
            a, b = np.divmod(np.arange(65536), 256)
            self._between[wrong] = self._steps(table[np.stack([a, b], axis=1).ravel()])[::2]
        return self._between[wrong]

    def score(self, s: str) -> float:
        """Natural logarithm of the likelihood of a line."""
        return float(self._steps(_points(s)).sum())

    def scores_of(self, lines: list[str]) -> np.ndarray:
        """The same of each of many lines."""
        points, _, begins = _between_ends(lines)
        return np.add.reduceat(self._steps(points), begins, dtype=np.float64) if lines else np.zeros(0)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """The same of each of many lines, given with a line end before, between and after them."""
        ends = np.flatnonzero(points == 10)
        return np.add.reduceat(self._steps(points), ends[:-1], dtype=np.float64) if len(ends) > 1 else np.zeros(0)


def plausible(old: str, new: str, model: Model) -> bool:
    """Whether the characters that a chain brings in are such as clean records have: at most
    one in four unknown to the model, the letters of Latin-1 aside, and no control or
    private-use character among them."""
    brought, unknown = set(new) - set(old), 0
    for c in brought:
        kind = model.kinds.get(c)
        if kind is None:
            code = 0x30 if "0" <= c <= "9" else ord(c)
            unseen = (code < 0xC0 or code > 0xFF) and model.chars[_char_bins(np.array([code]))][0] == 0
            kind = model.kinds[c] = 2 if unicodedata.category(c) in ("Cc", "Co", "Cn") else int(unseen)
        if kind == 2:
            return False
        unknown += kind
    return unknown * 4 <= len(brought)


def model_of(counts) -> Model:
    """The model of (kind, bin, n) rows: one number per bin, a fixed number of bins."""
    pairs, chars = np.zeros(PAIR_BINS, np.float32), np.zeros(CHAR_BINS, np.float32)
    p, c = counts[counts.kind == "pair"], counts[counts.kind == "char"]
    pairs[p.bin.to_numpy(np.int64)] = p.n
    chars[c.bin.to_numpy(np.int64)] = c.n
    return Model(pairs, chars)


# --- Traces -------------------------------------------------------------------------------

_LOST, _SIGN, _KANA_LEAD, _JIS, _GB, _HALF, _HALF_LEAD, _LETTER, _LEAD_4 = (1 << k for k in range(12, 21))
#: Of a line: bits of each one-byte codec for a lead and a following byte of UTF-8 side by
#: side, and of each double-byte codec for a character that begins a sequence.
_SIDE_BY_SIDE, _BEGINS = 32, 40


def trace_flags() -> np.ndarray:
    """Bits of each code point by which a wrong decoding is traced, made once per process:
    what a byte following a lead of UTF-8 is shown as by each one-byte codec (bits 0 to 5),
    what a lead is shown as (6 to 11), and the signs of the other codecs."""
    return _once("flags", _made_flags)


def _made_flags() -> np.ndarray:
    f = np.zeros(0x110000, np.uint32)
    for k, name in enumerate(SINGLE):
        t = _byte_table(name)
        for c in t[0x80:0xC0]:
            f[ord(c)] |= 1 << k
        for c in t[0xC2:0xF5]:
            f[ord(c)] |= 1 << (6 + k)
    f[0xFFFD] |= _LOST
    f[0x80:0xA0] |= _LOST
    f[0x85] &= ~np.uint32(_LOST)
    f[0xE000:0xF900] |= _LOST
    t = _byte_table("cp1252")
    for c in t[0x81:0xFF]:
        f[ord(c)] |= _SIGN
    for c in t[0x81:0x84]:
        f[ord(c)] |= _KANA_LEAD
    for name, bit in (("cp932", _JIS), ("gb18030", _GB)):
        for a in range(0xE0, 0xF0):
            for b in range(0x80, 0xC0):
                try:
                    c = bytes([a, b]).decode(name)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    f[ord(c)] |= bit
    # What double-byte codecs make of a Latin letter with an accent.
    for name in MULTI:
        for a in range(0xC2, 0xE0):
            for b in range(0x80, 0xC0):
                try:
                    c = bytes([a, b]).decode(name)
                except UnicodeDecodeError:
                    continue
                if len(c) == 1:
                    f[ord(c)] |= _LETTER
    # What they make of the first half of a sequence of four bytes.
    for name in MULTI:
        first, second = byte_tables(name)
        f[(first >= 0xF0) & (first <= 0xF4) & ((second & 0xC0) == 0x80)] |= _LEAD_4
    f[0xFF61:0xFFA0] |= _HALF
    f[[0xFF83, 0xFF64]] |= _HALF_LEAD
    return f


def byte_tables(name: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second byte of each code point in a double-byte codec, made once per process;
    0 where it has none. Of four bytes the first two stand for all, as the second is a digit."""
    return _once(f"bytes of {name}", lambda: _made_bytes(name))


def byte_counts(name: str) -> np.ndarray:
    """Number of bytes of each code point in a double-byte codec, made once per process: one
    where it has none and for what stands for lost characters, each written as one byte."""

    def made():
        _, second = byte_tables(name)
        out = np.where(second == 0, 1, np.where((second >= 0x30) & (second <= 0x39), 4, 2)).astype(np.uint8)
        out[0xFFFD] = 1
        return out

    return _once(f"sizes of {name}", made)


def _made_bytes(name: str) -> tuple[np.ndarray, np.ndarray]:
    first, second = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    codes = np.concatenate([np.arange(0x80, 0xD800), np.arange(0xE000, 0x10000 if name == "cp932" else 0x110000)])
    # One between line ends each; what the codec has not is left empty.
    text = np.full(2 * len(codes) + 2, 10, np.uint32)
    text[1:-1:2] = codes
    raw = np.frombuffer(text.tobytes().decode("utf-32-le").encode(name, "ignore"), np.uint8)
    ends = np.flatnonzero(raw == 10)[:-1]
    sizes = np.diff(ends) - 1
    first[codes] = np.where(sizes > 0, raw[ends[:-1] + 1], 0)
    second[codes] = np.where(sizes > 1, raw[ends[:-1] + 2], 0)
    return first, second


def _begins(points: np.ndarray, rows: np.ndarray):
    """For each double-byte codec: which characters begin bytes that form a sequence of UTF-8,
    and for ``_sequences`` the bytes and kinds of all."""

    follows = lambda a: (a & 0xC0) == 0x80
    same = rows[1:] == rows[:-1]
    for name in MULTI:
        first, second = (t[points] for t in byte_tables(name))

        def on(a):
            """The bytes a character on, none beyond the row's end."""
            out = np.zeros_like(a)
            out[:-1] = a[1:] * same
            return out

        one, after_one = on(first), on(second)
        then = np.where(second > 0, second, one)
        two = (first >= 0xC2) & (first <= 0xDF) & follows(then)
        both = follows(second) & follows(one)
        three = (first >= 0xE0) & (first <= 0xEF) & both
        last = np.where(after_one > 0, after_one, on(one))
        four = (first >= 0xF0) & (first <= 0xF4) & both & follows(last)
        yield name, two | three | four, (first, second, one, after_one, then, last, two, three, four, on)


def _sequences(points: np.ndarray, rows: np.ndarray):
    """For each double-byte codec: which characters begin bytes that form a sequence of UTF-8,
    the character that it stands for, and whether half a character is left over behind it."""
    for name, begins, (first, second, one, after_one, then, last, two, three, four, on) in _begins(points, rows):
        w, x, y, z = (v.astype(np.int64) & 0x3F for v in (first, then, one, last))
        made = np.where(two, (w & 0x1F) << 6 | x, np.where(three, (w & 0xF) << 12 | x << 6 | y, (w & 7) << 18 | x << 12 | y << 6 | z))
        yield name, begins, np.minimum(made, 0x10FFFF), (three | two & (second == 0)) & (after_one > 0) | four & (after_one == 0) & (on(on(second)) > 0)


def _any_in_row(hit: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows[hit], minlength=n) > 0


def _kana_rows(points: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Rows with the three half-width kana that a reading as EUC-JP needs."""
    return np.bincount(rows[(points >= 0xFF61) & (points < 0xFFA0)], minlength=n) >= 3


def traced_rows(points: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` rows a chain can make anything of: those surely traced, those in which
    the bytes of a double-byte codec form a sequence of UTF-8, a single one included, that
    begins where a character does, and those that may be EUC-JP. Clean East Asian text is
    among them; the model and the margin tell it apart."""
    return surely_traced_rows(points, rows, n) | doubtful_rows(points, rows, n)


def doubtful_rows(points: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The same without those that are traced surely alone."""
    hit = np.zeros(len(points), bool)
    for _, begins, _ in _begins(points, rows):
        hit |= begins
    return _kana_rows(points, rows, n) | _any_in_row(hit, rows, n)


def promising_rows(points: np.ndarray, rows: np.ndarray, n: int, model: "Model") -> np.ndarray:
    """Which of the traced rows can have a plausible reading: of the characters that the
    sequences stand for one at least is known, or is read on in a further step, or leaves half
    a character behind, which is read as another. All others bring in unknown ones alone."""
    hit = np.zeros(len(points), bool)
    for name, begins, made, rest in _sequences(points, rows):
        first, second = byte_tables(name)
        on = (first[made] >= 0xC2) & (first[made] <= 0xF4) & ((second[made] == 0) | ((second[made] & 0xC0) == 0x80))
        known = model.chars[_char_bins(Model.fold(made))] > 0
        hit |= begins & (known | (made >= 0xC0) & (made <= 0xFF) | on | rest)
    return surely_traced_rows(points, rows, n) | _kana_rows(points, rows, n) | _any_in_row(hit, rows, n)


def surely_traced_rows(points: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` rows show what clean text seldom has: lost or control
    characters, a lead and a following byte of UTF-8 side by side, three signs of a legacy
    encoding, two ideographs near each other that a double-byte codec makes of the leads of
    UTF-8, an ideograph after a plain letter, or half-width kana where EUC-JP or UTF-8 letters
    would give them."""
    f = trace_flags()[points]
    hit = (f & _LOST) != 0

    def at(k):
        """The bits k places on, none beyond the row's end."""
        out = np.zeros_like(f)
        if len(f) > k:
            out[:-k] = np.where(rows[k:] == rows[:-k], f[k:], 0)
        return out

    one, two, three = at(1), at(2), at(3)
    hit |= ((f >> np.uint32(6)) & one & np.uint32(63)) != 0
    hit |= (f & one & two & _SIGN) != 0
    hit |= ((f & _KANA_LEAD) != 0) & ((one & _SIGN) != 0)
    hit |= (f & (one | two | three) & np.uint32(_JIS | _GB)) != 0
    hit |= ((f & _HALF_LEAD) != 0) & ((one & _HALF) != 0)
    # After a plain letter.
    plain = ((points | np.uint32(32)) >= 0x61) & ((points | np.uint32(32)) <= 0x7A)
    hit |= plain & ((one & _LETTER) != 0)
    # Pairs of ASCII where the escapes of ISO-2022-JP were dropped.
    jis = np.flatnonzero((points[:-1] == 0x24) & ((points[1:] == 0x42) | (points[1:] == 0x40)))
    hit[jis] = True
    return np.bincount(rows[hit], minlength=n) > 0


def fields(posts: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """(id, field, text) of the fields that are neither null nor blank."""
    return (
        posts.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in names])).alias("f"))
        .select("id", "f.field", "f.text")
        .filter(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    )


_SCAN = "kind string, bin long, n long, id string, field string, text string"


def _of_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of the texts of a batch, the row of each, and where each text begins."""
    n = len(batch)
    column = batch.column(2).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = bytes(memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    data = np.frombuffer(raw, np.uint8)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets - offsets[0]]
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(n), np.diff(begins)), begins


def scan(texts: DataFrame) -> DataFrame:
    """One pass over ``texts`` (id, field, text): the surely traced rows (suspect), the other
    traced rows (maybe), and the character and pair counts of all but the suspects per task."""

    def read(batches):
        pairs, chars = np.zeros(PAIR_BINS, np.int64), np.zeros(CHAR_BINS, np.int64)
        for batch in batches:
            n = len(batch)
            points, rows, begins = _of_batch(batch)
            traced = surely_traced_rows(points, rows, n)
            for kind, which in (("suspect", traced), ("maybe", doubtful_rows(points, rows, n) & ~traced)):
                k = int(which.sum())
                keep = pa.array(which)
                yield pa.record_batch(
                    [pa.array([kind] * k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *(batch.column(c).filter(keep).cast(pa.string()) for c in range(3))],
                    names=["kind", "bin", "n", "id", "field", "text"],
                )
            # Clean rows, each between line ends, as one sequence.
            own = ~traced[rows]
            sizes = np.diff(begins)[~traced]
            p = Model.fold(np.insert(points[own], np.concatenate([[0], np.cumsum(sizes)]), 10))
            if len(p) > 1:
                pairs += np.bincount(_pair_bins(p), minlength=PAIR_BINS)
                chars += np.bincount(_char_bins(p), minlength=CHAR_BINS)
        for kind, a in (("pair", pairs), ("char", chars)):
            at = np.flatnonzero(a)
            k = len(at)
            yield pa.record_batch([pa.array([kind] * k, pa.string()), pa.array(at), pa.array(a[at]), *(pa.nulls(k, pa.string()) for _ in range(3))], names=["kind", "bin", "n", "id", "field", "text"])

    return texts.select("id", "field", "text").mapInArrow(read, _SCAN)


# --- Decision -----------------------------------------------------------------------------


def traces(lines: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of each line the bits of all its characters and of what stands side by side, whether it
    shows a trace surely, and whether it shows one at all; all lines in one pass."""
    if not lines:
        return [], np.zeros(0, bool), np.zeros(0, bool)
    points, rows, begins = _between_ends(lines)
    points, n = points[:-1], len(lines)
    f = trace_flags()[points]
    bits = np.bitwise_or.reduceat(f, begins).astype(np.int64)
    # The line end before a line has no bits.
    beside = np.zeros_like(f)
    beside[:-1] = (f[:-1] >> np.uint32(6)) & f[1:] & np.uint32(63)
    bits |= np.bitwise_or.reduceat(beside, begins).astype(np.int64) << _SIDE_BY_SIDE
    sure = surely_traced_rows(points, rows, n)
    traced = sure | _kana_rows(points, rows, n)
    for k, (_, begun, _) in enumerate(_begins(points, rows)):
        has = _any_in_row(begun, rows, n)
        bits |= has.astype(np.int64) << (_BEGINS + k)
        traced |= has
    return bits.tolist(), sure, traced


def repair_line(line: str, model: Model, margin: float, depth: int = 3) -> tuple[str, str, float]:
    """(text, chain, gain): the likeliest reading of a line; chain empty if it stays. ``gain``
    is the least that any accepted step has gained, infinite if there is none.

    A chain has up to ``depth`` steps, for text that was decoded wrongly more than once, and
    ends with a reading accepted that surely shows no trace. Until then every reading is followed, as the first step of a double decoding need not gain anything yet; by
    the same step again where it shows a trace, by any step where it surely does."""
    return repair_lines([line], model, margin, depth)[0]


def repair_lines(lines: list[str], model: Model, margin: float, depth: int = 3) -> list[tuple[str, str, float]]:
    """The same of each of many lines, step by step for all of them."""
    best = [(score, "", line) for score, line in zip(model.scores_of(lines).tolist(), lines)]
    least = [np.inf] * len(lines)
    front = {i: [("", line)] for i, line in enumerate(lines)}
    seen = [{line} for line in lines]
    for step in range(depth):
        facts = zip(*traces([text for texts in front.values() for _, text in texts]))
        found = {}
        for i, texts in front.items():
            new_texts = found[i] = []
            for chain, text in texts:
                bits, sure, traced = next(facts)
                if step and not traced:
                    continue
                last = "" if not step or sure else chain.rpartition("+")[2]
                for name, new in candidates(text, bits, last):
                    if new not in seen[i] and last in ("", name):
                        seen[i].add(new)
                        new_texts.append((f"{chain}+{name}" if chain else name, new))
        scores = iter(model.scores_of([new for texts in found.values() for _, new in texts]).tolist())
        taken = {}
        for i, texts in found.items():
            # A further step must itself gain the margin; what lies between need not be plausible.
            ranked = sorted(((next(scores), chain, new) for chain, new in texts), key=lambda x: (-x[0], x[1]))
            one = next((x for x in ranked if x[0] > best[i][0] + margin and plausible(lines[i], x[2], model)), None)
            if one:
                least[i] = min(least[i], one[0] - best[i][0])
                best[i] = taken[i] = one
        # What shows no sure trace any more has been read.
        read = dict(zip(taken, ~surely_traced_rows(*_laid_out([x[2] for x in taken.values()]), len(taken)))) if taken else {}
        front = {i: texts for i, texts in found.items() if texts and not read.get(i)}
        if not front:
            break
    return [(text, chain, gain) for (_, chain, text), gain in zip(best, least)]


def garble(text: str) -> list[str]:
    """The text decoded wrongly in each of the ways a chain undoes, where it can be."""
    out = []
    try:
        raw = text.encode("iso2022_jp").decode("ascii")
        out.append(raw.replace("\x1b", ""))
    except UnicodeError:
        pass
    for right, wrong in [("utf-8", w) for w in (*SINGLE, *MULTI)] + [(r, "cp1252") for r in LEGACY]:
        try:
            raw = text.encode(right)
            if wrong in SINGLE:
                table = _byte_table(wrong)
                out.append("".join(table[b] for b in raw))
            else:
                out.append(raw.decode(wrong))
        except UnicodeError:
            continue
    return [g for g in out if g != text]


#: Bins of the gains of garbled lines per natural-log unit, and the gain from which on all are one.
TRUE_BINS, TRUE_MOST = 64, 1_000


class _Spelled:
    """The characters ``codes`` as bytes of an encoding and, ``on`` the number of each point
    among them, the steps from point to point as pairs of bytes, for a score of the text read
    by a one-byte codec."""

    def __init__(self, codes: np.ndarray, right: str):
        raw = [_encodes(c, right) or b"" for c in map(chr, codes.tolist())]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.of = np.repeat(np.arange(len(raw)), self.sizes)
        ends = np.cumsum(self.sizes)
        has = self.sizes > 0
        self.first, self.last = np.zeros((2, len(raw)), np.uint16)
        self.first[has], self.last[has] = self.flat[(ends - self.sizes)[has]], self.flat[ends[has] - 1]
        self.high = np.bincount(self.of[self.flat >= 0x80], minlength=len(raw))
        # Whether the decoder gives the character back, and whether two high bytes, or one
        # that stands for a sign, are among its own.
        self.back = np.fromiter((x != b"" and x.decode(right, "replace") == chr(c) for x, c in zip(raw, codes.tolist())), bool, len(raw))
        self.two_high = np.fromiter((_TWO_HIGH.search(x) is not None for x in raw), bool, len(raw))
        self.signed = np.fromiter((_SIGNED.search(x) is not None for x in raw), bool, len(raw))

    def on(self, at: np.ndarray) -> "_Spelled":
        self.at, self.pairs = at, (self.last << 8)[at[:-1]] | self.first[at[1:]]
        return self

    def steps(self, model: "Model", wrong: str) -> np.ndarray:
        """As Model._steps of the text read by ``wrong``, those of a character's bytes added up."""
        table = np.array([ord(c) for c in _byte_table(wrong)], np.uint32)
        inner = np.flatnonzero(self.of[1:] == self.of[:-1])
        chars = table[self.flat]
        within = np.bincount(self.of[inner], weights=model._steps(chars)[inner], minlength=len(self.sizes)) if len(inner) else np.zeros(len(self.sizes))
        return model.between(wrong, table)[self.pairs] + within[self.at[1:]]


def true_gains(lines: list[str], model: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which, gains) for each way of garbling: what the right chain gains on those of the
    ``lines``, none of them ASCII alone, that are garbled so and that it gives back.

    The garbled copies are those of ``garble`` and given back are those that ``candidates``
    reads as they were, told for all lines at once: a line is one run of the wrong codec if
    it holds no control character; lines with one, and of double-byte codecs those with a
    character beyond the first plane, are asked of ``candidates`` itself. Bytes read by a
    one-byte codec are scored by character, not one by one."""
    out: list = []
    if not lines:
        return out
    points = _points("\n".join(lines))
    begins = np.flatnonzero(points == 10)[:-1]
    per_line = lambda a: np.add.reduceat(a, begins, dtype=np.float64)
    # From the line end before a line up to the last of its characters.
    count = lambda a: np.add.reduceat(a[:-1], begins, dtype=np.int64)
    own = model.scores(points)
    odd = count(((points < 0x20) | (points == 0x7F)) & (points != 10) & (points != 13)) > 0
    returns = count(points == 13)
    for i in np.flatnonzero(returns):
        odd[i] |= "\r" in lines[i].rstrip("\r")
    beyond = count(points > 0xFFFF) > 0
    whole = count((points >= 0xD800) & (points < 0xE000)) == 0

    def add(which, gains):
        if len(which):
            out.append((np.asarray(which, np.int64), gains))

    def add_texts(which, bad):
        which = np.asarray(which, np.int64)
        add(which, own[which] - model.scores(_points("\n".join(bad))))

    def read_back(i: int, bad: str) -> bool:
        return any(new == lines[i] for _, new in candidates(bad))

    every = np.flatnonzero(whole)
    number = np.zeros(0x110000, np.int32)
    number[points] = 1
    codes = np.flatnonzero(number)
    number[codes] = np.arange(len(codes))
    numbers = number[points]
    spelled = _Spelled(codes, "utf-8").on(numbers)
    for wrong in SINGLE:
        # What is UTF-8 is found in a run wherever it stands.
        add(every, (own - per_line(spelled.steps(model, wrong)))[every])
    utf8 = [line.encode("utf-8", "replace") for line in lines]
    for wrong in MULTI:
        which, bad = [], []
        for i in every.tolist():
            try:
                b = utf8[i].decode(wrong)
            except UnicodeDecodeError:
                continue
            if "\n" not in b and b != lines[i] and (read_back(i, b) if odd[i] or beyond[i] or "\ufffd" in b else _encodes(b, wrong) == utf8[i]):
                which.append(i)
                bad.append(b)
        add_texts(which, bad)
    table = _byte_table("cp1252")
    sizes, filler = np.diff(np.append(begins, len(points) - 1)), count(points == 0x3164) > 0
    for right in LEGACY:
        spelled = _Spelled(codes, right)
        encoded = whole & (count((spelled.sizes == 0)[numbers]) == 0)
        which = np.flatnonzero(encoded)
        if not len(which):
            continue
        # Only the lines that the encoding has, one after the other.
        at = numbers[np.append(np.repeat(encoded, sizes), True)]
        spelled.on(at)
        starts = np.cumsum(sizes[which]) - sizes[which]
        among = lambda a: np.add.reduceat(a[: len(at) - 1], starts, dtype=np.int64)
        high, size = among(spelled.high[at]), among(spelled.sizes[at]) - 1 - returns[which]
        two = among(spelled.two_high[at]) + among((spelled.pairs & 0x8080) == 0x8080)
        good = (8 * high >= size) & (two > 0) & (among(spelled.signed[at]) > 0) & (among(~spelled.back[at]) == 0)
        # The filler of Korean is read together with what follows.
        filled = (right == "euc_kr") & filler[which]
        for k in np.flatnonzero(odd[which] | filled).tolist():
            i = which[k]
            good[k] = read_back(i, "".join(table[b] for b in _encodes(lines[i], right)))
        gains = own[which] - np.add.reduceat(spelled.steps(model, "cp1252"), starts, dtype=np.float64)
        add(which[good], gains[good])
    # A line of plain pairs and ASCII without a sign of an escape is surely given back.
    plain = np.zeros(0x110000, bool)
    plain[points] = True
    codes = np.flatnonzero(plain)
    plain[codes] = [_plain_jis(chr(c)) for c in codes.tolist()]
    back = count(~plain[points] & (points != 10)) == 0
    which, bad = [], []
    for i in every.tolist():
        raw = _encodes(lines[i], "iso2022_jp")
        if raw is not None:
            # No other chain reads ASCII.
            b = raw.decode("ascii").replace("\x1b", "")
            if back[i] or ("$B" in b or "$@" in b) and read_jis(b) == lines[i]:
                which.append(i)
                bad.append(b)
    add_texts(which, bad)
    return out


#: Two bytes beyond ASCII side by side, and one that stands for a sign.
_TWO_HIGH, _SIGNED = re.compile(rb"[\x80-\xff]{2}"), re.compile(rb"[\x81-\xfe]")


def _encodes(line: str, codec: str) -> bytes | None:
    try:
        return line.encode(codec)
    except UnicodeEncodeError:
        return None


def _plain_jis(c: str) -> bool:
    """Whether a character is ASCII other than the dollar, or a pair of ISO-2022-JP that is
    read as it was and looks like no escape."""
    raw = _encodes(c, "iso2022_jp") or b""
    if " " <= c <= "~":
        return c != "$"
    return len(raw) == 8 and raw[:3] == b"\x1b$B" and raw[3:5] not in (b"(B", b"(J") and raw[3:5].translate(_HIGH_BIT).decode("euc_jp", "replace") == c


def gain_counts(texts: DataFrame, shared) -> DataFrame:
    """(bin, n): what the right chain gains on the lines of all records of ``texts``
    (id, field, text) that are not surely traced nor ASCII alone, each garbled in every way,
    by the model that ``shared`` has broadcast."""

    def read(batches):
        own, counts, below = Model(*shared.value), np.zeros(TRUE_BINS * TRUE_MOST + 1, np.int64), {}
        for batch in batches:
            points, rows, _ = _of_batch(batch)
            n = len(batch)
            clean = np.flatnonzero(_any_in_row(points >= 0x80, rows, n) & ~surely_traced_rows(points, rows, n))
            lines: dict = {}
            for text in batch.column(2).take(pa.array(clean)).to_pylist():
                for line in text.split("\n"):
                    if not line.isascii():
                        lines[line] = lines.get(line, 0) + 1
            times = np.array(list(lines.values()), np.int64)
            for which, gains in true_gains(list(lines), own):
                bins = np.floor(gains * TRUE_BINS).astype(np.int64)
                for b, k in zip(bins[bins < 0].tolist(), times[which][bins < 0].tolist()):
                    below[b] = below.get(b, 0) + k
                counts += np.bincount(np.clip(bins[bins >= 0], 0, len(counts) - 1), times[which][bins >= 0], minlength=len(counts)).astype(np.int64)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([*below, *at.tolist()], pa.int64()), pa.array([*below.values(), *counts[at].tolist()], pa.int64())], names=["bin", "n"])

    return texts.select("id", "field", "text").mapInArrow(read, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def clean_gains(texts: DataFrame, kept: DataFrame, shared) -> dict[int, int]:
    """The same of all clean records: of ``texts`` those surely traced are left out, and the
    ``kept`` ones, which have a plausible reading, are taken out again, as from the model."""
    both = gain_counts(texts, shared).unionByName(gain_counts(kept, shared).select("bin", (-F.col("n")).alias("n")))
    return {r.bin: r.n for r in both.groupBy("bin").agg(F.sum("n").alias("n")).filter("n > 0").collect()}


def least_true_gain(counts: dict[int, int]) -> float:
    """The gain of all but one in a thousand of the garbled lines that are counted by bin."""
    rank = int(0.001 * max(sum(counts.values()) - 1, 0))
    for b in sorted(counts):
        rank -= counts[b]
        if rank < 0:
            return b / TRUE_BINS
    return 2 * LEAST_MARGIN


#: Bins of gains per natural-log unit.
GAIN_BINS = 4


def margin_of(counts: dict[int, int], least: float) -> tuple[float, dict]:
    """The margin between what chains gain on traced lines that are as they should be and on
    garbled ones: the middle of the longest stretch, between LEAST_MARGIN and ``least``, of
    the gains that fewest of all traced lines have. ``counts`` has the lines by bin of gain."""
    bins = list(range(int(LEAST_MARGIN * GAIN_BINS), max(int(LEAST_MARGIN * GAIN_BINS) + 1, int(least * GAIN_BINS))))
    fewest = min(counts.get(b, 0) for b in bins)
    runs, at = [], 0
    while at < len(bins):
        end = at
        while end < len(bins) and counts.get(bins[end], 0) == fewest:
            end += 1
        runs.append((end - at, -at))
        at = max(end, at + 1)
    length, at = max(runs)
    margin = (bins[-at] + length / 2) / GAIN_BINS
    below = [b for b in counts if b < margin * GAIN_BINS]
    return margin, {"false": (max(below) + 1) / GAIN_BINS if below else 0.0, "true": least, "margin": margin, "doubtful": sum(counts[b] for b in below)}


def traced_lines(lines: list[str]) -> np.ndarray:
    """Which lines show a trace themselves; all lines in one pass."""
    return traced_rows(*_laid_out(lines), len(lines))


def _laid_out(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines, and the line of each."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(lines)), sizes)


#: Lines that are taken through their steps together.
LOCKSTEP = 1_000


def judge_texts(texts: list[str], model: Model, margin: float) -> list[tuple[bool, str | None, str | None]]:
    """(garbled, restored, chain) of each text: restored is null where something stays lost,
    and chain where no chain reads what is."""
    return [x[:3] for x in _judged(texts, model, margin)]


def _judged(texts: list[str], model: Model, margin: float) -> list[tuple[bool, str | None, str | None, list[float]]]:
    """The same, and the least gain of each line that a chain reads. Only lines that show a
    trace are tried."""
    split = [t.split("\n") for t in texts]
    flat = [line for lines in split for line in lines]
    traced = traced_lines(flat).tolist() if flat else []
    which = [i for i, x in enumerate(traced) if x]
    repaired = {}
    for at in range(0, len(which), LOCKSTEP):
        own = which[at : at + LOCKSTEP]
        repaired |= zip(own, repair_lines([flat[i] for i in own], model, margin))
    out, number = [], -1
    for lines in split:
        new, chains, gains = [], [], []
        for line in lines:
            number += 1
            if number in repaired:
                line, chain, gain = repaired[number]
                if chain:
                    chains.append(chain)
                    gains.append(gain)
            new.append(line)
        restored = "\n".join(new)
        lost = "\ufffd" in restored or not _sane(restored)
        if chains or lost:
            out.append((True, None if lost else restored, "|".join(dict.fromkeys(chains)) or None, gains))
        else:
            out.append((False, None, None, gains))
    return out


def readable(texts: list[str], model: Model, depth: int = 3) -> list[bool]:
    """Whether any chain makes a plausible reading of any line of each text; the likelihood
    is not asked. What is not plausible stays so when counts are taken from the model."""
    split = [t.split("\n") for t in texts]
    flat = [line for lines in split for line in lines]
    points, rows = _laid_out(flat)
    hope = promising_rows(points, rows, len(flat), model)
    of = np.repeat(np.arange(len(texts)), [len(lines) for lines in split])
    hopeful = list(dict.fromkeys(flat[at] for at in np.flatnonzero(hope)))
    have: set = set()
    for at in range(0, len(hopeful), LOCKSTEP):
        have |= _with_reading(hopeful[at : at + LOCKSTEP], model, depth)
    out = [False] * len(texts)
    for at in np.flatnonzero(hope):
        out[of[at]] |= flat[at] in have
    return out


def _with_reading(lines: list[str], model: Model, depth: int) -> set[str]:
    have, front, seen = set(), {line: [("", line)] for line in lines}, {line: {line} for line in lines}
    for _ in range(depth):
        bits = iter(traces([reading for texts in front.values() for _, reading in texts])[0])
        found = {}
        for line, texts in front.items():
            new_texts = []
            for chain, reading in texts:
                own = next(bits)
                for name, new in candidates(reading, own, chain) if line not in have else ():
                    if new not in seen[line] and chain in ("", name):
                        if plausible(line, new, model):
                            have.add(line)
                            break
                        seen[line].add(new)
                        new_texts.append((name, new))
            if new_texts and line not in have:
                found[line] = new_texts
        front = found
    return have


def sift(maybe: DataFrame, chars: np.ndarray) -> DataFrame:
    """Of the rows that are traced but not surely: those that have a plausible reading, and
    what they have added to the counts, per task."""
    shared = maybe.sparkSession.sparkContext.broadcast(chars)

    def read(batches):
        own = Model(np.zeros(0, np.float32), shared.value)
        p_out, c_out = np.zeros(PAIR_BINS, np.int64), np.zeros(CHAR_BINS, np.int64)
        for batch in batches:
            keep = readable(batch.column(2).to_pylist(), own)
            kept = [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns]
            k = sum(keep)
            yield pa.record_batch([pa.array(["suspect"] * k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), *kept], names=["kind", "bin", "n", "id", "field", "text"])
            for text in kept[2].to_pylist():
                # As scan() counts a row, the line end before it left out.
                p = Model.fold(_points(text))
                p_out += np.bincount(_pair_bins(p), minlength=PAIR_BINS)
                c_out += np.bincount(_char_bins(p[1:]), minlength=CHAR_BINS)
        for kind, a in (("pair", p_out), ("char", c_out)):
            at = np.flatnonzero(a)
            k = len(at)
            yield pa.record_batch([pa.array([kind] * k, pa.string()), pa.array(at), pa.array(-a[at]), *(pa.nulls(k, pa.string()) for _ in range(3))], names=["kind", "bin", "n", "id", "field", "text"])

    return maybe.select("id", "field", "text").mapInArrow(read, _SCAN)


def detect(texts: DataFrame) -> DataFrame:
    """(id, field, restored, chain) of the garbled rows of ``texts`` (id, field, text).

    ``restored`` is null where characters are lost for good. The text is read once; all but
    the surely traced rows go into the counts, and those of them that have a plausible
    reading are taken out again before the judgement."""
    spark = texts.sparkSession
    stored = cut(scan(texts))
    by_bin = stored.filter("kind = 'char'").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    sifted = cut(sift(stored.filter("kind = 'maybe'"), model_of(by_bin).chars))
    stored = stored.unionByName(sifted)
    counts = stored.filter("kind in ('pair', 'char')").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    model = model_of(counts)
    shared = spark.sparkContext.broadcast((model.pairs, model.chars))
    least = least_true_gain(clean_gains(texts, sifted.filter("kind = 'suspect'"), shared))

    def judge(limit, doubt):
        """Judged with the margin ``limit``; a text with a gain up to ``doubt`` goes along."""

        def read(batches):
            own = Model(*shared.value)
            for batch in batches:
                ids, names, texts = (c.to_pylist() for c in batch.columns)
                rows = [(i, f, restored, chain, gains, t if min(gains, default=np.inf) <= doubt else None) for i, f, t, (garbled, restored, chain, gains) in zip(ids, names, texts, _judged(texts, own, limit)) if garbled]
                columns = list(zip(*rows)) if rows else [[]] * 6
                types = (*[pa.string()] * 4, pa.list_(pa.float64()), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "field", "restored", "chain", "gains", "text"])

        return lambda df: df.select("id", "field", "text").mapInArrow(read, "id string, field string, restored string, chain string, gains array<double>, text string")

    # Every traced text is judged with the least margin; the gains of all set the margin, and
    # the few between are judged again.
    first = cut(judge(LEAST_MARGIN, max(least, LEAST_MARGIN))(stored.filter("kind = 'suspect'")))
    bins = first.select(F.explode("gains").alias("g")).filter(F.col("g") < max(least, LEAST_MARGIN)).groupBy(F.floor(F.col("g") * GAIN_BINS).alias("bin")).agg(F.count("*").alias("n"))
    margin, _ = margin_of({r.bin: r.n for r in bins.collect()}, least)
    doubtful = F.coalesce(F.array_min("gains") <= margin, F.lit(False))
    again = judge(margin, -1.0)(first.filter(doubtful))
    return first.filter(~doubtful).unionByName(again).select("id", "field", "restored", "chain")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and fields decoded wrongly, wholly or in part, restorable or not."""
    return detect(fields(read_table(spark, sf_dir, "posts"))).select("id", "field").distinct()


def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of garbled fields by the chains that read them, "lost" where none does."""
    found = detect(fields(read_table(spark, sf_dir, "posts"))).select("id", "field", F.coalesce("chain", F.lit("lost")).alias("chain")).distinct()
    return found.groupBy("field", "chain").agg(F.count("*").alias("n"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled fields with their original text, null where it cannot be given back."""
    return detect(fields(read_table(spark, sf_dir, "posts"))).select("id", "field", "restored", "chain").distinct()
