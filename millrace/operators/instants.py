"""Timestamps in mixed formats, precisions and zones, normalised to one unambiguous form.

Every value is reduced to a *shape mask* (runs of letters become ``A``, digits become ``9``) by two
native expressions. A mask is compiled to a parser once per worker; all values of a mask are then
converted together with numpy, and local times go through a zone's table of offset transitions,
which carries the version of the zone database it was built from.

Defined results for odd input: null, blank and undatable text, impossible dates or times give null;
whitespace of any kind around or within a value counts as one space; letter case never matters.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and abbreviations of Bokmål, Nynorsk and English.
MONTHS = {
    "januar": 1, "january": 1, "jan": 1,
    "februar": 2, "february": 2, "feb": 2,
    "mars": 3, "march": 3, "mar": 3,
    "april": 4, "apr": 4,
    "mai": 5, "may": 5,
    "juni": 6, "june": 6, "jun": 6,
    "juli": 7, "july": 7, "jul": 7,
    "august": 8, "aug": 8,
    "september": 9, "sept": 9, "sep": 9,
    "oktober": 10, "october": 10, "okt": 10, "oct": 10,
    "november": 11, "nov": 11,
    "desember": 12, "december": 12, "des": 12, "dec": 12,
}
# Zone abbreviations with one meaning here, in minutes east of Greenwich.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0,
    "west": 60, "bst": 60, "cet": 60, "mez": 60,
    "cest": 120, "mesz": 120, "eet": 120,
    "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Words that may stand between a date and its time of day.
JOINERS = {"t", "kl", "klokka", "klokken", "at"}

#: Latest second and earliest second that the normal form can hold (years 1 to 9999).
_FIRST, _LAST = -62135596800, 253402300799
#: Years whose transitions a zone table lists: from before any zone had one (earlier, the first offset
#: holds) to the end of a whole Gregorian cycle of 400 years in which zones follow their standing rules.
TABLE_YEARS = (1800, 2500)
#: Seconds of a cycle. After the table's end a time has the offset of its like one or more cycles earlier.
_CYCLE = 146_097 * 86_400
_TABLE_END = 16_725_225_600


# ---------------------------------------------------------------- zone tables
@dataclass(frozen=True)
class ZoneTable:
    """Offsets of one zone: ``offsets[i]`` seconds hold from ``instants[i]`` (UTC seconds) on."""

    name: str
    version: str
    instants: np.ndarray
    offsets: np.ndarray

    def to_utc(self, local: np.ndarray) -> np.ndarray:
        """UTC seconds of local seconds. A local time that occurs twice is the earlier one; one that
        is skipped is read with the offset before the change."""
        past = np.maximum(local - _TABLE_END, -1) // _CYCLE + 1
        like = local - past * _CYCLE
        before = self.offsets[:-1]
        # Change i makes local times from (instant + larger offset) on follow the new offset: in a gap
        # the old offset holds up to the end of the gap, in an overlap up to the end of the overlap.
        switch = self.instants[1:] + np.maximum(before, self.offsets[1:])
        return local - self.offsets[np.searchsorted(switch, like, side="right")]


@lru_cache(maxsize=1)
def zone_database_version() -> str:
    """Version of the zone database in use, or ``unknown``."""
    import zoneinfo

    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            try:
                with open(f"{folder}/{name}", encoding="ascii", errors="replace") as f:
                    return f.readline().replace("# version", "").strip()
            except OSError:
                pass
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        return "unknown"


def same_zones(version: str) -> None:
    """An error if this process has another version of the zone database than ``version``."""
    if zone_database_version() != version:
        raise RuntimeError(f"zone database {zone_database_version()} here, {version} on the driver")


@lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    """Table of zone ``name`` over TABLE_YEARS, or null if there is no such zone. Transitions are found
    by bisection between days, so the table holds at any precision the database has."""
    import zoneinfo

    try:
        zone = zoneinfo.ZoneInfo(name)
    except Exception:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def offset(second: int) -> int:
        return int((epoch + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

    first = int((datetime(TABLE_YEARS[0], 1, 2, tzinfo=timezone.utc) - epoch).total_seconds())
    last = int((datetime(TABLE_YEARS[1], 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    instants, offsets = [-(2**62)], [offset(first)]
    step = 7 * 86400
    for low in range(first, last, step):
        high = low + step
        while (old := offsets[-1]) != offset(high):
            at = bisect.bisect_left(range(low, high), True, key=lambda s: offset(s) != old) + low
            instants.append(at)
            offsets.append(offset(at))
            low = at
    return ZoneTable(name, zone_database_version(), np.array(instants, np.int64), np.array(offsets, np.int64))


# ---------------------------------------------------------------- masks
def squeezed(value: Column) -> Column:
    """``value`` with every run of whitespace as one space, trimmed."""
    return F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " "))


def shape_mask(value: Column) -> Column:
    """Character-class shape of a squeezed value."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "A"), "[0-9]", "9")


_DATES = (
    r"(?P<Y>9{4})(?P<sep>[-/.])(?P<M>9{1,2})(?P=sep)(?P<D>9{1,2})",
    r"(?P<D>9{1,2})(?P<sep>[-/.])(?P<M>9{1,2})(?P=sep)(?P<Y>9{4})",
    r"(?P<D>9{1,2})\.? ?(?P<W>A)[.,]? (?P<Y>9{4})",
    r"(?P<W>A)\.? (?P<D>9{1,2})[.,]? (?P<Y>9{4})",
    r"(?P<YMD>9{8})",
)
_TIME = (
    r"(?:(?P<J>A)\.? ?|,? (?:(?P<K>A)[.:]? )?)"
    r"(?:(?P<h>9{1,2})[:.](?P<m>99)(?:[:.](?P<s>99)(?:[.,](?P<f>9+))?)?|(?P<hm>9{4}(?:99)?))"
    r"(?: ?(?P<X>A))?(?: (?P<X2>A))?"
    r"(?: ?(?P<sign>[-+])(?:(?P<ohm>9{4})|(?P<oh>9{1,2})(?::(?P<om>99))?)(?: [(\[]?A[)\]]?)?)?"
    r"(?P<zone> ?[\[(]?A(?:[/_+-][A9]+)+[\])]?)?"
)
_MASKS = tuple(re.compile(r"(?:A[.:,]? )*?" + d + rf"(?P<time>{_TIME})?") for d in _DATES)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+")
_ZONE_NAME = re.compile(r"[^\W\d_]+(?:[/_+-][^\W_]+)+(?=[\])]?$)")


@lru_cache(maxsize=65536)
def mask_parser(mask: str) -> dict[str, int | str] | None:
    """The parser of a mask: for each part of a date and time, the number of the token (run of digits
    or of letters) that holds it; null if no value of this shape is a date."""
    if re.fullmatch("9+", mask):
        # Digits only: seconds, milliseconds or microseconds since 1970, told apart by length.
        unit = next((u for most, u in ((11, 1_000_000), (14, 1_000), (17, 1)) if len(mask) <= most), 0)
        return {"epoch": unit} if unit else None
    token_at = {m.start(): i for i, m in enumerate(re.finditer("A|9+", mask))}
    for shape in _MASKS:
        if m := shape.fullmatch(mask):
            parts: dict[str, int | str] = {
                k: token_at[m.start(k)] for k, v in m.groupdict().items() if v and k not in ("sep", "time", "sign", "zone")
            }
            if m["time"]:
                parts["time"] = 1
            if m["sign"]:
                parts["sign"] = m["sign"]
            if m["zone"]:
                parts["zone"] = 1
            return parts
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which of them exist."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    m = np.clip(m, 1, 12)
    y = np.clip(y, 1, 9999)
    start = ((y - 1970) * 12 + (m - 1)).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = ((y - 1970) * 12 + m).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return start + d - 1, ok & (d <= after - start)


def _mapped(words: np.ndarray, table: dict[str, int], missing: int) -> np.ndarray:
    unique, inverse = np.unique(words, return_inverse=True)
    return np.array([table.get(w, missing) for w in unique], np.int64)[inverse]


def convert(values: list[str], mask: str, zone: str) -> np.ndarray:
    """Normal forms (object array, null where unusable) of values that share one mask."""
    out = np.full(len(values), None, dtype=object)
    parser = mask_parser(mask)
    if parser is None or not values:
        return out
    if "epoch" in parser:
        micros = np.array([int(v) for v in values], np.int64) * parser["epoch"]
        ok = (micros // 1_000_000 >= _FIRST) & (micros // 1_000_000 <= _LAST)
        out[ok] = _instants(micros[ok])
        return out
    columns = list(zip(*(_TOKEN.findall(v) for v in values), strict=True))
    number = lambda k: np.array([int(x) for x in columns[parser[k]]], np.int64)
    words = lambda k: np.array([x.lower() for x in columns[parser[k]]])
    if "YMD" in parser:
        whole = number("YMD")
        year, month, day = whole // 10000, whole // 100 % 100, whole % 100
    else:
        year, day = number("Y"), number("D")
        month = number("M") if "M" in parser else _mapped(words("W"), MONTHS, 0)
    days, ok = _days(year, month, day)
    if "time" not in parser:
        if "YMD" in parser:
            return out
        out[ok] = np.datetime_as_string(days[ok].astype("datetime64[D]"))
        return out
    for k in ("J", "K"):
        if k in parser:
            ok &= np.isin(words(k), list(JOINERS))
    if "hm" in parser:
        digits = number("hm")
        wide = len(columns[parser["hm"]][0]) == 6
        hour, minute, second = (digits // 10000, digits // 100 % 100, digits % 100) if wide else (digits // 100, digits % 100, digits * 0)
    else:
        hour, minute = number("h"), number("m")
        second = number("s") if "s" in parser else hour * 0
    ok &= (minute < 60) & (second < 60)
    micro = np.array([int(x[:6].ljust(6, "0")) for x in columns[parser["f"]]], np.int64) if "f" in parser else hour * 0
    # Words after the time: a half of the day and/or a zone.
    offset = np.zeros(len(values), np.int64)
    named = np.zeros(len(values), bool)
    half = np.full(len(values), "", dtype=object)
    for k in ("X", "X2"):
        if k in parser:
            w = words(k)
            is_half = np.isin(w, ["am", "pm"])
            ok &= ~(is_half & (half != ""))
            half[is_half] = w[is_half]
            minutes = _mapped(w, ABBREVIATIONS, 99999)
            is_zone = ~is_half & (minutes != 99999) & ~named
            ok &= is_half | is_zone
            offset[is_zone] = minutes[is_zone] * 60
            named |= is_zone
    has_half = half != ""
    ok &= np.where(has_half, (hour >= 1) & (hour <= 12), hour < 24)
    hour = np.where(has_half, hour % 12 + 12 * (half == "pm"), hour)
    local = days * 86400 + hour * 3600 + minute * 60 + second
    if "sign" in parser:  # outranks any zone name
        if "ohm" in parser:
            hours, rest = number("ohm") // 100, number("ohm") % 100
        else:
            hours, rest = number("oh"), number("om") if "om" in parser else hour * 0
        ok &= (rest < 60) & (hours * 60 + rest <= 18 * 60)
        seconds = local - (hours * 3600 + rest * 60) * (1 if parser["sign"] == "+" else -1)
    elif "zone" in parser:
        names = np.array([m[0] if (m := _ZONE_NAME.search(v)) else "" for v in values])
        seconds = local.copy()
        for name in np.unique(names):
            at, table = names == name, zone_table(str(name))
            if table is None:
                ok &= ~at
            else:
                seconds[at] = table.to_utc(local[at])
    else:
        table = zone_table(zone)
        if table is None:
            raise ValueError(f"the zone database {zone_database_version()} has no zone {zone!r}")
        seconds = np.where(named, local - offset, table.to_utc(local))
    ok &= (seconds >= _FIRST) & (seconds <= _LAST)
    out[ok] = _instants(seconds[ok] * 1_000_000 + micro[ok])
    return out


def _instants(micros: np.ndarray) -> np.ndarray:
    return np.char.add(np.datetime_as_string(micros.astype("datetime64[us]"), unit="us"), "Z").astype(object)


def _convert_batch(values: list[str | None], masks: list[str | None], zone: str) -> list[str | None]:
    by_mask: dict[str, list[int]] = {}
    for i, mask in enumerate(masks):
        if mask:
            by_mask.setdefault(mask, []).append(i)
    out: list[str | None] = [None] * len(values)
    for mask, at in by_mask.items():
        if mask_parser(mask) is not None:
            for i, form in zip(at, convert([values[i] for i in at], mask, zone), strict=True):
                out[i] = form
    return out


def normal_forms(df: DataFrame, value: Column, keep: dict[str, Column], zone: str) -> DataFrame:
    """``keep`` columns (named by the caller, so no clash with columns of ``df``) and ``normal_form``
    of each row of ``df`` whose ``value`` is usable; unusable values give no row.

    ``zone`` is the zone of values that name none. Nothing is shuffled or collected. Workers build zone tables
    from their own zone database; one of another version than the driver's is an error, as equal values
    would come out as different instants."""
    text = squeezed(value)
    picked = df.select(*[c.alias(k) for k, c in keep.items()], text.alias("__value"))
    picked = picked.where(F.col("__value") != "").withColumn("__mask", shape_mask(F.col("__value")))
    names = list(keep)
    version = zone_database_version()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_zones(version)
        for b in batches:
            forms = _convert_batch(b.column("__value").to_pylist(), b.column("__mask").to_pylist(), zone)
            out = pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(forms, pa.string())], names=[*names, "normal_form"])
            yield out.filter(out.column("normal_form").is_valid())

    schema = picked.select(*names).schema.add("normal_form", "string")
    return picked.mapInArrow(run, schema)
