"""Scalar normalisation and validation as Column functions, for whole tables.

Validators are null-safe: a null value is not valid. Parsers give null where the text is not valid.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ID_PREFIXES, SENSITIVE_PARTS

MAX_MINOR_UNITS = 999_999_999_999_999
MAX_EXPONENT = 6
MAX_DURATION_US = 365 * 86_400 * 1_000_000
MAX_ATTRIBUTES, MAX_ATTRIBUTE_BYTES = 32, 4096
MAX_KEY_CHARS, MAX_VALUE_CHARS, MAX_VALUE_BYTES = 64, 256, 512
MAX_PAYLOAD_BYTES, MAX_PAYLOAD_DEPTH, MAX_PAYLOAD_ENTRIES = 1 << 20, 32, 10_000


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _let(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(c), then), 1)


def _nfc(c: Column) -> Column:
    """NFC form; Spark has no function for it. Texts of ASCII, which have as many bytes as letters and are in that form already, are not sent to Python."""

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.coalesce(nfc(F.when(F.length(c) < F.octet_length(c), c)), c)


def _nfc_each(c: Column) -> Column:
    """NFC form of each text of an array."""

    @F.pandas_udf("array<string>")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda a: [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in a], na_action="ignore")

    return nfc(c)


# The code points that count as white space, beside the blank.
_SPACES = r"\t\n\x0B\f\r\x1C-\x1F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def text_error(v: Column, max_chars: int, max_bytes: int, allow_empty: bool = False) -> Column:
    """The first rule that a text in NFC form breaks, or null: missing, empty, whitespace, control, too_long."""
    return (
        F.when(v.isNull(), "missing")
        .when((F.length(v) == 0) & F.lit(not allow_empty), "empty")
        .when(v.rlike(rf"^ | $|  |[{_SPACES}]"), "whitespace")
        .when(v.rlike(r"\p{C}"), "control")
        .when((F.length(v) > max_chars) | (F.octet_length(v) > max_bytes), "too_long")
    )


def normalize_text(c: Column, max_chars: int = 160, max_bytes: int = 320, allow_empty: bool = False) -> Column:
    """struct(value, error): NFC text with single inner blanks and no control, format, surrogate or unassigned code point, or the rule that it breaks."""
    v = _nfc(c)
    error = text_error(v, max_chars, max_bytes, allow_empty)
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def valid_sku(c: Column) -> Column:
    return _is((F.length(c) <= 64) & c.rlike(r"\A[A-Z0-9]+(-[A-Z0-9]+)*\z"))


def valid_quantity(c: Column) -> Column:
    """Whole numbers from 0 to 2^31 - 1; for text, plain digits only."""
    n = F.when(c.cast("string").rlike(r"\A(0|[1-9][0-9]{0,9})\z"), c.cast("string").try_cast("long"))
    return _is(n.between(0, 2_147_483_647))


def valid_currency(c: Column) -> Column:
    return _is(c.rlike(r"\A[A-Z]{3}\z"))


def valid_money(units: Column, currency: Column, exponent: Column) -> Column:
    return _is(units.between(-MAX_MINOR_UNITS, MAX_MINOR_UNITS) & exponent.between(0, MAX_EXPONENT)) & valid_currency(currency)


def _pow10(exponent: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(MAX_EXPONENT + 1)]), exponent.cast("int") + 1)


def money_from_decimal(amount: Column, currency: Column, exponent: Column) -> Column:
    """struct(units, currency, exponent) of a decimal amount given as text or number; null if it needs rounding or is out of bounds."""
    ok = F.coalesce(exponent.between(0, MAX_EXPONENT), F.lit(False)) & valid_currency(currency)
    value = amount.cast("string").try_cast("decimal(38,18)")
    scaled = F.when(ok, value * _pow10(F.when(ok, exponent).otherwise(F.lit(0))).cast("decimal(7,0)"))
    units = _let(scaled, lambda s: F.when((s == F.floor(s)) & (F.abs(s) <= MAX_MINOR_UNITS), s.cast("long")))
    return _let(units, lambda u: F.when(u.isNotNull(), F.struct(u.alias("units"), currency.alias("currency"), exponent.cast("tinyint").alias("exponent"))))


def money_from_text(c: Column) -> Column:
    """struct(units, currency, exponent) of canonical text such as ``USD 12.30``; the digits after the point are the exponent."""
    shape = r"\A([A-Z]{3}) (-?)(0|[1-9][0-9]*)(?:\.([0-9]{1,6}))?\z"
    fits = c.rlike(shape)
    digits = F.concat(F.regexp_extract(c, shape, 3), F.regexp_extract(c, shape, 4))
    units = F.when(fits & (F.length(digits) <= 18), digits.try_cast("long"))
    minus = F.regexp_extract(c, shape, 2) == "-"
    units = F.when(F.abs(units) <= MAX_MINOR_UNITS, F.when(minus, -units).otherwise(units))
    good = fits & units.isNotNull() & ~(minus & (units == 0))
    return F.when(good, F.struct(units.alias("units"), F.regexp_extract(c, shape, 1).alias("currency"), F.length(F.regexp_extract(c, shape, 4)).cast("tinyint").alias("exponent")))


def money_to_text(units: Column, currency: Column, exponent: Column) -> Column:
    digits = F.lpad(F.abs(units).cast("string"), 40, "0")
    e = exponent.cast("int")
    whole = F.regexp_replace(F.substring(digits, F.lit(1), F.lit(40) - e), r"\A0+(?=[0-9])", "")
    text = F.when(e > 0, F.concat(whole, F.lit("."), F.substring(digits, F.lit(41) - e, e))).otherwise(whole)
    return F.when(valid_money(units, currency, exponent), F.concat(currency, F.lit(" "), F.when(units < 0, "-").otherwise(""), text))


_STAMP = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?(Z|[+-][0-9]{2}:[0-9]{2})\z"


def parse_utc(c: Column) -> Column:
    """Timestamp of ISO-8601 text with an offset; null for any other text. Offsets go to +-23:59, and -00:00 is not one."""
    num = lambda at, n=2: F.substring(c, at, n).try_cast("int")  # noqa: E731  # places are fixed where the shape fits, and nothing else counts
    zone = F.when(F.substring(c, -1, 1) == "Z", "Z").otherwise(F.substring(c, -6, 6))
    digits = F.when(F.substring(c, 20, 1) == ".", F.substring(c, F.lit(21), F.length(c) - F.length(zone) - 20)).otherwise("")
    off_h, off_m = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    zone_ok = (zone == "Z") | ((off_h <= 23) & (off_m <= 59) & (zone != "-00:00"))
    day = F.substring(c, 1, 10).try_cast("date")
    ok = c.rlike(_STAMP) & zone_ok & day.isNotNull() & (num(1, 4) >= 1) & (num(12) <= 23) & (num(15) <= 59) & (num(18) <= 59)
    minutes = F.when(zone == "Z", 0).otherwise(F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (off_h * 60 + off_m))
    micros = (F.unix_date(day).cast("long") * 86_400 + num(12) * 3600 + num(15) * 60 + num(18) - minutes * 60) * 1_000_000 + F.rpad(digits, 6, "0").try_cast("long")
    return F.when(_is(ok), F.timestamp_micros(micros))


def format_utc(c: Column) -> Column:
    """27-character UTC text of an instant, whatever the session's zone is."""
    us = F.unix_micros(c)
    second = F.pmod(F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("long"), F.lit(86_400))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(us / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("int"))
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second % 3600 / 60)), two(second % 60))
    return F.concat(day.cast("string"), F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z"))


def parse_duration(c: Column) -> Column:
    """Microseconds of ``PT<s>.<6 digits>S``, at most 365 days; else null."""
    shape = r"\APT(0|[1-9][0-9]{0,7})\.([0-9]{6})S\z"
    us = F.regexp_extract(c, shape, 1).try_cast("long") * 1_000_000 + F.regexp_extract(c, shape, 2).try_cast("long")
    return F.when(_is(c.rlike(shape) & (us <= MAX_DURATION_US)), us)


def format_duration(us: Column) -> Column:
    seconds = F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("long")
    return F.when(_is(us.between(0, MAX_DURATION_US)), F.concat(F.lit("PT"), seconds.cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"), F.lit("S")))


def attribute_rules(items: Column) -> Column:
    """struct(value, error) of array<struct<key,value>> whose values are in NFC form."""
    return _let(items, _attribute_rules)


def _attribute_rules(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0), lambda n, a: n + F.coalesce(F.octet_length(a["key"]), F.lit(0)) + F.coalesce(F.octet_length(a["value"]), F.lit(0)))
    fine = lambda k: _is(k.rlike(r"\A[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*\z") & (F.length(k) <= MAX_KEY_CHARS))
    error = (
        F.when(items.isNull(), "missing")
        .when(F.size(items) > MAX_ATTRIBUTES, "too_many")
        .when(F.exists(items, lambda a: ~fine(a["key"])), "key")
        .when(F.size(F.array_distinct(F.transform(items, lambda a: a["key"]))) < F.size(items), "duplicate_key")
        .when(F.exists(items, lambda a: text_error(a["value"], MAX_VALUE_CHARS, MAX_VALUE_BYTES, allow_empty=True).isNotNull()), "value")
        .when(total > MAX_ATTRIBUTE_BYTES, "too_long")
    )
    return _let(error, lambda e: F.struct(F.when(e.isNull(), F.array_sort(items)).alias("value"), e.alias("error")))


def canonical_attributes(c: Column) -> Column:
    """struct(value, error) of array<struct<key,value>>: unique lower-case keys of at most 64 characters, sorted; values in NFC form, empty ones
    among them, of at most 256 characters and 512 bytes by the rules of text; at most 32 items and 4096 bytes."""
    composed = F.zip_with(F.transform(c, lambda a: a["key"]), _nfc_each(F.transform(c, lambda a: a["value"])), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return attribute_rules(composed)


def attribute_get(c: Column, key: str, default: str | None = None) -> Column:
    found = F.filter(c, lambda a: a["key"] == key)
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(default))


def valid_id(c: Column, kind: str) -> Column:
    """kind is one of the nine; the part after the prefix has 3 to 64 characters."""
    return _is(c.rlike(rf"\A{ID_PREFIXES[kind]}_[a-z0-9]+(?:-[a-z0-9]+)*\z") & F.length(c).between(7, 68))


# The text rules of partition keys, ports and node kinds.
STABLE_TEXT = {"partition_key": r"\A[a-z0-9]+(?:[-_.:][a-z0-9]+)*\z", "port": r"\A[a-z][a-z0-9]*(?:-[a-z0-9]+)*\z", "node_kind": r"\A[a-z][a-z0-9]*(?:\.[a-z][a-z0-9]*)*\z"}


def valid_stable_text(c: Column, kind: str, max_chars: int = 128) -> Column:
    return _is(c.rlike(STABLE_TEXT[kind]) & F.length(c).between(1, max_chars))


_KEY = re.compile(r'("(?:[^"\\]|\\.)*")\s*:', re.S)


#: The eleven names as tuples of words; none has more than two.
_NAMES = frozenset(tuple(name.split("_")) for name in SENSITIVE_PARTS)


def _words(key: str) -> list[str]:
    """The words of a key: letters and digits between other signs and at changes to a capital, composed and case-folded."""
    pieces = re.split(r"(?<=[a-z0-9])(?=[A-Z])", key)
    return [w for piece in pieces for w in re.findall("[a-z0-9]+", unicodedata.normalize("NFC", piece).casefold())]


def _sensitive(key: str) -> bool:
    """Whether one of the names stands among a key's words."""
    words = _words(key)
    return not _NAMES.isdisjoint([*((w,) for w in words), *zip(words, words[1:])])


def _keys(text: str) -> set[str]:
    """All keys of a JSON text, as parsed; of a text that can't be parsed, every string before a colon."""
    found: set[str] = set()

    def pairs(items: list[tuple[str, object]]) -> None:
        found.update(k for k, _ in items)

    try:
        json.loads(text, object_pairs_hook=pairs)
    except (ValueError, RecursionError):
        for quoted in _KEY.findall(text):
            try:
                found.add(json.loads(quoted, strict=False))
            except ValueError:
                found.add(quoted)
    return found


def has_sensitive_key(json_text: Column) -> Column:
    """Whether any key at any depth of a JSON text is sensitive. Keys are parsed, so escapes hide nothing."""

    @F.pandas_udf("boolean")
    def sensitive(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t is not None and any(map(_sensitive, _keys(t))), na_action=None).astype(bool)

    return sensitive(json_text)


def has_sensitive_attribute(c: Column) -> Column:
    """Whether any key of array<struct<key,value>> is sensitive."""

    @F.pandas_udf("boolean")
    def sensitive(s: pd.Series) -> pd.Series:
        return s.map(lambda a: a is not None and any(_sensitive(k) for k in a if k is not None), na_action=None).astype(bool)

    return sensitive(F.transform(c, lambda a: a["key"]))


def _payload(text: str) -> tuple[str | None, str | None]:
    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise ValueError("duplicate_key")
        return dict(items)

    def refuse(_: str) -> None:
        raise ValueError("number")

    if len(text.encode("utf-8", "replace")) > MAX_PAYLOAD_BYTES:
        return None, "too_long"
    try:
        root = json.loads(text, object_pairs_hook=pairs, parse_float=refuse, parse_constant=refuse)
    except (ValueError, RecursionError) as e:
        return None, str(e) if str(e) in ("duplicate_key", "number") else "syntax"
    if not isinstance(root, dict):
        return None, "not_object"
    entries, level, depth = 0, [root], 0
    while level:
        depth += 1
        below = [v for x in level for v in (x.values() if isinstance(x, dict) else x)]
        entries += len(below)
        level = [v for v in below if isinstance(v, (dict, list))]
    if depth > MAX_PAYLOAD_DEPTH:
        return None, "depth"
    if entries > MAX_PAYLOAD_ENTRIES:
        return None, "entries"
    return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None


def canonical_payload(c: Column) -> Column:
    """struct(value, error, is_canonical): the compact sorted form of a JSON object without floats or repeated keys, else what is wrong."""

    @F.pandas_udf("value string, error string")
    def payload(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, "missing") if t is None else _payload(t) for t in s], columns=["value", "error"])

    p = payload(c)
    return F.struct(p["value"].alias("value"), p["error"].alias("error"), _is(p["value"] == c).alias("is_canonical"))


def valid_sha256(c: Column) -> Column:
    return _is(c.rlike(r"\A[0-9a-f]{64}\z"))


# Names that some systems keep for devices, whatever follows a dot, and names that they keep as they are.
DEVICES = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in "123456789¹²³"))
CONSOLES = ("conin$", "conout$")


def valid_artifact_path(c: Column, max_bytes: int = 1024, max_segments: int = 32, max_segment_bytes: int = 255) -> Column:
    """Relative, forward slashes, NFC form, no hidden, ambiguous, device, non-portable or over-long segment."""
    parts = F.split(c, "/")

    def fine(s: Column) -> Column:
        low = F.lower(s)
        device = F.substring_index(low, ".", 1).isin(*DEVICES) | low.isin(*CONSOLES)
        return (F.length(s) > 0) & (F.octet_length(s) <= max_segment_bytes) & ~s.startswith(".") & ~s.endswith(".") & ~s.rlike(rf"^[ {_SPACES}]|[ {_SPACES}]$") & ~s.rlike(r'[<>:"\\|?*]') & ~device

    composed = F.coalesce(_nfc(F.when(~c.rlike(r"\A\p{ASCII}*\z"), c)), c)  # most paths are ASCII, and composed as they are
    return _is((F.octet_length(c) <= max_bytes) & ~c.rlike(r"\p{C}") & (F.size(parts) <= max_segments) & F.forall(parts, fine) & (composed == c))


def valid_enum(c: Column, values: Iterable[str]) -> Column:
    return _is(c.isin(*values))
