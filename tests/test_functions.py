"""Scalar functions: accepted and rejected values."""


import itertools
import unicodedata
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crosstally.functions import text as t
from crosstally.schemas import ID_PREFIXES


def values(spark, fn, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", fn(F.col("x")).alias("v")).orderBy("i").collect()]


LIMIT = t.MAX_MINOR_UNITS


def test_money_text_is_the_inverse_of_its_parts(spark):
    """Every exponent with units about zero, about each power of ten and at the bounds."""
    cases = [(u * sign, e) for e in range(t.MAX_EXPONENT + 1) for u in (0, 1, 9, 10**e, 10**e + 1, 7 * 10**e - 1, LIMIT) for sign in (1, -1)]
    df = spark.createDataFrame([(i, u, e) for i, (u, e) in enumerate(cases)], "i int, u long, e int")
    shown = df.select("i", "u", "e", t.money_to_text(F.col("u"), F.lit("CHF"), F.col("e")).alias("x"))
    for r in shown.select("u", "e", "x", t.money_from_text(F.col("x")).alias("m")).collect():
        digits = str(abs(r["u"])).zfill(r["e"] + 1)
        cut = len(digits) - r["e"]
        assert r["x"] == f"CHF {'-' if r['u'] < 0 else ''}{digits[:cut]}{'.' + digits[cut:] if r['e'] else ''}"
        assert (r["m"]["units"], r["m"]["currency"], r["m"]["exponent"]) == (r["u"], "CHF", r["e"])


def test_money_text_refuses(spark):
    """One step off the form, at each place of it."""
    good = "CHF 340.5"
    assert values(spark, t.money_from_text, [good])[0]["units"] == 3405
    bad = [good.lower(), good.replace(" ", ""), good.replace(" ", "  "), good + " ", "\t" + good, good.replace("340", "0340"), good.replace("340", ""), good.replace("340", "+340"), good + "e1", good.replace(".5", "."), good.replace(".5", ",5"), good + "000000", "CHF -0", "CHF -0.00", f"CHF {LIMIT + 1}", "CH 1", "CHFX 1", "CHF", None]
    assert values(spark, t.money_from_text, bad) == [None] * len(bad)


def test_money_from_decimal_is_exact_or_null(spark):
    """Against exact arithmetic: amounts that need more digits than the exponent gives, or leave the bounds, are null."""
    amounts = ["3.50", "3.505", "-0.25", "250", "2.5E2", "25E-1", "0.000000", "1e-6", "-1e-7", str(LIMIT), str(LIMIT + 1), f"-{LIMIT}", f"{LIMIT}.9", "Infinity", "three", "", None]
    cases = [(a, e) for a in amounts for e in (-1, 0, 1, 2, 6, 7)]
    df = spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(cases)], "i int, a string, e int")
    for r in df.select("i", t.money_from_decimal(F.col("a"), F.lit("CHF"), F.col("e")).alias("m")).collect():
        a, e = cases[r["i"]]
        try:
            scaled = Fraction(a) * 10**e if 0 <= e <= 6 else None
        except (ValueError, TypeError):
            scaled = None
        want = int(scaled) if scaled is not None and scaled.denominator == 1 and abs(scaled) <= LIMIT else None
        assert (r["m"]["units"] if r["m"] else None) == want, cases[r["i"]]


@pytest.mark.parametrize("length", range(5))
def test_currency_is_three_capitals(spark, length):
    codes = ["".join(x) for x in itertools.product("AZaé1 ", repeat=length)] if length <= 3 else ["AZAZ"]
    assert values(spark, t.valid_currency, codes) == [len(c) == 3 and set(c) <= {"A", "Z"} for c in codes]


def test_instants_against_the_calendar(spark):
    """Instants at ends of days, years and leap days, written with whole-minute offsets and 0 to 6 digits of a second, against datetime."""
    texts, want = [], []
    for day in ("0001-01-01", "1899-12-31", "1970-01-01", "2000-02-29", "2023-03-01", "9999-12-31"):
        for clock, digits in (("00:00:00", ""), ("23:59:59", ".9"), ("12:34:56", ".000001"), ("06:07:08", ".25")):
            for offset in ("Z", "+00:00", "+14:00", "-09:30", "+23:59", "-23:59"):
                at = datetime.fromisoformat(f"{day}T{clock}{digits.ljust(7, '0') if digits else ''}+00:00")
                minutes = 0 if offset == "Z" else (1 if offset[0] == "+" else -1) * (int(offset[1:3]) * 60 + int(offset[4:]))
                try:
                    at = at - timedelta(minutes=minutes)
                except OverflowError:
                    continue
                texts.append(f"{day}T{clock}{digits}{offset}")
                want.append(at.strftime("%Y").zfill(4) + at.strftime("-%m-%dT%H:%M:%S.%fZ"))
    assert values(spark, lambda c: t.format_utc(t.parse_utc(c)), texts) == want


def test_instants_refuse(spark):
    """One step off the form, at each place of it."""
    good = "2031-05-06T07:08:09.5+01:00"
    off = [("2031", "31"), ("2031", "0000"), ("-05-", "-00-"), ("-05-", "-13-"), ("-06T", "-32T"), ("05-06", "02-30"), ("T", " "), ("T", "t"), ("07:", "24:"), (":08:", ":60:"), (":09", ":60"), (".5", "."), (".5", ".1234567"), (".5", ",5"), ("+01:00", ""), ("+01:00", "z"), ("+01:00", "+0100"), ("+01:00", "-00:00"), ("+01:00", "+24:00"), ("+01:00", "+00:60")]
    bad = [good.replace(a, b, 1) for a, b in off] + [good + "\n", " " + good, "", None]
    assert all(x != good for x in bad) and values(spark, t.parse_utc, [good])[0] is not None
    assert values(spark, t.parse_utc, bad) == [None] * len(bad)


def test_instants_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    try:
        assert values(spark, lambda c: t.format_utc(t.parse_utc(c)), ["2031-05-06T07:08:09.5-02:30"]) == ["2031-05-06T09:38:09.500000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations_and_their_texts(spark):
    last = t.MAX_DURATION_US
    us = [0, 1, 999_999, 1_000_000, 86_399_999_999, 10**12 + 7, last - 1, last]
    texts = [f"PT{x // 10**6}.{x % 10**6:06d}S" for x in us]
    assert values(spark, t.format_duration, [*us, -1, last + 1, None], "long") == [*texts, None, None, None]
    assert values(spark, t.parse_duration, texts) == us
    good = "PT35.250000S"
    bad = [good.replace(a, b) for a, b in (("PT", "P"), ("PT", "pt"), ("35", "035"), ("35", ""), ("35", "-35"), (".250000", ""), (".250000", ".25"), (".250000", ".2500000"), ("S", ""), ("S", "M"), ("PT", "P1DT"))] + [f"PT{last // 10**6}.000001S", "", None]
    assert values(spark, t.parse_duration, bad) == [None] * len(bad)


def test_text(spark):
    cases = [("Café", "Café", None), (" a", None, "whitespace"), ("a  b", None, "whitespace"), ("a\tb", None, "whitespace"), ("a b", None, "whitespace"), ("a​b", None, "control"), ("", None, "empty"), (None, None, "missing"), ("x" * 160, "x" * 160, None), ("x" * 161, None, "too_long"), ("é" * 160, "é" * 160, None), ("日" * 120, None, "too_long")]
    got = values(spark, t.normalize_text, [c[0] for c in cases])
    assert [(g["value"], g["error"]) for g in got] == [c[1:] for c in cases]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=8), min_size=1, max_size=40))
def test_text_is_nfc(spark, texts):
    for x, g in zip(texts, values(spark, t.normalize_text, texts)):
        if g["error"] is None:
            assert g["value"] == unicodedata.normalize("NFC", x)


def test_sku_quantity_ids(spark):
    assert values(spark, t.valid_sku, ["A", "A-1", "AB-C9-0", "a", "A--1", "-A", "A" * 65, "A\n", None]) == [True] * 3 + [False] * 6
    assert values(spark, t.valid_quantity, ["0", "2147483647", "2147483648", "-1", "1.0", "true", "01", None]) == [True, True] + [False] * 6
    for kind, p in ID_PREFIXES.items():
        assert values(spark, lambda c, k=kind: t.valid_id(c, k), [f"{p}_abc", f"{p}_a-b-c1", f"{p}_ab", "xxx_abc", f"{p}_ABC", f"{p}_" + "a" * 65]) == [True, True] + [False] * 4
    assert values(spark, t.valid_sha256, ["a" * 64, "A" * 64, "a" * 63, None]) == [True, False, False, False]
    assert values(spark, lambda c: t.valid_stable_text(c, "partition_key"), ["partition-00000000", "a.b:c", "A", "", "a--b"]) == [True, True, False, False, False]
    assert values(spark, lambda c: t.valid_enum(c, ["x"]), ["x", "y", None]) == [True, False, False]


def test_attributes(spark):
    a = lambda *kv: [{"key": k, "value": v} for k, v in kv]
    good = [a(("shape", "round"), ("finish", "matt")), [], a(("k" * 64, "x" * 256)), a(("k", "\u00e9" * 256)), a(("k", "")), a(("k", "Cafe\u0301")), a(*((f"k{i}", "v") for i in range(32)))]
    bad = {"duplicate_key": [a(("a", "1"), ("a", "2"))], "key": [a(("A", "1")), a(("k" * 65, "1")), a((None, "x")), a(("a--b", "x"))], "value": [a(("a", " 1")), a(("a", None)), a(("a", "x" * 257)), a(("a", "\u65e5" * 171)), a(("a", "x\u00a0y")), a(("a", "x\u200by"))], "missing": [None], "too_many": [a(*((f"k{i}", "v") for i in range(33)))], "too_long": [a(*((f"k{i:02d}", "x" * 250) for i in range(17)))]}
    cases = good + [x for xs in bad.values() for x in xs]
    got = values(spark, t.canonical_attributes, cases, "array<struct<key:string,value:string>>")
    assert [g["error"] for g in got] == [None] * len(good) + [k for k, xs in bad.items() for _ in xs]
    assert [x["key"] for x in got[0]["value"]] == ["finish", "shape"] and got[5]["value"][0]["value"] == "Caf\u00e9"
    assert values(spark, lambda c: t.attribute_get(c, "shape", "none"), cases[:2], "array<struct<key:string,value:string>>") == ["round", "none"]


def test_sensitive_keys(spark):
    yes = ['{"password": 1}', '{"a": {"userPassword": 1}}', '{"a": [{"API-Key" : 1}]}', '{"x_session_y": 0}', '{"private_key":""}', r'{"pa\u0073sword": 1}', r'{"\u0061pi key": 1}', '{"\u017fecret": 1}', '{"x": NaN, "token": ', r'[1, {"to\u006ben": 2} x', '{"a": 1, "a": {"cookie": 1}}']
    no = ['{"text": "password"}', '{"passwords": 1}', '{"tokens": ["token"]}', '{"a": "\\"token\\": 1"}', "{}", "", "token", None]
    assert values(spark, t.has_sensitive_key, yes + no) == [True] * len(yes) + [False] * len(no)
    assert values(spark, t.has_sensitive_attribute, [[{"key": "api_key", "value": "x"}], [{"key": "size", "value": "token"}], [], None, [{"key": None, "value": "x"}]], "array<struct<key:string,value:string>>") == [True, False, False, False, False]


def test_payloads(spark):
    deep = '{"a":' * 33 + "1" + "}" * 33
    cases = {'{"a":1,"b":[]}': (None, True), '{"b":1,"a":2}': (None, False), '{"a":1.0}': ("number", False), '{"a":NaN}': ("number", False), '{"a":1,"a":2}': ("duplicate_key", False), "[1]": ("not_object", False), "{": ("syntax", False), deep: ("depth", False), '{"a":[' + ",".join("1" * 10_001) + "]}": ("entries", False)}
    got = values(spark, t.canonical_payload, [*cases, None])
    assert [(g["error"], g["is_canonical"]) for g in got] == [*cases.values(), ("missing", False)]
    assert got[1]["value"] == '{"a":2,"b":1}'


def test_paths(spark):
    good = ["out/a/part-7.parquet", "b", "\u00e9/b c", "conx/comA", "a/com0.txt", "x" * 255, "/".join("a" * 32), "/".join(["y" * 204] * 5)]
    bad = ["", "/b", "b/", "b//c", "../b", "b/./c", ".out", "b./c", " b", "b\u2003/c", "b\\c", "b:c", "b|c", "b\u0000c", "e\u0301/b", "x" * 256, "\u00e9" * 128, "/".join("a" * 33), "/".join(["y" * 205] * 5), None]
    bad += [f"q/{name}{end}" for name in ("CON", "prn", "Aux", "nul", "com1", "LPT9", "com\u00b2") for end in ("", ".txt", ".a.b")] + ["conin$", "q/CONOUT$"]
    assert values(spark, t.valid_artifact_path, good + bad) == [True] * len(good) + [False] * len(bad)


def test_unknown_kind(spark):
    with pytest.raises(KeyError):
        t.valid_id(F.col("x"), "nothing")


def test_only_texts_beyond_ascii_go_to_python(spark):
    """n01: the normaliser gets no text that is in NFC form by its bytes, and long texts go in small batches."""
    df = spark.createDataFrame([("plain",), ("e\u0301",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(t.normalize_text(F.col("t"), allow_empty=True)["value"]).collect()] == ["plain", "\u00e9", None, ""]
    plan = df.select(t.normalize_text(F.col("t"))["value"])._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in plan.split("ArrowEvalPython")[1].split("\n")[0]
    entry.queries()["n01_text_rules"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
