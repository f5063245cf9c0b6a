import hashlib
import json
import random
import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crosstally.llm import chat, entries, licenses, media

from .helpers import LONG, documents, empty

TEXT = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "[TURN ", "[/TURN]", "]", "\\", "\\\\", "<", "[", "a", "é", "\n", " ", "", "[/", "s>"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=6)


# --- chat


@given(TURNS)
def test_round_trip(turns):
    assert chat.read_back(chat.render(turns)) == turns


@given(TURNS)
def test_spans_by_rendering(turns):
    r = chat.render_incrementally(turns)
    assert r.formatted == chat.render(turns) and not r.rewrites
    assert [chat.read_back(r.formatted[a:b]) for a, b in r.spans] == [[t] for t in turns]
    assert [chat.unescape(r.formatted[a:b]) for a, b in r.contents] == [t for _, t in turns]


def test_rewriting_templates_are_found():
    last_only = lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    assert chat.render_incrementally([("user", "one"), ("assistant", "two")], last_only).rewrites
    closing = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + "<end>"
    assert chat.render_incrementally([("user", "one"), ("assistant", "two")], closing).rewrites


def test_what_is_not_known_is_told(spark):
    """No span of an output that was rewritten, no place for a text that the template changed, and neither under the mask."""
    shout = lambda turns: "".join(f"<{r}>{t.upper() if r == 'user' else t[::-1]}" for r, t in turns)
    drops = lambda turns: "".join(f"<{r}>" + ("" if r == "user" else t) for r, t in turns)
    r = chat.render_incrementally([("user", "one"), ("assistant", "two")], drops)
    assert r.contents == [None, (17, 20)] and r.spans == [(0, 6), (6, 20)] and not r.rewrites
    closing = lambda turns: "".join(f"<{r}>{t}" for r, t in turns) + "<end>"
    r = chat.render_incrementally([("user", "a"), ("assistant", "b"), ("user", "c")], closing)
    assert r.rewrites and r.spans == r.contents == [None] * 3
    rows = spark.createDataFrame([(1, 0, "user", "one"), (1, 1, "assistant", "two"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.format_chats(rows, closing).collect()}
    assert got[1]["rewrites"] and got[1]["n_unplaced"] == 2 and got[1]["loss_spans"] == []
    assert chat.render_incrementally([("user", "Ab"), ("assistant", "cd")], shout).contents == [(6, 8), (19, 21)]  # changed texts have places too


def test_very_long_conversation(spark):
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [/INST]") for i in range(3000)] + [(8, 0, "assistant", LONG)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.format_chats(rows)).collect()}
    loss = "".join(t for c, _, r, t in turns if c == 7 and r == "assistant")
    assert got[7]["n_turns"] == 3000 and got[7]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[8]["loss_chars"] == len(LONG)


def test_op9_contract(spark, tmp_path):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "[INST] a"), (2, 0, None, None), (2, 0, None, None), (3, None, "assistant", "x"), (3, 5, "assistant", "y"), (4, 0, "user", "only")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in entries.op9_chat(spark, str(tmp_path)).collect()}
    want = {1: [("user", "[INST] a"), ("assistant", "b</s>")], 2: [("", ""), ("", "")], 3: [("assistant", "x"), ("assistant", "y")], 4: [("user", "only")], -1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[k]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat.render(turns))


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, spans string")
    assert chat.format_chats(none).count() == 0


# --- media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 63, 576 * 64, 576 * 64 + 1, 576 * 200 + 5])
def test_container_round_trip(n):
    rng = random.Random(n)
    payload = media.padded("".join(chr(rng.choice([65, 233, 0x4E00])) for _ in range(n)))
    m = media.to_media(payload)
    assert media.read_samples(m) == payload and media.to_media(payload) == m
    (d,) = media.describe(m)
    assert len(d["keyframes"]) == -(-d["n_samples"] // 64)
    assert d["codec"] == "raw" and d["duration"] == len(payload) and d["n_samples"] * media.UNIT == len(payload)
    for k, (offset, length) in enumerate(d["keyframes"]):
        assert m[offset : offset + length] == payload[k * 64 * 576 : k * 64 * 576 + 576]
    assert [p[-1] for p, _, _ in media.walk(m) if len(p) == 1] == [b"ftyp", b"moov", b"mdat"]


def test_other_layouts_are_read():
    """64-bit box sizes, a box up to the end of the file, unequal samples, several samples a chunk, no keyframe table."""
    box = lambda kind, body, wide=False: struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body
    full = lambda kind, body: box(kind, bytes(4) + body)
    sizes, data = [3, 5, 2], b"abcdefghij"

    def movie(a, b):
        table = box(b"stbl", full(b"stsd", struct.pack(">II4s", 1, 16, b"abcd") + bytes(8)) + full(b"stts", struct.pack(">III", 1, 3, 10)) + full(b"stsc", struct.pack(">I", 2) + struct.pack(">III", 1, 2, 1) + struct.pack(">III", 2, 1, 1)) + full(b"stsz", struct.pack(">II3I", 0, 3, *sizes)) + full(b"co64", struct.pack(">IQQ", 2, a, b)))
        return box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 30)) + full(b"hdlr", bytes(4) + b"vide" + bytes(12)) + box(b"minf", table)), True))

    start = 8 + len(movie(0, 0)) + 8
    m = box(b"free", b"") + movie(start, start + 8) + struct.pack(">I4s", 0, b"mdat") + data
    assert media.read_samples(m) == data
    (d,) = media.describe(m)
    assert d["codec"] == "abcd" and d["duration"] == 30 and d["keyframes"] == [[start, 3], [start + 3, 5], [start + 8, 2]]


def test_broken_containers(spark):
    good = media.to_media(media.padded("x"))
    with pytest.raises(ValueError):
        list(media.walk(good[:-1]))
    rows = spark.createDataFrame([(1, good), (2, good[:50]), (3, b""), (4, None)], "id int, m binary").select("id", media.describe_column(F.col("m")).alias("d")).collect()
    assert {r["id"]: r["d"] and r["d"][0]["codec"] for r in rows} == {1: "raw", 2: None, 3: [], 4: None}


def test_hostile_containers(spark):
    """Deep nesting, false counts and offsets outside the file are told at once, without their memory."""
    good = media.to_media(media.padded("x" * 5000))
    nested = b""
    for _ in range(3000):
        nested = struct.pack(">I4s", len(nested) + 8, b"moov") + nested

    def patched(kind, skip, value, form=">I"):
        at = good.index(kind) + 8 + skip
        return good[:at] + struct.pack(form, value) + good[at + struct.calcsize(form) :]

    bad = [patched(b"stsz", 4, 1 << 31), patched(b"stts", 0, 1 << 31), patched(b"stco", 0, 1 << 30), patched(b"stco", 4, 1 << 31), patched(b"stss", 4, 0), patched(b"stsc", 8, 1 << 31), patched(b"stsc", 4, 7)]
    for m in bad:
        with pytest.raises(ValueError):
            media.describe(m)
    assert media.describe(nested) == [] and len(list(media.walk(nested))) == 3000
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([good, nested, *bad])], "id int, m binary").select("id", media.describe_column(F.col("m")).alias("d")).collect()
    assert {r["id"]: None if r["d"] is None else len(r["d"]) for r in rows} == {0: 1, 1: 0} | {i: None for i in range(2, 2 + len(bad))}


def _plain_box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def _plain_track(number, handler, codec, sizes, offset, keys):
    f = lambda kind, body: _plain_box(kind, bytes(4) + body)
    n = len(sizes)
    table = f(b"stsd", struct.pack(">II", 1, 16) + codec + bytes(8)) + f(b"stts", struct.pack(">III", 1, n, 7)) + f(b"stsc", struct.pack(">IIII", 1, 1, n, 1)) + f(b"stsz", struct.pack(f">II{n}I", 0, n, *sizes)) + f(b"stco", struct.pack(">II", 1, offset))
    if keys:
        table += f(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))
    media_box = _plain_box(b"mdia", f(b"mdhd", struct.pack(">IIII", 0, 0, 50, n * 7)) + f(b"hdlr", bytes(4) + handler + bytes(12)) + _plain_box(b"minf", _plain_box(b"stbl", table)))
    return _plain_box(b"trak", f(b"tkhd", struct.pack(">III", 0, 0, number)) + media_box)


def test_two_tracks(spark):
    """Sound before picture: both are described, each with its own ranges."""
    sound, picture = b"so" * 6, b"pictures!"
    build = lambda at: _plain_box(b"moov", _plain_track(1, b"soun", b"mp4a", [4, 4, 4], at, []) + _plain_track(2, b"vide", b"avc1", [5, 4], at + 12, [1]))
    start = len(build(0)) + 8
    m = build(start) + _plain_box(b"mdat", sound + picture)
    a, b = media.describe(m)
    assert (a["handler"], a["codec"], a["duration"], a["keyframes"]) == ("soun", "mp4a", 21, [[start, 4], [start + 4, 4], [start + 8, 4]])
    assert (b["handler"], b["codec"], b["duration"], b["keyframes"]) == ("vide", "avc1", 14, [[start + 12, 5]])
    assert media.read_samples(m) == sound and media.read_samples(m, 1) == picture
    (r,) = spark.createDataFrame([(m,)], "m binary").select(media.describe_column(F.col("m")).alias("d")).collect()
    assert [(t["handler"], [tuple(k) for k in t["keyframes"]]) for t in r["d"]] == [("soun", [(start, 4), (start + 4, 4), (start + 8, 4)]), ("vide", [(start + 12, 5)])]


def plain_file(payload):
    """The stored form of a payload, written out from the format's definition."""
    f = lambda kind, body, version=0, flags=0: _plain_box(kind, bytes([version]) + flags.to_bytes(3, "big") + body)
    units, chunks = len(payload) // 576, -(-len(payload) // (576 * 64))
    last = units - 64 * (chunks - 1)
    runs = [(1, 64, 1)] * (chunks > 1 or last == 64) + [(chunks, last, 1)] * (last < 64)
    matrix = struct.pack(">9I", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)

    def moov(at):
        sample = _plain_box(b"raw ", bytes(6) + b"\0\1" + bytes(8) + b"\0\1\0\x08" + bytes(4) + struct.pack(">I", 8000 * 65536))
        tables = [f(b"stsd", struct.pack(">I", 1) + sample), f(b"stts", struct.pack(">III", 1, units, 576)), f(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)), f(b"stsz", struct.pack(">II", 576, units))]
        tables += [f(b"stss", struct.pack(">I", chunks) + b"".join(struct.pack(">I", 64 * k + 1) for k in range(chunks))), f(b"stco", struct.pack(">I", chunks) + b"".join(struct.pack(">I", at + 64 * 576 * k) for k in range(chunks)))]
        minf = _plain_box(b"minf", f(b"smhd", bytes(4)) + _plain_box(b"dinf", f(b"dref", struct.pack(">I", 1) + f(b"url ", b"", flags=1))) + _plain_box(b"stbl", b"".join(tables)))
        mdia = _plain_box(b"mdia", f(b"mdhd", struct.pack(">IIIIHH", 0, 0, 8000, units * 576, 0x55C4, 0)) + f(b"hdlr", bytes(4) + b"soun" + bytes(12) + b"sound\0") + minf)
        tkhd = f(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, units * 576) + bytes(8) + struct.pack(">HHHH", 0, 0, 256, 0) + matrix + bytes(8), flags=3)
        return _plain_box(b"moov", f(b"mvhd", struct.pack(">IIIIIH", 0, 0, 8000, units * 576, 65536, 256) + bytes(10) + matrix + bytes(24) + struct.pack(">I", 2)) + _plain_box(b"trak", tkhd + mdia))

    kind = _plain_box(b"ftyp", b"isom" + struct.pack(">I", 512) + b"isomiso2mp41")
    start = len(kind) + len(moov(0)) + 8
    keys = [[start + 64 * 576 * k, 576] for k in range(chunks)]
    return kind + moov(start) + _plain_box(b"mdat", payload), {"codec": "raw", "handler": "soun", "timescale": 8000, "duration": len(payload), "n_samples": units, "keyframes": keys, "max_sample": 576}


def test_op10_whole_result(spark):
    """media_bytes, media_sha256 and feature against a file written out by hand, on a whole table with texts of several chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "é" * 100_000), (-2, ""), (-3, None), (-4, "a" * 576 * 64)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in media.media_digests(docs).collect():
        b = (texts[r["doc_id"]] or "").encode()
        m, told = plain_file(b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576)))
        assert (r["media_bytes"], r["media_sha256"], json.loads(r["feature"])) == (len(m), hashlib.sha256(m).hexdigest(), told)


def test_op10_contract(spark):
    docs = documents(spark)
    rows = media.media_digests(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"]}
    for r in rows:
        if r["doc_id"]:
            b = texts[r["doc_id"]].encode()
            p = b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = [tuple(r)[1:] for r in rows if r["doc_id"] in (1, 2)]
    assert len(set(same)) == 1
    assert media.media_digests(empty(spark)).count() == 0


# --- licences


def test_licences(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 200)
    texts = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (3, mit.replace("sublicense", "sublicence").replace(",", ";")), (4, mit + " and more"), (5, "prose\nReleased under the MIT Licence!\nprose\nLicensed under CC BY-NC 4.0."),
        (6, None), (7, ""), (8, "Released under the MIT License."), (9, "(c) 2020"), (10, LONG), (11, LONG + "\nReleased under the MIT License."),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts], "doc_id long, text string, digest string, license_id string")
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"], r["n_lines"]) for r in licenses.scan_licenses(df).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "MIT" and got[4][0] is None
    assert got[5] == (None, "CC-BY-NC-4.0,MIT", 2) and got[8] == ("MIT", "MIT", 1)
    assert all(got[k] == (None, "", 0) for k in (6, 7, 9, 10)) and got[11] == (None, "MIT", 1)
    assert licenses.scan_licenses(documents(spark)).count() == documents(spark).count() and licenses.scan_licenses(empty(spark)).count() == 0


def test_licences_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(map(str, con.execute(f"SELECT doc_id, digest, license_id, line_licenses, n_lines FROM ({licenses.scan_sql()})").fetchall()))
    got = sorted(str(tuple(r)) for r in licenses.scan_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("doc_id", "digest", "license_id", "line_licenses", "n_lines").collect())
    assert got == want
