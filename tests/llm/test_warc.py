"""WARC archives: exact round trips, other writers' archives, and damage."""

import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from scholia.llm import warc

BIG = "<p>some words of a page</p>" * 60


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://x/{k}", h, "clash", 1) for k, h in rows], "page_id long, url string, html string, payload string, row int")


def told(df):
    return sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in df.collect() if r["page_id"] is not None)


def test_round_trip_with_copies_nulls_and_long_pages(spark):
    rows = [(1, BIG), (2, BIG), (3, "short"), (4, "short"), (5, None), (6, ""), (7, BIG), (8, "é日本🙂" * 200_000), (9, "a\r\n\r\nWARC/1.1\r\n" * 100), (9, "a\r\n\r\nWARC/1.1\r\n" * 100), (None, BIG)]
    got = warc.round_trip(pages(spark, rows)).cache()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    keep = {1: 7, 2: 7}
    want = [(k, "revisit" if k in keep else "response", keep.get(k), len((h or "").encode()), sha(h)) for k, h in rows if k not in (9, None)]
    assert [t for t in told(got) if t[0] != 9] == sorted(want, key=lambda t: t[0])
    assert [t[1:3] for t in told(got) if t[0] == 9] == [("response", None), ("revisit", 9)]
    assert [(r["record_type"], r["refers_to"]) for r in got.where("page_id IS NULL").collect()] == [("revisit", 7)]
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert bodies[8] == rows[7][1] and bodies[5] == "" and bodies[7] == BIG
    assert got.select("record_id").distinct().count() == len(rows)


def test_groups_beyond_the_broadcast_are_joined_alike(spark, monkeypatch):
    rows = [(k, BIG + str(k % 7)) for k in range(60)]
    df = pages(spark, rows).repartition(3)
    one = told(warc.round_trip(df))
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    assert told(warc.round_trip(df)) == one
    assert sum(t[1] == "response" for t in one) == 7


def test_dictionary_leads_each_archive_and_shortens_records(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    frame = [word() for _ in range(200)]
    rows = [(k, " ".join(frame[:150]) + " ".join(word() for _ in range(20))) for k in range(400)]
    path = f"{tmp_path}/archives"
    warc.write_archives(pages(spark, rows).repartition(2), path)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect()]
    assert len(files) == 2
    for raw in files:
        trained, n = warc.load_dictionary(memoryview(raw))
        assert trained is not None and raw[:4] == struct.pack("<I", 0x184D2A5D)
        assert len(raw) < 0.7 * sum(len(zstandard.compress(whole)) for _, whole in warc.frames_of(memoryview(raw)))
        with pytest.raises(zstandard.ZstdError):  # no record decodes without it
            zstandard.ZstdDecompressor().decompressobj().decompress(raw[n + len(warc.EMPTY_FRAME) :])
    got = warc.read_archives(spark, path).where("page_id IS NOT NULL")
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in got.collect()} == {str(k): h for k, h in rows}


def other_archive(payload, length=None, digest=None, kind="response", dictionary=None, raw_dictionary=True):
    """An archive as another writer makes it: a raw or packed dictionary, no checksums, no content size."""
    block = b"HTTP/1.0 200 OK\r\ncontent-length: %d\r\n\r\n" % len(payload) + payload
    rec = (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:1>\r\nwarc-payload-digest: sha1:{digest or hashlib.sha1(payload).hexdigest()}\r\n"
           f"content-length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"
    coder = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False)
    lead = b""
    if dictionary:
        raw = dictionary.as_bytes() if raw_dictionary else zstandard.compress(dictionary.as_bytes())
        lead = struct.pack("<II", 0x184D2A5D, len(raw)) + raw
    return lead + coder.compress(rec)


def read(spark, tmp_path, **archives):
    for name, raw in archives.items():
        (tmp_path / name).write_bytes(raw)
    out = {}
    for r in warc.read_archives(spark, str(tmp_path)).collect():
        out.setdefault(r["archive"].rsplit("/", 1)[1], []).append(r)
    return out


def test_archives_of_other_writers_and_damaged_ones(spark, tmp_path):
    body = b"<html>some body text</html>" * 40
    trained = zstandard.train_dictionary(4_096, [b"<html>some body %d text</html>" % k * 30 for k in range(300)])
    good = other_archive(body)
    skip = struct.pack("<II", 0x184D2A53, 5) + b"extra"
    got = read(
        spark, tmp_path, plain=good, raw=other_archive(body, dictionary=trained), packed=other_archive(body, dictionary=trained, raw_dictionary=False), skipped=skip + good + skip + good,
        empty=b"", length=other_archive(body, length=7) + good, digest=other_archive(body, digest="0" * 40), cut=good + good[:-9], junk=good + b"\x01\x02\x03\x04\x05\x06\x07\x08\x09",
        revisit=other_archive(b"", kind="revisit"), version=zstandard.compress(b"HTTP/1.1 x\r\n\r\n\r\n\r\n"), nolength=zstandard.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\n\r\n\r\n\r\n"),
        lead=struct.pack("<II", 0x184D2A5D, 900) + b"too short",
    )
    for name, n in {"plain": 1, "raw": 1, "packed": 1, "skipped": 2}.items():
        assert [(r["problem"], bytes(r["payload"])) for r in got[name]] == [(None, body)] * n
    assert "empty" not in got
    problem = lambda name: [r["problem"] for r in got[name]]
    assert problem("length") == ["record is not as long as it says", None]
    assert problem("digest") == ["payload digest differs"] and problem("cut") == [None, "frame is cut off"] and problem("junk") == [None, "no frame begins here"]
    assert problem("revisit") == ["revisit without what it refers to"] and problem("nolength") == ["record has no length"]
    assert problem("version")[0].startswith("bad version") and problem("lead") == ["dictionary is cut off"]


def test_a_flipped_byte_is_told_and_stops_the_query(spark, tmp_path):
    path = f"{tmp_path}/a"
    warc.write_archives(pages(spark, [(k, f"page {k} " * 50) for k in range(30)]).coalesce(1), path)
    raw = bytearray(spark.read.format("binaryFile").load(path).first()["content"])
    raw[len(raw) // 2] ^= 0x55
    got = read(spark, tmp_path / "a", flipped=bytes(raw))["flipped"]
    assert any(r["problem"] for r in got)


def test_empty_table_and_other_id_types(spark):
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0
    df = spark.createDataFrame([("b", BIG), ("a", BIG)], "page_id string, html string").withColumn("url", F.lit(None).cast("string"))
    assert [t[:3] for t in told(warc.round_trip(df))] == [("a", "revisit", "b"), ("b", "response", None)]
