import base64
import gzip
import hashlib
import io
import random

import pytest

from loomgraph.llm import warc
from loomgraph.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, record_type string"


def sha(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/1", "same", "x"), (2, "http://a/2", "same", "x"), (5, None, "same", "x"), (3, "http://b/\r\nEvil: 1", "é" * 50_000, "x"), (4, "u", None, "x"), (6, "u", "", "x"), (None, "u", "none", "x"), (7, "r", "twice", "x"), (7, "r", "twice", "x")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    archives = warc.write_warc(pages, scratch_path(spark, "t"))
    got = warc.read_warc(archives).collect()
    assert len(got) == 9 and all(r.gap is None for r in got)
    by = {r.record_id: r for r in got}
    assert by["5"].type == "response" and by["1"].type == by["2"].type == "revisit" and by["1"].refers_to == "5" and by["1"].payload_bytes == 4
    assert by["3"].payload.decode() == "é" * 50_000 and by["3"].digest == "sha1:" + sha(by["3"].payload)
    assert by["6"].type == "response" and by["4"].refers_to == "6" and by["4"].digest == "sha1:" + sha(b"")
    assert by[None].payload == b"none"
    assert sorted(r.type for r in got if r.record_id == "7") == ["response", "revisit"]


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(1, "u", "x", ""), (2, "u", "x", ""), (3, "u", "long enough", ""), (4, "u", "long enough", "")], SCHEMA)
    got = {r.record_id: r.type for r in warc.read_warc(warc.write_warc(pages, scratch_path(spark, "t"), at_least=5)).collect()}
    assert got == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_empty(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert warc.read_warc(warc.write_warc(pages, scratch_path(spark, "t"))).collect() == []


def test_salvage_recovers_all_other_records():
    random.seed(5)
    records = [warc.record("response", str(k), f"http://h/{k}", random.randbytes(random.choice([0, 10, 3000, 700_000]))) for k in range(40)]
    parts = [gzip.compress(r) if k % 4 else r for k, r in enumerate(records)]
    starts = [sum(map(len, parts[:k])) for k in range(40)]
    data = bytearray(b"".join(parts))
    broken = {3, 8, 9, 21, 39}
    for k in broken:
        body = len(parts[k]) - 40 if k % 4 == 0 else len(parts[k]) // 2  # a plain record's headers are covered by no digest
        data[starts[k] + min(body, len(parts[k]) - 5)] ^= 0x55
    data[0:0] = b"junk before WARC/1.1 starts"
    out = list(warc.salvage(io.BytesIO(bytes(data))))
    ids = [int(o[3]["warc-record-id"][10:-1]) for o in out if o[0] == "record"]
    assert set(ids) >= set(range(40)) - broken and len(ids) == len(set(ids))
    assert out[0][:3] == ("gap", 0, 27)
    assert [o[1] for o in out[1:]] == [o[2] for o in out[:-1]] and out[-1][2] == len(data)  # every byte accounted for


def test_truncated_tail():
    whole = b"".join(gzip.compress(warc.record("response", str(k), None, b"x" * 500)) for k in range(3))
    out = list(warc.salvage(io.BytesIO(whole[:-7])))
    assert [o[0] for o in out] == ["record", "record", "gap"] and "cut off" in out[-1][3]


def test_absurd_length_is_a_gap(monkeypatch):
    good = [warc.record("response", str(k), None, b"x" * 3000) for k in range(400)]
    lie = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999999999\r\n\r\n"
    data, held = lie + b"".join(good), []
    source = warc._Source.upto
    monkeypatch.setattr(warc._Source, "upto", lambda self, at: (source(self, at), held.append(len(self.data)))[0])
    out = list(warc.salvage(io.BytesIO(data)))
    assert [o[0] for o in out] == ["gap"] + ["record"] * 400 and "claims more" in out[0][3]
    assert max(held) < 8 * warc._CHUNK


def test_long_gaps_are_let_go(monkeypatch):
    held = []
    source = warc._Source.upto
    monkeypatch.setattr(warc._Source, "upto", lambda self, at: (source(self, at), held.append(len(self.data)))[0])
    whole = warc.record("response", "1", None, b"x")
    out = list(warc.salvage(io.BytesIO(whole + b"junk" * 10_000_000 + whole)))
    assert [(o[0], o[2] - o[1]) for o in out] == [("record", len(whole)), ("gap", 40_000_000), ("record", len(whole))]
    assert max(held) < 16 * warc._CHUNK


def test_decompression_bomb_is_a_gap(monkeypatch):
    monkeypatch.setattr(warc, "LARGEST", 1 << 20)
    bomb = gzip.compress(b"WARC/1.1\r\nContent-Length: 300000000\r\n\r\n" + bytes(300_000_000))
    good = gzip.compress(warc.record("response", "1", None, b"fine"))
    out = list(warc.salvage(io.BytesIO(bomb + good)))
    assert [o[0] for o in out] == ["gap", "record"] and "unpacks" in out[0][3]


def test_records_above_the_bound_are_not_written(monkeypatch):
    monkeypatch.setattr(warc, "LARGEST", 1000)
    with pytest.raises(ValueError, match="larger than"):
        warc.record("response", "1", None, b"x" * 1000)


def test_damaged_length_across_chunks():
    whole = warc.record("response", "1", None, random.Random(1).randbytes(3 * warc._CHUNK + 17))
    n = b"Content-Length: %d\r\n\r\n" % (len(whole) - whole.index(b"\r\n\r\n") - 8)
    assert n in whole
    for wrong in (1, warc._CHUNK, 3 * warc._CHUNK, 10 * warc._CHUNK):
        data = whole.replace(n, b"Content-Length: %d\r\n\r\n" % wrong, 1) + whole
        out = list(warc.salvage(io.BytesIO(data)))
        assert out[0][0] == "gap" and out[-1][0] == "record" and len(out[-1][4]) > 3 * warc._CHUNK
        assert [o[1] for o in out[1:]] == [o[2] for o in out[:-1]] and out[-1][2] == len(data)


def test_empty_identifier_is_not_null(spark):
    pages = spark.createDataFrame([("", "u", "same"), (None, "u", "same"), ("a%b>", "u", "other")], "page_id string, url string, html string")
    got = {r.record_id: (r.type, r.refers_to) for r in warc.read_warc(warc.write_warc(pages, scratch_path(spark, "t"))).collect()}
    assert got == {"": ("response", None), None: ("revisit", ""), "a%b>": ("response", None)}
