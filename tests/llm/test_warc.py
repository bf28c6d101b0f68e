"""Archives: round trip, choice of responses, and salvage of damaged bytes."""

import base64
import hashlib
import random
import uuid
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc
from ledgerloom.llm.common import shared_dir

HTML = [None, "", "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nWARC/1.1\r\nWARC-Type: x", "long " * 400_000, "<p>b</p>", None, "<p>a</p>"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h/ {k}\n" if k % 3 else None, h, "x") for k, h in enumerate(HTML)]
    rows += [(3, "http://again", "<p>a</p>", "y"), (3, "http://again", "<p>a</p>", "y"), (None, "u", "<p>b</p>", "z"), (None, None, "only here", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3), rows


def folder(spark):
    return f"{shared_dir(spark)}/warc-test-{uuid.uuid4().hex}"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, pages, compress, least):
    df, rows = pages
    to = folder(spark)
    warc.write(df, to, compress=compress, least=least, archive=700)
    got = warc.records(spark, to).collect()
    assert warc.gaps(spark, to).count() == 0 and len(got) == len(rows)
    assert len({r["record_id"] for r in got}) == len(rows)
    by_id = {r["record_id"]: r for r in got}
    payloads, responses = defaultdict(list), defaultdict(list)
    for i, _, h, _ in rows:
        payloads[(h or "").encode()].append(i)
    sha = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in payloads}
    for r in got:
        text = sha[r["payload_digest"]]
        assert r["payload_bytes"] == len(text)
        if r["type"] == "response":
            assert r["payload"] == text
            responses[text].append(r)
        else:
            to = by_id[r["headers"]["warc-refers-to"]]
            assert to["payload"] == text and to["headers"].get("page-id") == r["headers"].get("refers-to-page-id")
    for text, ids in payloads.items():
        if len(text) < least:
            assert len(responses[text]) == len(ids)
        else:
            first = min(ids, key=lambda i: (i is None, i or 0))
            assert [r["headers"].get("page-id") for r in responses[text]] == [None if first is None else str(first)]


def test_empty(spark, pages):
    to = folder(spark)
    warc.write(pages[0].limit(0), to)
    assert warc.read(spark, to).count() == 0


def plain(k, body=b"hello world"):
    sha = warc.digest_name(hashlib.sha1(body).digest())
    return (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Block-Digest: sha1:{sha}\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def member(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def found(data):
    parts = list(warc.salvage(data))
    at = 0
    for x in parts:  # records and gaps cover the bytes, but for padding
        if x["offset"] >= at:  # the first of a member's
            assert not data[at:x["offset"]].strip(b"\0\r\n")
            at = x["offset"] + x["length"]
    return [x["record_id"][5:-1] if x["kind"] == "record" else x["reason"] for x in parts], parts


@pytest.mark.parametrize("pack", [lambda x: x, member])
def test_salvage(pack):
    a, b, c = (pack(plain(k)) for k in "abc")
    assert found(a + b + c)[0] == ["a", "b", "c"]
    hurt = bytearray(b)
    hurt[-12] ^= 255
    names, parts = found(a + bytes(hurt) + c)
    assert names[0] == "a" and names[-1] == "c" and len(names) == 3
    assert (parts[1]["offset"], parts[1]["length"]) == (len(a), len(b))
    for cut in (1, len(b) // 2, len(b) - 5):  # bytes missing in front, or behind
        assert [n for n in found(a + b[cut:] + c)[0] if n in "abc"] == ["a", "c"]
        assert [n for n in found(a + b[:cut] + c)[0] if n in "abc"] == ["a", "c"]
    assert found(b"junk" + a)[0] == ["no version line", "a"]
    assert found(a + b"\0\0" + b)[0] == ["a", "b"]
    assert found(a + b[:-9])[0][0] == "a" and len(found(a + b[:-9])[0]) == 2
    assert found(b"")[0] == [] and found(b"\r\n")[0] == []


def test_salvage_inside_member_and_mixed():
    one = member(plain("a") + b"broken WARC/1.0\r\nnothing\r\n\r\n" + plain("b"))
    names, parts = found(one + plain("c") + member(plain("d")))
    assert [x for x in names if len(x) == 1] == ["a", "b", "c", "d"] and len(names) == 5
    assert parts[1]["inner"] == len(plain("a"))
    assert found(member(b"no archive") + plain("e"))[0] == ["no version line", "e"]


def test_salvage_random_damage():
    rng = random.Random(4)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(300))) for _ in range(30)]
    for pack in (member, lambda x: x):
        whole = [pack(plain(k, b)) for k, b in enumerate(bodies)]
        data, starts = bytearray(b"".join(whole)), []
        for x in whole:
            starts.append(sum(map(len, whole[:len(starts)])))
        struck = {rng.randrange(30) for _ in range(6)}
        for k in struck:
            data[starts[k] + len(whole[k]) // 2] ^= 0x55
        names = [n for n in found(bytes(data))[0] if n.isdigit()]
        assert set(map(str, range(30))) - set(names) <= set(map(str, struck))
        assert set(names) >= set(map(str, set(range(30)) - struck))


def test_reader_logs_gaps(spark, pages, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(member(plain("a")) + b"\x1f\x8b\x08lost" + member(plain("b")))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [r["kind"] for r in got] == ["record", "gap", "record"] and got[1]["length"] == 7
    assert got[0]["payload"] == b"hello world"
    assert warc.gaps(spark, f"file://{tmp_path}").columns == ["path", "offset", "length", "inner", "inner_length", "reason"]
