"""Archives written and read back, against a plain account of the pages, and damaged ones."""

import hashlib
import io
import random
from collections import Counter

import pytest

from vellum.llm import warc
from vellum.llm.common import new_path
from vellum.llm.queries import QUERIES

SCHEMA = "page_id bigint, url string, html string, digest string, size string, kept string, n string, archive string"
LONG = "<p>" + "a repeated page " * 100


def brute(rows):
    groups = {}
    for p, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((p is not None, p or 0, u is not None, u or "", p))
    out = Counter()
    for data, some in groups.items():
        some.sort()
        for k, (*_, p) in enumerate(some):
            again = len(data) >= 1000 and k < len(some) - 1
            out[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", some[-1][-1] if again else None] += 1
    return out


def odd_rows():
    rows = [(i, f"http://a/{i % 3}", LONG) for i in range(40)] + [(50, "http://b/ \r\nX: y", "short")] * 3
    rows += [(60, "http://c/", "ü" * 499 + "a"), (61, None, "ü" * 500), (62, "http://d/", "ü" * 500), (62, "http://e/", "ü" * 500), (62, "http://e/", "ü" * 500)]
    rows += [(None, None, None), (None, "http://f/", "z" * 2000), (None, "http://f/", "z" * 2000), (70, "", ""), (71, "http://g/", None)]
    rows += [(80 + i, f"http://long/{i}", f"{i}" + "\r\n\r\nWARC/1.1\r\n" * 40_000) for i in range(2)] + [(-5, "http://h/", "\0\x1f" + "é" * 3000)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + ("mine",) * 5 for r in odd_rows()], SCHEMA)


def test_pages_read_back(odd):
    assert Counter(map(tuple, warc.archived(odd).collect())) == brute(odd_rows())
    assert Counter(map(tuple, warc.archived(odd, archive=3000).collect())) == brute(odd_rows())
    assert warc.archived(odd.limit(0)).count() == 0


def test_query_and_whole_payloads(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert Counter(map(tuple, QUERIES["op11_warc"](spark, small).collect())) == brute(rows)
    folder = new_path(spark, "warc")
    found = warc.read(spark, warc.write(pages, folder), folder, payloads=True).collect()
    assert Counter((r.url, bytes(r.payload)) for r in found if r.record_type == "response") == Counter((u, h.encode()) for _, u, h in rows)
    assert len({r.record_id for r in found}) == len(found)
    assert {r.record_type for r in found} == {"response", "warcinfo"}


def test_revisits_name_a_record_that_is_there(spark, odd):
    folder = new_path(spark, "warc")
    found = warc.read(spark, warc.write(odd, folder), folder).collect()
    responses = {r.record_id: r for r in found if r.record_type == "response"}
    revisits = [r for r in found if r.record_type == "revisit"]
    assert revisits and all(responses[r.refers_to_id].payload_digest == r.payload_digest for r in revisits)


def archive(tmp_path, n=400):
    out = warc.Writer(f"file://{tmp_path}")
    for i in range(n):
        words = " ".join(f"w{random.Random(i * 100 + k).randrange(3000)}" for k in range(600))
        data = f"<html><head><title>Page {i}</title></head><body class=page><p>{words}</p></body></html>".encode()
        out.add(warc.page_record(f"urn:x-page:{i}:x", f"http://x/{i}", data, hashlib.sha1(data).hexdigest(), len(data), None))
    (done,) = out.close()
    return (tmp_path / done["archive"]).read_bytes()


def test_dictionary_comes_first_and_is_needed(tmp_path):
    data = archive(tmp_path)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    whole = list(warc.frames(io.BytesIO(data)))
    assert len(whole) == 401 and all(isinstance(x, bytes) for _, x in whole)
    without = data[8 + int.from_bytes(data[4:8], "little") :]
    assert all(isinstance(x, warc.Fault) for _, x in warc.frames(io.BytesIO(without)))
    at, last = whole[-1]
    assert warc.parsed(last)["url"] == "http://x/399" and data[at : at + 4] == warc.FRAME


def test_a_broken_frame_is_one_fault(tmp_path):
    data = bytearray(archive(tmp_path))
    places = [at for at, _ in warc.frames(io.BytesIO(bytes(data)))]
    data[places[200] + 20] ^= 0xFF
    found = list(warc.frames(io.BytesIO(bytes(data))))
    assert [isinstance(x, warc.Fault) for at, x in found if at in places] == [k == 200 for k in range(401)]
    cut = list(warc.frames(io.BytesIO(bytes(data[: places[-1] + 30]))))
    assert isinstance(cut[-1][1], warc.Fault)


GOOD = warc.page_record("urn:x-page:1:x", "http://x/", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None)
BAD = {
    "WARC/1.1": (b"WARC/1.1", b"WARC/9.1"),
    "length": (b"Content-Length: 7", b"Content-Length: 8"),
    "letters": (b"Content-Length: 7", b"Content-Length: x"),
    "payload": (b"payload", b"PAYLOAD"),
    "mandatory": (b"WARC-Date", b"WARC-Dote"),
    "twice": (b"WARC-Date", b"WARC-Type"),
    "line": (b"WARC-Date: ", b"WARC-Date "),
    "end": (b"\r\n\r\n\x00", b"\r\n\r\n\x00\x00"),
    "no http": (b"HTTP/1.1", b"HTTQ/1.1"),
    "digest": (b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha9:"),
}


@pytest.mark.parametrize("name", BAD)
def test_faults_are_found(name):
    assert warc.parsed(GOOD)["payload"] == b"payload"
    a, b = BAD[name]
    data = (GOOD + b"\x00").replace(a, b)
    with pytest.raises(warc.Fault):
        warc.parsed(data[:-1] if name != "end" else data)


def test_strict_and_lenient_reading(spark, tmp_path):
    folder = f"file://{tmp_path}"
    data = bytearray(archive(tmp_path))
    places = [at for at, _ in warc.frames(io.BytesIO(bytes(data)))]
    data[places[5] + 20] ^= 0xFF
    (tmp_path / "damaged.warc.zst").write_bytes(bytes(data))
    names = spark.createDataFrame([("damaged.warc.zst",)], "archive string")
    found = warc.read(spark, names, folder, strict=False).collect()
    assert [r.offset for r in found if r.fault] == [places[5]] and sum(r.record_type == "response" for r in found) == 399
    with pytest.raises(Exception, match="damaged.warc.zst, at"):
        warc.read(spark, names, folder).collect()
