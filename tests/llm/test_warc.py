"""Archives: a round trip against plain rules."""

import hashlib

from pyspark.sql import functions as F

from tilespan.llm import warc

SCHEMA = "page_id long, url string, html string, key string, digest string, mark int, range string"
X = ("k", "d", 1, "r")


def pages():
    big, odd = "<p>" + "a" * 300, "é" * 60
    out = [(k, f"http://www.Site{k % 7}.example.com:80/a/{k % 9}?q=a b#f{k}", f"<html>{k % 50} " + "x" * (k % 130) + "</html>", *X) for k in range(200)]
    out += [(300 + k, "https://same.example.org/", big, *X) for k in range(60)] + [(299, None, big, *X), (None, "http://n.example/", big, *X)]
    out += [(400, "weird url \n\t|~", None, *X), (401, "", "", *X), (402, "http://a.b:8080", odd, *X), (403, "http://u@a.b:8080/x", odd, *X), (404, "http://[::1]/", "s", *X), (405, None, None, *X)]
    out += [(299, None, big, *X), (410, "http://z.z/", "tiny", *X), (411, "http://z.z/", "tiny", *X), (412, "http://long.example/", "y" * 2_000_000, *X)]
    return out


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(data)
        revisit = to is not None and (page is None or page > to)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, SCHEMA)
    directory = warc.write(frame)
    wanted = frame.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    got = warc.lookup(directory, wanted)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows)
    one = warc.lookup(directory, frame.where("page_id = 412").select(warc.url_key(F.col("url")).alias("key"), "page_id")).collect()
    assert len(one) == 1 and one[0].payload == b"y" * 2_000_000
    none = warc.lookup(directory, spark.createDataFrame([("zzz)/", 1), ("", 5)], "key string, page_id long"))
    assert none.count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 7)
    rows = pages()[:230]
    frame = spark.createDataFrame(rows, SCHEMA)
    wanted = frame.select(warc.url_key(F.col("url")).alias("key"), "page_id")
    got = warc.lookup(warc.write(frame), wanted).drop("payload")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert warc.lookup(warc.write(frame), frame.select("key", "page_id")).count() == 0


def test_keys(spark):
    urls = ["http://www.Example.com/a?b#c", "https://u:p@x.example.com:443", "http://a.b:81/c d", None, "no scheme"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/a?b", "com,example,x)/", "b,a:81)/c%20d", ")/", "no%20scheme)/"]


def test_record_is_standard():
    raw = warc.record(3, "http://a/", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")
    assert warc.parse(raw)[4] == b"hello"
