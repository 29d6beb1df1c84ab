import base64
import hashlib
import io

import pytest

from tidemark.llm import warc


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def brute(rows, least=0):
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        first = len(p) < least or best.get(p) in (None, i)
        out.append((i, len(p), b32(p), "response" if first else "revisit", None if first else best[p]))
    return sorted(out, key=str)


PAGES = [(i, f"http://e.org/{i % 7} x\ny", "<p>é " + "x" * (i % 11) + "</p>" if i % 5 else ("" if i % 2 else None)) for i in range(120)]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, monkeypatch, least):
    rows = [*PAGES, (500, None, "HTTP/1.1 200 OK\r\n\r\nnested\n\nWARC/1.1\r\n"), (501, "u", "z" * 3_000_000), (None, "v", "alone")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, record_type string, file int")
    got = sorted((tuple(r) for r in warc.archive_pages(df, min_bytes=least).collect()), key=str)
    assert got == brute(rows, least)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert [g[:2] for g in got] == [(1, "response"), (1, "revisit"), (2, "response")]
    assert warc.archive_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    bodies = [b"HTTP/1.0 200 OK\nA: b\n\nbody", b"no header at all", b"\n\n1 2 3 4 5\n", b""]
    data = warc.arc_head(version, "f.arc", "20010203040506")
    for b in bodies:
        data += warc.arc_record(version, b"http://a/b c", "200102", b, len(data), "f.arc", ip="1.2.3.4")
    got = list(warc.read_arc(io.BytesIO(data)))
    assert [r.content for r in got[1:]] == bodies and got[0].version == version
    out = [warc.arc_to_warc(r, "f.arc") for r in got]
    assert [w.headers["WARC-Type"] for w in out] == ["warcinfo", "response", "resource", "resource", "resource"]
    assert out[1].headers["WARC-Date"] == "2001-02-01T00:00:00Z" and out[1].headers["WARC-IP-Address"] == "1.2.3.4"
    assert out[1].headers["WARC-Payload-Digest"] == "sha1:" + b32(b"body")
    assert len({w.headers["WARC-Record-ID"] for w in out}) == 5
    back = list(warc.read_warc(io.BytesIO(b"".join(w.dump() for w in out))))
    assert [(w.headers, w.block) for w in back] == [({k: v for k, v in w.headers.items()}, w.block) for w in out]
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(data[:-3] + b"\nhttp://x 1 2\n")))


def test_url_with_blanks():
    data = b"filedesc://f 0.0.0.0 2001 text/plain 8\n1 0 own\n" + b"\nhttp://a/b c d 1.1.1.1 20010203040506 text/html 3\nabc"
    r = list(warc.read_arc(io.BytesIO(data)))[1]
    assert (r.fields["URL"], r.content) == ("http://a/b c d", b"abc")


def test_dates():
    assert warc.warc_date("20240229123456") == "2024-02-29T12:34:56Z"
    assert warc.warc_date("1999") == "1999-01-01T00:00:00Z"
    assert warc.warc_date("") == "1970-01-01T00:00:00Z"
