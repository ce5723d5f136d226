from __future__ import annotations

import base64
import hashlib
import io
from collections import defaultdict

import pytest

from tickloom.llm import arc
from tickloom.staging import new_folder


def plain(rows):
    """[(page, bytes, digest, type, refers_to)] of (page_id, url, html)."""
    of = defaultdict(list)
    for page, _, html in rows:
        if page is not None:
            of[html or ""].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        top = max(of[html or ""], default=None)
        first = top is None or top == page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture
def pages_of(spark):
    return lambda rows, n=3: spark.createDataFrame(
        [(*r, "x", 1, "y") for r in rows],
        "page_id long, url string, html string, digest string, keeper int, number string").repartition(n)


ROWS = [(1, "http://a.example/", "<p>same</p>"), (2, "http://b.example/x y\tz", "<p>same</p>"), (3, "http://c.example/é", "ünïcödé 🙂"),
        (4, None, "<p>no url</p>"), (5, "http://e.example/", None), (6, "http://f.example/", ""), (7, "", "\r\n\r\nWARC/1.0\r\n\r\n"),
        (8, "filedesc-like", "filedesc://x 0.0.0.0 20200101000000 text/plain 3\n1 0"), (9, "http://g/", "line\n" * 40_000),
        (10, "http://h/", "<p>same</p>"), (10, "http://h/", "<p>same</p>"), (None, "http://i/", "<p>same</p>"),
        (None, "http://j/", "only without number"), (None, "http://k/", "only without number"), (-4, "http://l/", "negative")]


@pytest.mark.parametrize("n", [1, 4])
def test_round_trip(pages_of, n):
    assert got(arc.archived(pages_of(ROWS, n))) == plain(ROWS)


def test_empty_table(pages_of):
    assert arc.archived(pages_of([])).count() == 0


def test_a_group_of_a_third_of_all_rows(pages_of):
    rows = [(i, f"http://x/{i}", "hot" if i % 3 == 0 else f"own {i}") for i in range(600)]
    assert got(arc.archived(pages_of(rows, 6))) == plain(rows)


def test_both_versions_and_their_header_lines():
    for version in (1, 2):
        data = arc.arc_version_block(version, "f.arc", "19970101000000") + b"\n" + arc.arc_record(version, "http://a/b c", "text/html", b"one\ntwo")
        data += b"\n" + arc.arc_record(version, "dns:a", "text/dns", b"") + b"\n"
        head, one, two = arc.read_arc(io.BytesIO(data))
        assert head.version == version and head.fields["Archive-date"] == "19970101000000"
        assert one.fields["URL"] == "http://a/b%20c" and one.body == b"one\ntwo" and one.fields["Content-type"] == "text/html"
        assert two.body == b"" and two.fields["Archive-length"] == "0"
        assert list(one.fields) == arc.FIELDS[version].split()


def test_malformed_archives():
    block = arc.arc_version_block(1, "f.arc") + b"\n"
    (_, spaced) = arc.read_arc(io.BytesIO(block + b"http://a/with some spaces 1.2.3.4 19990101 text/html 2\nok\n"))
    assert spaced.fields["URL"] == "http://a/with some spaces" and spaced.fields["IP-address"] == "1.2.3.4"
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(block + b"http://a 1.2.3.4 19990101 text/html 20\nshort")))
    with pytest.raises(ValueError):
        list(arc.read_arc(io.BytesIO(block + b"http://a text/html 2\nok")))
    with pytest.raises(ValueError):
        list(arc.read_warc(io.BytesIO(b"not an archive\r\n")))
    assert arc.iso_date("199701020304") == "1997-01-02T03:04:00Z"


def test_records_that_are_no_http(spark):
    """A legacy file with a bare document and a DNS answer becomes resources, with equal ones left alone without numbers."""
    old, new = new_folder(spark, "old"), new_folder(spark, "new")
    text = arc.arc_version_block(1, "f.arc") + b"\n" + b"\n".join(
        arc.arc_record(1, f"dns:{i}", "text/dns", b"1.2.3.4") for i in range(2))
    spark.createDataFrame([(text.decode(),)], "value string").coalesce(1).write.option("compression", "gzip").text(old)
    arc.convert(spark, old, new)
    rows = arc.warc_rows(spark, new).collect()
    assert [(r.number, r.payload_bytes, r.record_type) for r in rows] == [(None, 7, "resource")] * 2
