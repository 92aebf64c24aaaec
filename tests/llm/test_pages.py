"""Pages with forms, article headers and open quotes, hosts of many templates, and records that public readers take."""

import datetime
import re
import time

import pytest

from newsweft.llm.archive import archive_pages, read_records, warc_record, write_archive
from newsweft.llm.hostpaths import Page, host_paths, main_texts

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "some words of the article " * 12 + "</p>"
LINE = ("some words of the article " * 12).strip()


def blocks(source):
    return [line for _, line in Page(source).blocks]


@pytest.mark.parametrize("source,want", [
    (f"<body><form><nav>menu</nav><div>{LONG}<p>end</p></div><div class='comments'><p>I like it</p></div></form></body>", [LINE, "end"]),
    (f"<body><article>{LONG}</article><form><p>Sign up here</p></form></body>", [LINE]),
    (f"<body><article><header><h1>Head</h1><p>by me</p></header>{LONG}</article></body>", ["Head", LINE]),
    (f"<body><header><h1>Site</h1></header><article>{LONG}</article></body>", [LINE]),
    (f"<article><header><nav><h2>m</h2></nav><div><h1>Deep <a href=x>head</a></h1></div></header>{LONG}<footer><h4>foot</h4></footer></article>", ["Deep head", LINE]),
    (f'<body><article><p class="x>open</p>{LONG}<p>last</p></article>', ["open", LINE, "last"]),
    (f"<body><article><p title='a > b'>quoted</p>{LONG}</article>", ["quoted", LINE]),
    ("<form></form>", []),
    ("", []),
])
def test_blocks(source, want):
    assert blocks(source) == want


def test_a_very_long_page():
    start = time.time()
    source = "<body><article>" + "<p class='a'>word</p>\n" * 100_000 + "</article>" + '<p class="open>x</p>' * 2
    found = blocks(source)
    assert found[:100_000] == ["word"] * 100_000 and time.time() - start < 30


def test_hosts_of_many_templates(spark):
    rows = [(k, f"http://many.example/{k}", f"<body><div class='{'abcdefghijklmnopqrstuvwxyz'[k]}'><p>{'text ' * (60 + k)}{k}</p></div><div class='side'>links</div></body>") for k in range(26)]
    docs = spark.createDataFrame(rows, PAGES)
    paths = {r.host: r.paths for r in host_paths(docs).collect()}["many.example"]
    assert {f"/body/div.{c}" for c in "abcdefghijklmnopqrstuvwxyz"} <= set(paths)
    for r in main_texts(docs).collect():
        assert r.text == "text " * (60 + r.page_id) + str(r.page_id)


def test_urls_stay_on_their_line(spark, tmp_path):
    wild = ["http://a.example/x\r\nWARC-Type: revisit\r\nWARC-Refers-To: <urn:page:5>", "http://a.example/\u2028WARC-Refers-To: <urn:page:7>", "http://a.example/\x00\x7f", None, "plain"]
    rows = [(k, url, f"page {k}") for k, url in enumerate(wild)]
    docs = spark.createDataFrame(rows, PAGES)
    for r in archive_pages(docs).collect():
        assert (r.record_type, r.refers_to) == ("response", None)
    path = str(tmp_path / "warc")
    write_archive(docs, path, written_at=datetime.datetime(2024, 2, 29, 12, 30, 1, tzinfo=datetime.UTC))
    for r in read_records(spark, path).select("page_id", warc_record().alias("record")).collect():
        head, _, rest = bytes(r.record).decode().partition("\r\n\r\n")
        lines = head.split("\r\n")
        assert lines[0] == "WARC/1.1" and len(lines) == 8
        named = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        assert named["WARC-Date"] == "2024-02-29T12:30:01Z" and rest == f"page {r.page_id}\r\n\r\n"
        url = re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), named["WARC-Target-URI"])
        assert url == (wild[r.page_id] or "")
