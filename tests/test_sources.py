"""Readers and writers over small files."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from newsweft.sources import artifacts as A
from newsweft.sources import feeds

RSS = """<?xml version="1.0"?><rss><channel><title>x</title>
<item><title>First story - Reuters</title><link>https://e.org/1</link><description>&lt;b&gt;Bold&lt;/b&gt; text</description><pubDate>Tue, 02 Jun 2026 08:00:00 GMT</pubDate></item>
<item><title>Second</title><link>https://e.org/2</link><description>d</description><pubDate>bad date</pubDate></item>
<item><title> </title><link>https://e.org/3</link></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed><title>y</title>
<entry><title>Atom one</title><link href="https://a.org/1"/><summary>s</summary><updated>2026-06-02T10:00:00+02:00</updated></entry></feed>"""


def write(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_feeds(spark, tmp_path):
    write(tmp_path, "wire.xml", RSS)
    write(tmp_path, "blog.xml", ATOM)
    sources = spark.createDataFrame([("wire", "w", True, 8, 24, 0), ("blog", "t", None, 8, 72, 1)],
                                    "name string, category string, reference boolean, max_items int, window_hours int, feed_idx int")
    rows = feeds.read_feeds(spark, str(tmp_path), sources).orderBy("feed_idx", "entry_idx").collect()
    assert [(r.title, r.link) for r in rows] == [("First story", "https://e.org/1"), ("Second", "https://e.org/2"), ("Atom one", "https://a.org/1")]
    assert rows[0].summary == "Bold text" and rows[0].published == datetime(2026, 6, 2, 8)
    assert rows[1].published is None and rows[2].published == datetime(2026, 6, 2, 8)


def test_feeds_of_all_kinds(spark):
    rdf = ('<rdf:RDF xmlns:rdf="r" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d"><channel rdf:about="q"><title>c</title><items><rdf:Seq/></items></channel>'
           '<item><title>R1</title><link>http://r/1</link><dc:date>2024-01-02T00:00:00Z</dc:date></item><item><link>http://r/2</link></item><item><title>R3</title></item></rdf:RDF>')
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><link href="me" rel="self"/><entry><title>A</title><link rel="enclosure" href="e.mp3"/><link rel="alternate" type="text/html" href="http://a/1"/>'
            '<link rel="self" href="http://a/s"/></entry><entry><title>B</title><link rel="related" href="http://a/2"/></entry><entry><title>C</title><link rel="self" href="s"/></entry></feed>')
    files = spark.createDataFrame([("r", rdf), ("a", atom), ("n", "no feed <"), ("e", "")], "name string, content string")
    sources = spark.createDataFrame([(n, "en", False, 5, 24, i) for i, n in enumerate("rane")], "name string, category string, reference boolean, max_items int, window_hours int, feed_idx int")
    rows = feeds.parse_feeds(files, sources).orderBy("feed_idx", "entry_idx").collect()
    assert [(r.source, r.entry_idx, r.title, r.link) for r in rows] == [
        ("r", 0, "R1", "http://r/1"), ("r", 2, "R3", ""), ("a", 0, "A", "http://a/1"), ("a", 1, "B", "http://a/2"), ("a", 2, "C", "")]
    assert rows[0].published == datetime(2024, 1, 2)


def test_source_list(spark, tmp_path):
    write(tmp_path, "s.txt", "# comment\n\nA | https://a|b\nbroken\n | https://c\n")
    assert [tuple(r) for r in feeds.read_source_list(spark, str(tmp_path)).collect()] == [("A", "https://a|b")]


def test_notes(spark, tmp_path):
    write(tmp_path / "x", "20260701-a.md", '---\ntitle: "T: one"\nurl: https://u\nurl: https://v\n---\n## Summary\n hi\n')
    write(tmp_path, "plain.md", "no head")
    notes = {r.path.rsplit("/", 1)[1]: r.meta for r in feeds.read_notes(spark, str(tmp_path)).collect()}
    assert notes == {"20260701-a.md": {"title": "T: one", "url": "https://v"}, "plain.md": {}}


@pytest.mark.parametrize("content,keys", [
    ({"history": {"2026-06-01": ["a", "b"], "2026-06-02": ["b"]}}, {"a", "b"}), ({"links": ["x"], "ts": "2026-06-07 13:46"}, {"x"}),
    ({"repos": ["o/r"], "ts": "2026-06-07 13:46"}, {"o/r"}), ("{broken", set())])
def test_ledger(spark, tmp_path, content, keys):
    write(tmp_path, "sent.json", content if isinstance(content, str) else json.dumps(content))
    ledger = A.read_ledger(spark, str(tmp_path))
    assert {r.key for r in A.sent_keys(ledger).collect()} == keys
    days = {str(r.day) for r in A.ledger_rows(ledger).collect()}
    if isinstance(content, dict) and "links" in content:
        assert days == {"2026-06-07"}
        today = A.ledger_rows(ledger, F.lit("2026-06-09").cast("date")).collect()
        assert [r.day for r in today] == [date(2026, 6, 9)]


def test_snapshots(spark, tmp_path):
    for i, key in enumerate(["2026-06-01-AM", "2026-06-01-PM", "2026-06-02-AM", "2026-06-02-PM"]):
        write(tmp_path, f"{key}.json", json.dumps({"date": key[:10], "session": key[-2:], "reps": [{"raw_title": f"t{i}", "zh": "z", "article_id": f"a{i}"}]}))
        write(tmp_path, f"{key}-evidence.json", json.dumps({"items": []}))
    write(tmp_path, "2026-06-03-AM.json", '{"date": "2026-06-03", "reps": [{"raw_')
    rows = A.read_recent_reps(spark, str(tmp_path)).orderBy("run_key").collect()
    assert [(r.raw_title, r.article_id, r.date) for r in rows] == [("t1", "a1", "2026-06-01"), ("t2", "a2", "2026-06-02"), ("t3", "a3", "2026-06-02")]


def test_quality_reports_of_two_ages(spark, tmp_path):
    write(tmp_path, "2026-06-01-AM.json", json.dumps({"total_items": 3, "items_with_unsupported_numbers": 1}))
    write(tmp_path, "2026-06-01-PM.json", json.dumps({"total_items": 2, "validation_complete": True, "unsupported_ratio": 0.0}))
    write(tmp_path, "2026-06-02-AM.json", '{"total_items": ')
    rows = {r.run_key: r for r in A.read_json_artifacts(spark, str(tmp_path), A.QUALITY_SCHEMA).collect()}
    assert rows["2026-06-01-AM"].validation_complete is None and rows["2026-06-01-PM"].validation_complete
    assert rows["2026-06-02-AM"].artifact_status == "invalid" and rows["2026-06-01-AM"].artifact_status == "present"


def test_titles_of_digests(spark, tmp_path):
    for d in range(1, 5):
        write(tmp_path, f"2026-06-0{d}-AM.md", f"x\n**🔥⭐ Title {d}**\n**plain**\n")
    write(tmp_path, "ACTIVE_EVENTS.md", "**🔥 not a digest**")
    assert [r.title for r in A.read_archive_titles(spark, str(tmp_path)).collect()] == ["🔥⭐ Title 2", "🔥⭐ Title 3", "🔥⭐ Title 4"]


def test_partitions_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("2026-06-01-AM", 1), ("2026-06-02-AM", 2)], "run_key string, v int")
    A.write_partitions(one, path, "run_key")
    A.write_partitions(spark.createDataFrame([("2026-06-02-AM", 3)], "run_key string, v int"), path, "run_key")
    rows = A.read_partitions(spark, path)
    assert sorted((r.run_key, r.v) for r in rows.collect()) == [("2026-06-01-AM", 1), ("2026-06-02-AM", 3)]
    kept = A.within_retention(rows, F.lit("2026-06-09").cast("date"), 7)
    assert [r.run_key for r in kept.collect()] == ["2026-06-02-AM"]
    A.write_with_latest(one, str(tmp_path / "e"), "run_key")
    assert [r.v for r in spark.read.parquet(str(tmp_path / "e" / "latest")).collect()] == [2]
    for v in (1, 2):
        A.write_version(one.filter(f"v = {v}"), str(tmp_path / "a"), v)
    assert [r.v for r in A.read_version(spark, str(tmp_path / "a")).collect()] == [2]
