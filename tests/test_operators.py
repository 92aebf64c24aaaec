"""Selection, evidence, quality, sessions, events, bundle and documents on small inputs."""

import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators import backfill, bundle, chunking, evidence, events, health, ledger, quality, rollup, selection, sessions
from newsweft.rules import SelectionRules
from newsweft.session import ensure_checkpoint_dir

RULE = SelectionRules(quota={"w": 6, "t": 4, "f": 3}, floor={"w": 3, "f": 2}, required=("w", "t", "f"), default_category="w")
ROW = "run string, id long, category string, score double, ai_score double, feed_idx int, entry_idx int"


def rows_of(rnd, n, start=0):
    return [("r", start + i, rnd.choice("wtfx"), float(rnd.randint(0, 9)), float(rnd.randint(0, 9)), 0, start + i) for i in range(n)]


def repaired(selected, pool):
    """Ids after the repair: one wish per missing category, then the best rows with room up to eight."""
    def passes(rows):
        return len(rows) >= 8 and set(RULE.required) <= {r[2] for r in rows}

    taken = list(selected)
    if not passes(taken) and passes(pool):
        ranked = sorted((r for r in pool if r not in taken), key=lambda r: (-r[3], r[5], r[6]))
        absent = set(RULE.required) - {r[2] for r in taken}
        wishes = [next(r for r in ranked if r[2] == c) for c in absent if any(r[2] == c for r in ranked)]
        for r in wishes + ranked:
            room = RULE.quota.get(r[2], 0) - [t[2] for t in taken].count(r[2])
            if r not in taken and room > 0 and (r in wishes or len(taken) < 8):
                taken.append(r)
    return {r[1] for r in taken}


def test_coverage_backfill_equals_walk(spark):
    rnd = random.Random(11)
    want, selected, pools = set(), [], []
    for run in range(40):
        pool = [(f"r{run}",) + r[1:] for r in rows_of(rnd, rnd.randint(5, 30), run * 100)]
        top = []
        for c, q in RULE.quota.items():
            top += [r for r in pool if r[2] == c][: rnd.randint(0, q)]
        pools += pool
        selected += top
        want |= {(f"r{run}", i) for i in repaired(top, pool)}
    out = selection.coverage_backfill(spark.createDataFrame(selected, ROW), spark.createDataFrame(pools, ROW), "run", RULE)
    assert {(r.run, r.id) for r in out.collect()} == want


def test_quota_and_floor(spark):
    pool = [("r", i, "w", float(i), 0.0, 0, i) for i in range(10)] + [("r", 20 + i, "f", float(i), 0.0, 0, i) for i in range(4)]
    kept = [r[:4] + (5.0,) + r[5:] for r in pool if r[1] in (1, 2)]
    out = selection.quota_with_floor(spark.createDataFrame(kept, ROW), spark.createDataFrame(pool, ROW), "run", RULE)
    assert {r.id for r in out.collect()} == {1, 2, 9, 23, 22}
    rejected = spark.createDataFrame([("r", 9)], "run string, id long")
    out = selection.quota_with_floor(spark.createDataFrame(kept, ROW), spark.createDataFrame(pool, ROW), "run", RULE, rejected)
    assert {r.id for r in out.collect()} == {1, 2, 8, 23, 22}


@pytest.mark.parametrize("rising,veteran,want", [(10, 10, (3, 2)), (1, 10, (1, 4)), (10, 1, (4, 1)), (0, 3, (0, 3))])
def test_mix(spark, rising, veteran, want):
    rows = [("e", "rising", f"a{i}", 100 - i, i) for i in range(rising)] + [("e", "veteran", f"b{i}", 1000 - i, i) for i in range(veteran)]
    out = selection.select_mix(spark.createDataFrame(rows, "e string, kind string, name string, stars int, pos int"), ["e"]).collect()
    assert (sum(r.kind == "rising" for r in out), sum(r.kind == "veteran" for r in out)) == want


def test_mix_takes_a_name_once(spark):
    rows = [("e", "rising", "same", 9, 0), ("e", "veteran", "same", 9, 0), ("e", "veteran", "b", 5, 1), ("e", "veteran", "c", 4, 2), ("e", "veteran", "d", 3, 3), ("e", "veteran", "x", 2, 4)]
    out = selection.select_mix(spark.createDataFrame(rows, "e string, kind string, name string, stars int, pos int"), ["e"]).collect()
    assert sorted(r.name for r in out) == ["b", "c", "d", "same", "x"]


def test_tiers_and_heads(spark):
    rows = [("a", 50), ("a", 1200), ("a", 150), ("b", 60)]
    out = selection.best_tier(spark.createDataFrame(rows, "s string, stars int"), ["s"], "stars").collect()
    assert [(r.s, r.stars) for r in out] == [("a", 1200)]
    data = [("r", 1, "w", 9.0, None, 0, 1), ("r", 2, "w", 8.0, None, 0, 2), ("r", 3, "t", 1.0, None, 0, 3)]
    out = selection.one_per_category(spark.createDataFrame(data, ROW), "run", ("w", "t", "f"))
    assert {r.id for r in out.collect()} == {1, 2, 3}


def card_of(spark, **article):
    base = {"title": "T", "summary": "", "fulltext": "", "link": "https://e.org/a", "source": "Reuters", "category": "w"}
    df = spark.createDataFrame([{**base, **article}], "title string, summary string, fulltext string, link string, source string, category string"
                               + (", cluster_titles array<string>" if "cluster_titles" in article else ""))
    return evidence.build_evidence_cards(df, F.lit("2026-01-01 00:00:00"), F.lit("2026-01-01")).collect()[0].card


def test_cards(spark):
    text = "Output rose 12 % on May 5. Nothing here at all. The UN said 30 people left."
    card = card_of(spark, fulltext=text, cluster_titles=["A: one", "B: two"])
    assert [f.excerpt for f in card.confirmed_facts] == ["Output rose 12 % on May 5.", "The UN said 30 people left."]
    assert card.numbers == ["12 %", "30 people"] and card.dates == ["May 5"] and card.unknowns == []
    assert [s.role for s in card.sources] == ["primary", "corroboration", "corroboration"]
    assert card.sources[0].trust_tier == "major_media" and card.sources[0].content_level == "fulltext"
    assert card.coverage.has_multiple_sources and card.coverage.fact_count == 2
    bare = card_of(spark)
    assert bare.unknowns == [rules.UNKNOWN_NO_FULLTEXT, rules.UNKNOWN_NO_DATE] and bare.sources[0].content_level == "headline"


def draft(ids, cut="", end="\n"):
    items = "".join(f"<!-- article_id:{i} -->\n**🔥 t**\n【核心事实】a\n【深层逻辑】b\n【后市/影响】c\n> 📰 来源：x（https://e.org）\n" for i in ids)
    return "## 🌍 国际要闻\n" + items + "## 💻 科技与 AI\n## 💰 财经市场\n" + end


@pytest.mark.parametrize("text,code", [
    (draft(["1"]), None),
    (draft(["1"]).replace("## 💰 财经市场\n", ""), "missing:💰 财经市场"),
    (draft(["1"]) + "## 💻 科技与 AI\n", "repeated:💻 科技与 AI"),
    ("## 💰 财经市场\n" + draft(["1"]).replace("## 💰 财经市场\n", ""), "order"),
    (draft(["1"]) + "自我审计", "leak"),
    (draft(["1"]) + "```\n", "open_fence"),
    (draft(["1"]).replace("<!--", "```\n<!--").replace("e.org）\n", "e.org）\n```\n"), "news_in_fence"),
    (draft(["2"]), "ids"),
    (draft(["1", "1"]), "ids"),
    (draft(["1"]).replace("【深层逻辑】", ""), "labels:1"),
    (draft(["1"]).replace("https", "ftp"), "citation:1"),
])
def test_layout(value, text, code):
    errors = value(quality.layout_errors(F.lit(text), F.array(F.lit("1"))))
    assert errors == [] if code is None else code in errors, errors


def test_items_of_a_draft(spark, value):
    items = value(quality.parse_items(F.lit(draft(["a", "b"]))))
    assert [i.article_id for i in items] == ["a", "b"] and all("##" not in i.content for i in items)
    text = "intro\n**🔥⭐ 🎯 First**\nbody one\nbody two\n> 📰 来源：x\nloose\n**⭐ Second**\nno source\n**📈 Third**\n> 📰 来源：y"
    df = spark.createDataFrame([(1, text)], "d int, md string")
    got = [(r.title, r.body, r.source_line) for r in quality.split_items(df, ["d"], "md").orderBy("item").collect()]
    assert got == [("First", "body one\nbody two", "> 📰 来源：x"), ("Second", "no source", ""), ("Third", "", "> 📰 来源：y")]


def test_unsupported_numbers(spark):
    items = spark.createDataFrame([("r", "a", "40 billion and 10%"), ("r", "wrong", "5%")], "run string, article_id string, content string")
    cards = spark.createDataFrame([("r", "a", ["20 billion", "10%"]), ("r", "expected", [])], "run string, article_id string, numbers array<string>")
    checked = quality.check_items(items, cards, ["run", "article_id"])
    by = {r.article_id: r for r in checked.collect()}
    assert by["a"].unsupported == [4e10] and by["wrong"].unsupported == [] and not by["wrong"].has_card
    report = quality.quality_report(checked, "run").collect()[0]
    assert (report.total_items, report.items_with_unsupported_numbers, report.items_with_missing_evidence, report.unmatched_evidence) == (2, 1, 1, 1)
    assert not report.validation_complete and report.unsupported_ratio == 0.5


def test_conflicts_look_past_own_article(spark):
    rows = [("r", "百分比", "same", i, f"{10 ** (i % 2 + 1)}%") for i in range(30)] + [("r", "百分比", "other", 100, "500%")]
    df = spark.createDataFrame(rows, "run string, type string, article string, ord long, claim string")
    got = [(r.claim_a, r.article_b) for r in quality.number_conflicts(df, "run").orderBy("no").collect()]
    assert got == [(f"{10 ** (i % 2 + 1)}%", "other") for i in range(10)]


def test_conflicts_like_all_pairs(spark):
    """Few articles, many values, ties and an article without a name, against all pairs."""
    rng = random.Random(5)
    rows = [
        (run, rng.choice(["百分比", "金额"]), rng.choice(["x", "x", "x", "y", "z", None]), i, f"{rng.choice([10, 10, 11, 12, 14])}%")
        for run in (1, 2) for i in range(80)
    ] + [(3, "百分比", "x", i, f"{10 + i}%") for i in range(40)]
    df = spark.createDataFrame(rows, "run int, type string, article string, ord int, claim string")
    first = {(run, kind): min(r[3] for r in rows if r[0] == run and r[1] == kind) for run, kind, *_ in rows}
    want = []
    for run in (1, 2, 3):
        pairs = [
            (first[run, a[1]], a[3], b[3]) for a in rows for b in rows
            if a[0] == b[0] == run and a[1] == b[1] and a[3] < b[3] and a[2] and b[2] and a[2] != b[2]
            and max(int(a[4][:-1]), int(b[4][:-1])) / min(int(a[4][:-1]), int(b[4][:-1])) > 1.2
        ]
        want += [(run, i + 1, rows[80 * (run - 1) + a][4], rows[80 * (run - 1) + b][4]) for i, (_, a, b) in enumerate(sorted(pairs)[:10])]
    found = quality.number_conflicts(df, "run", ratio=1.2).collect()
    assert sorted((r.run, r.no, r.claim_a, r.claim_b) for r in found) == want


def stored_rows(spark, run) -> int:
    """Rows of the tables that ``run`` stores below the checkpoint folder."""
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("newsweft-*"))
    run()
    return sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("newsweft-*")) - before)


def test_conflicts_with_late_partners(spark):
    """Partners behind thousands of like claims, of another article only, and before the claim; claims are stored once."""
    rows = [("r", "百分比", f"a{i}", i, "10%") for i in range(3000)] + [("r", "百分比", "a0", 3000, "50%"), ("r", "百分比", "z", 3001, "90%")]
    rows += [("s", "百分比", "a", 0, "90%")] + [("s", "百分比", "b", i, "10%") for i in range(1, 3000)]
    rows += [("t", "百分比", f"a{i}", i, f"{10 + i % 4}%") for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, type string, article string, ord long, claim string")
    found = []
    stored = stored_rows(spark, lambda: found.extend(quality.number_conflicts(df, "run").orderBy("run", "no").collect()))
    got = [(r.run, r.article_a, r.claim_a, r.article_b, r.claim_b) for r in found]
    pairs = [("r", "a0", "10%", "z", "90%")]
    for i in range(1, 6):
        pairs += [("r", f"a{i}", "10%", "a0", "50%"), ("r", f"a{i}", "10%", "z", "90%")]
    assert got == pairs[:10] + [("s", "a", "90%", "b", "10%")] * 10
    assert len(rows) <= stored < len(rows) + 500


def test_issues_are_dealt_to_many_tasks(spark):
    """Few keys a task, more tasks than shuffle partitions; repeated issues count once and the rates are whole."""
    rows = [(f"2026-{i % 12 + 1:02}", i % 50, "AB"[i % 2], i) for i in range(600)] * 2
    found = rollup.unique_issues(spark.createDataFrame(rows, "run_key string, article_id long, code string, normalized_value int"))
    dealt = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 600 and len(dealt) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rates = rollup.false_alarm_rates(found, found.withColumn("false_alarm", F.col("normalized_value") % 3 == 0)).collect()
    assert {r.code: (r.reviewed, r.false_alarms) for r in rates} == {"A": (300, 100), "B": (300, 100), None: (600, 200)}


def test_lint(value):
    day = F.lit("2026-06-01").cast("date")
    ok = "自我审计" + "📰 来源：x" * 8
    assert value(quality.lint_text(F.lit(ok), day)) == []
    assert value(quality.lint_text(F.lit(ok + "2027年1月1日 123,456,789 "), day)) == ["future_date", "too_precise"]
    assert value(quality.lint_text(F.lit("📈"), day)) == ["no_audit", "few_citations", "mostly_progress"]


def test_session_rules(spark, value):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    assert value(sessions.session_of(at("2026-01-01 00:00:00"))) == "AM"
    assert value(sessions.session_of(at("2026-01-01 12:00:00"))) == "PM"
    assert value(sessions.logical_date(at("2026-01-01 18:00:00"))) == date(2026, 1, 1)
    assert value(sessions.logical_date(at("2026-01-01 21:00:00"))) == date(2026, 1, 2)
    assert value(sessions.should_skip(at("2026-01-01 02:00:00"), at("2026-01-01 00:30:00")))
    assert value(sessions.should_skip(at("2026-01-01 07:00:00"), at("2026-01-01 00:30:00")))
    assert not value(sessions.should_skip(at("2026-01-01 09:00:00"), at("2026-01-01 00:30:00")))


def number(ts):
    return int((ts + timedelta(hours=8) - datetime(1970, 1, 1, 4)).total_seconds() // 43200)


def test_gate_equals_walk(spark):
    rnd = random.Random(6)
    rows, want = [], set()
    for key in range(20):
        times = sorted({datetime(2026, 1, 1) + timedelta(minutes=rnd.randrange(60 * 24 * 6)) for _ in range(rnd.randint(1, 60))})
        rows += [(key, t) for t in times]
        last = None
        for t in times:
            if last is None or ((t - last).total_seconds() >= 3 * 3600 and number(t) != number(last)):
                want.add((key, t))
                last = t
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    assert {(r.k, r.ts) for r in sessions.session_gate(df, "k").collect()} == want


def test_month_of_triggers(spark):
    """A failed first try every fifth day leaves the gate open, a delivery closes it."""
    rows = [(0, datetime(2026, 1, d, h, m)) for d in range(1, 31) for h, m in ((0, 5), (1, 0), (3, 30)) if not (d % 5 == 0 and h == 0)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    assert sessions.session_gate(df, "k").count() == 30


def archive_row(i, title, raw, seen="2026-07-01"):
    d = date.fromisoformat(seen)
    return (f"e{i}", i, title, d, d, title, raw, ["f"], ["q"], ["s"])


ARCHIVE = ("event_id string, ord long, title string, first_seen date, latest_seen date, latest_title string, latest_raw_title string, "
           "key_facts array<string>, open_questions array<string>, sources array<string>")
BATCH = "id string, ord long, title string, zh string, prev_title string, key_facts array<string>, open_questions array<string>, sources array<string>"


def test_event_archive(spark):
    archive = spark.createDataFrame([archive_row(1, "Old zh", "Old raw"), archive_row(2, "Other", "Other raw")], ARCHIVE)
    batch = spark.createDataFrame([
        ("a", 1, "New raw", "New zh", "old ZH!", ["x", "y", "z", "w"], ["?"], []), ("b", 2, "Other RAW", None, None, [], [], []),
        ("c", 3, "Fresh", None, None, [], [], []), ("d", 4, "fresh!", None, None, ["k"], [], []), ("e", 5, "", None, "", [], [], []),
    ], BATCH)
    day = F.lit("2026-07-02")
    matches = events.match_events(batch, archive, day)
    got = {r.id: (r.event_id, r.is_update) for r in matches.collect()}
    fresh = got["c"][0]
    assert got["a"] == ("e1", True) and got["b"] == ("e2", True) and got["d"] == (fresh, True) and got["c"] == (fresh, False)
    assert fresh.startswith("evt_20260702_")
    out = {r.event_id: r for r in events.upsert_events(archive, batch, matches, day.cast("date")).collect()}
    assert out["e1"].latest_title == "New zh" and out["e1"].title == "Old zh" and out["e1"].key_facts == ["x", "y", "z"]
    assert out["e1"].first_seen == date(2026, 7, 1) and out["e1"].latest_seen == date(2026, 7, 2)
    assert out[fresh].title == "Fresh" and out[fresh].key_facts == ["k"]
    updates = events.event_updates(batch.filter("false").select(F.col("id").alias("event_id"), day.cast("date").alias("date"), F.col("id").alias("article_id"), "title", F.col("title").alias("raw_title")), batch, matches, day.cast("date"))
    assert updates.count() == 5
    old = spark.createDataFrame([archive_row(1, "a", "a", "2026-07-01")], ARCHIVE)
    assert events.active_events(old, F.lit("2026-09-01").cast("date")).count() == 0


def test_ledgers(spark):
    runs = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1)], "run_id string, count long")
    done = spark.createDataFrame([("c", "delivered", 4), ("a", "failed", 0)], "run_id string, status string, count long")
    assert {r.run_id: (r.status, r.count_) for r in ledger.deliver_once(runs, done).withColumnRenamed("count", "count_").collect()} == {
        "a": ("delivered", 2), "b": ("empty", 0), "c": ("duplicate", 4)}
    history = spark.createDataFrame([(date(2026, 1, 1), "x"), (date(2026, 1, 9), "y")], "day date, key string")
    out = ledger.append_sent(history, spark.createDataFrame([("y",), ("z",), ("z",)], "key string"), F.lit("2026-01-09").cast("date"))
    assert sorted((str(r.day), r.key) for r in out.collect()) == [("2026-01-09", "y"), ("2026-01-09", "z")]
    proposals = spark.createDataFrame([("r", "1", "c", "w", "n", [("https://x",)]), ("r", "2", " ", "w", "n", [("https://x",)])],
                                      "run string, entry_id string, claim string, when_to_use string, when_not_to_use string, evidence array<struct<url:string>>")
    row = ledger.proposal_status(proposals, "run").collect()[0]
    assert (row.proposals, row.incomplete, row.valid) == (2, 1, False)
    issues = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("k", 4, None), ("k", 5, "b")], "key string, at int, issue string")
    assert [(r["at"], r.signature) for r in ledger.issue_changes(issues, "key", "at", "issue").orderBy("at").collect()] == [(1, "a"), (3, ""), (5, "b")]


def test_metrics(spark):
    attempts = spark.createDataFrame([("a", 1, True, False, True, True), ("a", 2, True, True, True, True), ("b", 1, True, True, False, True), ("c", 1, False, True, True, True)],
                                     "run_key string, attempt int, eligible boolean, evidence_ok boolean, quality_ok boolean, marked boolean")
    row = rollup.bundle_coverage(attempts).collect()[0]
    assert (row.eligible_runs, row.covered_runs, row.coverage) == (2, 1, 0.5)
    issues = spark.createDataFrame([("r", i % 40, "c", i % 2) for i in range(400)], "run_key string, article_id int, code string, normalized_value int")
    one, two = (rollup.review_sample(issues.repartition(n)).collect() for n in (1, 7))
    assert sorted(one) == sorted(two) and len(one) == 30
    assert rollup.review_sample(issues, 1000).count() == 40


def test_weekly(spark):
    runs = spark.createDataFrame([("2026-07-01-AM", "present", "x"), ("2026-07-01-PM", "missing", "x"), ("2026-05-01-AM", "present", "x")],
                                 "run_key string, artifact_bundle_status string, delivered_at string")
    items = runs.select("run_key", F.col("run_key").alias("id"))
    out = rollup.weekly_items(runs, items, runs, runs, F.lit("2026-07-03").cast("date"))
    assert [r.run_key for r in out.collect()] == ["2026-07-01-AM"]


def bundle_row(i, title, url, source="daily", complete=True, score="5", day=1):
    return (i, date(2026, 7, day), title, url, complete, source, score, int(i[1:]))


BUNDLE = "id string, date date, title string, url string, evidence_complete boolean, source_system string, score string, pos long"


def test_bundle(spark):
    rows = [bundle_row("i1", "A wiki view", "https://E.org/a", "wiki", False), bundle_row("i2", "Daily view", "https://e.org/A "),
            bundle_row("i3", "OpenAI releases its new model today", "https://x/1", score="9/10"),
            bundle_row("i4", "OpenAI releases its new models today", "https://x/2", "radar"), bundle_row("i5", "no url", "")]
    out = bundle.dedupe_bundle(spark.createDataFrame(rows, BUNDLE), "daily").orderBy("rank").collect()
    assert [r.id for r in out] == ["i3", "i2"]
    many = [bundle_row(f"i{i}", f"title number {i} {'x' * i}", f"https://u/{i}") for i in range(9)]
    assert bundle.dedupe_bundle(spark.createDataFrame(many, BUNDLE), "daily").count() == 5


def test_previous_night(spark):
    items = spark.createDataFrame([bundle_row("i1", "a", "u", day=1)], BUNDLE)
    targets = spark.createDataFrame([(date(2026, 7, d),) for d in (1, 2, 3)], "date date")
    out = {r.date.day: r.freshness_label for r in bundle.with_previous_night(items, targets).collect()}
    assert out == {1: "today", 2: "previous_night"}


def test_context(spark):
    items = spark.createDataFrame([bundle_row("i1", "a", "https://U/1"), bundle_row("i2", "Some long headline about markets", "x"), bundle_row("i3", "none", "y")], BUNDLE)
    contexts = spark.createDataFrame([
        (date(2026, 7, 1), 1, "https://u/1", "other", "c1"), (date(2026, 6, 30), 2, "https://z", "Some long headlines about markets", "c2"),
        (date(2026, 6, 29), 3, "y", "none", "too old")], "captured date, pos int, url string, title string, summary string")
    out = {r.id: r.knowledge_context.summary if r.knowledge_context else None for r in bundle.enrich_context(items, contexts).collect()}
    assert out == {"i1": "c1", "i2": "c2", "i3": None}


def test_handoffs(spark):
    schema = "handoff_id string, schema_version int, status string, created_at string, payload string"
    old = spark.createDataFrame([("a", 2, "pending", "t0", "p0"), ("b", 3, "consumed", "t0", "p0"), ("c", 2, "pending", "t0", "p0")], schema)
    asked = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("n", "p1")], "handoff_id string, payload string")
    got = {r.handoff_id: tuple(r)[1:] for r in bundle.upsert_handoffs(old, asked, F.lit("now")).collect()}
    assert got == {"a": (3, "pending", "t0", "p1"), "b": (3, "consumed", "t0", "p0"), "c": (2, "pending", "t0", "p0"), "n": (3, "pending", "now", "p1")}


def packed(text, limit):
    weight = lambda t: len(t.encode())
    if weight(text) <= limit:
        return [text]
    messages = [""]
    for para in text.split("\n\n"):
        if messages[-1] and weight(messages[-1] + "\n\n" + para) <= limit:
            messages[-1] += "\n\n" + para
        elif weight(para) <= limit:
            messages.append(para)
        else:
            messages.append("")
            for ch in para:
                if weight(messages[-1] + ch) > limit:
                    messages.append("")
                messages[-1] += ch
            messages.append("")
    return [m for m in messages if m] or [text]


def test_chunks(spark):
    rnd = random.Random(8)
    texts = ["\n\n".join("".join(rnd.choice("ab é汉🔥") for _ in range(rnd.choice([0, 3, 10, 80]))) for _ in range(rnd.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = {r.i: (r.b, r.c) for r in df.select("i", chunking.chunk_by_bytes(F.col("t"), 40).alias("b"), chunking.chunk_by_chars(F.col("t"), 30).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert out[i][0] == packed(t, 40)
        assert all(len(c) <= 30 for c in out[i][1])
        assert "".join(out[i][1]).replace("\n\n", "") == t.replace("\n\n", "")


def test_sections(spark):
    rows = [(1, 1, "## 🌍 国际要闻\na\n（本批暂无符合该板块的候选新闻）"), (1, 2, "loose\n## 🌍 国际要闻\nb\n## 💰 财经市场\nc")]
    out = chunking.merge_sections(spark.createDataFrame(rows, "d int, part int, t string"), ["d"], "part", "t")
    assert {r.section: r.content for r in out.collect()} == {"🌍 国际要闻": "a\nb", "💰 财经市场": "c", rules.SECTION_OTHER: "loose"}


def test_health(spark):
    now = F.lit("2026-07-03 00:00:00").cast("timestamp_ntz")
    out = health.health_issues(
        spark.createDataFrame([("a", False, False), ("b", True, False), ("c", True, True)], "name string, running boolean, connected boolean"),
        spark.createDataFrame([("c", "job", "ok", "boom")], "profile string, name string, last_status string, last_error string"),
        spark.createDataFrame([("s", "Present"), ("t", None)], "name string, status string"),
        spark.createDataFrame([("p", "OK", datetime(2026, 7, 1))], "name string, status string, last_run timestamp_ntz"), now)
    assert sorted((r.code, r.source) for r in out.collect()) == [
        ("disconnected", "b"), ("job_failed", "c"), ("pipeline_stale", "p"), ("process_down", "a"), ("source_unavailable", "t")]


def test_items_are_cut_inside_their_row(spark):
    mark = rules.TITLE_MARKS[0]
    text = f"intro\r\n**{mark} One**\r\nbody\r\n> 📰 来源：x\r\nafter\r\n**{mark} Two**"
    df = spark.createDataFrame([(1, text), (1, text), (2, "no title\nat all"), (3, None), (4, "")], "d int, md string")
    out = quality.split_items(df, ["d"], "md")
    one, two = (1, 1, "One", "body", "> 📰 来源：x"), (1, 2, "Two", "", "")
    assert sorted(map(tuple, out.collect())) == [one, one, two, two]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_sections_without_lines_leave_no_trace(spark):
    rows = [(1, 1, "lead\n## A\n## B\nb1\n\nb2"), (1, 2, "## A\na1"), (1, 3, None), (1, 4, ""), (2, 1, "## B"), (1, 5, "  ## B \nb3\n## A")]
    df = spark.createDataFrame(rows, "d int, part int, t string")
    out = chunking.merge_sections(df, ["d"], "part", "t", sections=("A", "B"), placeholder="nothing new", other="rest")
    assert sorted(map(tuple, out.collect())) == [(1, "A", "a1"), (1, "B", "b1\n\nb2\nb3"), (1, "rest", "lead")]


def test_targets_of_one_search_share_its_result(spark):
    targets = spark.createDataFrame([(1, "r", "q", None), (2, "r", "q", "old"), (3, "r", "z", "own"), (4, "r", None, None)], "id int, run_key string, query string, fulltext string")
    results = spark.createDataFrame(
        [("q", 2, "https://www.reuters.com/b", "t", "s", "later"), ("q", 1, "https://www.reuters.com/a", "t", "s", "first"), ("q", 0, "https://www.reuters.com/0", "t", "s", ""), ("z", 1, "https://other.example/", "t", "s", "text")],
        "query string, search_rank int, url string, title string, source string, text string")
    out = backfill.backfill_texts(targets, results, F.lit("2026-07-03"), domains=("reuters.com",), search="query")
    assert {r.id: (r.fulltext, r.backfill and r.backfill.search_rank) for r in out.collect()} == {1: ("first", 1), 2: ("first", 1), 3: ("own", None), 4: (None, None)}
