from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions import numbers as N
from newsweft.functions import salvage as V
from newsweft.functions import scoring as S
from newsweft.functions import text as T
from newsweft.functions import urls as U


def lit_id(link, **other):
    parts = {"source": "s", "title": "t", "day": "2026-01-01", **other}
    return U.article_id(F.lit(link), F.lit(parts["source"]), F.lit(parts["title"]), F.lit(parts["day"]))


def test_canonical_url(value):
    url = "HTTPS://www.Example.com:443/path/to//file/?utm_source=google&b=2&a=1#section"
    assert value(U.normalize_url(F.lit(url))) == "https://www.example.com/path/to/file?a=1&b=2"
    assert value(U.normalize_url(F.lit("http://a.b:80/?q=a+b&e=&q=1"))) == "http://a.b/?e=&q=a+b&q=1"
    assert value(U.normalize_url(F.lit("http://a.b/x?OC=1&z=%C3%A9&y=a%20b"))) == "http://a.b/x?y=a+b&z=%C3%A9"
    assert value(U.normalize_url(F.lit(""))) == ""


def test_article_id(value):
    a, b = (value(lit_id(f"https://e.org/a?utm_campaign={c}")) for c in "xy")
    assert a == b and a.startswith("a1_") and len(a) == 27
    proxy = "https://news.google.com/rss/articles/abc"
    assert value(lit_id(proxy, title="t1")) != value(lit_id(proxy, title="t2"))
    assert value(U.is_aggregator_url(F.lit(proxy)))


def test_allowed_hosts(value):
    for host, ok in (("www.bbc.co", True), ("bbc.co", True), ("notbbc.co", False), ("bbc.co.evil.com", False)):
        assert value(U.host_allowed(F.lit(host))) is ok


def test_whole_words(value):
    terms = ("war", "ai", "ban", "crypto", "crypto etf")
    for text, n in (("warning", 0), ("said", 0), ("bank", 0), ("War and war", 1), ("据AI透露", 0), ("crypto etf", 1), ("a war, an AI", 2)):
        assert value(S.keyword_hits(F.lit(text), terms)) == n, text
    assert value(S.keyword_hit_list(F.lit("AI war ai"), terms)) == ["ai", "war"]


def test_hard_numbers(value):
    for text, ok in (("Festival returns in 2026", False), ("$2B deal", True), ("up 3.5 %", True), ("3 billion", True), ("€1.5", True)):
        assert value(S.has_hard_number(F.lit(text))) is ok, text


def test_score(value):
    now = F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")

    def score(title, summary="", hours=100, source=""):
        published = now - F.make_dt_interval(hours=F.lit(hours))
        return value(S.score_importance(F.lit(title), F.lit(summary), published, F.lit(source), now))

    assert score("plain words here") == 0
    assert score("war and missile") == 6
    assert score("quiet", "market deal") == 2
    assert score("horoscope quiz") == -4
    assert score("bitcoin now") == 4
    assert score("plain words here", hours=6) == 3 and score("plain words here", hours=13) == 1
    assert score("plain words here", source="Reuters") == 2
    assert score("here's why we should") == -2
    assert score("total of 40% now") == 1
    assert score("Ukraine meets Poland again") == 1
    assert value(S.score_importance(F.lit("x y"), F.lit(""), F.lit(None).cast("timestamp_ntz"), F.lit(""), now)) == 0


def test_signal_counts_all(value):
    assert value(S.score_signal(F.lit("launch launch"), F.lit(""))) == 6
    assert value(S.score_signal(F.lit("see github.com/a/b"), F.lit(""))) == 5


def test_names_and_keywords(value):
    assert value(T.proper_nouns(F.lit("The Federal Reserve and WTO met in New York 北京时间新闻报道"))) == [
        "new york", "the federal reserve", "wto", "北京时间新闻", "报道"]
    assert value(T.title_keywords(F.lit("The Fed says AI rate cut is near"))) == ["cut", "fed", "near", "rate"]


def test_cleaning(value):
    assert value(T.clean_html(F.lit("<p>a &amp;lt; b</p> "))) == "a < b"
    assert value(T.strip_source_suffix(F.lit("Title here - Reuters"), F.lit(True))) == "Title here"
    assert value(T.strip_source_suffix(F.lit("Title here - Reuters"), F.lit(False))) == "Title here - Reuters"
    assert value(T.normalize_ws(F.lit(" a  b\n"))) == "a b"
    page = "<html><nav>x</nav><article><h1>T</h1><!-- c --><script>1</script><p>a&amp;b</p><table>t</table></article></html>"
    assert value(T.extract_main_text(F.lit(page))) == "T a&b"
    assert value(T.extract_main_text(F.lit("no article"))) == ""
    assert value(T.extract_main_text(F.lit("<body><nav>x</nav><div><p>a</p><p>b</p></div></body>"))) == "a b"
    assert value(T.extract_main_text(F.lit("<body>x<main><p>a</p></main></body>"))) == "a"
    assert value(T.leading_int(F.lit("25/30"))) == 25 and value(T.leading_int(F.lit("x"))) == 0


def test_audit_block(value):
    text = "a\n## 自我审计\nx\n## next\nb"
    assert value(T.strip_audit_block(F.lit(text))) == "a\n## next\nb"
    assert value(T.strip_audit_block(F.lit("a\n```自我审计\nx\n```\nb"))) == "a\nb"
    assert value(T.strip_audit_block(F.lit("```markdown\nbody\n```"))) == "body"
    for raw, want in (
        ("a\n### 『自我审计』：\nx\n```\ny\n## b\nc", "a\n## b\nc"), ("a\n```自我审计 v2\nx", "a"), ("a\n自我审计", "a\n自我审计"), ("自我审计\n", ""),
        ("```md\na\n```自我审计\nx\n```\n## 自我审计\ny\n##\nb\n```\n", "a\n##\nb"), ("a\n自我审计 is fine\nb", "a\n自我审计 is fine\nb"), ("", ""),
        ("```自我审计\nx\n```\n```自我审计\ny\n```\n自我审计:\nz\n## n", "## n"),
    ):
        assert value(T.strip_audit_block(F.lit(raw))) == want


def test_numbers(value):
    assert value(N.parse_numbers(F.lit("243亿美元"))) == [2.43e10]
    assert value(N.parse_numbers(F.lit("3,300人"))) == [3300.0]
    assert value(N.parse_numbers(F.lit("$40 billion and 10%"))) == [4e10, 10.0]
    assert value(N.parse_numbers(F.lit("2万亿"))) == [2e12]
    assert value(N.parse_numbers(F.lit("2万亿"), parity=True)) == [2e4]
    assert value(N.parse_numbers(F.lit("1.2.3 million in 2026"))) == []


def test_claims(value):
    claims = value(N.extract_claims(F.lit("12 people, $5 billion, 7% on May 5; 12 PEOPLE")))
    assert [(c.type, c.claim) for c in claims] == [
        (rules.CLAIM_QUANTITY, "12 people"), (rules.CLAIM_QUANTITY, "5 billion"), (rules.CLAIM_MONEY, "$5 billion"),
        (rules.CLAIM_PERCENT, "7%"), (rules.CLAIM_DATE, "May 5")]
    many = " ".join(f"{i} people" for i in range(1, 40))
    assert len(value(N.extract_claims(F.lit(many)))) == rules.CLAIMS_PER_DOC
    text = "x" * 100 + " 30% " + "y" * 100
    context = value(N.claim_context(F.lit(text), F.lit("30%"), F.lit(rules.CLAIM_PERCENT)))
    assert context == "x" * 79 + " 30% " + "y" * 79


def test_strict_numbers(value):
    same = [value(N.strict_number(F.lit(s))) for s in ("$2bn", "2 billion USD", "２ billion 美元")]
    assert {(n.digits, n.unit) for n in same} == {("2", "USD_BILLION")}
    assert value(N.strict_number(F.lit("20 亿美元"))).unit == "USD_HUNDRED_MILLION"
    assert value(N.strict_number(F.lit("2,000 people"))).digits == "2000"
    assert value(N.strict_number(F.lit("20"))).status == "not_comparable"


def test_salvage(value):
    get = lambda raw: [(d.id, d.keep, d.score) for d in value(V.salvage_decisions(F.lit(raw)))]
    assert get('[{"id":1,"keep":true,"score":8},{"id":2,"keep":false}]') == [(1, True, 8.0), (2, False, 5.0)]
    assert get('x ```json\n[{"id":1,"keep":true}]\n``` y') == [(1, True, 5.0)]
    assert get('[{"id":1,"keep":true,"score":7},{"id":2,"ke') == [(1, True, 7.0)]
    assert get("<think>[{\"id\":9}]</think> nothing") == []
    assert get('[{"id":1,"keep":true,"score":8,"reason":"uses {x} here"},{"id":2,"keep":true,"meta":{"a":1}}]') == [(1, True, 8.0), (2, True, 5.0)]
    assert get('[{"id":1,"keep":true,"meta":{"a":1}},{"id":2,"ke') == []
    assert value(V.salvage_report(F.lit("garbage"))).overall == 10.0
    report = value(V.salvage_report(F.lit('{"overall": 4.5, "issues": ["say "x" now", "b"]}')))
    assert (report.overall, report.issues) == (4.5, ['say "x" now', "b"])
    for raw, want in (
        ('{"overall": -3, "issues": [] }x', (-3.0, [])), ('{"overall": 7 "issues": []}', (7.0, [])), ('{"overall": 6.5, "n": 01, "issues": ["a" ,\n "b ", ""]}', (6.5, ["a", "b"])),
        ('{"overall": 5, "issues": ["a"b"]', (10.0, [])), ('{"issues": ["x" y"]}', (10.0, [])), ('{"overall": 2, "issues": "x" y}', (10.0, [])),
        ('{"overall": 2, "n": 01, "issues": [open]}', (2.0, ["open"])), ('{"issues": ["p", null, ""], "overall": 3}', (3.0, ["p"])),
    ):
        report = value(V.salvage_report(F.lit(raw)))
        assert (report.overall, report.issues) == want, raw
    lines = value(V.numbered_lines(F.lit('1. "abc"\n2、 def\nfoo\n3) “g”')))
    assert [(x.idx, x.text) for x in lines] == [(1, "abc"), (2, "def"), (3, "g")]


def test_notice(value):
    assert value(S.evidence_notice(F.lit(True), F.lit(False), F.lit(1))) == rules.NOTICE_CONFLICT
    assert value(S.evidence_notice(F.lit(False), F.lit(False), F.lit(1))) == rules.NOTICE_NO_FULLTEXT
    assert value(S.evidence_notice(F.lit(None).cast("boolean"), F.lit(True), F.lit(1))) == rules.NOTICE_SINGLE_SOURCE
    assert value(S.evidence_notice(F.lit(False), F.lit(True), F.lit(2))) == ""
