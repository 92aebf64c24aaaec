"""Evidence queries: sentences, facts, claims, number checks, lint, items, salvage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions import numbers as N
from newsweft.functions import salvage as V
from newsweft.functions import text as T
from newsweft.functions.scoring import evidence_notice as notice
from newsweft.operators import backfill as BF
from newsweft.operators import evidence as E
from newsweft.operators import quality as Q
from newsweft.operators.backfill import with_numbered_text
from newsweft.plans.articles import ARTICLES_SQL, articles, as_of
from newsweft.plans.q_ingest import _CLEAN, _MAIN, _WS
from newsweft.plans.q_scoring import HARD_SQL, nouns_sql
from newsweft.plans.registry import query, table

SENTENCES_SQL = (
    "list_filter(string_split(regexp_replace(" + _WS.format(x="{x}")
    + ", '([。！？.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
)


def sentences_sql(x: str) -> str:
    return SENTENCES_SQL.replace("{x}", x)


def claims_sql(x: str) -> str:
    parts = [
        f"list_transform(regexp_extract_all({x}, '{p}'), lambda c: {{'t': '{k}', 'c': c}})"
        for k, p in rules.CLAIM_PATTERNS
    ]
    return f"list_concat(list_concat({parts[0]}, {parts[1]}), list_concat({parts[2]}, {parts[3]}))"


def first_claims_sql(c: str) -> str:
    return (f"list_filter({c}, lambda c, i: list_position(list_transform({c}, lambda d: lower(d.c)), lower(c.c)) = i)"
            f"[1:{rules.CLAIMS_PER_DOC}]")


@query("split_sentences", f"""SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos
  FROM (SELECT doc_id, {sentences_sql('text')} AS s FROM documents)""")
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(E.split_sentences(F.col("text"))).alias("pos", "sentence")
    )


_CARDS = f"""c0 AS (SELECT doc_id, text, {nouns_sql('text')} AS ent, {claims_sql('text')} AS cl FROM documents),
c1 AS (SELECT *, {first_claims_sql('cl')} AS fc FROM c0),
c2 AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(fc, lambda c: c.t <> '日期'), lambda c: c.c))) AS nums,
  list_sort(list_distinct(list_transform(list_filter(fc, lambda c: c.t = '日期'), lambda c: c.c))) AS dates FROM c1),
c3 AS (SELECT *, list_concat(list_concat(ent, nums), dates) AS anchors, {sentences_sql('text')} AS sents FROM c2),
c4 AS (SELECT *, list_filter(sents, lambda s: len(list_filter(anchors, lambda a: contains(s, a))) > 0)
  [1:{rules.FACTS_PER_CARD}] AS facts FROM c3)"""


@query("anchored_facts", f"""WITH {_CARDS}, f AS (SELECT doc_id, anchors, unnest(facts) AS s, generate_subscripts(facts, 1) AS fact_no FROM c4)
  SELECT doc_id, fact_no, substr(s, 1, {rules.EXCERPT_CHARS}) AS excerpt,
    sha256(trim(substr(s, 1, {rules.EXCERPT_CHARS}))) AS sentence_hash,
    array_to_string(list_sort(list_filter(anchors, lambda a: contains(s, a))), '|') AS anchors FROM f""")
def anchored_facts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf, "documents").select("doc_id", "text").withColumn("claims", N.extract_claims(text))
    anchors = F.concat(T.proper_nouns(text), E.claims_of(F.col("claims"), False), E.claims_of(F.col("claims"), True))
    facts = docs.withColumn("anchors", anchors).select(
        "doc_id", F.explode(E.anchored_facts(E.split_sentences(text), F.col("anchors"))).alias("f")
    )
    return facts.select("doc_id", "f.fact_no", "f.excerpt", "f.sentence_hash", F.array_join("f.anchors", "|").alias("anchors"))


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return E.build_evidence_cards(articles(spark, sf), as_of(), F.lit("2024-02-01"))


@query("evidence_cards", f"""WITH {_CARDS} SELECT doc_id AS id,
  'a1_' || substr(sha256('url:https://example.org/d/' || doc_id), 1, 24) AS article_id, len(facts) AS fact_count,
  len(ent) + len(nums) + len(dates) AS anchor_count, len(dates) = 0 AS no_date, 1 AS sources,
  sha256({_WS.format(x='text')}) AS content_sha256 FROM c4""")
def evidence_cards(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("card")
    return cards(spark, sf).select(
        "id", "article_id", c["coverage"]["fact_count"].alias("fact_count"),
        c["coverage"]["anchor_count"].alias("anchor_count"),
        F.array_contains(c["unknowns"], rules.UNKNOWN_NO_DATE).alias("no_date"),
        F.size(c["sources"]).alias("sources"), c["sources"][0]["content_sha256"].alias("content_sha256"),
    )


@query("card_problems", f"""WITH {_CARDS} SELECT doc_id AS id, array_to_string(list_filter(list_concat(
    [CASE WHEN doc_id % 5 = 0 THEN 'version must be 1' END, CASE WHEN doc_id % 7 = 0 THEN 'missing article_id' END],
    list_transform(list_filter(range(1, len(facts) + 1), lambda i: (doc_id + i) % 4 = 0), lambda i: 'fact f' || i || ' missing source_id')),
    lambda p: p IS NOT NULL), ';') AS problems FROM c4""")
def card_problems(spark: SparkSession, sf: str) -> DataFrame:
    damaged = cards(spark, sf).withColumn("card", F.struct(
        F.when(F.col("id") % 5 == 0, 2).otherwise(1).alias("version"),
        F.when(F.col("id") % 7 == 0, "").otherwise(F.col("article_id")).alias("article_id"),
        F.transform("card.confirmed_facts", lambda f, i: f.withField(
            "source_id", F.when((F.col("id") + i + 1) % 4 == 0, "").otherwise(f["source_id"]))).alias("confirmed_facts"),
    ))
    return damaged.select("id", F.array_join(E.card_problems(F.col("card")), ";").alias("problems"))


@query("evidence_notice", f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{rules.NOTICE_CONFLICT}'
  WHEN n_chars < 100 THEN '{rules.NOTICE_NO_FULLTEXT}' WHEN doc_id % 3 < 1 THEN '{rules.NOTICE_SINGLE_SOURCE}' ELSE '' END AS notice
  FROM documents""")
def evidence_notice(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", notice(
        F.col("doc_id") % 9 == 0, F.col("n_chars") >= 100, F.col("doc_id") % 3 + 1
    ).alias("notice"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders told as short reports with figures; a month is a run."""
    s = lambda c: F.col(c).cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("run"),
        F.concat(
            F.lit("Order "), s("o_orderkey"), F.lit(": $"),
            F.format_number(F.floor("o_totalprice"), 0), F.lit(" million for "), s("o_custkey"),
            F.lit(" people, up "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit("% on March "),
            F.dayofmonth("o_orderdate").cast("string"), F.lit(". Priority "), F.col("o_orderpriority"),
        ).alias("text"),
    )


NOTES_SQL = """notes AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS run, 'Order ' || o_orderkey || ': $' ||
  format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' million for ' || o_custkey || ' people, up ' ||
  (o_orderkey % 90 + 1) || '% on March ' || day(o_orderdate) || '. Priority ' || o_orderpriority AS text FROM orders)"""
_NOTE_CLAIMS = f"""{NOTES_SQL}, n0 AS (SELECT *, {claims_sql('text')} AS cl FROM notes),
  n1 AS (SELECT *, {first_claims_sql('cl')} AS fc FROM n0)"""


@query("extract_claims", f"""WITH {_NOTE_CLAIMS} SELECT o_orderkey,
  array_to_string(list_transform(fc, lambda c: c.t || '=' || c.c), '|') AS claims FROM n1""")
def extract_claims(spark: SparkSession, sf: str) -> DataFrame:
    claims = F.transform(N.extract_claims(F.col("text")), lambda c: F.concat(c["type"], F.lit("="), c["claim"]))
    return notes(spark, sf).select("o_orderkey", F.array_join(claims, "|").alias("claims"))


@query("extract_claims_docs", f"""WITH {_CARDS} SELECT doc_id,
  array_to_string(list_transform(fc, lambda c: c.t || '=' || c.c), '|') AS claims FROM c4""")
def extract_claims_docs(spark: SparkSession, sf: str) -> DataFrame:
    claims = F.transform(N.extract_claims(F.col("text")), lambda c: F.concat(c["type"], F.lit("="), c["claim"]))
    return table(spark, sf, "documents").select("doc_id", F.array_join(claims, "|").alias("claims"))


_NUM = r"(?i)(?:^|[^\d.])((?:\$?\d{1,3}(?:,\d{3})*(?:\.\d+)?|\$?\d+(?:\.\d+)?)\s*(?:万亿|trillion|billion|million|thousand|亿|万|千|美元|元|人|架|%|percent))"
_VALUE = """list_transform(regexp_extract_all(text, '%s', 1), lambda h:
  CAST(replace(replace(regexp_extract(h, '^[$0-9,.]+'), ',', ''), '$', '') AS DOUBLE) *
  CASE WHEN h LIKE '%%million' THEN 1e6 WHEN h LIKE '%%thousand' THEN 1e3 ELSE 1 END)""" % _NUM


@query("parse_numbers", f"""WITH {NOTES_SQL} SELECT o_orderkey, array_to_string(list_transform(
  {_VALUE}, lambda v: CAST(v AS BIGINT)), ',') AS numbers FROM notes""")
def parse_numbers(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform(N.parse_numbers(F.col("text")), lambda v: v.cast("bigint").cast("string"))
    return notes(spark, sf).select("o_orderkey", F.array_join(values, ",").alias("numbers"))


@query("number_conflicts", f"""WITH {_NOTE_CLAIMS},
  c AS (SELECT run, 'Order ' || o_orderkey AS article, u.t AS type, u.c AS claim, o_orderkey * 16 + i AS ord,
    try_cast(replace(regexp_extract(u.c, '[\\d,]+\\.?\\d*'), ',', '') AS DOUBLE) AS v
    FROM (SELECT run, o_orderkey, unnest(fc) AS u, generate_subscripts(fc, 1) AS i FROM n1)),
  k AS (SELECT run, type, min(ord) AS kind_ord FROM c GROUP BY ALL)
  SELECT a.run, row_number() OVER (PARTITION BY a.run ORDER BY kind_ord, a.ord, b.ord) AS no, a.type,
    a.article AS article_a, a.claim AS claim_a, b.article AS article_b, b.claim AS claim_b
  FROM c a JOIN c b ON a.run = b.run AND a.type = b.type AND a.ord < b.ord AND a.article <> b.article
  JOIN k ON k.run = a.run AND k.type = a.type
  WHERE a.type <> '日期' AND a.v > 0 AND b.v > 0 AND greatest(a.v, b.v) / least(a.v, b.v) > {rules.CONFLICT_RATIO}
  QUALIFY no <= {rules.CONFLICTS_SHOWN}""")
def number_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    claims = notes(spark, sf).select(
        "run", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("article"), "o_orderkey",
        F.posexplode(N.extract_claims(F.col("text"))).alias("i", "c"),
    ).select("run", "article", (F.col("o_orderkey") * 16 + F.col("i") + 1).alias("ord"), "c.type", "c.claim")
    return Q.number_conflicts(claims, "run")


def drafts_and_cards(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Drafts list the quantities of an order's lines, cards those that were not returned."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("article_id"), F.date_format("o_orderdate", "yyyy-MM").alias("run"), "o_orderstatus"
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), "l_returnflag",
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" million")).alias("n"),
    )
    per_order = lines.groupBy("article_id").agg(
        F.array_sort(F.collect_list("n")).alias("all_numbers"),
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("n")))).alias("numbers"),
    ).join(orders, "article_id")
    items = per_order.filter("o_orderstatus <> 'P'").select("run", "article_id", F.array_join("all_numbers", ", ").alias("content"))
    known = per_order.filter("article_id % 10 <> 3").select("run", "article_id", "numbers")
    return items, known


_CHECKED = """po AS (SELECT o_orderkey AS article_id, strftime(o_orderdate, '%Y-%m') AS run, o_orderstatus,
    list(l_quantity::INTEGER) AS qs, list(l_quantity::INTEGER) FILTER (WHERE l_returnflag <> 'R') AS es
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
checked AS (SELECT run, article_id, o_orderstatus <> 'P' AS has_item, article_id % 10 <> 3 AS has_card,
  CASE WHEN o_orderstatus <> 'P' AND article_id % 10 <> 3 THEN
    list_sort(list_filter(qs, lambda q: NOT list_contains(coalesce(es, []), q))) ELSE [] END AS bad
  FROM po WHERE o_orderstatus <> 'P' OR article_id % 10 <> 3)"""


def checked(spark: SparkSession, sf: str) -> DataFrame:
    return Q.check_items(*drafts_and_cards(spark, sf), ["run", "article_id"])


@query("unsupported_numbers", f"""WITH {_CHECKED} SELECT run, article_id, has_item, has_card,
  array_to_string(list_transform(bad, lambda b: b * 1000000), ',') AS unsupported FROM checked""")
def unsupported_numbers(spark: SparkSession, sf: str) -> DataFrame:
    values = F.array_join(F.transform(F.array_sort("unsupported"), lambda v: v.cast("bigint").cast("string")), ",")
    return checked(spark, sf).withColumn("unsupported", values)


REPORT_SQL = f"""{_CHECKED}, report AS (SELECT run, count(*) FILTER (WHERE has_item) AS total_items,
  count(*) FILTER (WHERE has_item AND len(bad) > 0) AS items_with_unsupported_numbers,
  count(*) FILTER (WHERE has_item AND NOT has_card) AS items_with_missing_evidence,
  count(*) FILTER (WHERE has_card AND NOT has_item) AS unmatched_evidence FROM checked GROUP BY run)"""


def report(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_report(checked(spark, sf), "run")


@query("quality_report", f"""WITH {REPORT_SQL} SELECT *, items_with_missing_evidence = 0 AND unmatched_evidence = 0 AS validation_complete,
  CASE WHEN total_items > 0 THEN items_with_unsupported_numbers / total_items ELSE 0 END::DOUBLE AS unsupported_ratio FROM report""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark, sf)


@query("quality_window", f"""WITH {REPORT_SQL} SELECT substr(run, 1, 4) AS year, count(*) AS window_reports,
  sum(total_items)::BIGINT AS total_items, sum(items_with_unsupported_numbers)::BIGINT AS total_unsupported,
  sum(items_with_unsupported_numbers) / sum(total_items) AS overall_unsupported_ratio FROM report GROUP BY 1""")
def quality_window(spark: SparkSession, sf: str) -> DataFrame:
    return Q.quality_window(report(spark, sf).withColumn("year", F.substring("run", 1, 4)), ["year"])


@query("strict_number_match", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' || (o_orderkey % 9) WHEN 1 THEN '' || (o_orderkey % 9)
    WHEN 2 THEN '' || (o_orderkey % 9) WHEN 3 THEN CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE '0.' || (o_orderkey % 9) END
    WHEN 5 THEN '2' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') END AS digits,
  CASE o_orderkey % 6 WHEN 0 THEN 'USD_BILLION' WHEN 1 THEN 'USD_BILLION' WHEN 2 THEN 'USD_HUNDRED_MILLION' WHEN 3 THEN 'PERCENT'
    WHEN 5 THEN 'PEOPLE' END AS unit, CASE WHEN o_orderkey % 6 = 4 THEN 'not_comparable' ELSE 'ok' END AS status FROM orders""")
def strict_number_match(spark: SparkSession, sf: str) -> DataFrame:
    k, small = F.col("o_orderkey"), (F.col("o_orderkey") % 9).cast("string")
    surface = (
        F.when(k % 6 == 0, F.concat(F.lit("$"), small, F.lit("bn")))
        .when(k % 6 == 1, F.concat(small, F.lit(" billion USD")))
        .when(k % 6 == 2, F.concat(small, F.lit(" 亿美元")))
        .when(k % 6 == 3, F.concat(F.lit("0."), small, F.lit("0%")))
        .when(k % 6 == 4, k.cast("string"))
        .otherwise(F.concat(F.lit("2,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(" people")))
    )
    return table(spark, sf, "orders").select("o_orderkey", N.strict_number(surface).alias("n")).select("o_orderkey", "n.*")


_FACTS = f"len(regexp_extract_all(text, '(?i){rules.HARD_NUMBER}')) + len({nouns_sql('text')})"


@query("density_floor", f"""SELECT doc_id, length(text) < {rules.DENSITY_MIN_CHARS} OR {_FACTS} < {rules.DENSITY_MIN_FACTS} AS thin
  FROM documents""")
def density_floor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", Q.is_thin(F.col("text")).alias("thin"))


_LINT_TEXT = """text || CASE doc_id % 4 WHEN 0 THEN ' 2024年3月5日' WHEN 1 THEN ' 2023年1月1日' WHEN 2 THEN ' 2024年13月1日' ELSE '' END
  || repeat('据官员透露，', doc_id % 5) || repeat('专家认为', doc_id % 4) || repeat('📰 来源：x ', doc_id % 12) || repeat('📈', doc_id % 7)
  || CASE WHEN doc_id % 3 = 0 THEN '自我审计' ELSE '' END || CASE WHEN doc_id % 8 = 0 THEN ' 123,456,789 ' ELSE '' END"""


@query("lint_text", f"""WITH l AS (SELECT doc_id, {_LINT_TEXT} AS t FROM documents),
  m AS (SELECT *, len(regexp_extract_all(t, '📰\\s*来源')) AS cites, len(regexp_extract_all(t, '📈')) AS prog FROM l)
  SELECT doc_id, array_to_string(list_filter([
    CASE WHEN contains(t, '2024年3月5日') THEN 'future_date' END,
    CASE WHEN regexp_matches(t, '\\b\\d{{3,}}(?:,\\d{{3}}){{2,}}\\b') THEN 'too_precise' END,
    CASE WHEN len(regexp_extract_all(t, '据[^，。]+透露')) >= 3 THEN 'vague:据XX透露' END,
    CASE WHEN len(regexp_extract_all(t, '专家(?:分析|认为|指出)')) >= 3 THEN 'vague:专家分析' END,
    CASE WHEN len(regexp_extract_all(t, '据悉[^，。]{{10,}}')) >= 3 THEN 'vague:据悉' END,
    CASE WHEN NOT contains(t, '自我审计') THEN 'no_audit' END, CASE WHEN cites < 8 THEN 'few_citations' END,
    CASE WHEN prog / greatest(cites, 1) > 0.5 THEN 'mostly_progress' END], lambda x: x IS NOT NULL), ',') AS codes FROM m""")
def lint_text(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    rep = lambda s, n: F.repeat(F.lit(s), (d % n).cast("int"))
    text = F.concat(
        F.col("text"),
        F.when(d % 4 == 0, " 2024年3月5日").when(d % 4 == 1, " 2023年1月1日").when(d % 4 == 2, " 2024年13月1日").otherwise(""),
        rep("据官员透露，", 5), rep("专家认为", 4), rep("📰 来源：x ", 12), rep("📈", 7),
        F.when(d % 3 == 0, "自我审计").otherwise(""), F.when(d % 8 == 0, " 123,456,789 ").otherwise(""),
    )
    codes = Q.lint_text(text, F.lit("2024-02-01").cast("date"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(codes, ",").alias("codes"))


def marked(text: Column) -> Column:
    """A text with an item mark at each line that starts with an ASCII word, and headings."""
    out = F.regexp_replace(text, r"\n([A-Za-z]+)", "\n<!-- article_id:$1 -->\n$1")
    return F.regexp_replace(out, r"(?m)^((?:The|La|Der|El|Of) )", "## $1")


MARKED_SQL = """regexp_replace(regexp_replace({x}, '\\n([A-Za-z]+)', chr(10) || '<!-- article_id:\\1 -->' || chr(10) || '\\1', 'g'),
  '(?m)^((?:The|La|Der|El|Of) )', '## \\1', 'g')"""


@query("parse_items", f"""WITH m AS (SELECT doc_id, string_split({MARKED_SQL.format(x='text')}, '<!-- article_id:')[2:] AS ps FROM documents),
  p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM m)
  SELECT doc_id, pos, trim(split_part(p, '-->', 1)) AS article_id,
    regexp_replace(string_split_regex(regexp_replace(substr(p, strpos(p, '-->') + 3), '^\\s+|\\s+$', '', 'g'), '(?m)^##\\s')[1], '\\s+$', '') AS content
  FROM p""")
def parse_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(Q.parse_items(marked(F.col("text")))).alias("pos", "i")
    ).select("doc_id", "pos", "i.article_id", "i.content")


@query("strip_item_markers", f"""SELECT doc_id, regexp_replace({MARKED_SQL.format(x='text')},
  '(?m)^[ \\t]*<!--\\s*article_id:[^>]+-->\\s*\\r?\\n?', '', 'g') AS text FROM documents""")
def strip_item_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.strip_item_markers(marked(F.col("text"))).alias("text"))


_RENDERED = """regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10)), '(?m)^((?:The|La|Der|El|In|Th)[a-z]* .*)$', '**🔥 \\1**', 'g'),
  '(?m)^((?:And|Et|Und|Con|Of)[a-z]* .*)$', '> 📰 来源：\\1', 'g')"""


@query("split_items", f"""WITH d AS (SELECT doc_id, string_split({_RENDERED}, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
  b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
  k AS (SELECT *, regexp_matches(bare, '^\\*\\*\\s*[🔥⭐🎯📈][🔥⭐🎯📈\\s]*(.+?)\\*\\*\\s*$') AS is_title FROM b),
  s AS (SELECT *, NOT is_title AND regexp_matches(bare, '📰\\s*来源') AS is_source,
    sum(is_title::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM k),
  c AS (SELECT *, coalesce(max(is_source::INTEGER) OVER (PARTITION BY doc_id, item ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM s WHERE item > 0)
  SELECT doc_id, item::BIGINT AS item,
    trim(max(regexp_extract(bare, '^\\*\\*\\s*[🔥⭐🎯📈][🔥⭐🎯📈\\s]*(.+?)\\*\\*\\s*$', 1)) FILTER (WHERE is_title)) AS title,
    regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT is_title AND NOT is_source), ''), '^\\s+|\\s+$', '', 'g') AS body,
    coalesce(max(bare) FILTER (WHERE is_source), '') AS source_line
  FROM c WHERE closed = 0 GROUP BY doc_id, item""")
def split_items(spark: SparkSession, sf: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    text = F.regexp_replace(text, r"(?m)^((?:The|La|Der|El|In|Th)[a-z]* .*)$", "**🔥 $1**")
    text = F.regexp_replace(text, r"(?m)^((?:And|Et|Und|Con|Of)[a-z]* .*)$", "> 📰 来源：$1")
    return Q.split_items(table(spark, sf, "documents").select("doc_id", text.alias("md")), ["doc_id"], "md")


@query("layout_check", """SELECT doc_id, doc_id % 9 AS kind, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'order' WHEN 2 THEN 'repeated:💻 科技与 AI'
  WHEN 3 THEN 'missing:💰 财经市场' WHEN 4 THEN 'leak' WHEN 5 THEN 'ids' WHEN 6 THEN 'labels:' || doc_id WHEN 7 THEN 'citation:' || doc_id
  ELSE 'open_fence' END AS errors FROM documents""")
def layout_check(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts built around each document, whole or damaged in one of nine ways."""
    d = F.col("doc_id")
    kind = d % 9
    mark = F.concat(F.lit("<!-- article_id:"), F.when(kind == 5, "other").otherwise(d.cast("string")), F.lit(" -->\n"))
    labels = F.when(kind == 6, "【核心事实】").otherwise("【核心事实】【深层逻辑】【后市/影响】")
    cite = F.when(kind == 7, "\n").otherwise("\n> 📰 来源：x（https://example.org/）\n")
    item = F.concat(mark, F.lit("**🔥 t**\n"), labels, F.col("text"), cite)
    world, tech, money = F.lit("## 🌍 国际要闻\n"), F.lit("## 💻 科技与 AI\n"), F.lit("## 💰 财经市场\n")
    text = F.concat(
        F.when(kind == 1, tech).otherwise(world), item,
        F.when(kind == 1, world).when(kind == 2, F.concat(tech, tech)).otherwise(tech),
        F.when(kind == 3, F.lit("")).otherwise(money),
        F.when(kind == 4, "自我审计\n").when(kind == 8, "```\n").otherwise(""),
    )
    errors = Q.layout_errors(text, F.array(d.cast("string")))
    return table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.array_join(errors, ",").alias("errors"))


_OLD = "'<!-- article_id:a' || doc_id || ' -->' || chr(10) || text || chr(10) || '> 📰 来源：s（https://x.org/' || doc_id || '）'"
_NEW = f"""CASE doc_id % 5 WHEN 0 THEN {_OLD} WHEN 1 THEN '<!-- article_id:a' || doc_id || ' -->' || chr(10) || '> 📰 来源：s（https://x.org/' || doc_id || '）'
  WHEN 2 THEN replace({_OLD}, 'article_id:a', 'article_id:b') WHEN 3 THEN replace({_OLD}, '> 📰 来源', '> 来源') ELSE {_OLD} || ' more' END"""


@query("accept_rewrite", f"""WITH v AS (SELECT doc_id, {_OLD} AS a, {_NEW} AS b FROM documents)
  SELECT doc_id, regexp_extract_all(a, '<!--\\s*article_id:([^>\\s]+)\\s*-->', 1) = regexp_extract_all(b, '<!--\\s*article_id:([^>\\s]+)\\s*-->', 1)
    AND regexp_extract_all(a, '(?m)^>\\s*📰\\s*来源[^\\n]*') = regexp_extract_all(b, '(?m)^>\\s*📰\\s*来源[^\\n]*')
    AND length(b) >= length(a) * 0.7::DOUBLE AND doc_id % 3 <= doc_id % 2 + 1 AS accepted FROM v""")
def accept_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    d, k = F.col("doc_id"), F.col("doc_id") % 5
    head = F.concat(F.lit("<!-- article_id:a"), d.cast("string"), F.lit(" -->\n"))
    cite = F.concat(F.lit("> 📰 来源：s（https://x.org/"), d.cast("string"), F.lit("）"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(head, F.col("text"), F.lit("\n"), cite).alias("a"), head.alias("h"), cite.alias("c"))
    new = (
        F.when(k == 0, F.col("a")).when(k == 1, F.concat("h", "c"))
        .when(k == 2, F.replace("a", F.lit("article_id:a"), F.lit("article_id:b")))
        .when(k == 3, F.replace("a", F.lit("> 📰 来源"), F.lit("> 来源"))).otherwise(F.concat("a", F.lit(" more")))
    )
    return docs.select("doc_id", Q.accept_rewrite(F.col("a"), new, d % 2 + 1, d % 3).alias("accepted"))


@query("citation_counts", f"""SELECT doc_id, len(regexp_extract_all(t, '来源')) AS citations, len(regexp_extract_all(t, '<!--')) AS ids FROM
  (SELECT doc_id, {MARKED_SQL.format(x='text')} || repeat('📰 来源：x ', doc_id % 12) AS t FROM documents)""")
def citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(marked(F.col("text")), F.repeat(F.lit("📰 来源：x "), (F.col("doc_id") % 12).cast("int")))
    return table(spark, sf, "documents").select(
        "doc_id", Q.citation_count(text).alias("citations"), F.size(Q.item_ids(text)).alias("ids")
    )


def raw_decisions(event_id: Column, score: Column) -> Column:
    """Answers in seven shapes: a list, a fenced list, a list cut short, loose objects, braces in a reason, a nested object, other items."""
    e, nxt = event_id.cast("string"), (event_id + 1).cast("string")
    one = lambda reason: F.concat(F.lit('{"id":'), e, F.lit(',"keep":true,"score":'), score.cast("string"), F.lit(f',"reason":{reason}}}'))
    k = event_id % 7
    return (
        F.when(k == 0, F.concat(F.lit("["), one('"r"'), F.lit(',{"id":'), nxt, F.lit(',"keep":false}]')))
        .when(k == 1, F.concat(F.lit("text ```json\n["), one('"r"'), F.lit("]\n``` more")))
        .when(k == 2, F.concat(F.lit("["), one('"r"'), F.lit(',{"id":'), nxt, F.lit(',"ke')))
        .when(k == 3, F.concat(F.lit('<think>[1]</think>no list {"x":1} {"id":'), e, F.lit(',"keep":true}')))
        .when(k == 4, F.concat(F.lit("["), one('"uses {x} here"'), F.lit("]")))
        .when(k == 5, F.concat(F.lit("["), one('"r","meta":{"a":{"b":1}}'), F.lit(',{"keep":true}]')))
        .otherwise(F.concat(F.lit("["), one('"r"'), F.lit(',7,"x"]')))
    )


@query("salvage_decisions", r"""WITH e AS (SELECT event_id, event_id AS i, event_id + 1 AS j, event_id % 7 AS k, CAST(floor(value) AS BIGINT) % 10 AS s FROM events),
  o AS (SELECT *, '{"id":' || i || ',"keep":true,"score":' || s || ',"reason":' AS head FROM e),
  r AS (SELECT event_id, CASE k WHEN 0 THEN '[' || head || '"r"},{"id":' || j || ',"keep":false}]'
    WHEN 1 THEN 'text ```json' || chr(10) || '[' || head || '"r"}]' || chr(10) || '``` more'
    WHEN 2 THEN '[' || head || '"r"},{"id":' || j || ',"ke'
    WHEN 3 THEN '<think>[1]</think>no list {"x":1} {"id":' || i || ',"keep":true}'
    WHEN 4 THEN '[' || head || '"uses {x} here"}]' WHEN 5 THEN '[' || head || '"r","meta":{"a":{"b":1}}},{"keep":true}]'
    ELSE '[' || head || '"r"},7,"x"]' END AS raw FROM o),
  t AS (SELECT event_id, regexp_replace(raw, '<think>.*?</think>', '', 'gs') AS raw FROM r),
  a AS (SELECT event_id, raw, CASE WHEN regexp_matches(raw, '```(?:json)?\s*\[.*?\]\s*```', 's') THEN regexp_extract(raw, '```(?:json)?\s*(\[.*?\])\s*```', 1, 's')
    ELSE regexp_extract(raw, '\[.*\]', 0, 's') END AS arr FROM t),
  p AS (SELECT event_id, CASE WHEN json_valid(arr) THEN list_filter(CAST(arr AS JSON[]), lambda x: json_type(x) = 'OBJECT')
    ELSE list_filter([CAST(y AS JSON) FOR y IN regexp_extract_all(raw, '\{[^{}]*\}') IF json_valid(y)], lambda x: json_extract_string(x, '$.id') IS NOT NULL) END AS objs FROM a),
  d AS (SELECT event_id, unnest(objs) AS v FROM p)
  SELECT event_id, CAST(json_extract_string(v, '$.id') AS INTEGER) AS id, coalesce(CAST(json_extract_string(v, '$.keep') AS BOOLEAN), false) AS keep,
    coalesce(CAST(json_extract_string(v, '$.score') AS DOUBLE), 5) AS score, coalesce(json_extract_string(v, '$.reason'), '') AS reason FROM d""")
def salvage_decisions(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_decisions(F.col("event_id"), F.floor("value") % 10)
    return table(spark, sf, "events").select("event_id", F.explode(V.salvage_decisions(raw)).alias("d")).select("event_id", "d.*")


@query("salvage_report", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 10)::DOUBLE WHEN 1 THEN event_id % 10 + 0.5::DOUBLE
    ELSE 10::DOUBLE END AS overall, CASE event_id % 3 WHEN 0 THEN 'a|' || event_type WHEN 1 THEN 'he said "x" y|' || event_type ELSE '' END AS issues
  FROM events""")
def salvage_report(spark: SparkSession, sf: str) -> DataFrame:
    e, n = F.col("event_id"), (F.col("event_id") % 10).cast("string")
    raw = (
        F.when(e % 3 == 0, F.concat(F.lit('<think>{</think>{"overall": '), n, F.lit(', "issues": ["a","'), F.col("event_type"), F.lit('"]}')))
        .when(e % 3 == 1, F.concat(F.lit('so {"overall": '), n, F.lit('.5, "issues": ["he said "x" y", "'), F.col("event_type"), F.lit('"]}')))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf, "events").select("event_id", V.salvage_report(raw).alias("r")).select(
        "event_id", "r.overall", F.array_join("r.issues", "|").alias("issues")
    )


@query("numbered_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS idx FROM l)
  SELECT doc_id, idx::INTEGER AS idx, regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[ "“”]+|[ "“”]+$', '', 'g') AS text
  FROM u WHERE idx % 3 <> 0 AND regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[ "“”]+|[ "“”]+$', '', 'g') <> ''""")
def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two of three lines of each text numbered in two styles and read back."""
    raw = F.array_join(F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when((i + 1) % 3 == 0, F.lit("-")).otherwise(
            F.concat((i + 1).cast("string"), F.when(i % 2 == 0, ". ").otherwise("、"), F.lit('"'), x)),
    ), "\n")
    return table(spark, sf, "documents").select("doc_id", F.explode(V.numbered_lines(raw)).alias("l")).select(
        "doc_id", "l.idx", "l.text"
    )


@query("numbered_join", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text, source FROM documents)
  SELECT doc_id, coalesce(CASE WHEN regexp_matches(ls[1], '^[A-Za-z]') AND doc_id % 3 <> 0 THEN
    regexp_replace(regexp_replace(ls[1], '^\\s+|\\s+$', '', 'g'), '^[ "“”]+|[ "“”]+$', '', 'g') END, substr(text, 1, 80)) AS line
  FROM l WHERE doc_id % 5 <> 1""")
def numbered_join(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per item from a numbered answer, the head of the text where the answer has none."""
    d = F.col("doc_id")
    first = F.element_at(F.split("text", "\n", 2), 1)
    said = F.when(d % 5 == 1, F.lit("skip")).when(F.rlike(first, F.lit("^[A-Za-z]")) & (d % 3 != 0), first)
    docs = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("idx"), "text", F.concat(F.lit("1. "), said).alias("raw"))
    lines = docs.filter("raw is not null").select("doc_id", F.posexplode(V.numbered_lines(F.col("raw"))).alias("pos", "l")).select(
        "doc_id", "pos", "l.idx", "l.text"
    )
    return with_numbered_text(docs.select("doc_id", "idx", "text"), lines, ["doc_id"], "text").select("doc_id", "line")


@query("backfill_texts", f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
    {_WS.format(x=_CLEAN.format(x=_MAIN))} AS body FROM pages),
  ok AS (SELECT * FROM p WHERE body <> '' AND (host = 'example.org' OR host LIKE '%.example.org')),
  t AS (SELECT doc_id AS id FROM documents WHERE source IN ('src0', 'src1')),
  b AS (SELECT t.id, min(page_id) AS page_id FROM t JOIN ok ON ok.page_id % 50 = t.id % 50 GROUP BY t.id)
  SELECT t.id, ok.page_id AS search_rank, ok.host AS hostname, substr(ok.body, 1, 2800) AS fulltext,
    sha256(trim(substr(ok.body, 1, 2800))) AS content_sha256 FROM t LEFT JOIN b USING (id) LEFT JOIN ok ON ok.page_id = b.page_id""")
def backfill_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of reference sources, each with one of 50 searches, whose results are the pages of a residue."""
    targets = articles(spark, sf).filter("reference").select("id", "run_key", (F.col("id") % 50).alias("slot"), F.lit(None).cast("string").alias("fulltext"))
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") % 50).alias("slot"), F.col("page_id").alias("search_rank"), "url", F.lit("t").alias("title"),
        F.lit("s").alias("source"), T.extract_main_text(F.col("html")).alias("text"),
    )
    out = BF.backfill_texts(targets, pages, as_of(), domains=("example.org",), search="slot")
    return out.select("id", "backfill.search_rank", "backfill.hostname", "fulltext", "backfill.content_sha256")


@query("cited_in_corpus", """WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
  SELECT page_id, host, url FROM p WHERE url IN (SELECT url FROM p WHERE page_id % 3 <> 1)
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1""")
def cited_in_corpus(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(
        "page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.lit("t").alias("title"),
        F.col("page_id").alias("ord"),
    )
    corpus = pages.filter("page_id % 3 <> 1").select("host", F.concat(F.lit("see <"), "url", F.lit("> for more")).alias("text"))
    return Q.cited_in_corpus(pages, corpus, "host").select("page_id", "host", "url")
