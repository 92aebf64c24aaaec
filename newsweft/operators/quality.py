"""Checks of drafts against evidence, text lint, layout and rewrite acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.functions.numbers import first_number, parse_numbers
from newsweft.functions.scoring import hard_number_count
from newsweft.functions.text import proper_nouns, strip
from newsweft.session import durable

_ITEM_MARK = "<!-- article_id:"


def parse_items(markdown: Column) -> Column:
    """Items of a marked draft: array of (article_id, content).

    The content of an item ends at the next item or at the next section heading.
    """
    parts = F.split(markdown, _ITEM_MARK)
    parts = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.contains(p, F.lit("-->")))
    return F.transform(
        parts,
        lambda p: F.struct(
            strip(F.element_at(F.split(p, "-->", 2), 1)).alias("article_id"),
            F.regexp_replace(
                F.element_at(F.split(strip(F.element_at(F.split(p, "-->", 2), 2)), r"(?m)^##\s", 2), 1), r"(?U)\s+$", ""
            ).alias("content"),
        ),
    )


def split_items(docs: DataFrame, keys: Sequence[str], markdown: str) -> DataFrame:
    """Rendered items of a digest: ``keys, item, title, body, source_line``.

    An item starts at a bold line with a mark and ends at its citation line or the next title. The lines stay an array of their
    row, cut at the titles, so nothing is shuffled and rows of equal keys don't mix. A null digest has no items.
    """
    keys = list(keys)
    mark = f"[{rules.TITLE_MARKS}]"
    title_line = rf"^\*\*\s*{mark}[{rules.TITLE_MARKS}\s]*(.+?)\*\*\s*$"
    lines = F.transform(F.split(markdown, r"\r\n|\r|\n"), lambda x: F.struct(x.alias("line"), strip(x).alias("bare")))
    lines = F.transform(lines, lambda x: F.struct(
        x["line"].alias("line"), x["bare"].alias("bare"), F.rlike(x["bare"], F.lit(title_line)).alias("is_title"),
    ))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(x["is_title"], i + 1)), lambda i: i.isNotNull())
    # An item ends before the next title; the last one with the text.
    ends = F.concat(F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))), F.array(F.size("_lines") + 1))
    spans = F.filter(F.arrays_zip(F.col("_at").alias("first"), ends.alias("end")), lambda x: x["first"].isNotNull())  # none without a title
    items = F.transform(spans, lambda x: F.slice("_lines", x["first"], x["end"] - x["first"]))
    rows = docs.select(*keys, lines.alias("_lines")).select(*keys, "_lines", places.alias("_at")).select(*keys, F.posexplode(items).alias("_number", "_item"))
    source = F.array_position(F.transform("_item", lambda x: ~x["is_title"] & F.rlike(x["bare"], F.lit(rules.SOURCE_MARK))), True)
    rows = rows.withColumn("_source", source.cast("int"))
    length = F.when(F.col("_source") > 0, F.col("_source") - 2).otherwise(F.size("_item") - 1)
    return rows.select(
        *keys, (F.col("_number") + 1).cast("long").alias("item"), strip(F.regexp_extract(F.col("_item")[0]["bare"], title_line, 1)).alias("title"),
        strip(F.array_join(F.slice("_item", F.lit(2), length)["line"], "\n")).alias("body"),
        F.when(F.col("_source") > 0, F.get("_item", F.col("_source") - 1)["bare"]).otherwise("").alias("source_line"),
    )


def is_thin(body: Column) -> Column:
    """Too short, or too few figures and names."""
    facts = hard_number_count(body) + F.size(proper_nouns(body))
    return (F.length(body) < rules.DENSITY_MIN_CHARS) | (facts < rules.DENSITY_MIN_FACTS)


def unsupported(draft: Column, evidence: Column, tolerance: float = rules.NUMBER_TOLERANCE) -> Column:
    """Draft numbers without an evidence number within the tolerance; zero matches only zero."""
    return F.filter(
        draft,
        lambda d: ~F.exists(
            evidence,
            lambda e: ((e == 0) & (d == 0)) | ((e != 0) & (F.abs(d - e) < tolerance * F.abs(e))),
        ),
    )


def check_items(items: DataFrame, cards: DataFrame, keys: Sequence[str], parity: bool = False) -> DataFrame:
    """Every draft item and every unmatched card: ``keys, has_card, has_item, unsupported``.

    ``items(keys, content)``, ``cards(keys, numbers)``; numbers are compared inside the joined row.
    """
    keys = list(keys)
    drafts = items.select(*keys, parse_numbers(F.col("content"), parity).alias("draft"), F.lit(True).alias("has_item"))
    known = cards.select(
        *keys,
        F.flatten(F.transform("numbers", lambda n: parse_numbers(n, parity))).alias("evidence"),
        F.lit(True).alias("has_card"),
    )
    found = unsupported(F.col("draft"), F.coalesce("evidence", F.array().cast("array<double>")))
    return drafts.join(known, keys, "full_outer").select(
        *keys,
        F.coalesce("has_item", F.lit(False)).alias("has_item"), F.coalesce("has_card", F.lit(False)).alias("has_card"),
        F.when(F.col("has_item") & F.col("has_card"), found).otherwise(F.array().cast("array<double>")).alias("unsupported"),
    )


def quality_report(checked: DataFrame, scope: str, threshold: int = 0) -> DataFrame:
    """One row per run: totals, unsupported items, missing evidence, unmatched cards, ratio."""
    flagged = F.col("has_item") & (F.size("unsupported") > threshold)
    missing = F.col("has_item") & ~F.col("has_card")
    unmatched = F.col("has_card") & ~F.col("has_item")
    return checked.groupBy(scope).agg(
        F.count_if("has_item").alias("total_items"), F.count_if(flagged).alias("items_with_unsupported_numbers"),
        F.count_if(missing).alias("items_with_missing_evidence"), F.count_if(unmatched).alias("unmatched_evidence"),
    ).withColumn(
        "validation_complete", (F.col("items_with_missing_evidence") == 0) & (F.col("unmatched_evidence") == 0)
    ).withColumn(
        "unsupported_ratio",
        F.when(F.col("total_items") > 0, F.col("items_with_unsupported_numbers") / F.col("total_items")).otherwise(0.0),
    )


def quality_window(reports: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = reports.groupBy(*keys).agg(
        F.count("*").alias("window_reports"), F.sum("total_items").alias("total_items"),
        F.sum("items_with_unsupported_numbers").alias("total_unsupported"),
    )
    return out.withColumn(
        "overall_unsupported_ratio",
        F.when(F.col("total_items") > 0, F.col("total_unsupported") / F.col("total_items")).otherwise(0.0),
    )


def number_conflicts(claims: DataFrame, scope: str, ratio: float = rules.CONFLICT_RATIO,
                     limit: int = rules.CONFLICTS_SHOWN, parity: bool = True) -> DataFrame:
    """First conflicts of each run: two articles, one claim type, values apart by more than ``ratio``.

    ``claims(<scope>, type, article, ord, claim)``: ``article`` is the shortened title that tells
    articles apart, ``ord`` the unique position of a claim in its run. With ``parity`` the first
    numerals are compared as they stand, else the numbers with their units multiplied in.

    Pairs are not enumerated. The extremes of a run and type, each with the best of a second article, tell exactly which claims
    have a partner at all. A claim without a later partner is one of an earlier claim, so the first pairs start at one of the
    first ``2 * limit`` of these, and mostly end among the first few as well; only where they don't, later claims are looked at.
    """
    by = [scope, "type"]
    value = first_number(F.col("claim")) if parity else F.coalesce(
        F.get(parse_numbers(F.col("claim")), F.lit(0)), first_number(F.col("claim"))
    )
    # Claims are cut out of long texts, so they are stored once, with their value, and read back for each step.
    counted = (F.col("type") != rules.CLAIM_DATE) & F.col("article").isNotNull()
    claims = durable(claims.select(scope, "type", "article", "ord", "claim").withColumn("v", F.when(counted, value)))
    values = claims.filter("v > 0").select(*by, "article", "ord", "v")
    paired = values.join(_extremes(claims, by), by).filter(
        (F.when(F.col("article") != F.col("hi_by"), F.col("hi")).otherwise(F.col("hi2")) / F.col("v") > ratio)
        | (F.col("v") / F.when(F.col("article") != F.col("lo_by"), F.col("lo")).otherwise(F.col("lo2")) > ratio)
    ).select(*by, "kind_ord", "article", "ord", "v")
    first = Window.partitionBy(*by).orderBy("ord")
    near = durable(paired.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= 6 * limit))

    def is_pair(a: Column, b: Column) -> Column:
        apart = F.greatest(a["v"], b["v"]) / F.least(a["v"], b["v"]) > ratio
        return (b["ord"] > a["ord"]) & (a["article"] != b["article"]) & apart

    row = F.struct("ord", "article", "v")
    seen = near.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("near"))
    mates = F.slice(F.filter("near", lambda b: is_pair(F.col("a"), b)), 1, limit)
    # Pairs that are known of the claims before; with enough of these a claim is not needed, nor what is behind its last mate.
    before = F.coalesce(F.sum(F.size("mates")).over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = near.filter(F.col("r") <= 2 * limit).join(seen, by).withColumn("a", row).withColumn("mates", mates).withColumn(
        "before", before
    ).filter(F.col("before") < limit)
    heads = durable(heads.groupBy(*by).agg(
        F.array_sort(F.collect_list("a")).alias("heads"),
        F.when(F.bool_and(F.size("mates") == limit), F.max(F.get("mates", F.lit(limit - 1))["ord"])).alias("until"),
    ))
    # Claims with the same mates are alike; the first ones of each kind are enough.
    of = F.array_join(F.transform("heads", lambda a: F.when(is_pair(a, F.col("b")), "1").otherwise("0")), "")
    later = paired.join(heads, by).filter("until is null or ord <= until").withColumn("b", row).withColumn("of", of)
    later = later.filter(F.contains("of", F.lit("1"))).withColumn(
        "_n", F.row_number().over(Window.partitionBy(*by, "of").orderBy("ord"))
    ).filter(F.col("_n") <= limit)
    pairs = later.select(*by, "kind_ord", "b", F.explode("heads").alias("a")).filter(is_pair(F.col("a"), F.col("b")))
    kinds = F.array(*[F.lit(k) for k, _ in rules.CLAIM_PATTERNS])
    order = Window.partitionBy(scope).orderBy("kind_ord", F.array_position(kinds, F.col("type")), "a.ord", "b.ord")
    ordered = durable(pairs.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= limit).select(
        scope, "no", "type", *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("a", "b") for c in ("ord", "article")]
    ))
    shown = ordered.select(scope, F.explode(F.array("ord_a", "ord_b")).alias("ord")).distinct()
    told = durable(claims.select(scope, "ord", "claim").join(shown, [scope, "ord"]))
    for side in ("a", "b"):
        ordered = ordered.join(told.withColumnsRenamed({"ord": f"ord_{side}", "claim": f"claim_{side}"}), [scope, f"ord_{side}"])
    return ordered.select(scope, "no", "type", "article_a", "claim_a", "article_b", "claim_b")


def _extremes(claims: DataFrame, by: list[str]) -> DataFrame:
    """Per group: first place, greatest and least value, an article that has each, and the best of the other articles.

    Every step sums up to one row a group before it shuffles, and is stored, so its true size picks the join.
    """
    counted = F.when(F.col("v") > 0, F.col("v"))
    ends = durable(claims.groupBy(*by).agg(F.min("ord").alias("kind_ord"), F.max(counted).alias("hi"), F.min(counted).alias("lo")))
    values = claims.filter("v > 0").select(*by, "article", "v").join(ends, by)
    at = {side: F.when(F.col("v") == F.col(side), F.col("article")) for side in ("hi", "lo")}
    holders = durable(values.filter("v = hi or v = lo").groupBy(*by).agg(*[F.min(who).alias(f"{side}_by") for side, who in at.items()]))
    others = durable(values.join(holders, by).groupBy(*by).agg(
        F.max(F.when(F.col("article") != F.col("hi_by"), F.col("v"))).alias("hi2"),
        F.min(F.when(F.col("article") != F.col("lo_by"), F.col("v"))).alias("lo2"),
    ))
    return durable(ends.join(holders, by).join(others, by))


def lint_text(text: Column, as_of_day: Column, min_citations: int = 8) -> Column:
    """Codes of what looks wrong in a finished text."""
    dates = F.transform(
        F.regexp_extract_all(text, F.lit(r"20\d{2}年\d{1,2}月\d{1,2}日"), F.lit(0)),
        lambda d: F.try_to_date(
            F.concat_ws(
                "-", F.regexp_extract(d, r"^(\d+)年", 1), F.lpad(F.regexp_extract(d, r"年(\d+)月", 1), 2, "0"),
                F.lpad(F.regexp_extract(d, r"月(\d+)日", 1), 2, "0"),
            ), "yyyy-MM-dd",
        ),
    )
    citations = F.size(F.regexp_extract_all(text, F.lit(rules.SOURCE_MARK), F.lit(0)))
    progress = F.size(F.regexp_extract_all(text, F.lit(rules.PROGRESS_MARK), F.lit(0)))
    vague = [
        F.when(F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))) >= 3, f"vague:{name}")
        for name, p in rules.VAGUE_PATTERNS
    ]
    return F.array_compact(F.array(
        F.when(F.exists(dates, lambda d: F.coalesce(d > F.date_add(as_of_day, 1), F.lit(False))), "future_date"),
        F.when(F.rlike(text, F.lit(r"\b\d{3,}(?:,\d{3}){2,}\b")), "too_precise"),
        *vague,
        F.when(~F.contains(text, F.lit(rules.AUDIT_WORD)), "no_audit"),
        F.when(citations < min_citations, "few_citations"),
        F.when(progress / F.greatest(citations, F.lit(1)) > 0.5, "mostly_progress"),
    ))


def _section_pattern(name: str) -> str:
    if name == rules.EDITOR_NOTE_SECTION:
        return rf"(?m)^(?:『{name}[^\n]*』|##\s+{name}[^\n]*)"
    escaped = "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in name)
    return rf"(?m)^##\s+{escaped}[^\n]*$"


def layout_errors(markdown: Column, expected_ids: Column | None = None,
                  sections: Sequence[str] = rules.SECTION_ORDER,
                  required: Sequence[str] = rules.REQUIRED_SECTIONS) -> Column:
    """What is damaged in a draft that still carries its item ids; empty when it may be sent."""
    errors: list[Column] = []
    places = []
    for name in sections:
        pattern = _section_pattern(name)
        count = F.size(F.regexp_extract_all(markdown, F.lit(pattern), F.lit(0)))
        errors.append(F.when(count > 1, f"repeated:{name}"))
        if name in required:
            errors.append(F.when(count == 0, f"missing:{name}"))
        # Text before the first hit is as long as its place.
        places.append(F.when(count > 0, F.length(F.element_at(F.split(markdown, pattern, 2), 1))))
    found = F.array_compact(F.array(*places))
    errors.append(F.when(found != F.array_sort(found), "order"))
    errors.append(F.when(F.contains(markdown, F.lit(rules.AUDIT_WORD)) | F.contains(markdown, F.lit(rules.PLACEHOLDER)), "leak"))
    fences = F.size(F.regexp_extract_all(markdown, F.lit(r"(?m)^\s*```"), F.lit(0)))
    errors.append(F.when(fences % 2 == 1, "open_fence"))
    blocks = F.split(markdown, r"(?m)^[^\S\n]*```[^\n]*$")
    fenced = F.filter(blocks, lambda b, i: i % 2 == 1)
    errors.append(F.when(
        F.exists(fenced, lambda b: F.rlike(b, F.lit(r"(?m)^## ")) | F.contains(b, F.lit(_ITEM_MARK))), "news_in_fence"
    ))
    out = F.array_compact(F.array(*errors))
    if expected_ids is None:
        return out
    items = parse_items(markdown)
    ids = F.array_sort(F.transform(items, lambda i: i["article_id"]))
    per_item = F.flatten(F.transform(items, lambda i: F.array_compact(F.array(
        F.when(~(F.contains(i["content"], F.lit(rules.ITEM_LABELS[0])) & F.contains(i["content"], F.lit(rules.ITEM_LABELS[1]))
                 & F.contains(i["content"], F.lit(rules.ITEM_LABELS[2]))), F.concat(F.lit("labels:"), i["article_id"])),
        F.when(~F.rlike(i["content"], F.lit(r"(?m)^>\s*📰\s*来源[^\n]*https?://")), F.concat(F.lit("citation:"), i["article_id"])),
    ))))
    return F.concat(out, F.array_compact(F.array(F.when(ids != F.array_sort(expected_ids), "ids"))), per_item)


def item_ids(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"<!--\s*article_id:([^>\s]+)\s*-->"), F.lit(1))


def citation_lines(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^>\s*📰\s*来源[^\n]*"), F.lit(0))


def citation_count(markdown: Column) -> Column:
    return F.size(F.regexp_extract_all(markdown, F.lit(rules.SOURCE_MARK), F.lit(0)))


def accept_rewrite(old: Column, new: Column, old_unsupported: Column, new_unsupported: Column) -> Column:
    """A rewrite is taken only if it lost no citation, id, or much length, and gained no unsupported item."""
    ids_old, ids_new = item_ids(old), item_ids(new)
    return (
        (ids_old == ids_new)
        & (citation_count(new) >= citation_count(old))
        & ((F.size(ids_old) == 0) | (citation_lines(old) == citation_lines(new)))
        & (F.length(new) >= F.length(old) * rules.REWRITE_MIN_LENGTH)
        & (new_unsupported <= old_unsupported)
    )


def cited_in_corpus(findings: DataFrame, corpus: DataFrame, scope: str, text: str = "text", limit: int = 1) -> DataFrame:
    """Findings with URL and title whose URL occurs in the corpus of their scope, the first ones by ``ord``."""
    known = corpus.select(
        scope, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))).alias("url")
    ).distinct()
    kept = findings.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).join(
        known, [scope, "url"], "left_semi"
    )
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy(scope).orderBy("ord"))).filter(
        F.col("_r") <= limit
    ).drop("_r")
