"""Bucketed top-k, quotas with floors, coverage repair and mixes.

Every operator works per ``scope`` (a run), so any number of runs goes through one plan.
Rank filters are plain ``row_number() <= k`` so that Spark also applies them before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.rules import SelectionRules

TIE = ("feed_idx", "entry_idx")


def _limits(values: dict[str, int], category: Column) -> Column:
    """Per-category number from the rule table; null for a category it does not name."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*values.items())]), category)


def _rank(df: DataFrame, keys: Sequence[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def bucket_top_k(df: DataFrame, scope: str, rule: SelectionRules, score: str = "score") -> DataFrame:
    """The best ``quota * factor`` of each category; categories never compete.

    Rows without a category count as the default one, unknown categories are dropped.
    """
    df = df.withColumn("category", F.coalesce("category", F.lit(rule.default_category)))
    room = _limits(rule.quota, F.col("category")) * rule.factor
    most = max(rule.quota.values()) * rule.factor
    ranked = df.filter(F.col("category").isin(*rule.quota)).withColumn(
        "_r", _rank(df, [scope, "category"], F.desc(score), *TIE)
    )
    # The literal bound lets the rank filter run before the shuffle, the other one is exact.
    return ranked.filter((F.col("_r") <= most) & (F.col("_r") <= room)).drop("_r")


def apply_decisions(candidates: DataFrame, decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that any decision keeps, with the score (5 if none) and reason of the last one that does.

    ``decisions(keys, seq, keep, score, reason)``: ``seq`` is the position in the raw output.
    One row per candidate, also when a decision was repeated.
    """
    kept = decisions.filter(F.coalesce("keep", F.lit(False))).groupBy(*keys).agg(
        F.max_by(F.struct("score", "reason"), "seq").alias("d")
    )
    return candidates.join(kept, list(keys)).select(
        *candidates.columns,
        F.coalesce("d.score", F.lit(5.0)).alias("ai_score"), F.coalesce("d.reason", F.lit("")).alias("ai_reason"),
    )


def quota_with_floor(kept: DataFrame, pool: DataFrame, scope: str, rule: SelectionRules,
                     rejected: DataFrame | None = None) -> DataFrame:
    """Up to ``quota`` per category by ``ai_score``; below its floor a category is filled up with
    its best unselected rows of ``pool`` by ``score``, rejected ones included unless given."""
    quota = _limits(rule.quota, F.col("category"))
    chosen = (
        kept.withColumn("_r", _rank(kept, [scope, "category"], F.desc("ai_score"), F.desc("score"), *TIE))
        .filter((F.col("_r") <= max(rule.quota.values())) & (F.col("_r") <= quota))
        .select(scope, "id", "category", "score", "ai_score", *TIE)
    )
    if not rule.floor:
        return chosen
    open_pool = pool.filter(F.col("category").isin(*rule.floor)).join(
        chosen.select(scope, "id"), [scope, "id"], "left_anti"
    )
    if rejected is not None:
        open_pool = open_pool.join(rejected.select(scope, "id"), [scope, "id"], "left_anti")
    have = chosen.groupBy(scope, "category").agg(F.count("*").alias("have"))
    missing = _limits(rule.floor, F.col("category")) - F.coalesce("have", F.lit(0))
    fill = (
        open_pool.withColumn("_r", _rank(open_pool, [scope, "category"], F.desc("score"), *TIE))
        .filter(F.col("_r") <= max(rule.floor.values()))
        .join(have, [scope, "category"], "left")
        .filter(F.col("_r") <= missing)
        .select(scope, "id", "category", "score", F.lit(None).cast("double").alias("ai_score"), *TIE)
    )
    return chosen.unionByName(fill)


def fallback_selection(pool: DataFrame, scope: str, rule: SelectionRules) -> DataFrame:
    """Selection by raw score when there are no usable decisions."""
    ranked = pool.withColumn("ai_score", F.col("score"))
    return quota_with_floor(ranked, pool, scope, rule).withColumn("ai_score", F.col("score")).withColumn(
        "triage_mode", F.lit("fallback")
    )


def coverage(selected: DataFrame, runs: DataFrame, scope: str, rule: SelectionRules) -> DataFrame:
    """Per run: number of rows, required categories without any, and whether delivery may go on.

    ``runs`` lists the runs to report, so a run without a single row shows up too.
    """
    counts = selected.groupBy(scope).agg(
        F.count("*").alias("items"),
        *[F.count_if(F.col("category") == c).alias(f"_{i}") for i, c in enumerate(rule.required)],
    )
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(f"_{i}", F.lit(0)) == 0, F.lit(c)) for i, c in enumerate(rule.required)])
    )
    return runs.select(scope).distinct().join(counts, scope, "left").select(
        scope, F.coalesce("items", F.lit(0)).alias("items"), missing.alias("missing"),
        ((F.coalesce("items", F.lit(0)) >= rule.minimum) & (F.size(missing) == 0)).alias("covered"),
    )


def coverage_backfill(selected: DataFrame, pool: DataFrame, scope: str, rule: SelectionRules) -> DataFrame:
    """Repair runs that fail coverage although their whole pool would pass.

    First the best row of each missing required category, then the best rows of any category
    with room left, until the minimum is reached. Returns all selected rows and the added ones.
    """
    failing = coverage(selected, pool, scope, rule).filter("not covered").select(scope, "items", "missing")
    passing = coverage(pool, pool, scope, rule).filter("covered").select(scope)
    todo = failing.join(passing, scope, "left_semi")
    counts = selected.groupBy(scope, "category").agg(F.count("*").alias("have"))
    quota = _limits(rule.quota, F.col("category"))
    cands = (
        pool.filter(F.col("category").isin(*rule.quota))
        .join(selected.select(scope, "id"), [scope, "id"], "left_anti")
        .withColumn("_c", _rank(pool, [scope, "category"], F.desc("score"), *TIE))
        .filter(F.col("_c") <= max(rule.quota.values()))
        .join(todo, scope)
        .join(counts, [scope, "category"], "left")
        .withColumn("have", F.coalesce("have", F.lit(0)))
        .filter(F.col("_c") <= quota - F.col("have"))
        .withColumn("first_of_missing", (F.col("_c") == 1) & F.array_contains("missing", F.col("category")))
    )
    ranked = cands.withColumn(
        "_g", _rank(cands, [scope], F.desc("first_of_missing"), F.desc("score"), *TIE)
    )
    added = ranked.filter("first_of_missing or _g <= greatest(%d - items, 0)" % rule.minimum)
    keep = [scope, "id", "category", "score", "ai_score", *TIE]
    mode = lambda m: F.lit(m).alias("triage_mode")
    return selected.select(*keep, mode("selected")).unionByName(
        added.withColumn("ai_score", F.col("score").cast("double")).select(*keep, mode("coverage_backfill"))
    )


def select_mix(repos: DataFrame, scope: Sequence[str], mix: dict[str, int] | None = None) -> DataFrame:
    """A fixed mix of two kinds, each filling up for the other, best stars first.

    ``repos(scope, kind, name, stars, pos)`` with sent names already removed; ``pos`` is the
    order inside a kind. A name is taken once, the first kind first.
    """
    mix = mix or rules.REPO_MIX
    (first, n_first), (second, n_second) = mix.items()
    total = n_first + n_second
    scope = list(scope)
    # No more than this many rows of a kind can be taken, by position or by stars.
    per_kind = total + n_first
    by_pos = repos.withColumn("_p", _rank(repos, [*scope, "kind"], "pos", "name")).filter(F.col("_p") <= per_kind)
    by_stars = repos.withColumn("_s", _rank(repos, [*scope, "kind"], F.desc("stars"), "pos", "name")).filter(
        F.col("_s") <= total + per_kind
    ).drop("_s").join(by_pos.select(*scope, "kind", "name"), [*scope, "kind", "name"], "left_anti")
    heads = by_pos.unionByName(by_stars.withColumn("_p", F.lit(None).cast("int")))
    a = heads.filter((F.col("kind") == first) & (F.col("_p") <= n_first))
    rest = heads.filter(F.col("kind") == second).join(a.select(*scope, "name"), [*scope, "name"], "left_anti")
    b = rest.withColumn("_q", _rank(rest, scope, "pos", "name")).filter(F.col("_q") <= n_second).drop("_q")
    chosen = a.unionByName(b)
    have = chosen.groupBy(*scope).agg(F.count("*").alias("have"))
    others = heads.join(chosen.select(*scope, "name"), [*scope, "name"], "left_anti")
    # The same name may be offered by both kinds; it fills one place.
    once = others.withColumn(
        "_o", _rank(others, [*scope, "name"], F.desc("stars"), (F.col("kind") != first), "pos")
    ).filter("_o = 1")
    fill = (
        once.withColumn("_f", _rank(once, scope, F.desc("stars"), (F.col("kind") != first), "pos", "name"))
        .filter(F.col("_f") <= total)
        .join(have, scope, "left")
        .filter(F.col("_f") <= total - F.coalesce("have", F.lit(0)))
    )
    keep = [*scope, "kind", "name", "stars"]
    return chosen.select(*keep).unionByName(fill.select(*keep))


def best_tier(df: DataFrame, scope: Sequence[str], value: str, tiers: Sequence[int] = rules.REPO_TIERS) -> DataFrame:
    """Rows at or above the first floor that any row of the scope reaches."""
    tag: Column | None = None
    for i, floor in enumerate(sorted(tiers, reverse=True)):
        test = F.col(value) >= floor
        tag = F.when(test, i) if tag is None else tag.when(test, i)
    tagged = df.withColumn("tier", tag).filter("tier is not null")
    best = tagged.groupBy(*scope).agg(F.min("tier").alias("best")) if scope else tagged.agg(F.min("tier").alias("best"))
    joined = tagged.join(best, list(scope)) if scope else tagged.join(F.broadcast(best), tagged["tier"] == best["best"])
    return joined.filter("tier = best").drop("best")


def one_per_category(df: DataFrame, scope: str, categories: Sequence[str], total: int = 3) -> DataFrame:
    """The best row of each category, then the best of the rest up to ``total``."""
    score = F.coalesce("ai_score", "score")
    per = _rank(df, [scope, "category"], score.desc(), *TIE)
    heads = df.withColumn("_c", per).filter(F.col("_c") <= total + 1)
    first = (F.col("_c") == 1) & F.col("category").isin(*categories)
    ranked = heads.withColumn("_first", first).withColumn(
        "_g", _rank(heads, [scope], F.desc("_first"), score.desc(), *TIE)
    )
    return ranked.filter(F.col("_first") | (F.col("_g") <= total)).drop("_c", "_g", "_first")


def top_k(df: DataFrame, scope: Sequence[str], score: str, k: int, tie: Sequence[str] = TIE) -> DataFrame:
    return df.withColumn("_r", _rank(df, scope, F.desc(score), *tie)).filter(F.col("_r") <= k).drop("_r")


def backfill_targets(df: DataFrame, scope: str, min_score: float = rules.BACKFILL_MIN_SCORE,
                     limit: int = rules.BACKFILL_MAX) -> DataFrame:
    """Important reference rows without text, the first few of each run in the given order."""
    open_rows = df.filter(
        F.col("reference") & (F.coalesce("fulltext", F.lit("")) == "") & (F.col("score") >= min_score)
    )
    return open_rows.withColumn("_r", _rank(open_rows, [scope], "ord")).filter(F.col("_r") <= limit).drop("_r")
