"""Reading decisions and reports out of raw, possibly damaged text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.text import let, strip


def drop_thinking(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))


def json_array_text(raw: Column) -> Column:
    """The fenced array when there is one, else the span from the first to the last bracket."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    bare = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    return F.when(fenced != "", fenced).otherwise(bare)


def flat_objects(raw: Column) -> Column:
    """Every object without nested braces, as text."""
    return F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0))


def _decision(v: Column) -> Column:
    """A decision's fields from a parsed object."""
    return F.struct(
        F.try_variant_get(v, "$.id", "int").alias("id"),
        F.coalesce(F.try_variant_get(v, "$.keep", "boolean"), F.lit(False)).alias("keep"),
        F.coalesce(F.try_variant_get(v, "$.score", "double"), F.lit(5.0)).alias("score"),
        F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"),
    )


def salvage_decisions(raw: Column) -> Column:
    """Array of decisions: the objects of a whole array if it parses, else each flat object that has an id."""
    text = drop_thinking(raw)
    whole = F.try_variant_get(F.try_parse_json(json_array_text(text)), "$", "array<variant>")
    objects = F.filter(whole, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    loose = F.filter(
        F.transform(flat_objects(text), lambda o: F.try_parse_json(o)),
        lambda v: F.try_variant_get(v, "$.id", "string").isNotNull(),
    )
    return F.transform(F.coalesce(objects, loose), _decision)


def _quoted_items(body: Column) -> Column:
    """The strings of a list whose inner quotes may stand bare: only a comma alone between two quotes parts them."""
    def items(tokens: Column) -> Column:
        framed = (F.size(tokens) > 2) & (tokens[0] == "") & (F.element_at(tokens, -1) == "")
        inside = F.when(framed, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))).otherwise(tokens)
        marked = F.transform(inside, lambda t: F.when(F.trim(F.translate(t, "\n\t\r", "   ")) == ",", "\x01").otherwise(t))
        return F.split(F.array_join(marked, '"'), '"?\x01"?')

    parts = let(F.split(strip(body), '"'), items)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def salvage_report(raw: Column, passing: float = 10.0) -> Column:
    """Overall mark and issues of a review; anything unreadable counts as passed.

    What the parser refuses is read by its two names: the number behind the first, and behind the second the strings of a list that
    the object's end follows.
    """
    payload = F.regexp_extract(drop_thinking(raw), r"(?s)\{.*\}", 0)
    strict = F.try_parse_json(payload)

    def behind(name: str) -> Column:
        return F.regexp_replace(F.get(F.split(payload, f'"{name}"', 2), F.lit(1)), r"^\s*:\s*", "")

    mark = F.get(F.split(behind("overall"), r"[\s,}\]]", 2), F.lit(0)).try_cast("double")
    ends = F.split(behind("issues"), r"\]\s*\}")
    body = F.array_join(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), "]}")
    listed = (F.size(ends) > 1) & F.startswith(body, F.lit("["))
    nothing = F.array().cast("array<string>")
    loose = F.when(mark.isNotNull() & listed, F.struct(mark.alias("overall"), _quoted_items(F.substr(body, F.lit(2))).alias("issues")))
    issues = F.coalesce(F.try_variant_get(strict, "$.issues", "array<string>"), nothing)
    clean = F.struct(
        F.coalesce(F.try_variant_get(strict, "$.overall", "double"), F.lit(passing)).alias("overall"),
        F.filter(issues, lambda i: i.isNotNull() & (i != "")).alias("issues"),
    )
    passed = F.struct(F.lit(passing).alias("overall"), nothing.alias("issues"))
    return F.when(strict.isNotNull() & (payload != ""), clean).otherwise(F.coalesce(loose, passed))


def numbered_lines(raw: Column) -> Column:
    """``<number> <text>`` lines as (idx, text), quotes removed, empty lines left out."""
    pattern = r"^(\d+)[.、)\s]+\s*(.+)$"
    lines = F.transform(F.split(raw, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    hits = F.transform(
        F.filter(lines, lambda x: F.rlike(x, F.lit(pattern))),
        lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).try_cast("int").alias("idx"),
            F.regexp_replace(F.regexp_extract(x, pattern, 2), '^[ "“”]+|[ "“”]+$', "").alias("text"),
        ),
    )
    return F.filter(hits, lambda h: (h["text"] != "") & h["idx"].isNotNull())
