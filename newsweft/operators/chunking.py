"""Splitting texts into messages, numbering batches and merging sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft import rules
from newsweft.operators.ranges import running_number


def chunk_by_bytes(text: Column, limit: int = rules.CHUNK_BYTES) -> Column:
    """Paragraphs packed into messages of at most ``limit`` UTF-8 bytes, four at least.

    A message is a stretch of the text's bytes, so the fold over the paragraphs carries places and sizes only. A paragraph
    above the limit is a stretch of its own, cut afterwards so that no piece ends inside a character. A text without any
    character but gaps stays whole.
    """
    if limit < 4:
        raise ValueError("a message has to hold four bytes, the longest character")
    raw = text.cast("binary")
    sizes = F.transform(F.split(text, "\n\n"), F.octet_length)
    none = F.lit(0)
    start = F.struct(
        F.array().cast("array<struct<at:int,size:int>>").alias("done"), none.alias("at"), none.alias("size"), none.alias("pos")
    )

    def closed(acc: Column) -> Column:
        message = F.struct(acc["at"].alias("at"), acc["size"].alias("size"))
        return F.when(acc["size"] > 0, F.array_append(acc["done"], message)).otherwise(acc["done"])

    def step(acc: Column, n: Column) -> Column:
        longer = acc["size"] + 2 + n
        fits = (acc["size"] > 0) & (longer <= limit)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(fits, acc["at"]).otherwise(acc["pos"]).alias("at"),
            F.when(fits, longer).otherwise(n).alias("size"),
            (acc["pos"] + n + 2).alias("pos"),
        )

    def inside(at: Column) -> Column:
        return F.hex(F.substr(raw, at + 1, F.lit(1))).between("80", "BF")

    def cut(message: Column) -> Column:
        """Pieces of a paragraph above the limit; a piece is at most three bytes short."""
        end = message["at"] + message["size"]

        def piece(acc: Column, _: Column) -> Column:
            most = acc["at"] + limit
            stop = (
                F.when(most >= end, end).when(~inside(most), most).when(~inside(most - 1), most - 1)
                .when(~inside(most - 2), most - 2).otherwise(most - 3)
            )
            part = F.struct(acc["at"].alias("at"), (stop - acc["at"]).alias("size"))
            return F.struct(
                F.when(acc["at"] < end, F.array_append(acc["done"], part)).otherwise(acc["done"]).alias("done"), stop.alias("at")
            )

        first = F.struct(F.array().cast("array<struct<at:int,size:int>>").alias("done"), message["at"].alias("at"))
        turns = F.sequence(F.lit(1), F.ceil(message["size"] / (limit - 3)).cast("int"))
        return F.aggregate(turns, first, piece, lambda acc: acc["done"])

    found = F.aggregate(sizes, start, step, closed)
    stretches = F.flatten(F.transform(found, lambda m: F.when(m["size"] > limit, cut(m)).otherwise(F.array(m))))
    messages = F.transform(stretches, lambda m: F.decode(F.substr(raw, m["at"] + 1, m["size"]), "UTF-8"))
    return F.when((F.octet_length(text) <= limit) | (F.size(messages) == 0), F.array(text)).otherwise(messages)


def chunk_by_chars(text: Column, limit: int = rules.CHUNK_CHARS) -> Column:
    """Paragraphs packed into messages of at most ``limit`` characters; a fold over the paragraphs.

    A too long paragraph is cut into pieces of ``limit`` characters.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, para: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(para) + 2 <= limit
        closed = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.length(para) - 1) / limit).cast("int")),
            lambda i: F.substr(para, i * limit + 1, F.lit(limit)),
        )
        return (
            F.when(fits, F.struct(
                acc["done"].alias("done"),
                F.when(acc["open"] != "", F.concat(acc["open"], F.lit("\n\n"), para)).otherwise(para).alias("open")))
            .when(F.length(para) > limit, F.struct(F.concat(closed, pieces).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(closed.alias("done"), para.alias("open")))
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    return F.aggregate(F.split(text, "\n\n"), start, step, finish)


def batch_ids(df: DataFrame, scope: Sequence[str], order: Sequence[str], size: int = rules.BATCH_SIZE) -> DataFrame:
    """Consecutive groups of ``size`` rows per scope as ``batch`` = 0, 1, ..."""
    numbered = running_number(df, scope, order, "_number")
    return numbered.withColumn("batch", F.floor(F.col("_number") / size).cast("int")).drop("_number")


def merge_sections(texts: DataFrame, scope: Sequence[str], order: str, text: str,
                   sections: Sequence[str] = rules.REQUIRED_SECTIONS, placeholder: str = rules.EMPTY_SECTION_TEXT,
                   other: str = rules.SECTION_OTHER) -> DataFrame:
    """Lines of all parts of a scope by the last heading seen in their part: ``scope, section, content``.

    Headings and filler lines are left out. Each part is cut at its headings inside its row, so what moves is one joined text for
    each stretch of a section; they are put together in order, once for each section of a scope.
    """
    scope = list(scope)

    def heading(bare: Column) -> Column:
        found = F.lit(None).cast("string")
        for s in reversed(sections):
            found = F.when(F.startswith(bare, F.lit("##")) & F.contains(bare, F.lit(s)), s).otherwise(found)
        return found

    def is_filler(line: Column) -> Column:
        return F.contains(F.regexp_replace(line, r"[\s（）()。.!！]", ""), F.lit(placeholder))

    said = F.filter(F.split(text, "\n"), lambda x: ~is_filler(x))
    lines = F.transform(said, lambda x: F.struct(x.alias("line"), heading(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).alias("heading")))
    # What stands before the first heading is a stretch as well, at place 0.
    places = F.concat(F.array(F.lit(0)), F.filter(F.transform("_lines", lambda x, i: F.when(x["heading"].isNotNull(), i + 1)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("_at", F.lit(2), F.size("_at")), F.array(F.size("_lines") + 1))
    stretches = F.transform(F.arrays_zip(F.col("_at").alias("head"), ends.alias("end")), lambda x: F.struct(
        F.coalesce(F.get("_lines", x["head"] - 1)["heading"], F.lit(other)).alias("section"),
        F.slice("_lines", x["head"] + 1, x["end"] - x["head"] - 1)["line"].alias("lines"),
    ))
    rows = texts.select(*scope, order, lines.alias("_lines")).filter("_lines IS NOT NULL").select(*scope, order, "_lines", places.alias("_at"))
    rows = rows.select(*scope, order, F.posexplode(stretches).alias("_number", "_part")).filter(F.size("_part.lines") > 0)
    rows = rows.select(*scope, order, "_number", F.col("_part.section").alias("section"), F.array_join("_part.lines", "\n").alias("_text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_number", "_text"))), lambda x: x["_text"]), "\n")
    return rows.groupBy(*scope, "section").agg(F.regexp_replace(body, r"(?U)^\s+|\s+$", "").alias("content"))
