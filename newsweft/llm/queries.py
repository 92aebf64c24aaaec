"""Registered queries of this subpackage, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsweft.functions.text import let
from newsweft.llm.alignment import benchmark_copies
from newsweft.llm.archive import archive_pages
from newsweft.llm.forest import nearest_vectors
from newsweft.llm.hostpaths import main_texts
from newsweft.llm.huffman import checksum, huffman_store
from newsweft.llm.packing import pack
from newsweft.llm.periodic import periodic_runs
from newsweft.llm.repetition import LEAST_WORDS, LONGEST_WORDS, MOST_COVERED_PERCENT, repetition_rules
from newsweft.llm.shards import lpt_shards
from newsweft.llm.spelling import spelling_variants
from newsweft.llm.substring import substring_dedup
from newsweft.llm.suffixdedup import suffix_dedup
from newsweft.llm.weighted import near_duplicates


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read(spark, sf_dir, "documents")).drop("longest_repeat")


def op2_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages"))


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lpt_shards(read(spark, sf_dir, "documents"), 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int"), "slot": F.col("slot").cast("long")})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(huffman_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))


def op9_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_copies(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def with_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, with a loop in the texts of every tenth checksum of an id: from a word on, the words after it repeat."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tens = F.floor(check / 10)

    def looped(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        first = tens % n
        period = 1 + F.floor((n - first) / (3 + tens % 8))
        return F.array_join(F.transform(
            words, lambda w, i: F.when(i >= first, F.get(words, (first + (i - first) % period).cast("int"))).otherwise(w)
        ), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return docs.select("doc_id", F.when(check % 10 == 0, let(words, looped)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.arrays_zip("starts", "lengths", "periods")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("starts", "lengths", "periods")]), F.lit("\n")))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["lengths"].alias("length"), (-r["starts"]).alias("s"), (-r["periods"]).alias("p"))))
    return periodic_runs(with_loops(read(spark, sf_dir, "documents"))).withColumn("best", best).select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), "best.length", (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest_vectors(rows, rows.where("vec_id % 20 = 0"), 20)


def spelled(docs: DataFrame) -> DataFrame:
    """``word, n``: the runs of letters of all texts, A-Z in lower case, with a code point left out where 97 divides the checksum of
    id and run; of at least 5 code points and 3 occurrences. A null id reads as no digits."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce("text", F.lit("")), upper, upper.lower())
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(r"([A-Za-z\u00C0-\u00FF]+)"), F.lit(1))).alias("run")
    )
    check = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (check % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(check % 97 == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= 5).groupBy("word").agg(F.count("*").alias("n")).where("n >= 3")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(spelled(read(spark, sf_dir, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_repetition, op2_content_addressed, op3_seed_extend, op4_weighted_minhash, op5_lpt_shards,
        op6_suffix_dedup, op7_huffman_ids, op8_host_paths, op9_seeded_alignment, op10_nnls_packing, op11_periodic_runs,
        op12_projection_forest, op13_spelling_variants,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NUMBERED = "w AS (SELECT doc_id, ws, len(ws) AS n, coalesce(text, '') AS text FROM (SELECT *, " + _WORDS + " AS ws FROM documents))"


def _window_words(name: str, width: int) -> str:
    """Words of each document in windows of so many that stand in it twice or more."""
    return f"""
{name}_s AS (SELECT doc_id, unnest(range(1, n - {width} + 2)) AS p, ws FROM w WHERE n >= {width}),
{name}_g AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + {width - 1}], ' ')) AS g FROM {name}_s),
{name}_r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM {name}_g) WHERE c > 1),
{name} AS (SELECT doc_id, count(DISTINCT q) AS c FROM (SELECT doc_id, unnest(range(p, p + {width})) AS q FROM {name}_r) GROUP BY 1)"""


def crc32_sql(text: str) -> str:
    """The checksum of a text, bit by bit: a byte is mixed in, then eight steps follow."""
    pairs = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, strlen({text})), lambda i: [CAST('0x' || substr({pairs}, 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: {step}), 4294967295::BIGINT)"


CHECKS = {
    "op1_suffix_repetition": f"""
WITH {_NUMBERED}, {_window_words('five', 5)}, {_window_words('deep', LEAST_WORDS)}, {_window_words('long', LONGEST_WORDS)},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS c FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
base AS (
  SELECT w.doc_id, n AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup.c, 0) AS n_dup_lines,
    coalesce(five.c, 0) AS n_repeat_words, coalesce(deep.c, 0) AS n_covered_words, long.c IS NOT NULL AS too_long
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN five USING (doc_id) LEFT JOIN deep USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_covered_words <= {MOST_COVERED_PERCENT} * n_words AND NOT too_long AS kept,
  n_covered_words
FROM base""",
    "op2_content_addressed": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM q""",
    "op3_seed_extend": f"""
WITH {_NUMBERED},
s AS (SELECT doc_id, unnest(range(1, n - 18)) AS p, ws FROM w WHERE n >= 20),
g AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS g FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, n + 1)) AS q FROM w WHERE n > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT w.doc_id, n AS n_words, coalesce(c.c, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op11_periodic_runs": f"""
WITH w0 AS (SELECT *, len(ws) AS n, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
w1 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM w0),
w AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i
    ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS ws FROM w1),
g AS (SELECT doc_id, n, i, md5(array_to_string(ws[i + 1:i + 5], ' ')) AS g FROM (SELECT doc_id, n, ws, unnest(range(0, n - 4)) AS i FROM w WHERE n > 5)),
cell AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS l FROM
  (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM cell) GROUP BY doc_id, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM stretch x WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = x.doc_id AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
a AS (SELECT doc_id, count(*) AS n_runs, max([l, -s, -q]) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, n)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, -best[2] AS start, best[1] AS length, -best[3] AS period, 1000 * best[1] // -best[3] AS exponent_milli,
  sha256(coalesce(a.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_spelling_variants": f"""
WITH RECURSIVE run AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
sum AS (SELECT *, {crc32_sql("(doc_id || ':' || run)")} AS h FROM run),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM sum) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w)),
pair AS (SELECT x.word, y.word AS near FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT less.word, w.word FROM less JOIN w ON w.word = less.rest UNION SELECT w.word, less.word FROM less JOIN w ON w.word = less.rest),
best AS (SELECT pair.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS near, max(w.n) AS near_n FROM pair JOIN w ON w.word = near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, form, here AS root, n, n_near, form_n FROM f JOIN chain USING (word) SEMI JOIN (SELECT word AS here FROM f WHERE form IS NULL) e ON e.here = chain.here""",
}
