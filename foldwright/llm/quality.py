"""Operator 1: quality rules with cross-document line frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, bind, fresh, materialize, sized, table, text_of, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate if more than so many documents of its host hold it, and more than so many of a thousand of
#: them.
MAX_TEXTS = 10
MAX_PER_MILLE = 2
#: A document is depleted if fewer words than this, or than this share, are left without its boilerplate lines.
MIN_WORDS_LEFT = 10
MIN_PERCENT_LEFT = 50


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in the array, the first included.

    Windows are 64-bit hashes. Only if some are equal, they are sorted with their places; the places of equal
    neighbours, in order, cover min(window, distance to the next) words each.
    """

    def hashes(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - window), lambda i: F.xxhash64(*(F.get(a, i + k) for k in range(window))))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            after = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda x, y: x["h"] == y["h"])
            marked = F.zip_with(F.concat(F.array(F.lit(False)), after), F.concat(after, F.array(F.lit(False))), lambda x, y: x | y)
            kept = F.filter(F.zip_with(s, marked, lambda x, m: F.when(m, x["i"])), lambda i: i.isNotNull())
            return F.sort_array(kept)

        def count(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(y - x, F.lit(window)))
            return F.aggregate(gaps, F.lit(window), lambda acc, g: acc + g).cast("long")

        return bind(placed, lambda s: bind(places(s), count))

    zero = F.lit(0).cast("long")
    return bind(w, lambda a: F.when(F.size(a) <= window, zero).otherwise(bind(hashes(a), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(h)))))


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (contract definitions)."""
    t = text_of(text)
    w = fresh(df, "w")[0]
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    df = df.withColumn(w, words(text))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.char_length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": bind(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
            "n_repeat_words": repeated_words(F.col(w)),
        }
    ).drop(w)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def normalised(line: Column) -> Column:
    """A line for comparison: lower case, words parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _n_words(line: Column) -> Column:
    """Words of a normalised line."""
    return F.when(line == "", F.lit(0)).otherwise(F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def doc_lines(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """One row a document and line with a word: key, host, hashes of the text and the normalised line, place, words."""
    lines = F.posexplode(F.transform(F.split(text_of(text), "\n"), normalised)).alias("place", "line")
    rows = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.xxhash64(text_of(text)).alias("text_hash"), lines).where("line <> ''")
    return rows.select("key", "host", "text_hash", "place", F.xxhash64("line").alias("line_hash"), _n_words(F.col("line")).alias("words"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """The (host, line_hash) that too many documents of the host hold.

    Documents are distinct (key, text), so copies under other keys count, and a line repeated in a text counts once. The
    distinct (host, line, document) are summed before the second shuffle, so a line that a third of all documents hold
    reaches its counter as one row a task. Null hosts are one host.
    """
    texts = lines.select("host", "key", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    counts = lines.select("host", "line_hash", "key", "text_hash").distinct().groupBy("host", "line_hash").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") > MAX_TEXTS)
    texts = texts.select(F.col("host").alias("h"), "texts")
    joined = counts.join(sized(texts), counts["host"].eqNullSafe(F.col("h")))
    return joined.where(F.col("n") * 1000 > F.col("texts") * MAX_PER_MILLE).select("host", "line_hash")


def without_lines(text: Column, places: Column) -> Column:
    """The text without the lines at ``places`` (from 0), each with its line feed; null for null."""

    def rest(a: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(a) - 1), places)
        return F.array_join(F.transform(kept, lambda i: F.get(a, i)), "\n")

    return F.when(places.isNull(), text).otherwise(bind(F.split(text, "\n"), rest))


def quality(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``df`` with the base features, n_line_words (words in boilerplate lines), clean_text, depleted and kept.

    clean_text is the text without the lines that ``boilerplate`` finds, the other lines unchanged; a document is depleted if fewer than MIN_WORDS_LEFT words or
    MIN_PERCENT_LEFT percent of its words stay; it is kept if it is neither depleted nor fails the base rules. Null
    and empty texts have no words and fail them. Rows with equal key and text are one document and get one verdict; a
    null key is a key. An empty table stays empty. Columns named like the results are replaced.
    """
    lines = materialize(doc_lines(df, key, host, text), "lines")
    frequent = materialize(boilerplate(lines), "boilerplate").select(F.col("host").alias("h"), F.col("line_hash").alias("l"))
    hit = lines.join(sized(frequent), lines["host"].eqNullSafe(F.col("h")) & (lines["line_hash"] == F.col("l")))
    hit = hit.select("key", "text_hash", "place", "words").distinct()
    k, t, gone, gone_at = fresh(df, "k", "t", "gone", "gone_at")
    hit = hit.groupBy(F.col("key").alias(k), F.col("text_hash").alias(t)).agg(F.sum("words").alias(gone), F.collect_set("place").alias(gone_at))
    out = base_features(df, text)
    out = out.join(hit, out[key].eqNullSafe(F.col(k)) & (F.xxhash64(text_of(text)) == F.col(t)), "left")
    out = out.withColumns({"n_line_words": F.coalesce(F.col(gone), F.lit(0)).cast("long"), "clean_text": without_lines(F.col(text), F.col(gone_at))}).drop(k, t, gone, gone_at)
    left = F.col("n_words") - F.col("n_line_words")
    out = out.withColumn("depleted", (left < MIN_WORDS_LEFT) | (100 * left < MIN_PERCENT_LEFT * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "depleted", "kept")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM repeated) GROUP BY doc_id
), raw_lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), lines AS (
  SELECT doc_id, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM raw_lines
), by_host AS (
  SELECT source, line, count(DISTINCT doc_id) AS n FROM lines JOIN d USING (doc_id) WHERE line <> '' GROUP BY source, line
), hosts AS (
  SELECT source, count(*) AS texts FROM d WHERE len(w) > 0 GROUP BY source
), frequent AS (
  SELECT b.source, line FROM by_host b JOIN hosts h ON b.source IS NOT DISTINCT FROM h.source
  WHERE n > {MAX_TEXTS} AND n * 1000 > texts * {MAX_PER_MILLE}
), gone AS (
  SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n
  FROM lines l JOIN d USING (doc_id) JOIN frequent f ON f.line = l.line AND f.source IS NOT DISTINCT FROM d.source GROUP BY l.doc_id
), base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_words - n_line_words < {MIN_WORDS_LEFT} OR 100 * (n_words - n_line_words) < {MIN_PERCENT_LEFT} * n_words AS depleted
  FROM base
)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""
