"""Operator 11: ranked lexical search by a join that is seeded with thresholds from stored top impacts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sized, table
from .kernels import chunks

#: Bytes that no term holds are the ASCII ones that are neither digits nor letters; only A-Z are lowered.
NO_TERM = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
#: Fixed values of the score: percent of a document's length that counts, factors of term frequency and of length.
LENGTH_PERCENT, SCALE, TF_UNIT, LENGTH_UNIT = 50, 1_000_000_000, 1000, 20
DEPTH = 50
#: Left-out terms of an item stay under this part of its bound. One in 1 would be safe; then fewer impacts are joined, but
#: most candidates could still reach the bound and each of them is scored over all terms.
LEFT_OUT = 2
#: Documents of an item that are scored for its first bound, as a multiple of the depth.
SEEDS = 10
#: Bytes of text that are cut into terms at once (a longer text is taken whole).
TERM_CHUNK = 1 << 20
#: Bytes of the items' distinct terms (with 16 for each) that may be sent to all tasks; beyond, postings of all terms are written.
VOCABULARY_BYTES = 1 << 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of the rows of a chunk in order, lowered, and the terms before each row."""
    data = _LOWER[data]
    inside = _IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate(([False], inside))[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    kept = np.concatenate(([0], np.cumsum(inside)))
    at = np.concatenate((kept[starts], kept[-1:]))
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[inside])), np.searchsorted(starts, offsets)


def counted(texts: pa.Array, vocabulary: pa.Array | None) -> Iterator[tuple[int, int, np.ndarray, pa.Array, pa.Array]]:
    """(first row, end row, terms of each row, distinct terms of the vocabulary a row, how often) of each chunk of texts."""
    for row, end, data, offsets in chunks(texts, TERM_CHUNK):
        terms, rows = terms_of(data, offsets)
        if vocabulary is None:
            found = terms.dictionary_encode()
            known, which = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            known, which = vocabulary, pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(end - row), np.diff(rows))
        keys, times = np.unique((owner * max(len(known), 1) + which)[which >= 0], return_counts=True)
        owner, which = np.divmod(keys, max(len(known), 1))
        ends = np.searchsorted(owner, np.arange(end - row + 1)).astype(np.int32)
        values = known.take(pa.array(which)).cast(pa.string())
        yield row, end, np.diff(rows), pa.ListArray.from_arrays(pa.array(ends), values), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int64)))


def term_lists(df: DataFrame, key: str, text: str, vocabulary: pa.Array | None = None) -> DataFrame:
    """One row a text with a term: its row number, key, n (terms with repeats), distinct terms (of the vocabulary) and their counts."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, n, terms, tfs in counted(batch.column(2), vocabulary):
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(n.astype(np.int64)), terms, tfs], names=schema.names)
                yield out.filter(pa.array(n > 0))

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, term); rows of one item are one item, rows without an id are none."""
    return term_lists(items.where(F.col(item_id).isNotNull()), item_id, text).select(F.col("key").alias("item"), F.explode("terms").alias("term")).distinct()


def vocabulary_of(wanted: DataFrame) -> pa.Array | None:
    """The items' distinct terms, if they are small enough to be sent to all tasks."""
    terms = wanted.select("term").distinct()
    size = terms.agg(F.sum(F.octet_length("term") + 16).alias("b")).first().b or 0
    return terms.orderBy("term").toArrow()["term"].combine_chunks().cast(pa.large_string()) if size <= VOCABULARY_BYTES else None


def top(df: DataFrame, group: str, by: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; tasks keep ``k`` rows of a group before they are shuffled."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col(name) <= k)


def exact_scores(pairs: DataFrame, lists: DataFrame, wanted: DataFrame, weights: DataFrame, impact: Column) -> DataFrame:
    """(item, row, key, score) of pairs of item and row, over all terms of the item."""
    found = lists.join(sized(pairs), "row").select("item", "row", "key", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    found = found.select("item", "row", "key", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    found = found.join(sized(wanted.join(sized(weights), "term")), ["item", "term"])
    return found.groupBy("item", "row").agg(F.first("key").alias("key"), F.sum(impact).alias("score"))


def last_scores(scored: DataFrame, depth: int) -> DataFrame:
    """(item, bound): the ``depth``-th highest of an item's scores; 1, as a result must have, for items with fewer."""
    best = top(scored, "item", [F.desc("score")], depth, "place")
    return best.groupBy("item").agg(F.when(F.count("*") >= depth, F.min("score")).otherwise(1).alias("bound"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", depth: int = DEPTH) -> DataFrame:
    """The ``depth`` highest-scoring documents of every item: item_id, rank from 1, doc_id, score.

    Impacts (a term's part of a score) are never negative. The ``depth`` largest impacts of each term are stored; summed
    by item and document they are lower bounds of scores, and the exact scores of the SEEDS * ``depth`` documents of the
    largest sums bound an item's last score. An item's terms in order of their largest impact are left out as long as all
    left out together stay under one in LEFT_OUT of its bound: no document with these alone can be in the result.
    Documents with one of the other terms are candidates; those whose sum over them cannot reach the bound even with all
    left-out terms are dropped. Of the rest, those of the largest sums are scored to raise the bound once more, and what
    can still reach it is scored exactly, so nothing is lost.

    Each row of ``docs`` is a document of its own: repeated rows and repeated ids all count and all can be returned; a
    null id comes last among equal scores. Rows of ``items`` with one id are one item with the terms of all its texts;
    those without an id are none. Null texts and texts without a term match nothing and do not count in the statistics.
    Terms count once an item, however often it repeats them. No items, no documents or no common term: no rows. Other
    columns are ignored.
    """
    wanted = materialize(item_terms(items, item_id, item_text), "item-terms")
    lists = materialize(term_lists(docs, doc_id, text, vocabulary_of(wanted)), "term-lists")
    total = lists.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total.n, max(total.l, 1)
    flat = lists.select("row", "key", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "key", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    counts = flat.groupBy("term").agg(F.count("*").alias("df")).join(sized(wanted.select("term").distinct()), "term", "left_semi")
    weight = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    weights = materialize(counts.select("term", weight.alias("w")), "term-weights")
    length = f"{100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * {n_docs}L) div {n_terms}L"
    impact = F.expr(f"w * (({SCALE}L * tf) div ({TF_UNIT} * tf + {LENGTH_UNIT} * ({length})))")
    impacts = flat.join(sized(weights), "term").select("row", "key", "term", impact.alias("impact")).where("impact > 0")

    tops = materialize(top(impacts.select("row", "term", "impact"), "term", [F.desc("impact"), F.col("row")], depth, "place"), "top-impacts")
    sums = tops.join(sized(wanted), "term").groupBy("item", "row").agg(F.sum("impact").alias("least"))
    seeds = top(sums, "item", [F.desc("least"), F.col("row")], SEEDS * depth, "place").select("item", "row")
    bound = last_scores(exact_scores(materialize(seeds, "seed-rows"), lists, wanted, weights, impact), depth)
    largest = wanted.join(sized(tops.where("place = 1").select("term", F.col("impact").alias("most"))), "term")
    below = F.sum("most").over(Window.partitionBy("item").orderBy("most", "term"))
    terms = materialize(largest.withColumn("below", below).join(sized(bound), "item"), "item-bounds")
    kept = F.col("below") * LEFT_OUT >= F.col("bound")
    rest = terms.groupBy("item").agg(F.coalesce(F.max(F.when(~kept, F.col("below"))), F.lit(0)).alias("rest"), F.max("bound").alias("bound"))
    reach = impacts.join(sized(terms.where(kept).select("item", "term")), "term").groupBy("item", "row").agg(F.sum("impact").alias("part"))
    reach = materialize(reach.join(sized(rest), "item").where("part + rest >= bound").select("item", "row", "part", "rest"), "reach")
    likely = top(reach, "item", [F.desc("part"), F.col("row")], 2 * depth, "place").select("item", "row")
    bound = last_scores(exact_scores(materialize(likely, "likely-rows"), lists, wanted, weights, impact), depth)
    candidates = materialize(reach.join(sized(bound), "item").where("part + rest >= bound").select("item", "row"), "candidates")
    scored = exact_scores(candidates, lists, wanted, weights, impact)
    ranked = top(scored, "item", [F.desc("score"), F.asc_nulls_last("key"), F.col("row")], depth, "rank")
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int"), F.col("key").alias("doc_id"), "score")


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_AZ}', '{_AZ.lower()}'), '[^{NO_TERM}]+') AS toks FROM documents
), s AS (
  SELECT count(*) AS n_docs, sum(len(toks))::BIGINT AS n_terms FROM d WHERE len(toks) > 0
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_AZ}', '{_AZ.lower()}'), '[^{NO_TERM}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(toks) AS n, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(w * (({SCALE} * tf) // ({TF_UNIT} * tf + {LENGTH_UNIT} * ({100 - LENGTH_PERCENT} + ({LENGTH_PERCENT} * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {DEPTH}
"""
