"""Operator 4: near-duplicates by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, join_counted, last_table_only, materialize, sized, table
from .components import components
from .kernels import chunks, finish, shingles

#: Links need 100 * intersection >= min_percent * union of the 5-word shingle sets: 80 for the operator and the stage, 85
#: in the query, whose contract says so.
MIN_PERCENT = 80
QUERY_PERCENT = 85
#: Values of a sketch. The inverted lists find every pair whose sketches share 17 of 32 values (odds of fewer at 80 %, by
#: four million simulated pairs: under 1e-6); the estimate passes half of the known values and more (odds of fewer: 8e-6).
SKETCH = 32
MIN_ESTIMATE = 0.5
#: Lists up to this length give all their pairs; longer ones give links to their first document, then are compared in
#: blocks of about BLOCK documents or BLOCK_SHINGLES shingles between different components only.
SHORT_LIST = 16
BLOCK = 256
BLOCK_SHINGLES = 1 << 18


def shingle_sets(df: DataFrame, key: str, text: str, keep: int | None) -> DataFrame:
    """(key, n_shingles, fp_a, fp_b, hashes): size and fingerprint of each set, and its smallest ``keep`` hashes."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_shingles", T.LongType()), T.StructField("fp_a", T.LongType()), T.StructField("fp_b", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                values, at, _, _ = shingles(data, offsets)
                values = values.view(np.int64)
                sets = [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                sizes = np.array([len(s) for s in sets], np.int64)
                sums = [[int(finish(s.view(np.uint64) ^ np.uint64(salt)).sum().view(np.int64)) if len(s) else 0 for s in sets] for salt in (1, 2)]
                kept = [s[:keep] for s in sets]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(sizes), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), lists], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def _close(a: str, b: str, min_percent: int):
    """Sizes that allow a link."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * 100 >= high * min_percent


def postings(reps: DataFrame) -> DataFrame:
    """(value, doc, n, df): the inverted-list entries that can be the first shared value of a linked pair.

    Values are ordered by how many sketches hold them, rare first. Sketches of length m that share more than m / 2
    values share one of the first m - m // 2 values of each, so only those are listed; values that no other sketch
    holds fill these places without being listed.
    """
    every = reps.select(F.col("key").alias("doc"), F.col("n_shingles").alias("n"), F.size("hashes").alias("m"), F.explode("hashes").alias("value"))
    shared = materialize(every.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "near-values")
    total = reps.agg(F.sum(F.size("hashes"))).first()[0] or 0
    held = join_counted(every, shared, "value", "df", total).groupBy("doc", "n", "m").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    places = F.col("m") - F.floor(F.col("m") / 2) - (F.col("m") - F.size("held"))
    held = held.where(places > 0).select("doc", "n", F.explode(F.slice("held", F.lit(1), places.cast("int"))).alias("x"))
    return held.select("x.value", "doc", "n", "x.df")


def sets_of(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hashes): the full sets of the documents in ``ids`` (key), one row a key."""
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sized(ids), "key", "left_semi").dropDuplicates(["key"])
    return shingle_sets(some, "key", "text", None).select("key", "hashes")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str, min_percent: int) -> DataFrame:
    """The pairs (a, b) that are links: union-sketch estimate first, then the full sets."""
    sk = reps.select(F.col("key").alias("d"), F.col("hashes").alias("s"))
    pairs = pairs.join(sk.withColumnsRenamed({"d": "a", "s": "sa"}), "a").join(sk.withColumnsRenamed({"d": "b", "s": "sb"}), "b")
    # values up to the smaller of the two largest retained values are known for both sets, if a sketch is full
    full = lambda s: F.when(F.size(s) < SKETCH, F.lit(2**63 - 1)).otherwise(F.element_at(s, -1))
    limit = F.least(full("sa"), full("sb"))
    pairs = pairs.withColumn("limit", limit).withColumn("both", F.size(F.array_intersect("sa", "sb")))
    known = F.size(F.filter("sa", lambda x: x <= F.col("limit"))) + F.size(F.filter("sb", lambda x: x <= F.col("limit"))) - F.col("both")
    pairs = materialize(pairs.where(F.col("both") >= F.lit(MIN_ESTIMATE) * known).select("a", "b"), "near-candidates")
    ids = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
    sets = materialize(sets_of(ids, docs, key, text), "near-sets")
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    full = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return full.where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * min_percent).select("a", "b")


def block_links(keys: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], cross: np.ndarray | None, min_percent: int) -> list[tuple[int, int]]:
    """Links between documents of different components, until no component can grow: a spanning forest.

    Intersections are counted exactly, through a matrix of documents by hash values, in slices of its columns.
    """
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, cols, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    held = times[cols] > 1
    rows, cols = rows[held], rank[cols[held]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(cols.max(initial=-1)) + 1, 4096):
        part = (cols >= at) & (cols < at + 4096)
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[rows[part], cols[part] - at] = 1
        both += grid @ grid.T
    ok = both * 100 >= (sizes[:, None] + sizes[None, :] - both) * min_percent
    ok &= comps[:, None] != comps[None, :]
    if cross is not None:
        ok &= cross[:, None] != cross[None, :]
    root: dict = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
        x, y = find(comps[i]), find(comps[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((keys[i], keys[j]))
    return out


def long_list_links(lists: DataFrame, comp: DataFrame, docs: DataFrame, key: str, text: str, min_percent: int) -> DataFrame | None:
    """Links that the long lists hold between documents of different components; None if there is nothing to compare.

    Of each list, the documents outside its largest component are cut into blocks by hash, which meet each other and the
    blocks of the largest component: rows grow with the list times the blocks of outsiders, not with its square. Each
    pair of blocks is a group of its own, so no task holds more than two, and pairs inside a component are not looked at.
    """
    comp = comp.select(F.col("node").alias("doc"), "comp")
    lists = materialize(lists.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc")), "near-lists")
    per = lists.groupBy("value", "comp").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    open_ = per.groupBy("value").agg(F.max(F.struct("docs", "comp", "shingles")).alias("top"), F.sum("docs").alias("size"), F.sum("shingles").alias("shingles"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda docs, shingles: F.ceil(F.greatest(docs / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    outer = blocks(F.col("size") - F.col("top.docs"), F.col("shingles") - F.col("top.shingles"))
    open_ = materialize(open_.select("value", "size", F.col("top.comp").alias("top"), outer.alias("outer"), blocks(F.col("top.docs"), F.col("top.shingles")).alias("inner")), "near-open")
    lists = materialize(join_counted(lists.drop("size"), open_, "value", "size", lists.count()), "near-blocks")
    if not lists.limit(1).count():
        return None
    sets = sets_of(lists.select(F.col("doc").alias("key")).distinct(), docs, key, text).withColumnRenamed("key", "doc")
    outsider = F.col("comp") != F.col("top")
    mine = F.when(outsider, F.pmod(F.hash("doc"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.hash("doc"), F.col("inner")))
    others = F.sequence(F.lit(0), F.when(outsider, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    tiles = lists.withColumn("mine", mine).withColumn("other", F.explode(others))
    tiles = tiles.select("value", "doc", "comp", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).join(sets, "doc")
    kind = lists.schema["doc"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        cross = group["mine"].to_numpy() if group["x"].iat[0] != group["y"].iat[0] else None
        found = block_links(group["doc"].to_numpy(), group["comp"].to_numpy(), [np.asarray(s, np.int64) for s in group["hashes"]], cross, min_percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype(group["doc"].dtype)

    return materialize(tiles.groupBy("value", "x", "y").applyInPandas(compare, schema), "near-links")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", min_percent: int = MIN_PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row; component_id is the smallest key reachable over links.

    Two documents are linked if their 5-word shingle sets have ``min_percent`` (MIN_PERCENT at least) of their union in common.

    Texts with equal shingle sets (copies) are one class, stood for by its smallest key. Sketches of the classes go
    into inverted lists; pairs from the lists are estimated, then compared on the full sets. Rows without words are
    linked with nothing. Rows with equal keys are one document (the first of the equal keys' sets counts for links);
    a null key stays null and alone. An empty table stays empty; other columns are ignored.
    """
    feats = materialize(shingle_sets(docs, key, text, SKETCH), "near-sketches")
    some = feats.where("n_shingles > 0 AND key IS NOT NULL")
    classes = materialize(some.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("key").alias("rep")), "near-classes")
    reps = some.join(classes.select(F.col("rep").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    reps = materialize(reps.select("key", "n_shingles", "hashes"), "near-reps")
    entries = materialize(postings(reps), "near-postings")
    sizes = entries.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("doc", "n")).alias("first")).where("size > 1")
    lists = join_counted(entries.select("value", "doc", "n"), materialize(sizes, "near-sizes"), "value", "size", entries.count())
    short = lists.where(F.col("size") <= SHORT_LIST).select("value", F.col("doc").alias("b"), F.col("n").alias("nb"))
    pairs = short.join(short.select("value", F.col("b").alias("a"), F.col("nb").alias("na")), "value").where(F.col("a") < F.col("b"))
    stars = lists.where((F.col("size") > SHORT_LIST) & (F.col("doc") != F.col("first.doc")))
    stars = stars.select(F.col("first.doc").alias("a"), F.col("doc").alias("b"), F.col("first.n").alias("na"), F.col("n").alias("nb"))
    pairs = pairs.select("a", "b", "na", "nb").unionAll(stars).where(_close("na", "nb", min_percent)).select("a", "b").distinct()
    links = materialize(verified(pairs, reps, docs, key, text, min_percent), "near-links")
    comp = components(links)
    more = long_list_links(lists.where(F.col("size") > SHORT_LIST).select("value", "doc", "n", "size"), comp, docs, key, text, min_percent)
    if more is not None and more.limit(1).count():
        comp = components(links.unionAll(more))
    out = feats.select("key", "n_shingles", "fp_a", "fp_b").join(classes, ["fp_a", "fp_b", "n_shingles"], "left")
    out = out.join(comp, out["rep"] == comp["node"], "left")
    out = out.select("key", "n_shingles", F.coalesce("comp", "rep", "key").alias("component_id"))
    return out.withColumn("kept", F.col("key").eqNullSafe(F.col("component_id")))


def op4_bottomk_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_components(docs, min_percent=QUERY_PERCENT).withColumnRenamed("key", "doc_id")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates (MIN_PERCENT), the one with the smallest doc_id.

    Rows without a doc_id, words or near-duplicates stay; rows of equal doc_id stay or go together; no rows, no rows.
    """
    with last_table_only(spark):
        out = materialize(near_components(docs).where("NOT kept").select("key").distinct(), "near-dropped")
    gone = fresh(docs, "gone")[0]
    return docs.join(sized(out.select(F.col("key").alias(gone))), F.col("doc_id") == F.col(gone), "left_anti")


OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {QUERY_PERCENT} * (x.n + y.n - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS node, b AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen
), low AS (
  SELECT node, min(seen) AS low FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.node = d.doc_id
"""
