"""Operator 10: benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, fresh, keys_within, last_table_only, materialize, sized, table, text_of

#: Fixed masks over nine tokens: each ignores every third position, so a hit survives substitutions there; each
#: position of a window is ignored by one of the masks.
MASKS = ("110110110", "101101101", "011011011")
SPAN = 9
#: Widths of plain windows beside the masks. With MIN_PERCENT of n tokens in place, some ``run_width(n)`` in a row are.
WIDTHS = (1, 2, 3, 4)
#: A document leaks an item if this share of the item's tokens is in place, on one alignment or, with tokens put in or
#: left out, on neighbouring ones; or if on one alignment this share of some LOCAL tokens of the item is.
MIN_PERCENT = 80
LOCAL = 13
#: Over several alignments, only tokens count that lie in NEAR tokens of which MIN_PERCENT are in place. Alignments are
#: neighbours if their shifts differ by NEAR_SHIFT tokens or by a fifth of the item's tokens at most.
NEAR = 5
NEAR_SHIFT = 5
#: Rows of hashed benchmark windows that one pass broadcasts; a larger benchmark is joined in several passes.
BLOCK_ROWS = 300_000
#: Items whose tokens may be broadcast for the comparison.
BROADCAST_ITEMS = 20_000


def tokens(text: str | Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    parts = F.filter(F.split(F.lower(text_of(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def run_width(n: Column) -> Column:
    """Tokens in a row, WIDTHS[-1] at most, that are in place wherever MIN_PERCENT of ``n`` tokens are (pigeonholes)."""
    wrong = F.floor(n * (100 - MIN_PERCENT) / 100)
    return F.least(F.ceil((n - wrong) / (wrong + 1)), F.lit(WIDTHS[-1])).cast("int")


def picks(widths: tuple[int, ...]) -> list[list[int]]:
    return [[i for i, bit in enumerate(m) if bit == "1"] for m in MASKS] + [list(range(w)) for w in widths]


def seeds(toks: Column, widths: tuple[int, ...]) -> Column:
    """Hashes of the windows under every mask and width; the index is place * (masks and widths) + which; null past the end."""

    def masked(a: Column, at: Column) -> Column:
        spans = [SPAN] * len(MASKS) + list(widths)
        return F.array(*(F.when(at + span <= F.size(a), F.xxhash64(F.lit(f"{span}:{pick}"), *(F.get(a, at + i) for i in pick))) for pick, span in zip(picks(widths), spans, strict=True)))

    none = F.expr("CAST(array() AS array<bigint>)")
    return bind(toks, lambda a: F.when(F.size(a) == 0, none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(a) - 1), lambda at: masked(a, at)))))


def seed_rows(df: DataFrame, key: str, text: str, name: str, widths: tuple[int, ...]) -> DataFrame:
    """(name, at, which, seed) of the texts; the tokens stay behind, as a copy of them in each row would grow with their square."""
    n = len(MASKS) + len(widths)
    rows = df.select(F.col(key).alias(name), F.posexplode(seeds(tokens(text), widths)).alias("i", "seed")).where("seed IS NOT NULL")
    return rows.select(name, F.floor(F.col("i") / n).cast("int").alias(f"{name}_at"), (F.col("i") % n).alias("which"), "seed")


def item_seeds(items: DataFrame, key: str, text: str) -> tuple[DataFrame, tuple[int, ...]]:
    """(item, item_at, seed): the masks of every item and the windows of its own run width; and the widths there are."""
    need = items.select(F.col(key).alias("item"), run_width(F.size(tokens(text))).alias("need")).where("need > 0").distinct()
    widths = tuple(sorted(r.need for r in need.select("need").distinct().collect()))
    width_of = F.get(F.array(*(F.lit(w) for w in (*([0] * len(MASKS)), *widths))), F.col("which"))
    rows = seed_rows(items, key, text, "item", widths).join(need, "item").where((F.col("which") < len(MASKS)) | (width_of == F.col("need")))
    return rows.select("item", "item_at", "seed"), widths


def in_place(doc: Column, item: Column, shift: Column) -> Column:
    """Per token of the item 1 if it is in place in the document, with the item's first token at ``shift``, else 0."""
    return F.transform(item, lambda x, j: F.coalesce((F.get(doc, j + shift) == x) & (j + shift >= 0), F.lit(False)).cast("int"))


def overlap(doc: Column, item: Column, shift: Column) -> Column:
    """Tokens of the item found in place in the document, with the item's first token at ``shift``."""
    return F.aggregate(in_place(doc, item, shift), F.lit(0), lambda acc, x: acc + x)


def window_sums(same: Column, width: Column) -> Column:
    """Sum of every window of ``width`` values; none if there are fewer."""
    none = F.expr("CAST(array() AS array<int>)")
    sums = F.transform(F.sequence(F.lit(0), F.size(same) - width), lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda acc, x: acc + x))
    return F.when(F.size(same) < width, none).otherwise(sums)


def near_places(same: Column, percent: int) -> Column:
    """Places of the tokens that are in place inside a window of NEAR tokens (or all, if fewer) of which ``percent`` are."""
    width = F.least(F.size(same), F.lit(NEAR))
    good = F.filter(F.transform(window_sums(same, width), lambda x, i: F.when(x * 100 >= width * percent, i)), lambda i: i.isNotNull())
    spread = F.array_distinct(F.flatten(F.transform(good, lambda i: F.sequence(i, i + width - 1))))
    return F.filter(spread, lambda j: F.get(same, j) == 1)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", min_percent: int = MIN_PERCENT) -> DataFrame:
    """One row a document and item that it leaks: doc_id, item_id, matched and item tokens, and the best alignment.

    Every window of SPAN tokens of the items is hashed under each mask, every window of its run width as it is, and both
    are joined with the windows of every document; each hit fixes an alignment, on which the whole item is compared token
    by token, so no alignment with ``min_percent`` (MIN_PERCENT at least) of an item in place is missed. Where no single
    alignment has that share, the tokens in place near others are added over neighbouring alignments; LOCAL tokens with
    that share in place are a leak, however long the item is. ``matched`` is of the best alignment if it has the share,
    else of the neighbours together. The benchmark is the query set: its windows are broadcast in blocks of BLOCK_ROWS
    rows at most, so documents are neither shuffled nor grouped; only documents with hits are read again. Items of fewer
    than five tokens leak where a document holds them word for word. Null or empty texts leak nowhere; repeated rows of
    a document or item count as one; rows with a null id are not reported. No items or no documents: no rows.
    """
    windows, widths = item_seeds(items, item_id, item_text)
    windows = materialize(windows.distinct(), "seeds")
    blocks = max(1, -(-windows.count() // BLOCK_ROWS))
    rows = seed_rows(docs, doc_id, text, "doc", widths)
    hits = None
    for k in range(blocks):
        block = windows if blocks == 1 else windows.where(F.pmod(F.hash("seed"), F.lit(blocks)) == k)
        found = rows.join(F.broadcast(block), "seed").select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        hits = found if hits is None else hits.unionAll(found)
    hits = materialize(hits.distinct(), "seed-hits")
    side = keys_within(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), hits.select("doc").distinct(), "doc")
    side = side.select("doc", tokens("text").alias("doc_tokens"))
    items = items.select(F.col(item_id).alias("item"), tokens(item_text).alias("item_tokens")).distinct()
    n_items = items.limit(BROADCAST_ITEMS + 1).count()
    pairs = hits.join(F.broadcast(items) if n_items <= BROADCAST_ITEMS else items, "item").join(side, "doc")
    n, percent = F.size("item_tokens"), F.lit(min_percent)
    pairs = pairs.withColumn("n", n).withColumn("matched", overlap(F.col("doc_tokens"), F.col("item_tokens"), F.col("shift")))
    pairs = pairs.where(F.col("matched") * 100 >= F.least("n", F.lit(NEAR)) * percent)
    same = in_place(F.col("doc_tokens"), F.col("item_tokens"), F.col("shift"))
    whole = F.col("matched") * 100 >= F.col("n") * percent
    local = bind(same, lambda a: F.coalesce(F.array_max(window_sums(a, F.lit(LOCAL))), F.lit(0)))
    pairs = materialize(pairs.select("doc", "item", "shift", "n", "matched", F.when(whole, F.lit(0)).otherwise(local).alias("local"), F.when(whole, F.expr("CAST(array() AS array<int>)")).otherwise(bind(same, lambda a: near_places(a, min_percent))).alias("places")), "seed-pairs")
    before = F.lag("shift").over(Window.partitionBy("doc", "item").orderBy("shift"))
    opens = F.coalesce(F.col("shift") - before > F.greatest(F.lit(NEAR_SHIFT), F.floor(F.col("n") / 5)), F.lit(True))
    pairs = pairs.withColumn("opens", opens.cast("int")).withColumn("turn", F.sum("opens").over(Window.partitionBy("doc", "item").orderBy("shift")))
    places = F.size(F.array_distinct(F.flatten(F.collect_list("places"))))
    turns = pairs.groupBy("doc", "item", "turn").agg(F.max(F.struct("matched", (-F.col("shift")).alias("back"), "n")).alias("top"), F.max("local").alias("local"), places.alias("near"))
    whole = F.col("top.matched") * 100 >= F.col("top.n") * percent
    turns = turns.where(whole | (F.col("near") * 100 >= F.col("top.n") * percent) | (F.col("local") * 100 >= LOCAL * percent))
    best = F.max(F.struct(whole.alias("whole"), F.when(whole, F.col("top.matched")).otherwise(F.greatest("top.matched", "near")).alias("matched"), "top.back", "top.n")).alias("best")
    best = turns.groupBy("doc", "item").agg(best)
    return best.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("best.matched").cast("long").alias("matched"), F.col("best.n").cast("long").alias("item_tokens"), (-F.col("best.back")).cast("long").alias("shift")
    )


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return leaks(docs, items)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that leak no benchmark item, with their columns as they are.

    Null and empty texts and rows without a doc_id stay; rows of one doc_id go together; without items all stay.
    """
    with last_table_only(spark):
        found = materialize(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    key = fresh(docs, "leak_id")[0]
    return docs.join(sized(found.select(F.col("doc_id").alias(key))), F.col("doc_id") == F.col(key), "left_anti")


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS doc FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS item FROM benchmark
), doc_at AS (
  SELECT doc_id, i, doc[i:i + {SPAN - 1}] AS w FROM (SELECT doc_id, doc, unnest(range(1, len(doc) - {SPAN - 2})) AS i FROM d)
), item_at AS (
  SELECT item_id, i, item[i:i + {SPAN - 1}] AS w FROM (SELECT item_id, item, unnest(range(1, len(item) - {SPAN - 2})) AS i FROM b)
), masks AS (
  SELECT unnest(range(3)) AS m
), doc_seed AS (
  SELECT doc_id, i, m, list_filter(w, lambda x, j: j % 3 <> (3 - m) % 3) AS s FROM doc_at, masks
), item_seed AS (
  SELECT item_id, i, m, list_filter(w, lambda x, j: j % 3 <> (3 - m) % 3) AS s FROM item_at, masks
), hits AS (
  SELECT DISTINCT doc_id, item_id, a.i - b.i AS shift FROM doc_seed a JOIN item_seed b ON a.m = b.m AND a.s = b.s
), scored AS (
  SELECT doc_id, item_id, shift, len(item) AS item_tokens,
    list_sum(list_transform(item, lambda x, j: CASE WHEN j + shift BETWEEN 1 AND len(doc) AND doc[j + shift] = x THEN 1 ELSE 0 END)) AS matched
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id)
)
SELECT doc_id, item_id, CAST(matched AS BIGINT) AS matched, CAST(item_tokens AS BIGINT) AS item_tokens, CAST(shift AS BIGINT) AS shift
FROM scored WHERE matched * 100 >= item_tokens * {MIN_PERCENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) = 1
"""
