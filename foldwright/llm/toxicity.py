"""Operator 6: toxicity from subword-bag embeddings averaged into a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table
from .kernels import BASE, BASE_INVERSE, SPACES, chunks, finish, powers

#: Character n-grams of these lengths, inside a word with its boundary marks, and the words themselves.
GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIM = 8
#: Bound of the fitting sample: labelled rows, and code points of all of them and of one.
MAX_ROWS = 6_000
MAX_CHARS = 24_000_000
MAX_TEXT = 480_000
#: Passes over the sample, and mini-batches of the fit at least.
EPOCHS = 6
#: Bytes of text whose subwords a fit or a scoring task holds at once (a longer text is taken whole).
FIT_CHUNK = 1 << 18
MIN_STEPS = 50
#: Rows of the sample that must hold a bucket for it to take part: one of these, chosen on one row in INNER of the sample.
MIN_ROWS = (3, 10, 30, 60)
INNER = 4
BATCH_ROWS = 256
RATE = 0.02
THRESHOLD = 0.3
#: The average is multiplied by a constant before the softmax, so that rare subwords can reach it.
SCALE = 400.0
#: Subwords of value zero that every average holds besides its own, so that a few words are not judged like many.
PRIOR = 1000


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the subwords of the distinct words of lower-cased texts, one pair of arrays a kind of subword."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = lead[offsets]
    # one space before, between and after the rows: word boundary marks
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    text = np.full(len(points) + len(at), 32, np.uint32)
    text[np.arange(len(points)) + rows + 1] = points
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)
    owner = np.concatenate((owner, owner[-1:]))
    space = np.isin(text, np.array(SPACES, np.uint32))
    text = np.where(space, 32, text).astype(np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(finish(text + np.uint64(1)) * powers(BASE, len(text)))))
    inverse = powers(BASE_INVERSE, len(text) + 1)

    def bucket(first: np.ndarray, width, bits: int = BUCKET_BITS) -> np.ndarray:
        value = finish((prefix[first + width] - prefix[first]) * inverse[first] + np.asarray(width, np.uint64))
        return (value >> np.uint64(64 - bits)).astype(np.int64)

    space = text == 32
    spaces = np.concatenate(([0], np.cumsum(space)))
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    words = bucket(starts - 1, ends - starts + 2, 40)
    _, once = np.unique(words << 24 | owner[starts], return_index=True)
    starts, ends = starts[once], ends[once]
    # places a gram may begin at: the mark before a word that counts, or a place in it
    inside = np.zeros(len(text) + 1, np.int8)
    np.add.at(inside, starts - 1, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:-1] > 0
    for n in GRAMS:
        last = len(text) - n + 1
        if last > 0:
            first = np.flatnonzero((spaces[n - 1 : n - 1 + last] == spaces[1 : 1 + last]) & inside[:last])
            yield owner[first + 1], bucket(first, n)
    yield owner[starts], bucket(starts - 1, ends - starts + 2)


def lowered_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of FIT_CHUNK bytes of the texts in lower case (a longer text is one chunk), lowered one by one."""
    for row, end, _, _ in chunks(texts, FIT_CHUNK):
        part = pc.utf8_lower(texts.slice(row, end - row).fill_null(""))
        yield row, end, *next(chunks(part, max(1, part.nbytes)))[2:]


@dataclass
class Model:
    """Embedding rows and softmax weights; ``value`` folds them into one number a bucket, as the average is linear."""

    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def value(self) -> np.ndarray:
        return (self.embedding @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def margin(self) -> float:
        return float(self.bias[1] - self.bias[0])


@dataclass
class Bag:
    """The buckets of a text's subwords, how often it has each, and all its subwords."""

    buckets: np.ndarray
    times: np.ndarray
    size: int


def bags(texts: pa.Array) -> list[Bag]:
    out = []
    for _, _, data, offsets in lowered_chunks(texts):
        row, bucket = (np.concatenate(x) for x in zip(*subwords(data, offsets), strict=True))
        keys, times = np.unique(row << BUCKET_BITS | bucket, return_counts=True)
        ends = np.searchsorted(keys, np.arange(len(offsets)) << BUCKET_BITS)
        sizes = np.bincount(row, minlength=len(offsets) - 1)
        buckets, times = (keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32), times.astype(np.float32)
        out += [Bag(buckets[a:b].copy(), times[a:b].copy(), int(n)) for a, b, n in zip(ends[:-1], ends[1:], sizes, strict=True)]
    return out


def trained(held: list[Bag], labels: np.ndarray, min_rows: int, seed: int) -> Model:
    """Embeddings, weights and bias together, by Adam on mini-batches of the softmax loss, over the buckets that
    ``min_rows`` of the texts hold at least."""
    rng = np.random.RandomState(seed)
    size = 1 << BUCKET_BITS
    params = {
        "embedding": np.zeros((size, DIM), np.float32),  # an unseen subword has no say
        "weights": rng.normal(0, DIM**-0.5, (DIM, 2)).astype(np.float32),
        "bias": np.zeros(2, np.float32),
    }
    share = np.clip(labels.mean() if len(held) else 0.0, 1e-3, 1 - 1e-3)
    params["bias"][:] = np.log([1 - share, share])
    rows = np.zeros(size, np.int64)
    for bag in held:
        rows[bag.buckets] += 1
    often = rows >= min_rows

    def part(bag: Bag) -> tuple[np.ndarray, np.ndarray]:
        known = often[bag.buckets]
        return bag.buckets[known], bag.times[known] * np.float32(SCALE / (bag.size + PRIOR))

    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(v) for k, v in params.items()}
    order = np.zeros(0, np.int64)
    steps = max(MIN_STEPS, EPOCHS * len(held) // BATCH_ROWS) if held else 0
    for step in range(1, steps + 1):
        if len(order) < BATCH_ROWS:
            order = np.concatenate((order, rng.permutation(len(held))))
        rows, order = order[:BATCH_ROWS], order[BATCH_ROWS:]
        batch = [part(held[r]) for r in rows]
        hidden = np.stack([share @ params["embedding"][cols] for cols, share in batch])
        logits = hidden @ params["weights"] + params["bias"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(rows)), labels[rows]] -= 1
        prob /= len(rows)
        # of two classes the one's gradient is the other's turned round, so all of a bucket's go along one direction
        pull = np.zeros(size, np.float32)
        for (cols, share), p in zip(batch, prob[:, 1].astype(np.float32), strict=True):
            pull[cols] += share * p
        direction = params["weights"][:, 1] - params["weights"][:, 0]
        grads = {"embedding": pull[:, None] * direction[None, :], "weights": hidden.T @ prob, "bias": prob.sum(0)}
        for k, g in grads.items():
            m[k] += (g - m[k]) * 0.1
            v[k] += (g * g - v[k]) * 0.001
            params[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    params["embedding"] = params["embedding"] * SCALE
    return Model(**params)


def bag_scores(held: list[Bag], model: Model) -> np.ndarray:
    value = model.value()
    means = np.array([float(value[bag.buckets] @ bag.times) / (bag.size + PRIOR) for bag in held])
    return 1 / (1 + np.exp(-(means + model.margin())))


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> Model:
    """A model of the sample; without one, all scores are low.

    Rare subwords let a fit learn its rows by heart. How many rows must hold a subword is therefore chosen among
    MIN_ROWS: each is fitted without one row in INNER, and that of the lowest softmax loss on these rows is fitted to all.
    """
    held = bags(texts)
    del texts
    inner = np.arange(len(held)) % INNER == INNER - 1
    best, least = MIN_ROWS[0], np.inf
    if len(set(labels[inner])) == 2 and len(set(labels[~inner])) == 2:
        mine, others = [h for h, i in zip(held, inner, strict=True) if i], [h for h, i in zip(held, inner, strict=True) if not i]
        for rows in MIN_ROWS:
            p = np.clip(bag_scores(mine, trained(others, labels[~inner], rows, seed)), 1e-6, 1 - 1e-6)
            loss = float(-np.log(np.where(labels[inner] == 1, p, 1 - p)).mean())
            if loss < least:
                best, least = rows, loss
    return trained(held, labels, best, seed)


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[pa.Array, np.ndarray, float]:
    """The fitting sample and the log odds of label 1 in all labels.

    The sample has MAX_ROWS keys at most, half of them or more (if there are so many) of label 1, the first of each label
    by hash. In that order, a text is passed over if it is longer than MAX_TEXT or than what is left of MAX_CHARS. Sizes
    are read first, one a key, so only the texts of the sample reach the driver. Null labels and keys do not count; of
    several labels of a key the largest does, of several texts the one with the smallest hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    count = {0: 0, 1: 0} | {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones = min(count[1], max(MAX_ROWS // 2, MAX_ROWS - count[0]))
    first = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    chosen = first(1, ones).unionAll(first(0, MAX_ROWS - ones))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    sizes = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("t"), F.char_length("t").alias("n"))).alias("text"))
    kept, left = [], MAX_CHARS
    for r in sizes.orderBy(F.xxhash64("k"), "k").collect():
        if r.text.n <= min(left, MAX_TEXT):
            kept.append((r.k, r.y, r.text.t))
            left -= r.text.n
    odds = float(np.log((count[1] + 0.5) / (count[0] + 0.5)))
    if not kept:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), odds
    keep = docs.sparkSession.createDataFrame(kept, T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("y", T.IntegerType()), T.StructField("h", T.LongType())]))
    found = texts.join(F.broadcast(keep), "k").where(F.xxhash64("t") == F.col("h")).dropDuplicates(["k"])
    rows = found.select(F.xxhash64("k").alias("h"), "k", "t", "y").toArrow().sort_by([("h", "ascending"), ("k", "ascending")])
    return rows["t"].cast(pa.large_string()).combine_chunks(), rows["y"].to_numpy().astype(np.int64), odds


def scores(texts: pa.Array, value: np.ndarray, margin: float) -> np.ndarray:
    """Scores of a batch of whole texts; a text without subwords has the score of the bias."""
    out = [np.zeros(0)]
    for row, end, data, offsets in lowered_chunks(texts):
        total, times = np.zeros(end - row), np.full(end - row, float(PRIOR))
        for owner, bucket in subwords(data, offsets):
            total += np.bincount(owner, value[bucket], end - row)
            times += np.bincount(owner, minlength=end - row)
        out.append(1 / (1 + np.exp(-(total / times + margin))))
    return np.concatenate(out)


def score(df: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, score) of every row: the softmax of the averaged subword vectors of the whole text.

    Equal texts get equal scores; a null or empty text, or one without a known subword, gets that of the bias. Rows of
    equal or null key are scored each for itself; no rows, no rows; other columns are ignored.
    """
    value, margin = model.value(), model.margin()
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), value, margin))], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def held_out(key: str):
    """Whether the crc32 of the key as text leaves 2 modulo 4: labels of these rows are never read."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def toxicity_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    texts, marks, odds = sample(docs, labels.where(~held_out(key)), key, text, label)
    ones, n = int(marks.sum()), len(marks)
    model = fit(texts, marks)
    del texts
    pa.default_memory_pool().release_unused()
    if n:  # label 1 is more frequent in the sample than in all labels
        model.bias[1] += odds - np.log((ones + 0.5) / (n - ones + 0.5))
    return model


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document; a null doc_id is not held out. Without labels all scores are low."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, "doc_id", "text").withColumnRenamed("key", "doc_id")
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_score(df: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``df`` with the score as a column, computed batch by batch beside the row; a column of that name is replaced."""
    value, margin = model.value(), model.margin()

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, value, margin))

    return df.withColumn(name, scored(F.col(text).cast("string")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with a score under THRESHOLD, with their columns as they are.

    Null texts and texts without a word stay whatever the share of label 1, as nothing in them speaks against them; equal
    texts stay or go together; no documents, no rows.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")[0]
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return with_score(docs, model, "text", name).where(blank | (F.col(name) < THRESHOLD)).drop(name)
