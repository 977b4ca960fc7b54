"""Operator 7: exact repeated byte windows by depth-limited radix passes over suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, materialize, table, text_of
from .kernels import Spans, chunks, sliding_argmin

#: Bytes of a repeated window: suffixes are ordered through so many bytes and no further.
DEPTH = 100
#: The first digit of a suffix is the least-hashed gram of GRAM bytes in its first DEPTH bytes and the place of that
#: gram; equal windows have equal digits. Neighbouring suffixes share the gram, so one row (a run) stands for them all.
GRAM = 24
#: Runs of one digit that one task compares in the last pass; more are cut into parts that meet in a further pass.
PART = 8192
#: Windows that the last pass sorts at once.
WINDOWS_AT_ONCE = 1_500_000


def _runs(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, gram hash and content hash of the runs of a chunk."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < depth:
        return none
    spans = Spans(data)
    grams = spans.windows(GRAM)
    low = sliding_argmin(grams, depth - GRAM + 1)
    # windows that begin and end in one row
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row_of[: len(low)] == row_of[depth - 1 : depth - 1 + len(low)]
    begins = inside.copy()
    begins[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return none
    ends = inside.copy()
    ends[:-1] &= (low[1:] != low[:-1]) | ~inside[1:]
    last = np.flatnonzero(ends)
    # a run does not outlive its row: low lies in the window, and windows in its row
    row = row_of[first]
    return row, first - offsets[row], last - first + 1, grams[low[first]], spans.of(first, last + depth)


def first_pass(docs: DataFrame, depth: int) -> DataFrame:
    """Runs of all texts: digit, content (57 bits of the hash and the windows), key, start; own = repeats in its batch.

    In an Arrow batch, only the first run of each content goes on as a candidate; the others are known to repeat an
    earlier one, and their digit is replaced by a random one. So a passage of a third of all texts arrives at its
    digit as one row a batch.
    """
    kind = docs.schema["key"].dataType
    schema = T.StructType([T.StructField("digit", T.LongType()), T.StructField("content", T.LongType()), T.StructField("key", kind), T.StructField("start", T.IntegerType()), T.StructField("own", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row, _, data, offsets in chunks(batch.column(1)):
                r, start, n, gram, content = _runs(data, offsets, depth)
                parts.append((r + row, start, gram.view(np.int64), (content >> np.uint64(7) << np.uint64(7) | n.astype(np.uint64)).view(np.int64)))
            r, start, digit, content = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
            if not len(r):
                continue
            keys = batch.column(0)
            rank = np.empty(len(keys), np.int64)
            rank[np.asarray(pc.array_sort_indices(keys, null_placement="at_start"))] = np.arange(len(keys))
            order = np.lexsort((start, rank[r], content, digit))
            d, c = digit[order], content[order]
            own = np.zeros(len(r), bool)
            own[order[1:]] = (d[1:] == d[:-1]) & (c[1:] == c[:-1])
            digit = np.where(own, content ^ (start * 1_000_003 + r), digit)
            yield pa.RecordBatch.from_arrays([pa.array(digit), pa.array(content), keys.take(pa.array(r)), pa.array(start.astype(np.int32)), pa.array(own)], names=schema.names)

    return docs.mapInArrow(run, schema)


def second_pass(runs: DataFrame) -> DataFrame:
    """Rows to mark (repeated runs) and runs to compare, from runs sorted by (digit, own, content, key, start).

    A digit held by one run is done: nothing repeats it. Of equal contents all but the first are marked. The first runs
    of different contents of one digit must be compared window by window; they get parts of PART runs. The pass keeps
    a few numbers between batches, whatever the size of a digit's group.
    """
    kind = runs.schema["key"].dataType
    schema = T.StructType([T.StructField("digit", T.LongType()), T.StructField("key", kind), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("part", T.IntegerType())])

    def rows(digit, keys, start, windows, part) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(digit, pa.int64()), keys, pa.array(start, pa.int32()), pa.array(windows.astype(np.int32)), pa.array(part, pa.int32())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_digit = last_content = None
        index, held = 0, None  # contents of the last digit so far, and its only run while there is one
        for batch in batches:
            if not batch.num_rows:
                continue
            digit, content = (np.asarray(batch.column(i)) for i in range(2))
            keys, start = batch.column(2), np.asarray(batch.column(3))
            own = np.asarray(batch.column(4).cast(pa.uint8())).astype(bool)
            n = len(digit)
            prev_d = np.concatenate(([last_digit if last_digit is not None else ~digit[0]], digit[:-1]))
            prev_c = np.concatenate(([last_content if last_content is not None else ~content[0]], content[:-1]))
            prev_own = np.concatenate(([False], own[:-1]))
            new_digit = (digit != prev_d) | own | prev_own
            new_content = new_digit | (content != prev_c)
            # number of the content in its digit; the first digit may go on from the last batch
            counts = np.cumsum(new_content)
            opens = np.flatnonzero(new_digit)
            group = np.cumsum(new_digit)
            base = np.concatenate(([-index], counts[opens] - 1))
            number = counts - 1 - base[group]
            windows = content & 127
            marked = own | ~new_content
            if marked.any():
                at = np.flatnonzero(marked)
                yield rows(np.zeros(len(at), np.int64), keys.take(pa.array(at)), start[at], windows[at], np.full(len(at), -1))
            first = new_content & ~own
            later = first & (number > 0)
            # a digit's first run is compared if a second content follows
            second = np.flatnonzero(first & (number == 1))
            if len(second) and held is not None and group[second[0]] == 0:
                yield held
                held = None
            want = later.copy()
            firsts = np.flatnonzero(first & (number == 0))
            has_second = np.zeros(int(group[-1]) + 1, bool)
            has_second[group[second]] = True
            want[firsts[has_second[group[firsts]]]] = True
            if want.any():
                at = np.flatnonzero(want)
                yield rows(digit[at], keys.take(pa.array(at)), start[at], windows[at], number[at] // PART)
            if len(opens):
                held = None
                if len(firsts) and group[firsts[-1]] == group[-1] and not has_second[group[-1]]:
                    at = firsts[-1:]
                    held = rows(digit[at], keys.take(pa.array(at)), start[at], windows[at], np.zeros(1, np.int64))
            last_digit, last_content, index = (digit[-1], content[-1], int(number[-1]) + 1)

    sort = [F.col("digit"), F.col("own").desc(), F.col("content"), F.col("key").asc_nulls_first(), F.col("start")]
    return runs.repartition("digit").sortWithinPartitions(*sort).mapInArrow(run, schema)


def third_pass(contexts: DataFrame, depth: int) -> DataFrame:
    """Windows that repeat an earlier one of their digit and part: key, start, windows.

    ``contexts`` holds digit, part, wide, key, start and the bytes of each run's windows. The runs of a digit and part
    are compared on their windows' hashes, many digits at a time. Where a digit has several parts (wide), the windows
    that are first in their part are returned too, with their hash, for the part that has them earliest.
    """
    kind = contexts.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.IntegerType()), T.StructField("windows", T.IntegerType()), T.StructField("hash", T.LongType())])

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        keys, start = rows["key"].combine_chunks(), rows["start"].to_numpy()
        wide = rows["wide"].cast(pa.uint8()).to_numpy().astype(bool)
        data = rows["data"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        bytes_ = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = np.diff(offsets) - depth + 1
        run = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        hashes = Spans(bytes_).windows(depth)[offsets[run] + step]
        order = np.argsort(hashes, kind="stable")  # runs come in order of key and start
        ranked = hashes[order]
        again = np.zeros(len(run), bool)
        part = _group(rows)[run]
        again[order[1:]] = (ranked[1:] == ranked[:-1]) & (part[order[1:]] == part[order[:-1]])
        opens = again.copy()
        opens[1:] &= ~again[:-1] | (run[1:] != run[:-1])
        closes = again.copy()
        closes[:-1] &= ~again[1:] | (run[1:] != run[:-1])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        yield out(keys, start, run[first], step[first], last - first + 1, None)
        rest = np.flatnonzero(~again & wide[run])
        yield out(keys, start, run[rest], step[rest], np.ones(len(rest)), hashes[rest].view(np.int64))

    def out(keys, start, run, step, windows, hashes) -> pa.RecordBatch:
        hashes = pa.nulls(len(run), pa.int64()) if hashes is None else pa.array(hashes)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(run)), pa.array((start[run] + step).astype(np.int32)), pa.array(np.asarray(windows).astype(np.int32)), hashes], names=schema.names)

    def _group(rows: pa.Table) -> np.ndarray:
        digit, part = rows["digit"].to_numpy(), rows["part"].to_numpy()
        return np.cumsum(np.concatenate(([False], (digit[1:] != digit[:-1]) | (part[1:] != part[:-1]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if windows >= WINDOWS_AT_ONCE:
                # cut where a digit and part end
                digit, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                last = held[-1].slice(held[-1].num_rows - 1)
                same = (digit == last.column(0)[0].as_py()) & (part == last.column(1)[0].as_py())
                cut = len(same) if same.all() else int(np.argmin(same))
                if cut:
                    held.append(batch.slice(0, cut))
                if cut < batch.num_rows:
                    yield from compare(held)
                    held, windows = [], 0
                batch = batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                windows += batch.num_rows * (depth - GRAM) // 2
        if held:
            yield from compare(held)

    sort = ["digit", "part", F.col("key").asc_nulls_first(), "start"]
    return contexts.select("digit", "part", "wide", "key", "start", "data").repartition("digit", "part").sortWithinPartitions(*sort).mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, start, windows): runs of windows of ``depth`` bytes that also start earlier, of ``docs`` (key, text)."""
    found = materialize(second_pass(first_pass(docs, depth)), "repeats-runs")
    marks = found.where("part < 0").select("key", "start", "windows")
    asked = found.where("part >= 0")
    wide = asked.where("part > 0").select("digit").distinct()
    n_wide = wide.limit(BROADCAST_ROWS + 1).count()
    if n_wide:
        wide = wide.select("digit", F.lit(True).alias("wide"))
        asked = asked.join(F.broadcast(wide) if n_wide <= BROADCAST_ROWS else wide, "digit", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    else:
        asked = asked.withColumn("wide", F.lit(False))
    some = _only(docs, asked).select(F.col("key").alias("k"), F.col("text").cast("binary").alias("data"))
    span = F.substring(F.col("data"), F.col("start") + 1, F.col("windows") + (depth - 1))
    contexts = asked.join(some, F.col("key").eqNullSafe(F.col("k"))).withColumn("data", span)
    more = materialize(third_pass(contexts, depth), "repeats-windows")
    marks = marks.unionAll(more.where("hash IS NULL").select("key", "start", "windows"))
    if n_wide:
        rest = more.where("hash IS NOT NULL")
        first = rest.groupBy("hash").agg(F.min(F.struct("key", "start")).alias("first"))
        late = rest.join(first, "hash").where(~(F.col("key").eqNullSafe(F.col("first.key")) & (F.col("start") == F.col("first.start"))))
        marks = marks.unionAll(late.select("key", "start", "windows"))
    return marks


def _only(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key ``rows`` has (or has not); the keys are broadcast if they are counted to be few."""
    keys = rows.select(F.col("key").alias("only_key")).distinct()
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(keys) if small else keys, docs["key"].eqNullSafe(F.col("only_key")), how)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row, ``kept`` being the bytes left.

    A byte goes if a window of ``depth`` bytes that covers it also starts earlier: in a smaller key, or earlier in the
    same text. Matches do not cross texts and are judged on the input. A null text is empty, a null key is the
    smallest; texts shorter than ``depth`` stay whole; rows of one key lose what any of them loses. No rows, no rows.
    """
    docs = df.select(F.col(key).alias("key"), text_of(text).alias("text"))
    marks = materialize(repeated_windows(docs, depth), "repeats-marks")
    spans = marks.groupBy("key").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + (depth - 1)).alias("end"))).alias("spans"))
    hit = _only(docs, marks).join(spans.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).select("key", "text", "spans")
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, at, kept, n = text.as_py().encode(), 0, [], 0
                starts, ends = (np.asarray(spans.values.field(i)) for i in range(2))
                end = -1
                for i in np.argsort(starts, kind="stable"):
                    if starts[i] > end:
                        kept.append(data[max(end, 0) : starts[i]])
                        n += 1
                    end = max(end, int(ends[i]))
                kept.append(data[end:])
                left = b"".join(kept)
                rows.append((len(data), len(data) - len(left), n, left))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    zero = F.lit(0).cast("long")
    whole = _only(docs, marks, "left_anti").select("key", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionAll(hit.mapInArrow(cut, schema)).withColumnRenamed("key", key)


def op7_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


#: Every window of the bytes, as hex digits; windows are grouped by 128 bits of md5.
OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT doc_id, h, length(h) // 2 AS n_bytes FROM d
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, {2 * DEPTH}) AS s FROM (SELECT doc_id, h, unnest(range(n_bytes - {DEPTH - 1})) AS p FROM n WHERE n_bytes >= {DEPTH})
), later AS (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY md5_number(s) ORDER BY doc_id, p) > 1
), runs AS (
  SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -{2 * DEPTH}) > {DEPTH} AS opens FROM later
), spans AS (
  SELECT doc_id, min(p) AS first, max(p) + {DEPTH} AS last FROM (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, first, last, coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY first), 0) AS since FROM spans
), parts AS (
  SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (first - since)), '' ORDER BY first) || substr(any_value(h), 2 * max(last) + 1) AS rest
  FROM kept JOIN n USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM n LEFT JOIN parts USING (doc_id)
"""
