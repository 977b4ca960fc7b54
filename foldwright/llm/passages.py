"""Operator 3: near-duplicate passages by compact windows over token min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_counted, materialize, sized, table, text_of
from .components import components
from .kernels import chunks, finish, shingles, sliding_argmin

#: Tokens are 5-word shingles; a passage has 50 words, 46 shingles, at least, and a similarity of MIN_SIMILARITY.
LEAST = 46
MIN_SIMILARITY = 0.8
#: Hash functions, and how many must agree at one place. A pair at 80 % agrees on 4.8 of 6 in the mean; the odds that
#: fewer than 2 agree are 0.0016, and exact copies always agree on all.
FUNCTIONS = 6
AGREE = 2
#: Shingles without a partner that a passage may hold in a row, from the longest stretch tried to the plainest: a
#: changed word spoils 5, two near ones 10.
GAPS = (12, 5, 0)
#: How often the stretches are screened for shingles that other classes hold, as each time fewer of them hold a shingle.
SCREENS = 1
#: How often the members of a list meet one of its largest class, before those still outside meet all.
STARS = 1
#: Lists of so many pairs at most, of its outsiders and all its documents, give them as rows; longer ones are compared in
#: blocks of about so many documents or shingles.
SHORT_LIST = 1024
BLOCK = 256
BLOCK_SHINGLES = 1 << 18
#: Pairs of one list that a task compares at once; a list of more is dealt over several groups.
TILE_PAIRS = 2048


def compact_windows(values: np.ndarray, row_ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places c, left and right ends of the nodes of the Cartesian tree of ``values`` that span ``least`` tokens.

    All passages inside [left, right] that hold c have c's value as min-hash. ``values`` must be 0 at ``row_ends``, which
    no other value is, so no node reaches over a row's end. A node spans ``least`` tokens just if it is the smallest of
    one window of that width; its ends are found by doubling steps over minima of 2 ** j values. Of equal values, whose
    windows lie inside each other, the first counts.
    """
    none = np.zeros(0, np.int64)
    low = sliding_argmin(values, least)
    if not len(low):
        return none, none, none
    c = np.unique(low)
    c = c[values[c] != 0]
    own = values[c]
    levels = [values]
    while (1 << len(levels)) < len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    right, left = c.copy(), c.copy()
    for j in range(len(levels) - 1, -1, -1):
        size, mins = 1 << j, levels[j]
        at = right + 1
        ok = at + size <= len(values)
        ok[ok] = mins[at[ok]] >= own[ok]
        right[ok] += size
        at = left - size
        ok = at >= 0
        ok[ok] = mins[at[ok]] > own[ok]
        left[ok] -= size
    # right of an equal value, a window lies inside that value's own
    own_first = (left == 0) | (values[left - 1] != own)
    return c[own_first], left[own_first], right[own_first]


def window_rows(docs: DataFrame, least: int) -> DataFrame:
    """(group, key, lo, hi) of all compact windows of (key, text); group is the function and its min-hash."""
    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("key", docs.schema["key"].dataType), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                hashes, at, _, _ = shingles(data, offsets)
                n = np.diff(at)
                # one zero after each row
                place = np.arange(len(hashes)) + np.repeat(np.arange(len(n)), n)
                starts, ends = (at[i : i + len(n)] + np.arange(len(n)) for i in (0, 1))
                keys = batch.column(0).slice(row, end - row)
                for k in range(FUNCTIONS):
                    values = np.zeros(len(hashes) + len(n), np.uint64)
                    values[place] = finish(hashes + np.uint64(k + 1)) | np.uint64(1)
                    c, lo, hi = compact_windows(values, ends, least)
                    r = np.searchsorted(ends, c)
                    group = (values[c] >> np.uint64(3) << np.uint64(3) | np.uint64(k)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(group), keys.take(pa.array(r)), *(pa.array((x - starts[r]).astype(np.int32)) for x in (lo, hi))], names=schema.names)

    return docs.mapInArrow(run, schema)


def stars(windows: DataFrame) -> DataFrame:
    """(group, a, a_lo, a_hi, b, lo, hi): every window of a group beside the group's first one (in order of key, place).

    The window function keeps one row a group, however many there are. A passage of a third of all texts gives its group
    a third of the texts, which is about 0.2 % of all windows.
    """
    order = Window.partitionBy("group").orderBy("key", "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = windows.withColumn("first", F.first(F.struct("key", "lo", "hi")).over(order)).where(F.col("key") != F.col("first.key"))
    return rows.select("group", F.col("first.key").alias("a"), F.col("first.lo").alias("a_lo"), F.col("first.hi").alias("a_hi"), F.col("key").alias("b"), "lo", "hi")


def agreeing(k: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Interval join: the stretches that windows (function k, lo to hi) of ``need`` functions cover."""
    order = np.argsort(lo, kind="stable")
    events = sorted([(x, 1, f) for f, x in zip(k[order].tolist(), lo[order].tolist(), strict=True)] + [(x + 1, -1, f) for f, x in zip(k.tolist(), hi.tolist(), strict=True)], key=lambda e: e[:2])
    depth, have, start, out = [0] * FUNCTIONS, 0, None, []
    for at, sign, f in events:
        depth[f] += sign
        have += int(sign > 0 and depth[f] == 1) - int(sign < 0 and depth[f] == 0)
        if have >= need and start is None:
            start = at
        elif have < need and start is not None:
            out.append((start, at - 1))
            start = None
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """The union of the intervals lo to hi, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist(), strict=True)):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _stretches(places: np.ndarray, gap: int, least: int) -> list[tuple[int, int]]:
    """First and last of the runs of sorted places that are at most ``gap`` apart and span ``least`` places."""
    cuts = np.flatnonzero(np.diff(places) > gap + 1)
    first, last = places[np.concatenate(([0], cuts + 1))], places[np.concatenate((cuts, [len(places) - 1]))]
    ok = last - first + 1 >= least
    return list(zip(first[ok].tolist(), last[ok].tolist(), strict=True))


def _widened(start: int, end: int, least: int, size: int) -> tuple[int, int]:
    """The stretch, grown to ``least`` places where ``size`` allows: changed words at its ends belong to it."""
    start = max(0, min(start, end - least + 1))
    return start, min(size - 1, max(end, start + least - 1))


def fewest_shared(least: int) -> int:
    """Shingles that two passages of ``least`` shingles share at MIN_SIMILARITY."""
    return int(np.ceil(2 * least * MIN_SIMILARITY / (1 + MIN_SIMILARITY)))


def matches(a: np.ndarray, b: np.ndarray, least: int = LEAST, kind: str | None = None) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of two shingle sequences: ends in b and in a (inclusive), and the exact Jaccard similarity.

    Stretches of b whose shingles occur in a are set against the stretches of a that hold these shingles, the longest
    first, until one is similar enough. Stretches may end in changed words, up to ``least`` shingles. Those with long gaps
    are tried first; what they do not settle is tried again with shorter ones. ``kind`` is that of ``np.isin``.
    """
    out: list[tuple[int, int, int, int, float]] = []
    fewest = fewest_shared(least)
    places = np.flatnonzero(np.isin(b, a, kind=kind))
    if len(places) < fewest - 1:
        return out
    for gap in GAPS:
        for start, end in _stretches(places, gap, fewest):
            start, end = _widened(start, end, least, len(b))
            if end - start + 1 < least or any(s <= end and start <= e for s, e, *_ in out):
                continue
            mine = np.unique(b[start : end + 1])
            # the similarity is at most the share of this side's shingles that the other one holds
            if np.searchsorted(places, end, "right") - np.searchsorted(places, start) < MIN_SIMILARITY * len(mine):
                continue
            there = np.flatnonzero(np.isin(a, mine, kind=kind))
            for low, high in sorted(_stretches(there, gap, fewest), key=lambda x: x[0] - x[1]):
                low, high = _widened(low, high, least, len(a))
                if high - low + 1 < least:
                    continue
                theirs = np.unique(a[low : high + 1])
                both = len(np.intersect1d(mine, theirs, assume_unique=True))
                similar = both / (len(mine) + len(theirs) - both)
                if similar >= MIN_SIMILARITY:
                    out.append((start, end, low, high, similar))
                    break
    return out


def sequences(docs: DataFrame) -> DataFrame:
    """(key, seq): the shingles of (key, text) in order, as 32 bits of their hashes."""
    schema = T.StructType([T.StructField("key", docs.schema["key"].dataType), T.StructField("seq", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                hashes, at, _, _ = shingles(data, offsets)
                short = (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(short))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _hit_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", kind), T.StructField("match", kind), *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "match_start", "match_end")), T.StructField("similarity", T.DoubleType())])


def verified(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Passages of the pairs (a, b, spots), where the windows of AGREE functions in spots agree."""
    need = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
    seqs = materialize(sequences(only(docs, need)).dropDuplicates(["key"]), "passage-sequences")
    left = seqs.select(F.col("key").alias("a"), F.col("seq").alias("a_seq"))
    right = seqs.select(F.col("key").alias("b"), F.col("seq").alias("b_seq"))
    ends = {"a_from": F.array_min(F.col("spots.a_lo")), "a_to": F.array_max(F.col("spots.a_hi")), "b_from": F.array_min(F.col("spots.lo")), "b_to": F.array_max(F.col("spots.hi"))}
    # only the stretches that the spots cover are shuffled and compared
    cut = lambda side: F.slice(f"{side}_seq", F.col(f"{side}_from") + 1, F.col(f"{side}_to") - F.col(f"{side}_from") + 1)
    full = pairs.withColumns(ends).join(left, "a").withColumn("a_seq", cut("a")).join(right, "b").withColumn("b_seq", cut("b"))
    schema = _hit_schema(docs.schema["key"].dataType)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            spot_at, spots = np.asarray(rows.column(2).offsets), rows.column(2).values
            k, lo, hi = (np.asarray(spots.field(i)) for i in range(3))
            (a_at, a_all), (b_at, b_all) = ((np.asarray(rows.column(i).offsets), np.asarray(rows.column(i).values)) for i in (5, 6))
            a_from, b_from = np.asarray(rows.column(3)), np.asarray(rows.column(4))
            out = []
            for i in range(rows.num_rows):
                x = slice(spot_at[i], spot_at[i + 1])
                a_seq, b_seq = a_all[a_at[i] : a_at[i + 1]], b_all[b_at[i] : b_at[i + 1]]
                for start, end in agreeing(k[x], lo[x], hi[x], AGREE):
                    own = b_seq[start - b_from[i] : end + 1 - b_from[i]]
                    for s, e, ms, me, similar in matches(a_seq, own, least):
                        out.append((i, start + s, start + e + 5, a_from[i] + ms, a_from[i] + me + 5, similar))
            if out:
                at, *cols, similar = (np.array(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(at)), rows.column(0).take(pa.array(at)), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(similar)], names=schema.names)

    return full.select("a", "b", "spots", "a_from", "b_from", "a_seq", "b_seq").mapInArrow(verify, schema).distinct()


def open_stretches(star: DataFrame, comp: DataFrame, least: int) -> DataFrame:
    """(doc, comp, los, his): stretches of documents that AGREE (two) functions hold together with another component.

    A group all of whose documents are in one component is settled. Of the others, two windows of different functions
    that overlap by ``least`` shingles give a stretch of the document; stretches that touch are one. Two documents of
    different components that agree twice at one place have it in such a stretch each.
    """
    names = comp.select(F.col("node").alias("n"), "comp")
    of = lambda rows, side: rows.join(sized(names), F.col(side) == F.col("n"), "left").withColumn(f"c{side}", F.coalesce("comp", side)).drop("n", "comp")
    rows = materialize(of(of(star, "a"), "b"), "passage-star-comps")
    # a group of two is settled by its one pair
    unsettled = rows.groupBy("group").agg(F.count("*").alias("n"), F.max(F.col("ca") != F.col("cb")).alias("out")).where("n > 1 AND out").select("group")
    rows = materialize(rows.join(sized(unsettled), "group", "left_semi"), "passage-open")
    firsts = rows.groupBy("group").agg(*(F.first(c).alias(c) for c in ("a", "a_lo", "a_hi", "ca")))  # equal in all rows of a group
    members = rows.select(F.col("b").alias("doc"), F.col("cb").alias("comp"), "group", "lo", "hi").unionAll(firsts.select("a", "ca", "group", "a_lo", "a_hi"))
    per = members.groupBy("doc", "comp").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "group"))).alias("x"))
    kind = star.schema["b"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("comp", kind), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("los", "his"))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, x = np.asarray(batch.column(2).offsets), batch.column(2).values
            have, ends = [], ([], [])
            for d in range(batch.num_rows):
                lo, hi, group = (np.asarray(x.field(i))[offsets[d] : offsets[d + 1]] for i in range(3))
                group = group.view(np.uint64)
                # windows come in order of lo; those that begin early enough for an overlap follow at once
                n = np.maximum(np.searchsorted(lo, hi - least + 1, "right") - np.arange(len(lo)) - 1, 0)
                i = np.repeat(np.arange(len(lo)), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                ok = (np.minimum(hi[i], hi[j]) - lo[j] + 1 >= least) & ((group[i] ^ group[j]) & np.uint64(7) != 0)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                order = np.argsort(lo[j])
                at, reach = lo[j][order], np.maximum.accumulate(np.minimum(hi[i], hi[j])[order])
                cuts = np.flatnonzero(at[1:] > reach[:-1] + 1)
                have.append(d)
                ends[0].append(at[np.concatenate(([0], cuts + 1))].tolist())
                ends[1].append(reach[np.concatenate((cuts, [len(at) - 1]))].tolist())
            at = pa.array(have, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(e, pa.list_(pa.int32())) for e in ends)], names=schema.names)

    return materialize(per.mapInArrow(combine, schema), "passage-stretches")


def stretch_shingles(stretches: DataFrame, docs: DataFrame) -> DataFrame:
    """(comp, doc, lo, seq): the hashes of the shingles of each stretch, in order.

    Of a component's stretches with the same words the first stays: the others link to no other document.
    """
    rows = docs.join(sized(stretches), docs["key"] == F.col("doc")).select("doc", "comp", "los", "his", "text")
    kind = stretches.schema["doc"].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("comp", kind), T.StructField("lo", T.IntegerType()), T.StructField("seq", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, los, his = np.asarray(batch.column(2).offsets), np.asarray(batch.column(2).values), np.asarray(batch.column(3).values)
            for row, end, data, offsets in chunks(batch.column(4)):
                hashes, at, _, _ = shingles(data, offsets)
                n = np.diff(ends[row : end + 1])
                of = np.repeat(np.arange(end - row), n)
                lo, hi = (x[ends[row] : ends[end]] for x in (los, his))
                cut = [hashes[x:y].view(np.int64) for x, y in zip(at[of] + lo, np.minimum(at[of] + hi + 1, at[of + 1]), strict=True)]
                sizes = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int32)
                seq = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.zeros(0, np.int64), *cut])))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row).take(pa.array(of)) for i in (0, 1)), pa.array(lo), seq], names=schema.names)

    rows = rows.mapInArrow(run, schema)
    once = rows.groupBy("comp", F.xxhash64("seq").alias("words")).agg(F.min(F.struct("doc", "lo", "seq")).alias("first"))
    return materialize(once.select("comp", "first.*"), "passage-shingles")


def distinct_counts(seq: np.ndarray, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each stretch of ``least`` places has, and how many of them are ``held``."""
    n = len(seq) - least + 1
    before, place = before_of(seq), np.arange(len(seq))
    # the first place of a shingle counts in the stretches that begin after the place before
    first, last = np.maximum(before + 1, np.maximum(place - least + 1, 0)), np.minimum(place, n - 1)
    out = []
    for ok in (first <= last, (first <= last) & held):
        out.append(np.cumsum(np.bincount(first[ok], minlength=n + 1) - np.bincount(last[ok] + 1, minlength=n + 1))[:n])
    return out[0], out[1]


def before_of(seq: np.ndarray) -> np.ndarray:
    """The place before of each place's shingle, or -1."""
    order = np.argsort(seq, kind="stable")
    before = np.full(len(seq), -1)
    again = np.flatnonzero(seq[order][1:] == seq[order][:-1])
    before[order[again + 1]] = order[again]
    return before


def roles(seq: np.ndarray, rank: np.ndarray, n_held: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(few, probe) of the open shingles of a stretch, by rank; closed places have the highest rank there can be.

    ``few`` is the least number of different shingles of a passage that can link and hold the shingle, 0 for none;
    ``least`` stands for that and more. ``probe`` is the largest such number for which the shingle is a probe, 0 for none.

    Of a passage at least MIN_SIMILARITY of the different shingles are open, and of the one of two linked passages that has
    fewer different ones 8 / 9 are shared. Of a passage of ``least`` different shingles or more, take the first place of
    each: some ``least`` of these in a row lack misses_at_best at most. Which places are first hangs on where the passage
    begins, but those that are first in the stretch always are, so the row ends at the ``least``-th of them. Of a passage
    of fewer different shingles, all count. The rarest open ones beyond those that may be missed are the probes.
    """
    closed = np.iinfo(rank.dtype).max
    few, probe = np.zeros(n_held, np.int32), np.zeros(n_held, np.int32)
    n, before = len(seq), before_of(seq)
    after = np.full(n, 2 * n + least)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    place, is_open = np.arange(n), rank != closed
    every, those = distinct_counts(seq, is_open, least)
    # of fewer shingles; a passage that can begin a place earlier without a further shingle is tried from there
    may = (every < least) & (every - those <= (1 - MIN_SIMILARITY) * least)
    may[1:] &= after[: len(may) - 1] - place[1 : len(may)] >= least
    for p in np.flatnonzero(may).tolist():
        new = p + np.flatnonzero(before[p:] < p)[:least]
        m = np.arange(1, min(len(new), least - 1) + 1)
        ranks = rank[new[: len(m)]]
        held = np.cumsum(ranks != closed)
        # passages from p with m different shingles end before the next new one
        long = np.append(new[1:], n)[: len(m)] - p >= least
        need = np.ceil(2 * MIN_SIMILARITY / (1 + MIN_SIMILARITY) * m - 1e-9).astype(int)
        for k in np.flatnonzero(long & (held >= MIN_SIMILARITY * m - 1e-9)).tolist():
            low = np.sort(ranks[: k + 1])[: held[k]]
            few[low] = np.where(few[low] > 0, np.minimum(few[low], k + 1), k + 1)
            low = low[: max(held[k] - need[k] + 1, 0)]
            probe[low] = np.maximum(probe[low], k + 1)
    firsts = np.flatnonzero(before < 0)
    if len(firsts) < least:
        return few, probe
    fewest, some = least - misses_at_best(least), least - misses_at_best(least, 1 - MIN_SIMILARITY)
    at = np.cumsum(before < 0) - (before < 0) + least
    end = np.where(at <= len(firsts), firsts[np.minimum(at, len(firsts)) - 1] + 1, n)
    opened = np.concatenate(([0], np.cumsum(is_open)))
    left = np.cumsum((after > n)[::-1])[::-1]
    tried = (left >= least) & (opened[end] - opened[:-1] >= some)
    plain = np.flatnonzero(tried & (end - place == least))
    can = bool(len(plain))
    if can:
        low = np.sort(np.lib.stride_tricks.sliding_window_view(rank, least)[plain], axis=1)
        probe[low[np.arange(least)[None, :] < ((low != closed).sum(axis=1) - fewest + 1)[:, None]]] = least
    for p in np.flatnonzero(tried & (end - place > least)).tolist():
        low = np.unique(rank[p : end[p]])
        low = low[low != closed]
        can |= len(low) >= some
        probe[low[: max(len(low) - fewest + 1, 0)]] = least
    if can:
        few[few == 0] = least
    return few, probe


def screened(rows: DataFrame, least: int) -> DataFrame:
    """The stretches that can link to another component: (comp, doc, lo, seq) with their open shingles and the roles of these.

    Only shingles of several components are open, and of these only those that a passage which can link holds are
    ``held``, the rarest first. Two linked stretches share one that is a probe of the one whose passage has fewer different
    shingles; the other one's passage has a quarter more at most (``roles``).
    """
    each = rows.select("comp", "doc", "lo", F.explode(F.array_distinct("seq")).alias("token"))
    found = each.groupBy("token").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    found = materialize(found.select("token", "size"), "passage-open-tokens")
    held = each.join(sized(found), "token").groupBy("doc", "lo").agg(F.sort_array(F.collect_list(F.struct("size", "token"))).alias("held"))
    held = held.select("doc", "lo", F.col("held.token").alias("held"))
    full = rows.join(held, ["doc", "lo"]).select("comp", "doc", "lo", "seq", "held")
    schema = T.StructType([*full.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("few", "probe"))])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (seq_at, seqs), (held_at, tokens) = ((np.asarray(batch.column(i).offsets), np.asarray(batch.column(i).values)) for i in (3, 4))
            keep, out = [], ([], [], [])
            for r in range(batch.num_rows):
                seq, held = seqs[seq_at[r] : seq_at[r + 1]], tokens[held_at[r] : held_at[r + 1]]
                if len(seq) < least:
                    continue
                order = np.argsort(held)
                rank = order[np.minimum(np.searchsorted(held, seq, sorter=order), len(held) - 1)]
                rank = np.where(held[rank] == seq, rank, np.iinfo(rank.dtype).max)
                few, probe = roles(seq, rank, len(held), least)
                if few.any():
                    keep.append(r)
                    for x, y in zip(out, (held, few, probe), strict=True):
                        x.append(y[few > 0])
            at = pa.array(keep, pa.int64())
            cols = [pa.array(x, pa.list_(kind)) for x, kind in zip(out, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), *cols], names=schema.names)

    return materialize(full.mapInArrow(screen, schema), "passage-screened")


def misses_at_best(least: int, share: float = (1 - MIN_SIMILARITY) / (1 + MIN_SIMILARITY)) -> int:
    """Shingles that some ``least`` places in a row of a passage lack, at most, if it lacks ``share`` of all.

    The shorter of two linked passages lacks a ninth (at the similarity of 0.8), either of them a fifth. They can lie in all
    stretches of ``least`` places only where the first and the last such stretch overlap by as many, which ends at
    n = 2 * least / (1 + share).
    """
    return int(np.floor(2 * least * share / (1 + share) + 1e-9))


def token_lists(rows: DataFrame) -> DataFrame:
    """(list, doc, comp, lo, hi, few, probe): the stretches of ``screened`` that hold an open shingle that is a probe of one."""
    each = F.explode(F.arrays_zip("held", "few", "probe")).alias("x")
    rows = rows.select("doc", "comp", "lo", (F.col("lo") + F.size("seq") - 1).alias("hi"), each).select(F.col("x.held").alias("list"), "doc", "comp", "lo", "hi", "x.few", "x.probe")
    return distinct_lists(materialize(rows, "passage-lists"))


def distinct_lists(lists: DataFrame) -> DataFrame:
    """``lists`` with their size, without those of one component or without a probe; of lists of the same stretches the first stays."""
    row = ("doc", "lo", "hi", "few", "probe")
    per = lists.groupBy("list").agg(
        F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum(F.xxhash64(*row).cast("decimal(20,0)")).alias("s0"), F.sum(F.hash(*row).cast("long")).alias("s1"), F.max("probe").alias("probe")
    )
    kept = per.where("c0 <> c1 AND probe > 0").groupBy("size", "s0", "s1").agg(F.min("list").alias("list"))
    return materialize(join_counted(lists, materialize(kept.select("list", "size"), "passage-kept"), "list", "size", lists.count()), "passage-meet")


def with_largest(lists: DataFrame) -> DataFrame:
    """``lists`` with their largest component ``top``, the documents outside it and the blocks that both parts fill."""
    per = lists.groupBy("list", "comp").agg(F.count("*").alias("docs"), F.sum(F.col("hi") - F.col("lo") + 1).alias("shingles"))
    per = per.groupBy("list").agg(F.max(F.struct("docs", "comp", "shingles")).alias("top"), F.sum("docs").alias("size"), F.sum("shingles").alias("shingles"))
    blocks = lambda docs, shingles: F.ceil(F.greatest(docs / F.lit(BLOCK), shingles / F.lit(BLOCK_SHINGLES))).cast("int")
    outside = F.col("size") - F.col("top.docs")
    per = per.select("list", "size", F.col("top.comp").alias("top"), outside.alias("outside"), blocks(outside, F.col("shingles") - F.col("top.shingles")).alias("outer"), blocks(F.col("top.docs"), F.col("top.shingles")).alias("inner"))
    return materialize(join_counted(lists, materialize(per.where("outside > 0"), "passage-tops"), "list", "size", lists.count()), "passage-lists-top")


def _pair_columns(far: str) -> list:
    """(list, far, a, b, a_lo, a_hi, lo, hi) of two stretches x and y that met, in order of their documents."""
    low = F.col("x_doc") < F.col("y_doc")
    pick = lambda c, first: F.when(low == F.lit(first), F.col(f"x_{c}")).otherwise(F.col(f"y_{c}"))
    ends = [pick("lo", True).alias("a_lo"), pick("hi", True).alias("a_hi"), pick("lo", False).alias("lo"), pick("hi", False).alias("hi")]
    return [F.col("list"), F.col(far).alias("far"), pick("doc", True).alias("a"), pick("doc", False).alias("b"), *ends]


def _each_once(pairs: DataFrame, label: str) -> DataFrame:
    """(list, far, a, b, a_from, a_to, spots): each pair of documents once, with the first of its lists."""
    spot = F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")
    per = pairs.groupBy("a", "b").agg(F.min(F.struct("list", "far")).alias("at"), F.min("a_lo").alias("a_from"), F.max("a_hi").alias("a_to"), F.collect_set(spot).alias("spots"))
    return materialize(per.select("at.list", "at.far", "a", "b", "a_from", "a_to", "spots"), label)


def star_pairs(lists: DataFrame) -> DataFrame:
    """The pairs, as of ``list_pairs``, of each outsider of a list with one stretch of the list's largest component.

    Which one hangs on the list, so an outsider that shares many shingles meets many others. There are no more pairs than
    entries of lists.
    """
    lists = with_largest(lists.drop("size"))
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("doc", "lo", "hi")]
    one = lists.where(F.col("comp") == F.col("top")).groupBy("list").agg(F.min(F.struct(F.xxhash64("list", "doc", "lo").alias("h"), "doc", "lo", "hi")).alias("y"))
    met = lists.where(F.col("comp") != F.col("top")).select("list", "top", *side("x")).join(one.select("list", *(F.col(f"y.{c}").alias(f"y_{c}") for c in ("doc", "lo", "hi"))), "list")
    return _each_once(met.withColumn("list", F.xxhash64("top")).select(*_pair_columns("x_doc")), "passage-star-pairs")


def joined(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` of ``screened`` with the components that ``hits`` between their documents join."""
    comp = rows.select("doc", "comp").distinct()
    links = hits.select("key", "match").join(comp.select(F.col("doc").alias("key"), F.col("comp").alias("x")), "key").join(comp.select(F.col("doc").alias("match"), F.col("comp").alias("y")), "match")
    new = components(links.select("x", "y"), "x", "y").select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    return rows.join(sized(new), "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")


def list_pairs(lists: DataFrame) -> DataFrame:
    """(list, far, a, b, a_from, a_to, spots) of documents of different components that share one of ``with_largest``'s
    short lists, in which one of them has a probe, each pair once.

    Of the pair's lists the first is given, and ``far`` is the document that the list's outsider met. The places to be
    compared are a_from to a_to of a, and the spots of b, as lo * 2 ** 32 + hi.
    """
    side = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("doc", "comp", "lo", "hi", "few", "probe")]
    outsiders = lists.where(F.col("comp") != F.col("top")).select("list", *side("x"))
    # the passage of more different shingles has a quarter more at most
    meets = F.greatest(F.col("x_probe") - F.col("y_few") * MIN_SIMILARITY, F.col("y_probe") - F.col("x_few") * MIN_SIMILARITY) >= -1e-9
    met = outsiders.join(lists.select("list", *side("y")), "list").where((F.col("x_doc") != F.col("y_doc")) & (F.col("x_comp") != F.col("y_comp")) & meets)
    return _each_once(met.select(*_pair_columns("y_doc")), "passage-more-pairs")


def block_hits(lists: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Passages of the documents of different components that share one of ``with_largest``'s long lists.

    Lists are cut into blocks by hash, of which the outsiders' meet each other and the largest component's. Two blocks are a
    group of their own, which compares its pairs at once, so none is written. A pair of two lists is compared in the one of
    the smaller shingle, and components that a passage of the group joins are compared no more.
    """
    short = lambda c: F.shiftright(c, 32).cast("int")
    probes = lists.where(F.col("probe") == least).groupBy("doc", "lo").agg(F.collect_set(short("list")).alias("probes"))
    seqs = sequences(only(docs, lists.select(F.col("doc").alias("key")))).dropDuplicates(["key"]).withColumnRenamed("key", "doc")
    ends = lists.select("doc", "lo", "hi").distinct().join(seqs, "doc").join(probes, ["doc", "lo"], "left")
    cut = F.slice("seq", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("seq")
    ends = materialize(ends.select("doc", "lo", cut, F.coalesce("probes", F.array().cast("array<int>")).alias("probes")), "passage-long")
    outsider = F.col("comp") != F.col("top")
    block = F.when(outsider, F.pmod(F.hash("doc"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.hash("doc"), F.col("inner")))
    others = F.sequence(F.lit(0), F.when(outsider, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    tiles = lists.withColumn("mine", block).withColumn("other", F.explode(others))
    tiles = tiles.select("list", "doc", "comp", "lo", "few", "probe", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).join(ends, ["doc", "lo"])
    schema = _hit_schema(docs.schema["key"].dataType)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc", "lo"])
        cross = group["mine"].to_numpy() if group["x"].iat[0] != group["y"].iat[0] else None
        doc, comp, lo, few, probe = (group[c].to_numpy() for c in ("doc", "comp", "lo", "few", "probe"))
        seqs = [np.asarray(s, np.int32) for s in group["seq"]]
        i, j = tile_pairs(comp, seqs, cross, least)
        ok = (doc[i] != doc[j]) & (np.maximum(probe[i] - few[j] * MIN_SIMILARITY, probe[j] - few[i] * MIN_SIMILARITY) >= -1e-9)
        i, j = i[ok], j[ok]
        values, codes = np.unique(np.concatenate(seqs), return_inverse=True)
        codes = np.split(codes, np.cumsum([len(x) for x in seqs])[:-1])
        if len(i):
            ok = ~settled_before(values, codes, group["probes"].tolist(), few >= least, int(group["list"].iat[0]) >> 32)[i, j]
            i, j = i[ok], j[ok]
        out, root = [], {}

        def find(c: object) -> object:
            while c in root:
                c = root[c]
            return c

        for n in np.flatnonzero(pairs_may_match(codes, i, j, least)):
            a, b = i[n], j[n]
            x, y = find(comp[a]), find(comp[b])
            found = matches(codes[a], codes[b], least, "table") if x != y else []
            out += [(doc[b], doc[a], lo[b] + s, lo[b] + e + 5, lo[a] + ms, lo[a] + me + 5, similar) for s, e, ms, me, similar in found]
            if found:
                root[max(x, y)] = min(x, y)
        return pd.DataFrame({f.name: pd.Series([x[k] for x in out], dtype=None if k < 2 and out else [object, np.int32, float][(k > 1) + (k > 5)]) for k, f in enumerate(schema)})

    return tiles.groupBy("list", "x", "y").applyInPandas(compare, schema).distinct()


def settled_before(values: np.ndarray, codes: list[np.ndarray], probes: list, whole: np.ndarray, this: int) -> np.ndarray:
    """Whether each two stretches also share the list of a smaller shingle than ``this`` as a probe of one of them.

    ``codes`` are the stretches as places in ``values``. The one beside the probe must be ``whole``: all its open shingles
    have lists.
    """
    n, sizes = len(codes), np.array([len(p) for p in probes])
    each = np.concatenate([np.zeros(0, np.int32), *probes]).astype(np.int32)
    rows, each = np.repeat(np.arange(n), sizes)[each < this], each[each < this]
    low, col = np.unique(each, return_inverse=True)
    mine, theirs = np.zeros((n, len(low)), np.float32), np.zeros((n, len(low)), np.float32)
    mine[rows, col] = 1
    at = np.full(len(values), -1)
    at[np.searchsorted(values, low)] = np.arange(len(low))
    for k in np.flatnonzero(whole).tolist():
        here = at[codes[k]]
        theirs[k, here[here >= 0]] = 1
    both = mine @ theirs.T > 0
    return both | both.T


def tile_hits(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Passages of the pairs of ``list_pairs``, compared list by list.

    A document's shingles go once to each group of TILE_PAIRS pairs of a list, not once to each pair: pairs grow with the
    product of a list's outsiders and members, what is shuffled with their sum. Pairs with too few shingles in common
    fall out first.
    """
    per = pairs.groupBy("list").agg(F.ceil(F.count("*") / F.lit(TILE_PAIRS)).cast("int").alias("blocks"))
    pairs = materialize(pairs.join(sized(materialize(per, "passage-blocks")), "list").withColumn("block", F.pmod(F.hash("far"), F.col("blocks"))).drop("blocks"), "passage-tiles")
    spots = lambda f, part: f(F.transform("spots", part)).cast("int")
    first, last = spots(F.array_min, lambda x: F.shiftright(x, 32)), spots(F.array_max, lambda x: x.bitwiseAND(F.lit(2**32 - 1)))
    ends = pairs.select("list", "block", F.col("a").alias("doc"), F.col("a_from").alias("lo"), F.col("a_to").alias("hi")).unionAll(pairs.select("list", "block", "b", first, last))
    ends = materialize(ends.groupBy("list", "block", "doc").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "passage-members")
    seqs = sequences(only(docs, ends.select(F.col("doc").alias("key")))).dropDuplicates(["key"]).withColumnRenamed("key", "doc")
    members = ends.join(seqs, "doc").select("list", "block", "doc", "lo", F.slice("seq", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1).alias("seq"))
    schema = _hit_schema(docs.schema["key"].dataType)

    def compare(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        at = pd.Index(members["doc"])
        lo, seqs = members["lo"].to_numpy(), [np.asarray(x, np.int32) for x in members["seq"]]
        # small numbers in place of hashes, so that members are looked up in a table
        codes = np.unique(np.concatenate(seqs), return_inverse=True)[1]
        seqs = np.split(codes, np.cumsum([len(x) for x in seqs])[:-1])
        i, j = at.get_indexer(pairs["a"]), at.get_indexer(pairs["b"])
        a_from, a_to, spots = pairs["a_from"].to_numpy(), pairs["a_to"].to_numpy(), pairs["spots"].to_numpy()
        out = []
        mine = at.get_indexer(pairs["far"])
        for n in np.flatnonzero(pairs_may_match(seqs, mine, i + j - mine, least)):
            a_seq = seqs[i[n]][a_from[n] - lo[i[n]] : a_to[n] - lo[i[n]] + 1]
            spot = np.asarray(spots[n], np.int64)
            for start, end in merged(spot >> 32, spot & (2**32 - 1)):
                for s, e, ms, me, similar in matches(a_seq, seqs[j[n]][start - lo[j[n]] : end - lo[j[n]] + 1], least, "table"):
                    out.append((n, start + s, start + e + 5, a_from[n] + ms, a_from[n] + me + 5, similar))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        of = np.array(cols[0], np.int64)
        ends = dict(zip(("start", "end", "match_start", "match_end"), (np.array(c, np.int32) for c in cols[1:5]), strict=True))
        return pd.DataFrame({"key": pairs["b"].to_numpy()[of], "match": pairs["a"].to_numpy()[of], **ends, "similarity": np.array(cols[5], float)})

    return pairs.groupBy("list", "block").cogroup(members.groupBy("list", "block")).applyInPandas(compare, schema).distinct()


def may_match(seqs: list[np.ndarray], least: int) -> np.ndarray:
    """Whether each two stretches have shingles enough in common for a passage."""
    sets = [np.unique(s) for s in seqs]
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
    # a shared shingle may stand for several in a repetitive stretch
    plain = sizes == np.array([len(s) for s in seqs])
    return (both >= fewest_shared(least)) | ((both > 0) & ~(plain[:, None] & plain[None, :]))


def pairs_may_match(seqs: list[np.ndarray], x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """The same for the pairs of stretches x and y alone, where x repeats; their shingles are small numbers.

    Of two stretches that repeat no shingle, one must have ``least`` places with but misses_at_best that the other lacks.
    """
    sizes = np.array([len(s) for s in seqs])
    plain = np.array([len(np.unique(s)) for s in seqs]) == sizes
    out = np.zeros(len(x), bool)
    place = np.full(max((int(s.max()) for s in seqs if len(s)), default=0) + 1, -1)
    order = np.argsort(x, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
        if not len(group):
            continue
        one = x[group[0]]
        n = sizes[one]
        place[seqs[one]] = np.arange(n)
        # parts of bounded size
        for part in np.split(group, np.arange(1, len(group) * (n + 1) // (1 << 20) + 1) * max((1 << 20) // (n + 1), 1)):
            if not len(part):
                continue
            others = np.concatenate([seqs[k] for k in y[part]])
            starts = np.concatenate(([0], np.cumsum(sizes[y[part]])))
            row = np.repeat(np.arange(len(part)), sizes[y[part]])
            at = place[others]
            held = np.concatenate(([0], np.cumsum(at >= 0)))
            both = np.diff(held[starts])
            best = np.zeros(len(part), np.int64)
            first = np.flatnonzero(starts[row + 1] - np.arange(len(others)) >= least)
            np.maximum.at(best, row[first], held[first + least] - held[first])
            if n >= least:
                here = np.zeros((len(part), n + 1), np.int32)
                here[row[at >= 0], at[at >= 0] + 1] = 1
                here = np.cumsum(here, axis=1)
                best = np.maximum(best, (here[:, least:] - here[:, :-least]).max(axis=1))
            once = plain[one] & plain[y[part]]
            out[part] = np.where(once, (both >= fewest_shared(least)) & (best >= least - misses_at_best(least)), both > 0)
        place[seqs[one]] = -1
    return out


def tile_pairs(comps: np.ndarray, seqs: list[np.ndarray], cross: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the stretches of different components that have shingles enough in common for a passage."""
    ok = may_match(seqs, least) & (comps[:, None] != comps[None, :])
    if cross is not None:
        ok &= cross[:, None] != cross[None, :]
    return np.nonzero(np.triu(ok, 1))


def near_passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, match, start, end, match_start, match_end, similarity, class_id): passages that nearly repeat in another text.

    Ends are in words, exclusive; class_id is the smallest key that can be reached over rows, so it joins all documents
    with a link to one of the class. Texts with equal bytes are one: the smallest key stands for them, and each other key
    gets one row for its whole text if that has ``least`` shingles. Of the others, every window meets the first window
    with its min-hash; pairs on which AGREE functions agree at one place are compared on the shingles. Where documents of
    a min-hash are then still in several classes, all pairs of different classes that agree twice are compared, too
    (``open_stretches``), so no link between classes is left out; inside a class, only the pairs that made it are returned.
    The rows do not hang on partitions or batches. Null, empty and short texts have no passage; rows with a null key take
    no part; rows of one key count once. No rows, no rows; other columns are ignored.
    """
    docs = df.select(F.col(key).alias("key"), text_of(text).alias("text")).where("key IS NOT NULL")
    ids = docs.select("key", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    classes = materialize(ids.groupBy("h", "m").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "passage-classes")
    copies = materialize(ids.join(classes.where("n > 1"), ["h", "m"]).where("key <> rep").select("key", "rep").distinct(), "passage-copies")
    reps = only(docs, copies.select("key"), "left_anti")
    star = materialize(stars(window_rows(reps, least)), "passage-stars")
    spots = F.collect_list(F.struct(F.col("group").bitwiseAND(F.lit(7)).cast("int").alias("k"), "lo", "hi", "a_lo", "a_hi"))
    pairs = star.groupBy("a", "b").agg(spots.alias("spots")).where(F.size(F.array_distinct("spots.k")) >= AGREE)
    hits = materialize(verified(materialize(pairs, "passage-pairs"), docs, least), "passage-hits")
    rows = stretch_shingles(open_stretches(star, components(hits, "key", "match"), least), docs)
    for _ in range(SCREENS):
        rows = screened(rows.select("comp", "doc", "lo", "seq"), least)
    lists = token_lists(rows)
    for _ in range(STARS):
        if not lists.limit(1).count():
            break
        more = materialize(tile_hits(star_pairs(lists), docs, least), "passage-star-hits")
        if not more.limit(1).count():
            break
        hits = hits.unionAll(more)
        rows = screened(joined(rows, more).select("comp", "doc", "lo", "seq"), least)
        lists = token_lists(rows)
    if lists.limit(1).count():
        lists = with_largest(lists.drop("size"))
        long = F.col("outside") * F.col("size") > SHORT_LIST
        if lists.where(long).limit(1).count():
            hits = hits.unionAll(materialize(block_hits(lists.where(long), docs, least), "passage-long-hits"))
        hits = hits.unionAll(materialize(tile_hits(list_pairs(lists.where(~long)), docs, least), "passage-more-hits")).distinct()
    sizes = sequences(only(docs, copies.select(F.col("rep").alias("key")))).select(F.col("key").alias("rep"), F.size("seq").alias("n")).where(F.col("n") >= least).dropDuplicates(["rep"])
    size, zero = (F.col("n") + 4).cast("int"), F.lit(0).cast("int")
    whole = copies.join(sizes, "rep").select("key", F.col("rep").alias("match"), zero.alias("start"), size.alias("end"), zero.alias("match_start"), size.alias("match_end"), F.lit(1.0).alias("similarity"))
    out = materialize(hits.unionAll(whole), "passages")
    comp = components(out, "key", "match").select(F.col("node").alias("key"), F.col("comp").alias("class_id"))
    return out.join(sized(comp), "key")


def only(docs: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` whose key is (not) among ``keys``; the keys are broadcast if they are counted to be few."""
    keys = keys.select(F.col("key").alias("only_key")).distinct()
    return docs.join(sized(keys), docs["key"] == F.col("only_key"), how)


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_passages(docs).withColumnsRenamed({"key": "doc_id", "match": "match_doc_id"})
