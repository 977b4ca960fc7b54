"""Operator 8: mix sources to target weights by certain whole copies and Pareto order sampling of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, sized, table, words

#: Weights go round in source order; a source is repeated three times at most.
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = "pareto-1"
#: Ranks are first counted in so many intervals; only the one where the target is reached is sorted.
RANK_BINS = 4096


def source_targets(sizes: DataFrame, source: str, size: str, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row a source: its words, weight and target.

    Targets share all words by weight; a source stops at ``max_copies`` times its words and the excess is shared anew
    until none is above. That ends where target = min(level * weight, cap) for one level; with the sources in order of
    cap / weight, the level follows from running sums. One row a source goes through one task, never the documents.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)) + 1)
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    every = Window.partitionBy()
    per = per.withColumn("caps_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
    per = per.withColumn("weights_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.col("caps_before")) / F.col("weights_left").cast("double"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))).select(source, "source_size", "weight", "target")


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the md5 of the key: 52 bits, centred."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def odds_score(key: Column, f: Column) -> Column:
    """Random odds over inclusion odds, z, as z / (1 + z): the Pareto rank, in (0, 1)."""
    u = uniform(key)
    z = (u / (1 - u)) * (1 - f) / F.greatest(f, F.lit(1e-12))
    return z / (1 + z)


def mix_plan(sizes: DataFrame, key: str, source: str, size: str, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row a source: source_size, target, base copies, inclusion share f, the last rank taken and the extra key.

    Each row of a source should be taken r = target / source words times. floor(r) copies are certain. For the rest,
    f = r - floor(r), rows are ranked by their random odds u / (1 - u) over their inclusion odds f / (1 - f) (Pareto
    order sampling) and the first rows are taken while the words still due are not passed: a sample of fixed size in
    words. Bins of the rank are summed first, so only the bin in which the limit falls is sorted. Of the rows left out,
    the largest that fits the gap is taken too. Rows of one source with equal keys are one unit. ``sizes`` is read
    several times: pass a narrow table. A null source is a source of its own, a null key the empty key.
    """
    sizes = sizes.select(F.col(source).alias("source"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(size).alias("size"))
    per = source_targets(sizes, "source", "size", max_copies)
    r = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(max_copies)))
    per = per.withColumn("base", F.floor(r)).withColumn("f", r - F.floor(r)).withColumn("due", F.col("target") - F.floor(r) * F.col("source_size"))
    per = materialize(per, "mix-targets")
    units = sizes.groupBy("source", "key").agg(F.sum("size").alias("size"))
    units = keys_null_safe(units, per.select("source", "f", "due"), ["source"]).withColumn("score", odds_score(F.col("key"), F.col("f")))
    units = materialize(units.withColumn("bin", F.floor(F.col("score") * RANK_BINS)), "mix-units")
    bins = units.groupBy("source", "bin", "due").agg(F.sum("size").alias("bin_sum"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # RANK_BINS rows a source at most
    bins = bins.withColumn("upto", F.sum("bin_sum").over(ahead))
    whole = bins.where(F.col("upto") <= F.col("due")).groupBy("source").agg(F.max("bin").alias("last_bin"), F.max("upto").alias("taken_bins"))
    cross = bins.where(F.col("upto") > F.col("due")).groupBy("source").agg(F.min("bin").alias("bin"), F.min(F.col("upto") - F.col("bin_sum")).alias("before"))
    inside = keys_null_safe(units, cross, ["source", "bin"])
    run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("score"))
    part = inside.withColumn("run", run).where(F.col("run") <= F.col("due")).groupBy("source").agg(F.max("score").alias("cut"), F.max("run").alias("taken_part"))
    cuts = keys_null_safe(keys_null_safe(per, whole, ["source"], "left"), part, ["source"], "left")
    cuts = cuts.withColumn("taken_rank", F.coalesce("taken_part", "taken_bins", F.lit(0)))
    cuts = materialize(cuts.select("source", "source_size", "target", "base", "f", "due", F.coalesce("last_bin", F.lit(-1)).alias("last_bin"), F.coalesce("cut", F.lit(-1.0)).alias("cut"), (F.col("due") - F.col("taken_rank")).alias("gap")), "mix-cuts")
    left = keys_null_safe(units.drop("due", "f"), cuts.select("source", "base", "last_bin", "cut", "gap"), ["source"])
    left = left.where((F.col("bin") > F.col("last_bin")) & (F.col("score") > F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("base") < max_copies))
    extra = left.groupBy("source").agg(F.max(F.struct("size", F.col("key").alias("extra_key"))).alias("best"))
    return keys_null_safe(cuts, extra.select("source", F.col("best.extra_key").alias("extra_key")), ["source"], "left").drop("gap", "due")


def keys_null_safe(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null equal to null; ``other``, a row a source, is broadcast if it is small."""
    renamed = other.select(*(F.col(c).alias(f"__{c}" if c in on else c) for c in other.columns))
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return df.join(sized(renamed), cond, how).drop(*(f"__{c}" for c in on))


def with_copies(df: DataFrame, plan: DataFrame, key: str, source: str, source_size: str = "source_size", target: str = "target", copies: str = "copies") -> DataFrame:
    """``df`` with source_size, target and the copies the plan takes of each row; the rows themselves are not shuffled.

    Columns of ``df`` named like the three results are replaced.
    """
    names = ("base", "f", "last_bin", "cut", "extra_key")
    df = df.drop(source_size, target, copies)
    new = {"source_size": source_size, "target": target} | dict(zip(names, fresh(df.withColumns({source_size: F.lit(0), target: F.lit(0)}), *names), strict=True))
    src, rank = fresh(df, *(f"{n}_" for n in ("mix_source", "mix_rank")))
    plan = plan.select(F.col("source").alias(src), *(F.col(c).alias(n) for c, n in new.items()))
    out = df.join(sized(plan), F.col(source).eqNullSafe(F.col(src)))
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    out = out.withColumn(rank, odds_score(text_key, F.col(new["f"])))
    by_rank = (F.floor(F.col(rank) * RANK_BINS) <= F.col(new["last_bin"])) | (F.col(rank) <= F.col(new["cut"]))
    by_gap = F.coalesce(text_key == F.col(new["extra_key"]), F.lit(False))
    out = out.withColumn(copies, F.col(new["base"]) + by_rank.cast("long") + by_gap.cast("long"))
    return out.drop(src, rank, *(new[c] for c in names))


def _n_words(col: str = "text") -> Column:
    return F.size(words(col)).cast("long")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _n_words().alias("size"))
    docs = materialize(docs, "mix-sizes")
    out = with_copies(docs, mix_plan(docs, "doc_id", "source", "size"), "doc_id", "source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, each as often as it is taken, with their columns as they are.

    A null source is a source; documents without words cost nothing and are taken as often as their source's whole copies
    and rank say; rows of one source with equal doc_id are taken together; no documents, no rows.
    """
    size, copies, source_size, target = fresh(docs, "size", "copies", "source_size", "target")
    sizes = materialize(docs.select("doc_id", "source", _n_words().alias(size)), "mix-sizes")
    out = with_copies(docs, mix_plan(sizes, "doc_id", "source", size), "doc_id", "source", source_size, target, copies)
    return out.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
