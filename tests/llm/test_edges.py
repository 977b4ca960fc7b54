"""Defined results for nulls, empty and repeated rows, long texts and clashing names."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldwright.llm import chat, common, decontaminate, mixing, near_dedup, quality, repeats, revisits, sharding, toxicity
from foldwright.llm.common import table

DOCS = "doc_id long, text string, source string"


def prose(rng, n):
    return " ".join(f"w{rng.randrange(400)}" for _ in range(n))


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


# op1


def test_quality_keeps_clashing_columns_and_repeated_rows(spark):
    rng = random.Random(1)
    text = prose(rng, 60)
    rows = [(1, text, "a"), (1, text, "a"), (None, text, None), (2, None, "a"), (3, "", None), (4, "word\n" * 3000, "a"), (5, prose(rng, 20_000), "b")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("key", "host", "line", "place", "line_hash", "clean")})
    out = quality.quality(docs).collect()
    assert len(out) == len(rows) and all(r.key == r.host == r.line == r.place == r.line_hash == r.clean == 7 for r in out)
    by = {(r.doc_id, r.text): r for r in out}
    assert by[2, None].base_failed and not by[2, None].kept and by[4, rows[5][1]].base_failed
    assert not by[1, text].base_failed and by[5, rows[6][1]].n_words == 20_000


# op2

CAPTURES = "id long, url string, time long, kind string, headers map<string,string>, source string, near string"


def test_revisits_of_nothing_and_of_repeated_rows(spark):
    assert revisits.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0
    one, again = (1, "http://a.com/x", 5, "response", {"etag": '"v"'}, "s", "n"), (2, "http://a.com/x", 6, "revisit", {"etag": '"v"'}, "s", "n")
    out = revisits.resolve_revisits(spark.createDataFrame([one, one, again, again, (3, None, None, "other", None, None, None)], CAPTURES)).collect()
    assert [(r.id, r.response_id, r.status) for r in out] == [(2, 1, "resolved")] * 2


# op5

TURNS = "conv_id long, turn int, role string, text string, formatted string, turns int"


def turned(spark, rows):
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, TURNS)))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in back.collect()}


def test_chats_of_nothing_repeated_null_and_many_turns(spark):
    assert turned(spark, []) == {}
    row = (1, 0, "user", "hi", "x", 1)
    many = [(2, i, ("user", "assistant", "assistant")[i % 3], f"t{i}", None, None) for i in range(9000)]
    got = turned(spark, [row, row, (1, None, None, None, None, None), (1, 1, "assistant", "<b>\\l", None, 2), (None, 0, "assistant", "", None, None), *many])
    assert got[1] == ([("", ""), ("user", "hi"), ("user", "hi"), ("assistant", "<b>\\l")], "<b>\\l")
    assert got[None] == ([("assistant", "")], "")
    assert got[2] == ([(r[2], r[3]) for r in many], "".join(r[3] for r in many if r[2] == "assistant"))


# op6


def test_scores_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", "a"), (1, "some words", "a"), (None, None, None), (2, "x" * 300_000, "a")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, labels)
    out = toxicity.score(docs, model, "doc_id", "text").collect()
    assert len(out) == 4 and all(r.score < toxicity.THRESHOLD for r in out)
    one_sided = toxicity.toxicity_model(docs, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), one_sided, "doc_id", "text").count() == 0
    assert toxicity.score(docs, one_sided, "doc_id", "text").count() == 4


def test_rare_subwords_are_not_learnt_by_heart(spark):
    """Every text has words of its own, so any label could be told by them; only one word speaks for the label."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghaeiou") for _ in range(7))
    rows, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(["zzyzx", "qwartz"])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.toxicity_model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = toxicity.score(docs.where(toxicity.held_out("doc_id")), model, "doc_id", "text").collect()
    good = sum((r.score >= toxicity.THRESHOLD) == (r.key % 5 == 0) for r in held)
    assert len(held) > 200 and good >= 0.97 * len(held)


def test_toxicity_stage_keeps_blank_texts_and_columns(spark, tmp_path):
    rows = [(i, ("vile vile words " if i % 2 else "kind words here ") * 10, "a") for i in range(300)]
    rows += [(1001, None, None), (1002, "", "a"), (1003, " \n\t", "a"), (None, "kind words here " * 10, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(0.9), "_score": F.lit(1)})
    spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.toxicity_stage(spark, docs, str(tmp_path))
    kept = out.collect()
    assert out.columns == docs.columns and all(r.score == 0.9 for r in kept)
    assert {1001, 1002, 1003, None} <= {r.doc_id for r in kept} and not any(r.doc_id % 2 for r in kept if r.doc_id is not None and r.doc_id < 300)
    assert sum(r.doc_id is not None and r.doc_id < 300 for r in kept) == 150
    assert toxicity.toxicity_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


# op4


def test_near_dedup_sql_splits_at_every_space(spark):
    rng = random.Random(3)
    words = prose(rng, 40).split()
    rows = [(i, sep.join(words), "a") for i, sep in enumerate([" ", "\r", "\f", "\v", "\t", "\r\n", " \f "])] + [(20, "\r\f", "a"), (21, None, "a"), (22, " ".join(words), "a")]
    docs = spark.createDataFrame(rows, DOCS)
    got = near_dedup.near_components(docs, min_percent=near_dedup.QUERY_PERCENT)
    names, want = sql_rows(near_dedup.OP4_SQL, documents=docs)
    assert names == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.select("key", "n_shingles", "component_id", "kept").collect())) == sorted(want)
    assert {r[2] for r in want if r[0] < 7} == {0} and (22, 1, 22, True) in want


# op8


def test_mix_of_repeated_rows_and_null_sources(spark):
    rng = random.Random(4)
    rows = [(i % 150, prose(rng, 20), [None, "a", "null"][i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(5) for c in ("target", "f", "base", "mix_source_")})
    out = mixing.mix_stage(spark, docs, "").collect()
    assert all(r.target == r.f == r.base == r.mix_source_ == 5 for r in out)
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + 20
    size, total = 100 * 20, 300 * 20
    want = {"a": total / 6, "null": total * 2 / 6, None: total * 3 / 6}
    assert set(taken) == set(want) and all(abs(taken[s] - want[s]) <= 40 and taken[s] <= 3 * size for s in want)


# op9


def test_shards_of_null_and_repeated_keys(spark):
    rows = [(i // 3 if i % 7 else None, f"t{i}", "a") for i in range(203)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit(99), "bucket": F.lit(1), "place": F.lit(2)})
    out = sharding.shard_stage(spark, docs, "").collect()
    assert sorted(r.slot * sharding.N_SHARDS + r.shard for r in out) == list(range(203))
    assert sorted((r.text for r in out)) == sorted(t for _, t, _ in rows) and all(r.bucket == 1 and r.place == 2 for r in out)
    assert sharding.shard_stage(spark, docs.limit(0), "").count() == 0


# op10


def test_decontamination_stage_and_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    item = prose(rng, 30)
    rows = [(1, f"{prose(rng, 40)} {item} {prose(rng, 40)}", "a"), (1, "other words", "a"), (2, prose(rng, 80), "a"), (None, item, "a"), (3, None, None), (4, "", "a"), (5, prose(rng, 30_000), "a")]
    docs = spark.createDataFrame([*rows, rows[0], rows[2]], DOCS).withColumns({"leak_id": F.lit(3), "shift": F.lit(4), "item": F.lit("x")})
    spark.createDataFrame([(7, item), (7, item), (8, None), (None, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = decontaminate.decontaminate_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 2, 3, 4, 5, None]
    found = decontaminate.leaks(docs, table(spark, str(tmp_path), "benchmark")).collect()
    assert [(r.doc_id, r.item_id, r.matched) for r in found] == [(1, 7, 30)]
    assert decontaminate.decontaminate_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


# the pipeline


def test_pipeline_as_a_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns == [*docs.columns, "row", "shard", "slot"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all(texts[r.doc_id] == r.text for r in rows)
    n = len(rows)
    assert sorted(r.slot * sharding.N_SHARDS + r.shard for r in rows) == list(range(n)) == sorted(r.row for r in rows)
    stages = dict(corpus_pipeline.STAGES)
    kept, now = [], docs
    for name in ("toxicity", "near-dedup", "decontamination"):
        now = stages[name](spark, now, sf)
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert set(texts) >= kept[0] >= kept[1] >= kept[2] >= {r.doc_id for r in rows}
    assert max(sum(r.doc_id == d for r in rows) for d in {r.doc_id for r in rows}) <= mixing.MAX_COPIES
    assert sum(r.doc_id in kept[2] for r in rows) == n


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_a_table_without_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    none = table(spark, sf, "documents").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, none, sf)
    assert out.count() == 0 and set(none.columns) <= set(out.columns)


def test_shards_equal_the_network_and_hang_on_the_seed(spark):
    """The network in plain numbers: rounds with keys of their own, walked until the place is inside."""

    def mix(v, key):
        y = (v + key) % sharding.MODULUS * sharding.MUL_1 % sharding.MODULUS
        z = (y ^ (y >> 15)) * sharding.MUL_2 % sharding.MODULUS
        return z ^ (z >> 13)

    def place(p, n, seed):
        a, b = sharding.domain(n)
        while True:
            x, y = divmod(p, b)
            for i in range(sharding.ROUNDS):
                key = (seed + i * sharding.ROUND_STEP) % sharding.MODULUS
                x, y = ((x + mix(y, key)) % a, y) if i % 2 == 0 else (x, (y + mix(x, key)) % b)
            p = x * b + y
            if p < n:
                return p

    for n, seed in ((1000, sharding.SEED), (1000, 5), (37, 1)):
        out = sharding.feistel_shards(spark.range(n), ["id"], 8, seed).collect()
        got = {r.row: r.slot * 8 + r.shard for r in out}
        assert got == {i: place(i, n, seed) for i in range(n)}


def test_shard_sql_and_repeat_sql_equal_the_operators(spark, tmp_path):
    rng = random.Random(6)
    shared = prose(rng, 60)
    rows = [(i, f"{prose(rng, 30)} {shared} é{i}😀", "a") for i in range(20)] + [(30, None, "a"), (31, "", "a"), (32, "ab" * 300, None), (33, "short", "a"), (34, "é" * 120, "a"), (35, "é" * 49 + "xy", "a")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for query, sql in ((sharding.op9_feistel_shards, sharding.OP9_SQL), (repeats.op7_radix_repeats, repeats.OP7_SQL)):
        out = query(spark, str(tmp_path))
        names, want = sql_rows(sql, documents=docs)
        assert sorted(names) == sorted(out.columns)
        assert sorted(map(tuple, out.select(*names).collect()), key=str) == sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in want), key=str)


def test_only_the_last_table_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    with common.last_table_only(spark):
        one = common.materialize(spark.range(5), "one")
        two = common.materialize(one.where("id > 2"), "two")
    common.materialize(spark.range(1), "later")
    left = sorted(p.name.split("-")[0] for p in (tmp_path / "foldwright").iterdir())
    assert left == ["later", "two"] and two.count() == 2
    with common.last_table_only(spark):
        pass
