import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foldwright.llm import chat, common, decontaminate, mixing, near_dedup, passages, quality, repeats, revisits, sharding, toxicity

DOCS = "doc_id long, text string, source string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [" ".join(prose(rng, rng.randrange(60, 200))) for _ in range(40)]
    near = texts[0].split()
    near[50] = "changed"
    shared = prose(rng, 60)
    texts += [texts[1], texts[1], " ".join(near), None, "", "one two three", "one two three", "one two THREE"]
    texts += [" ".join(prose(rng, 80) + shared + prose(rng, 80)) for _ in range(12)]
    texts += [texts[2] + "\n" + texts[2]]
    return [(i, t, [None, "a", "a", "b"][i % 4]) for i, t in enumerate(texts)]


def test_near_components_equal_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS)
    sets = {}
    for i, t, _ in corpus:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = comp[a], comp[b]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    got = {r.key: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_long_lists_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = []
    for i in range(30):
        w = list(base)
        w[(i * 10) % 300] = f"x{i}"
        rows.append((i, " ".join(w), "a"))
    out = near_dedup.near_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in out} == {0}


def test_repeats_equal_brute_force(spark, corpus):
    rows = corpus[:50] + [(60, "äö" * 40, "a"), (61, "x" * 90, "b")]
    depth = 40
    seen, marks = set(), {}
    for i, t, _ in rows:
        data = (t or "").encode()
        marks[i] = bytearray(len(data))
        for at in range(len(data) - depth + 1):
            window = data[at : at + depth]
            if window in seen:
                marks[i][at : at + depth] = b"\x01" * depth
            seen.add(window)
    out = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS), depth=depth).collect()}
    assert out == {i: bytes(b for b, m in zip((t or "").encode(), marks[i], strict=True) if not m) for i, t, _ in rows}


def test_passages_find_shared_ones(spark, corpus):
    out = passages.near_passages(spark.createDataFrame(corpus, DOCS)).collect()
    linked = {x for r in out for x in (r.key, r.match)}
    planted = set(range(48, 60))
    assert planted <= linked and {1, 40, 41} <= linked
    assert all(r.similarity >= 0.8 and r.end - r.start >= 50 for r in out)
    hit = next(r for r in out if r.key in planted and r.match in planted)
    assert hit.start <= 80 and hit.end >= 140


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(9)
    item = prose(rng, 30)
    near = list(item)
    near[10] = "other"
    rows = [(1, " ".join(prose(rng, 50) + near + prose(rng, 50)), "a"), (2, " ".join(prose(rng, 100)), "a"), (3, None, "a"), (4, "", None)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "too short")], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), items).collect()
    assert [(r.doc_id, r.item_id, r.matched, r.item_tokens, r.shift) for r in got] == [(1, 7, 29, 30, 50)]
    assert decontaminate.leaks(spark.createDataFrame([], DOCS), items).count() == 0


def test_seeds_equal_brute_force_alignment(spark):
    rng = random.Random(21)
    items, rows, want = [], [], set()
    for n in [5, 6, 7, 10, 11, *range(15, 61, 3)]:
        item = [f"i{n}t{j}" for j in range(n)]
        items.append((n, " ".join(item)))
        for k in range(6):
            copy = list(item)
            for j in rng.sample(range(n), n // 5):
                copy[j] = f"c{k}x{j}"
            want.add((n * 10 + k, n))
            rows.append((n * 10 + k, " ".join(prose(rng, 20) + copy + prose(rng, 20)), "a"))
    for doc, n, changed in ((1001, 16, (7, 8)), (1002, 17, (7, 8, 9)), (1003, 20, (7, 8, 11, 12))):
        items.append((doc, " ".join(f"d{doc}t{j}" for j in range(n))))
        rows.append((doc, " ".join("changed" if j in changed else f"d{doc}t{j}" for j in range(n)), "a"))
        want.add((doc, doc))
    items += [(2001, "only three tokens"), (2002, "lone")]
    rows += [(2001, "Here: ONLY three, tokens!", "a"), (2002, "only two tokens", "a")]
    want.add((2001, 2001))
    got = decontaminate.leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.matched * 100 >= r.item_tokens * 80 for r in got)


def test_decontamination_adds_neighbouring_alignments(spark):
    rng = random.Random(22)
    item = [f"i{j}" for j in range(200)]
    more, less, other = item[:100] + ["new"] + item[100:], item[:100] + item[101:], prose(rng, 40)
    rows = [(1, more), (2, less), (3, other + item[40:160] + other), (4, other + item[50:57] + other), (5, item[:7] + other + item[7:14] + other + item[14:21])]
    docs = spark.createDataFrame([(i, " ".join(w), "a") for i, w in rows], DOCS)
    got = {r.doc_id: (r.matched, r.item_tokens) for r in decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (200, 200), 2: (199, 200), 3: (120, 200)}
    short = [f"s{j}" for j in range(12)]
    docs = spark.createDataFrame([(1, " ".join(short[:6] + ["new"] + short[6:]), "a")], DOCS)
    assert decontaminate.leaks(docs, spark.createDataFrame([(7, " ".join(short))], "item_id long, text string")).count() == 1


def test_quality_base_rules(spark):
    rep = " ".join(["a b c d e"] * 4)
    rows = [(1, rep, None), (2, "x\nx\n \n#$ y", "h"), (3, None, "h"), (4, " ".join(f"w{i}" for i in range(20)), "h")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (20, 20, True)
    assert (got[2].n_dup_lines, got[2].n_symbols, got[2].word_chars) == (1, 2, 5)
    assert got[3].n_words == 0 and not got[3].kept and got[4].kept


def test_quality_counts_documents(spark):
    line = "the same line of many words in every copy of one text here"
    rows = [(i, line, "h") for i in range(40)] + [(100 + i, f"{line}\nown words of text {i} " + " ".join(f"v{i}x{j}" for j in range(30)), "h") for i in range(3)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].depleted and not got[i].kept and not got[i].base_failed for i in range(40))
    assert all(got[100 + i].n_line_words == len(line.split()) and got[100 + i].kept for i in range(3))


def test_quality_returns_clean_text(spark):
    rows = [(i, f"Own {i}  line\n\n All  rights RESERVED\n" + " ".join(f"v{i}x{j}" for j in range(20)) + "\nall rights reserved", "h") for i in range(20)]
    rows += [(50, None, "h"), (51, "", "h"), (52, "All rights reserved", "other"), (53, "all rights reserved", "h")]
    got = {r.doc_id: r.clean_text for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == f"Own {i}  line\n\n" + " ".join(f"v{i}x{j}" for j in range(20)) for i in range(20))
    assert (got[50], got[51], got[52], got[53]) == (None, "", "All rights reserved", "")


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a<turn x> \\l"), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n<seam>\\"), (2, None, None, "é<"), (None, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a<turn x> \\l"), ("user", ""), ("assistant", "</turn>\n<seam>\\")]
    assert got[1].loss_text == "</turn>\n<seam>\\" and got[None].loss_text == ""
    assert [(t.role, t.text) for t in got[2].turns] == [("", "é<")]


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing._n_words().alias("size"))

    def run():
        return {r.doc_id: r.copies for r in mixing.with_copies(docs, mixing.mix_plan(docs, "doc_id", "source", "size"), "doc_id", "source").collect()}

    first = run()
    assert first == run() and max(first.values()) <= 3
    total = sum(1 + i % 7 for i, *_ in rows)
    for k, weight in zip("abc", (1, 2, 3), strict=True):
        taken = sum(first[i] * (1 + i % 7) for i, _, s in rows if s == k)
        assert abs(taken - total * weight / 6) <= 7


def test_shards_are_a_permutation(spark):
    for n in (0, 1, 7, 500):
        df = spark.range(n).select(F.col("id").alias("doc_id"))
        out = sharding.feistel_shards(df, ["doc_id"], 8).collect()
        assert sorted(r.slot * 8 + r.shard for r in out) == list(range(n))


def test_toxicity_learns_misspellings(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        w = prose(rng, 30)
        if bad:
            w[rng.randrange(30)] = "".join(rng.sample(["horridword", "horridwort", "horridwerd"], 1))
        rows.append((i, " ".join(w), "a"))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.toxicity_model(docs, known)
    test = spark.createDataFrame([(1, rows[1][1] + " horridworb", "a"), (2, rows[1][1], "a"), (3, None, "a"), (4, "", "a")], DOCS)
    got = {r.key: r.score for r in toxicity.score(test, model, "doc_id", "text").collect()}
    assert got[1] > got[2] and all(0 <= s <= 1 for s in got.values())


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.a.com/p/", 10, "response", h(ETag='"x"', Content_Type="t", Date="1")),
        (2, "https://a.com/p", 20, "revisit", h(etag='W/"x"', Date="2", Content_Type="no")),
        (3, "https://a.com/p#f", 5, "revisit", h(etag='"x"')),
        (4, "https://a.com/p?utm_source=q", 30, "revisit", h(etag='"y"')),
        (5, None, None, "revisit", None),
    ]
    df = spark.createDataFrame(rows, "id long, url string, time long, kind string, headers map<string,string>")
    got = {r.id: r for r in revisits.resolve_revisits(df).collect()}
    assert (got[2].status, got[2].response_id) == ("resolved", 1)
    assert got[2].merged_headers == {"etag": 'W/"x"', "content-type": "t", "date": "2"}
    assert (got[3].status, got[4].status, got[5].status) == ("no_response", "mismatch", "no_response")


def test_clashing_columns_and_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus, DOCS).withColumns({c: F.lit(1) for c in ("key", "gone", "size", "copies", "shard", "w", "score_")})
    assert near_dedup.near_dedup_stage(spark, docs, "").count() < docs.count()
    assert sharding.shard_stage(spark, docs, "").count() == docs.count()
    assert mixing.mix_stage(spark, docs, "").columns == docs.columns
    empty = docs.limit(0)
    assert near_dedup.near_components(empty).count() == 0 and repeats.remove_repeats(empty).count() == 0
    assert passages.near_passages(empty).count() == 0 and quality.quality(empty).count() == 0
    assert mixing.mix_stage(spark, empty, "").count() == 0


def test_repeats_digest_matches_text(spark):
    docs = spark.createDataFrame([(1, "abc", "a")], DOCS)
    row = repeats.remove_repeats(docs).first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == hashlib.sha256(b"abc").hexdigest()


def test_tables_are_written_with_their_settings_and_the_session_keeps_its_own(spark):
    seen = []

    class Frame:
        sparkSession, schema = spark, spark.range(1).schema

        class write:
            @staticmethod
            def parquet(path):
                seen.append({k: spark.conf.get(k) for k in common.WRITING})
                spark.range(1).write.parquet(path)

    before = {k: spark.conf.get(k, None) for k in common.WRITING}
    assert common.materialize(Frame, "settings").count() == 1
    assert seen == [common.WRITING]
    assert before == {k: spark.conf.get(k, None) for k in common.WRITING}
