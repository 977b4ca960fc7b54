import random

import numpy as np
from pyspark.sql import functions as F

from foldwright.llm import passages

DOCS = "doc_id long, text string"


def shingle_ids(text, ids):
    w = text.split()
    return np.array([ids.setdefault(tuple(w[i : i + 5]), len(ids)) for i in range(len(w) - 4)], np.int32)


def brute_classes(rows):
    """Classes over all pairs that ``matches`` accepts on whole texts."""
    ids, comp = {}, {i: i for i, _ in rows}
    seqs = {i: shingle_ids(t, ids) for i, t in rows}
    links = 0
    for i, _ in rows:
        for j, _ in rows:
            if i < j and passages.matches(seqs[i], seqs[j]):
                links += 1
                x, y = comp[i], comp[j]
                comp = {k: min(x, y) if v in (x, y) else v for k, v in comp.items()}
    return comp, links


def variants(rng, n, start, words=110):
    """Texts that hold one passage with one changed word each, in prose of their own."""
    passage = [f"p{start}x{i}" for i in range(words)]
    out = []
    for k in range(n):
        w = list(passage)
        w[rng.randrange(words)] = f"c{start}x{k}"
        own = lambda: [f"o{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60))]
        out.append((start + k, " ".join(own() + w + own())))
    return out


def test_classes_equal_brute_force_for_groups_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHORT_LIST", 8)
    monkeypatch.setattr(passages, "BLOCK", 16)
    rng = random.Random(4)
    rows = [r for n, start in ((3, 0), (4, 100), (12, 200), (60, 300)) for r in variants(rng, n, start)]
    comp, links = brute_classes(rows)
    assert links > 1500
    results = []
    for parts in (1, 13):
        out = passages.near_passages(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        got = {i: i for i, _ in rows} | {r.key: r.class_id for r in out} | {r.match: r.class_id for r in out}
        assert got == comp
        results.append(sorted(map(tuple, out)))
    assert results[0] == results[1]


def test_changed_words_at_the_ends_count(spark):
    base = [f"w{i}" for i in range(50)]
    ids = {}
    for changed in ([0], [2], [49], [25]):
        other = ["x" if i in changed else w for i, w in enumerate(base)]
        a, b = (shingle_ids(" ".join(w), ids) for w in (base, other))
        assert len(passages.matches(a, b)) == (1 if changed != [25] or 41 / 51 >= 0.8 else 0)


def test_any_stretch_of_a_is_tried():
    a = np.concatenate([np.where(np.arange(80) % 7 == 3, 900 + np.arange(80), np.arange(80)), 500 + np.arange(20), np.arange(60)])
    assert any(similar == 1.0 for *_, similar in passages.matches(a, np.arange(60)))


def test_degenerate_tables(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, long), (2, long), (3, None), (4, ""), (5, "short text"), (None, long), (6, " ".join(["same"] * 100)), (7, " ".join(["same"] * 120)), (8, " ".join(f"v{i % 900}" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("key", "match", "class_id", "comp")})
    got = {(r.key, r.match, r.class_id) for r in passages.near_passages(docs).collect()}
    assert got == {(2, 1, 1), (7, 6, 6)}
    assert passages.near_passages(docs.where("doc_id IN (3, 4, 5)")).count() == 0


def test_documents_that_share_only_a_run_of_one_word_are_not_compared(spark, monkeypatch):
    def never(*args):
        raise AssertionError("pairs were listed")

    monkeypatch.setattr(passages, "list_pairs", never)
    rng = random.Random(7)
    own = lambda: [f"o{rng.randrange(10**9)}" for _ in range(20)]
    rows = [(k, " ".join(own() + ["the"] * 45 + own())) for k in range(12)]
    assert passages.near_passages(spark.createDataFrame(rows, DOCS)).count() == 0


def test_the_screen_of_pairs_loses_no_link():
    rng = np.random.default_rng(1)
    links = 0
    for _ in range(60):
        seqs = []
        for _ in range(6):
            s = np.arange(rng.integers(46, 140))
            changed = rng.random(len(s)) < rng.choice([0.02, 0.08, 0.12])
            s[changed] = 1000 + rng.integers(0, 10**6, changed.sum())
            seqs.append(s)
        codes = np.unique(np.concatenate(seqs), return_inverse=True)[1]
        seqs = np.split(codes, np.cumsum([len(s) for s in seqs])[:-1])
        i, j = np.triu_indices(6, 1)
        for a, b, kept in zip(i, j, passages.pairs_may_match(seqs, i, j, 46), strict=True):
            found = bool(passages.matches(seqs[a], seqs[b]))
            links += found
            assert kept or not found
    assert links > 50


def test_linked_stretches_share_a_probe():
    """Also where shingles repeat: near copies of lines, runs and prose, all pairs by ``matches``."""
    rng = np.random.default_rng(3)
    links = repeats = 0
    for _ in range(150):
        lines = [rng.integers(0, 200, rng.integers(1, 40)) for _ in range(4)]
        base = np.resize(np.concatenate([lines[k] for k in rng.integers(0, 4, 12)]), 140) if rng.random() < 0.7 else np.arange(120)
        seqs = []
        for _ in range(5):
            s = base[: rng.integers(46, 141)].copy()
            changed = rng.random(len(s)) < rng.choice([0.01, 0.05, 0.1])
            s[changed] = 1000 + rng.integers(0, 10**6, changed.sum())
            seqs.append(np.concatenate([2000000 + rng.integers(0, 10**6, 9), s]))
        values, size = np.unique(np.concatenate([np.unique(s) for s in seqs]), return_counts=True)
        found = []
        for s in seqs:
            held = np.unique(s)
            held = held[size[np.searchsorted(values, held)] > 1]
            held = held[np.argsort(size[np.searchsorted(values, held)], kind="stable")]
            order = np.argsort(held)
            rank = order[np.minimum(np.searchsorted(held, s, sorter=order), len(held) - 1)] if len(held) else np.zeros(len(s), int)
            rank = np.where(held[rank] == s, rank, np.iinfo(np.int64).max) if len(held) else rank + np.iinfo(np.int64).max
            few, probe = passages.roles(s, rank, len(held), 46)
            found.append({h: (f, p) for h, f, p in zip(held.tolist(), few.tolist(), probe.tolist(), strict=True) if f})
        for i in range(5):
            for j in range(5):
                if i != j and passages.matches(seqs[i], seqs[j]):
                    links += 1
                    repeats += len(np.unique(seqs[i])) < len(seqs[i])
                    a, b = found[i], found[j]
                    assert any(max(a[h][1] - 0.8 * b[h][0], b[h][1] - 0.8 * a[h][0]) >= -1e-9 for h in a.keys() & b.keys())
    assert links > 300 and repeats > 100


def test_documents_that_share_a_repeated_line_among_their_own_are_not_compared(spark, monkeypatch):
    def never(*args):
        raise AssertionError("pairs were listed")

    for name in ("list_pairs", "block_hits"):
        monkeypatch.setattr(passages, name, never, raising=False)
    rng = random.Random(8)
    line = " ".join(f"l{i}" for i in range(14))
    rows = []
    for k in range(12):
        own = " ".join(f"o{rng.randrange(10**9)}" for _ in range(2))
        rows.append((k, " ".join([line, own] * 6)))
    assert passages.near_passages(spark.createDataFrame(rows, DOCS)).count() == 0


def test_near_copies_that_do_not_link_are_not_written_as_pairs(spark, monkeypatch):
    """Of a group of n copies with many changed words, rows grow with n, not with its square; classes are brute force's."""
    monkeypatch.setattr(passages, "SHORT_LIST", 8)
    monkeypatch.setattr(passages, "BLOCK", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(80):
        w = list(base)
        for i in rng.sample(range(120), 3 if k % 4 == 0 else 8):
            w[i] = f"c{k}x{i}"
        rows.append((k, " ".join(w)))
    comp, _ = brute_classes(rows)
    assert 10 < len(set(comp.values())) < 80
    written, plain = {}, passages.materialize

    def counted(df, label):
        out = plain(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    out = passages.near_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {i: i for i, _ in rows} | {r.key: r.class_id for r in out} | {r.match: r.class_id for r in out} == comp
    assert written.get("passage-more-pairs", 0) < 4 * len(rows)
