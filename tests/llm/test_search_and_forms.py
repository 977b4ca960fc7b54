"""Operators 11 to 13: ranked search, fill-in-middle forms and SentencePiece ids."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from foldwright.llm import infill, pieces, ranked

DOCS = "doc_id long, text string, form string, ids int, row string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(docs, items, k=50):
    """Brute force: every document against every item."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    wanted = {}
    for q, t in items:
        if q is not None:
            wanted.setdefault(q, set()).update(terms(t))
    df = {t: sum(t in b for _, b in bags) for q in wanted.values() for t in q}
    out = []
    for q, words in wanted.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * len(b) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in words if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(q, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300, size=80):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(1, 60), rng.randrange(1, 60), rng.randrange(1, 60))}"
    rows = [(i, " ".join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randrange(1, size)))) for i in range(n)]
    return [*rows, (3, rows[3][1]), (None, rows[4][1]), (n, None), (n + 1, ""), (n + 2, "?! \x00"), (n + 3, "É w1é_w2\x00w3"), (n + 4, "w1 " * 5000)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, "r", "s") for i, t in rows], DOCS)


@pytest.mark.parametrize("depth", [50, 3, 1])
def test_search_equals_brute_force(spark, depth):
    rows = corpus(2)
    items = [(1, "w1 w2 w3 w40"), (2, "w1 W1 w59"), (2, "w58"), (3, None), (4, "nowhere"), (None, "w1"), (5, rows[7][1]), (6, "é w1é")]
    found = ranked.search(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), depth=depth)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == best(rows, items, depth)


def test_search_without_a_sent_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(ranked, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(ranked, "TERM_CHUNK", 1)
    rows = corpus(3, 120)
    items = [(1, "w1 w2 w3 w40 w17"), (2, rows[7][1])]
    found = ranked.search(docs_of(spark, rows).repartition(5), spark.createDataFrame(items, "item_id long, text string"), depth=4)
    assert sorted((tuple(r) for r in found.collect()), key=str) == best(rows, items, 4)


def test_search_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in range(200, 80, -1)] + [(i, "other things") for i in range(300)]
    found = ranked.search(docs_of(spark, rows), spark.createDataFrame([(1, "words")], "item_id long, text string"))
    assert [(r["rank"], r.doc_id) for r in found.orderBy("rank").collect()] == [(i + 1, 81 + i) for i in range(50)]


def test_search_of_nothing(spark):
    none, items = docs_of(spark, []), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(docs_of(spark, [(1, "w1"), (2, "x")]), items.where("item_id > 5")).count() == 0
    assert ranked.search(docs_of(spark, [(1, None)]), items).count() == 0


TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def filled(key, text):
    text, n = text or "", len(TOKEN.findall(text or ""))
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    starts = [m.start() for m in TOKEN.finditer(text)] + [len(text)]
    a, b = sorted((starts[h[0] % (n + 1)], starts[h[1] % (n + 1)]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_forms_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab c\n<PSM>é😀\r.") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "one two"), (None, None), (7, rows[7][1]), (900, None), (901, ""), (902, "a<P>b"), (903, "x" * 200_000), (904, "a, " * 80_000), (905, "<<S<P<M")]
    for part in (infill.PART, 3):
        monkeypatch.setattr(infill.token_cuts, "__defaults__", (part,))
        out = infill.fill_in_middle(docs_of(spark, rows if part > 3 else rows[:60]), name="form")
        out = out.select("doc_id", "text", "form.*", infill.restored(F.col("form.output"), F.col("form.form")).alias("again")).collect()
        assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=str) == sorted(((i, t, *filled(i, t)) for i, t in (rows if part > 3 else rows[:60])), key=str)
        assert all(r.again == (r.text or "") for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_cuts_do_not_depend_on_parts():
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(infill.TOKEN), "isolated")
    for text in ("", "abc", "abc def", "é" * 9, "a1" * 9, "longword " * 5, " " * 7):
        starts = [*(m.start() for m in TOKEN.finditer(text)), len(text)]
        n = len(starts) - 1
        for one in range(n + 2):
            for two in (0, one, n, n + 1):
                want = (n, *sorted((starts[one % (n + 1)], starts[two % (n + 1)])))
                assert all(infill.token_cuts(text, split, one, two, part) == want for part in (1, 2, 3, 5, 100))


def test_forms_keep_other_columns(spark):
    out = infill.fill_in_middle(docs_of(spark, [(1, "some words here")]), name="fim")
    assert out.drop("fim").first() == docs_of(spark, [(1, "some words here")]).first()
    assert infill.fill_in_middle(docs_of(spark, [])).count() == 0


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


def awkward():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "▁", "\n", "\t", "é", "😀", "中", "<s>", "<0x41>", "\x00", ".", "ing", " "]) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    return [None, "", " ", "  ", "▁", "a ", " a", "a▁", "▁ ▁a", "a  b ", "word" * 30_000, "some words, " * 20_000, *texts, *texts[:9]]


@pytest.mark.parametrize(("chunk", "words", "apart"), [(1 << 22, 1_000_000, True), (1, 3, True), (1 << 22, 10, False)])
def test_ids_equal_the_library(model, monkeypatch, chunk, words, apart):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "WORD_CHUNK", chunk)
    monkeypatch.setattr(pieces, "TABLE_WORDS", words)
    texts = awkward()
    texts = texts if chunk > 1 else texts[:100]
    assert pieces.cuts_at_marks(model)
    table = pieces.WordTable(model)
    got = [x.as_py() for part in pieces.encoded(pa.array(texts, pa.string()), table, apart) for x in part]
    assert got == model.encode([t or "" for t in texts])


def test_each_word_is_segmented_once(model):
    import pyarrow as pa

    class Counting:
        def __init__(self):
            self.seen = []

        def encode(self, words, **_):
            self.seen += words
            return model.encode(words)

        def __getattr__(self, name):
            return getattr(model, name)

    counting = Counting()
    table = pieces.WordTable(counting)
    for _ in range(3):
        list(pieces.encoded(pa.array(["red red blue", "blue  red"] * 50), table, True))
    assert sorted(counting.seen) == sorted(["red", "blue", " red"])


def test_round_trip_in_spark(spark, model):
    rows = list(enumerate(awkward()))
    out = pieces.decode(pieces.encode(docs_of(spark, rows).repartition(3), name="ids"), name="row").collect()
    assert len(out) == len(rows) and {r.form for r in out} == {"f"}
    for r in out:
        want = model.encode(r.text or "")
        assert r.ids == want and r.row == model.decode(want)
    assert pieces.decode(pieces.encode(docs_of(spark, []))).count() == 0
    assert pieces.decode(docs_of(spark, [(1, "x")]).select(F.lit(None).cast("array<int>").alias("ids"))).first().decoded == ""


def test_query_of_pieces_equals_the_library(spark, model):
    from foldwright.llm.common import table

    sf = "/root/testdata/sf0.001"
    want = set()
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = model.encode(r.text or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids))))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op13_piece_round_trip(spark, sf).collect()} == want
