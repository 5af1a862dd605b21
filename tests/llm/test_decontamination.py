import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowgrove.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(texts, items, window):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + window]), set()).add(name)
    out = []
    for text in texts:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                names = windows.get(tuple(w[a : a + n]))
                if names:
                    hit.update(range(a, a + n))
                    found |= names
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def searched(texts, items, window):
    return [(n, [i for a, b in spans for i in range(a, b)], ids) for n, spans, ids in d.search_shard(texts, d.Phrases.of(items, window))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a B c dd é 1 .".split()), max_size=30).map(" ".join), max_size=5), st.lists(st.lists(st.sampled_from("a b C dd".split()), max_size=7).map(" ".join), max_size=4), st.integers(1, 4))
def test_small_alphabets(texts, items, window):
    items = [(str(i), x) for i, x in enumerate(items)]
    assert searched(texts, items, window) == plain(texts, items, window)


def test_long_repeats_and_copies():
    r = random.Random(1)
    base = " ".join(r.choice("ab") for _ in range(3000))
    texts = [base, base, None, "", base[: len(base) // 2] + " zz " + base, "a " * 5000]
    items = [("1", "a " * 12), ("2", base[100:160]), ("10", "b a b"), ("3", None), ("4", "...")]
    assert searched(texts, items, 10) == plain(texts, items, 10)


def test_index_is_a_suffix_array_and_locates():
    r = np.random.default_rng(2)
    text = np.append(r.integers(0, 4, 4000), 0)
    index = d.FMIndex(text, 3)
    order = d.FMIndex._suffixes(text, 3)
    # Sentinels differ by place and end a comparison.
    full = sorted(range(len(text)), key=lambda i: next(([*text[i:j].tolist(), 0, j] for j in range(i, len(text)) if text[j] == 0), [*text[i:].tolist()]))
    assert order.tolist() == full
    assert sorted(index.locate(np.arange(len(text))).tolist()) == list(range(len(text)))


def test_wide_refinement_agrees(monkeypatch):
    text = np.append(np.random.default_rng(3).integers(0, 3, 3000), 0)
    order = d.FMIndex._suffixes(text, 2)
    depth, bits = 1, 2
    key = text.copy()
    keyed = np.sort((key << 20) | np.arange(len(text)))
    wide = d.FMIndex._refined_wide(keyed >> 20, keyed & ((1 << 20) - 1), text > 0, depth)
    assert bits and wide.tolist() == order.tolist()


def test_wavelet_ranks():
    r = np.random.default_rng(4)
    symbols = r.integers(0, 13, 500)
    w = d.WaveletMatrix(symbols, 4)
    ask, ends = r.integers(0, 13, 200), r.integers(0, 501, 200)
    assert w.rank(ask, ends)[0].tolist() == [int((symbols[:e] == s).sum()) for s, e in zip(ask, ends, strict=True)]


def test_words_that_share_a_hash_are_confirmed(monkeypatch):
    plain_hash = d.hashed_words

    def colliding(data):
        starts, ends, hashes = plain_hash(data)
        raw = data.tobytes()
        return starts, ends, np.array([7 if raw[a:b] in (b"fake", b"real") else h for a, b, h in zip(starts, ends, hashes, strict=True)], np.uint64)

    monkeypatch.setattr(d, "hashed_words", colliding)
    assert searched(["x real y fake z", "fake fake"], [("1", "real y")], 2) == [(5, [1, 2], ["1"]), (2, [], [])]


def test_blocks_of_items_give_the_same(spark, docs_of, monkeypatch):
    texts = ["one two three four five", "three four x one two three", None, "nothing here"]
    items = [(1, "one two three"), (2, "two three four five"), (3, "three four"), (3, "x one"), (4, None), (None, "nothing")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def run():
        found = d.find_contamination(docs_of(texts), benchmark, window=3)
        return sorted((r.row.doc_id, r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in found.collect())

    whole = run()
    assert whole[3] == (3, 2, [(0, 1)], [])  # an item without an id hits words but isn't named
    assert whole == [(0, 5, [(0, 5)], ["1", "2", "3"]), (1, 6, [(0, 2), (2, 6)], ["1", "3"]), (2, 0, [], []), (3, 2, [(0, 1)], [])] or whole[1][2] == [(0, 6)]
    monkeypatch.setattr(d, "BLOCK_BYTES", 20)
    parts = run()
    cover = lambda rows: [(k, n, sorted({i for a, b in s for i in range(a, b)}), x) for k, n, s, x in rows]
    assert cover(parts) == cover(whole)


def test_edges(spark, docs_of):
    docs = docs_of(["one two", "one two", "", None, "word " * 100_000 + "one two"])
    none = spark.createDataFrame([], "item_id long, text string")
    assert {(len(r.spans), len(r["items"])) for r in d.find_contamination(docs, none).collect()} == {(0, 0)}
    some = spark.createDataFrame([(1, "One, TWO!")], "item_id long, text string")
    got = {r.row.doc_id: [tuple(s) for s in r.spans] for r in d.find_contamination(docs, some).collect()}
    assert got == {0: [(0, 2)], 1: [(0, 2)], 2: [], 3: [], 4: [(100_000, 100_002)]}
    assert d.find_contamination(docs.where("false"), some).count() == 0


def test_stage_drops_contaminated_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = {r.doc_id for r in d.op4_decontamination(spark, sf_dir).where("contaminated").collect()}
    kept = d.keep_clean(spark, docs, sf_dir)
    assert kept.columns == docs.columns and bad
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad


@pytest.mark.parametrize("ids", [[], ["10", "9"]])
def test_digest_of_items(ids):
    assert hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_merged_spans():
    assert d.merge_spans([(5, 7), (1, 3), (2, 4), (7, 8)]) == [(1, 4), (5, 8)] and d.merge_spans([]) == []


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_share_any_polynomial_hash(spark, docs_of):
    """Two Thue-Morse words of 2,048 letters have one hash modulo 2**64, whatever its base."""
    one, two = thue_morse(2048), thue_morse(2048, 1)
    starts, ends, hashes = d.hashed_words(np.frombuffer(f"{one} {two}".encode(), np.uint8))
    assert hashes[0] == hashes[1] and one != two
    texts, items = [f"x {one} y", f"x {two} y", f"{two} {one}", one], [("1", f"{one} y"), ("2", f"x {two}"), ("3", two)]
    assert searched(texts, items, 2) == plain(texts, items, 2)
    assert searched(texts, items[:1], 2) == plain(texts, items[:1], 2)


def test_spans_are_cut_out(spark, docs_of):
    docs = docs_of(["Keep this, One two! THREE and (this).", "one", None, "nothing of it", "é one two three é"])
    benchmark = spark.createDataFrame([(1, "one two three"), (2, "one")], "item_id long, text string")
    found = d.without_spans(d.find_contamination(docs, benchmark, window=3))
    got = {r.row.doc_id: r.clean_text for r in found.collect()}
    assert got == {0: "Keep this,  and (this).", 1: "", 2: None, 3: "nothing of it", 4: "é  é"}
    again = found.select(F.col("row.doc_id").alias("doc_id"), F.col("clean_text").alias("text"))
    assert d.find_contamination(again, benchmark, window=3).where("size(spans) > 0").count() == 0


def test_a_block_of_phrases_is_bounded():
    """Windows of a full block take some fifteen times its text."""
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(50_000)}" for _ in range(80_000))
    made = d.Phrases.of([("1", text)])
    size = sum(x.nbytes for x in (made.windows, made.lengths, made.first_item, made.items, made.hashes, made.symbols)) + sum(map(len, made.words))
    assert size < 20 * len(text) and len(made.windows) == 80_000 - 9
