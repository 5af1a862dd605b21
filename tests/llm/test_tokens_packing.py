import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgrove.llm import packing, token_counts, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "՘֋ a", "naïve café", "日本語 text", "👩‍👩‍👧 !", "\x00\x1c\x85 a", "don't  'LL\n\n x1234", "a" * 5000, "ꟍ ꟏", "   x"]


def true_ids(text):
    return vocab.library(PATH).encode(text, add_special_tokens=False).ids


def test_the_stored_proof_is_the_one_made():
    assert vocab.digest(PATH) in vocab._stored() and vocab.proof(PATH) == vocab.prove(PATH) == vocab.Proof(True, frozenset(), True)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert token_counts.counter(PATH)(text) == len(true_ids(text))
    assert vocab.ids_of(PATH, True)(text).tolist() == vocab.ids_of(PATH, False)(text).tolist() == true_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert token_counts.counter(PATH)(text) == len(true_ids(text))
    assert vocab.ids_of(PATH, True)(text).tolist() == true_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "👩", "\u200d", "اللغة", "हिन्दी", "ﬁ", "\ufeff", "12", "\n", "<|endoftext|>", "'s"]), max_size=12))
def test_unusual_characters_are_counted_by_pre_tokens(parts):
    text = "".join(parts)
    assert token_counts.counter(PATH)(text) == len(true_ids(text))


def test_unusual_texts_take_the_shortcut():
    counts = token_counts._Counts(PATH, vocab.proof(PATH))
    pieces, special = vocab.pre_tokens(PATH)("plain words 👩 here<|endoftext|>")
    assert special == 1 and [counts[x] for x in pieces[:2]] == [1, 1] and len(counts) - len(counts.proven) < len(pieces)


def tokenizer_file(to, merges, ids=None, add_prefix_space=False, use_regex=True, **changes):
    """A byte-level BPE file with a few merges; ``ids`` gives the order of the results' ids."""
    import json

    made = ["".join(m) for m in merges]
    words = {c: i for i, c in enumerate(sorted(vocab.byte_alphabet()))} | {w: 256 + i for i, w in enumerate(ids or made)}
    bytes_ = {"type": "ByteLevel", "add_prefix_space": add_prefix_space, "trim_offsets": True, "use_regex": use_regex}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": words, "merges": [list(m) for m in merges]}
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": bytes_, "post_processor": None, "decoder": None, "model": model} | changes
    to.write_text(json.dumps(spec))
    return str(to)


BC_AB_BCD = [("b", "c"), ("a", "b"), ("bc", "d")]


@pytest.mark.parametrize(
    ("merges", "options", "plain", "unproven", "by_rank"),
    [
        (BC_AB_BCD, {}, True, 0, True),
        (BC_AB_BCD, {"ids": ["ab", "bc", "bcd"]}, True, 0, False),
        ([("a", "b"), ("b", "c"), ("a", "bc")], {}, True, 1, False),  # abc is never reached: ab comes first
        ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], {"ids": ["ab", "bc", "abc"]}, True, 0, False),
        (BC_AB_BCD, {"add_prefix_space": True}, False, 0, False),
        (BC_AB_BCD, {"use_regex": False}, False, 0, False),
        (BC_AB_BCD, {"normalizer": {"type": "Lowercase"}}, False, 0, False),
        (BC_AB_BCD, {"added_tokens": [{"id": 300, "content": "<x>", "single_word": False, "lstrip": True, "rstrip": False, "normalized": False, "special": True}]}, False, 0, False),
        (BC_AB_BCD, {"added_tokens": [{"id": 259, "content": "<x>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]}, True, 0, True),
    ],
)
def test_proofs_hold_for_any_settings(tmp_path, merges, options, plain, unproven, by_rank):
    import itertools

    path = tokenizer_file(tmp_path / "t.json", merges, **options)
    known = vocab.proof(path)
    assert (known.plain, len(known.unproven), known.by_rank) == (plain, unproven, by_rank)
    lib, count, ids = vocab.library(path), token_counts.counter(path), vocab.ids_of(path, known.by_rank)
    for n in range(6):
        for letters in itertools.product(["a", "b", "c", "d", " ", "<x>"] if n < 4 else "abcd", repeat=n):
            text = "".join(letters)
            want = lib.encode(text, add_special_tokens=False).ids
            assert count(text) == len(want) and ids(text).tolist() == want, text


def test_agreed_ranges_class_alike():
    import regex

    pattern, library = regex.compile(public_tokenizers.PATTERN), vocab.library(PATH).pre_tokenizer
    for cp in [*range(1, 0x558), *range(0x2010, 0x2071), *range(0x20A0, 0x20B1), *range(0x2100, 0x2150), *range(0x2190, 0x2200), *range(0x3040, 0xA000, 7), *range(0xAC00, 0xD7A4, 31)]:
        text = f"a{chr(cp)}a 1{chr(cp)}1 .{chr(cp)}."
        assert [m.span() for m in pattern.finditer(text)] == [o for _, o in library.pre_tokenize_str(text)], hex(cp)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_go_to_their_library(spark, docs_of, name):
    path = public_tokenizers.path(name)
    assert not vocab.proof(path).plain
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_of(["Hello there, world", None]), path).collect()}
    count = token_counts.counter(path)
    assert got == {0: count("Hello there, world"), 1: 0}


def test_counts_of_the_fixture(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = token_counts.op2_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(true_ids(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)


def test_count_edges(docs_of):
    df = docs_of([None, "", "same", "same", "word " * 300_000])
    got = [(r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, PATH).orderBy("doc_id").collect()]
    assert got[:4] == [(0, 0, False), (0, 0, False), (4, 1, False), (4, 1, False)] and got[4][1] >= 300_000 and got[4][2]
    assert token_counts.count_tokens(df.where("false"), PATH).count() == 0


def plain_first_fit(lengths, capacity):
    order, rooms, out = sorted(range(len(lengths)), key=lambda i: -lengths[i]), [], {}
    for i in order:
        k = next((k for k, r in enumerate(rooms) if r >= lengths[i]), len(rooms))
        if k == len(rooms):
            rooms.append(capacity)
        out[i] = (k, capacity - rooms[k])
        rooms[k] -= lengths[i]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_tree_is_first_fit_decreasing(lengths):
    sequence, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    want = plain_first_fit(lengths, 64)
    assert [(int(s), int(o)) for s, o in zip(sequence, offset, strict=True)] == [want[i] for i in range(len(lengths))]


def check_packing(rows, texts, capacity):
    ids = {k: [*true_ids(t or ""), 1] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for k, all_ids in ids.items():
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(all_ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sequences


def test_packing_of_the_fixture(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sequences = check_packing(packing.op8_packing(spark, sf_dir).collect(), texts, 2048)
    used = sum(r.length for held in sequences.values() for r in held)
    assert used / (2048 * len(sequences)) > 0.99


def test_packing_edges_and_groups(docs_of):
    texts = [None, "", "same text", "same text", "word " * 30_000, "<|endoftext|>"]
    df = docs_of(texts)
    rows = packing.pack_documents(df, PATH, capacity=64, group_pieces=40).collect()
    check_packing(rows, dict(enumerate(texts)), 64)
    assert len({r.sequence_id >> 32 for r in rows if r.length < 64}) == 1  # six documents are fewer than a group
    assert all(r.sequence_id >= packing.FULL for r in rows if r.length == 64) and sum(r.length == 64 for r in rows) > 400
    assert packing.pack_documents(df.where("false"), PATH).count() == 0
    many = packing.pack_documents(docs_of([f"text {i}" for i in range(400)]), PATH, group_pieces=50).collect()
    assert len({r.sequence_id >> 32 for r in many}) == 8


def test_groups_are_bounded_whatever_the_rows(spark, docs_of):
    """Thousands of equal rows, and one document of thousands of pieces, make no group larger than others."""
    from collections import Counter

    equal = packing.pack_documents(docs_of(["the same text"]).select("doc_id", "text").crossJoin(spark.range(4000)).drop("id"), PATH, group_pieces=50).collect()
    sizes = Counter(r.sequence_id >> 32 for r in equal)
    assert len(equal) == 4000 and len(sizes) == 80 and max(sizes.values()) < 100
    giant = packing.pack_documents(docs_of(["word " * 60_000, *["short"] * 99]), PATH, capacity=32, group_pieces=10).collect()
    small = Counter(r.sequence_id >> 32 for r in giant if r.length < 32)
    assert sum(small.values()) == 100 and max(small.values()) < 30 and len({r.sequence_id for r in giant if r.length == 32}) == sum(r.length == 32 for r in giant)


def test_files_that_are_not_plain_are_packed_by_their_library(tmp_path, docs_of):
    path = tokenizer_file(tmp_path / "p.json", BC_AB_BCD, add_prefix_space=True)
    assert [r.doc_tokens for r in packing.pack_documents(docs_of(["ab"]), path).collect()] == [len(vocab.library(path).encode("ab").ids) + 1]


def test_null_and_large_keys(docs_of):
    from pyspark.sql import functions as F

    df = docs_of(["one", "two", "three"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id") + F.lit(2**60 + 1)))
    assert {r.doc_id for r in packing.pack_documents(df, PATH).collect()} == {None, 2**60 + 2, 2**60 + 3}


def test_repeated_rows_are_packed_each(docs_of):
    df = docs_of(["one two", "three"])
    rows = packing.pack_documents(df.union(df), PATH).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
