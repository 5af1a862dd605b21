import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rowgrove.llm import simhash as s


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b", "a b c d", "A\x0bb\tC  d e", "é É x y z ü", "w " * 3000, "\x1c a\xa0b"])
def test_fingerprints(text):
    assert s.fingerprint(text) == plain_print(text)


def test_fingerprints_of_the_fixture(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = s.op9_simhash(spark, sf_dir).collect()
    assert len(got) == len(texts)
    keys = sorted(texts)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert all(prints[k] == plain_print(texts[k]) for k in keys[::5])
    root = plain_components([prints[k] for k in keys])
    assert {r.doc_id: r.component_id for r in got} == {k: keys[i] for k, i in zip(keys, root, strict=True)}


def indexed(prints, most=4):
    x = np.array(prints, np.uint64)
    forest = s._Forest(len(x))
    for first, bits in s.blocks(most):
        forest.link(*s.link_within(x, first, bits, most))
    return forest.root.tolist()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 90), st.integers(1, 4), st.integers(0, 9))
def test_index_finds_every_component(seed, n, centres, spread):
    r = random.Random(seed)
    middle = [r.getrandbits(64) for _ in range(centres)]
    prints = list(dict.fromkeys(m ^ sum(1 << b for b in r.sample(range(64), r.randint(0, spread))) for m in (r.choice(middle) for _ in range(n))))
    assert indexed(prints) == plain_components(prints)


def test_dense_groups_and_shared_blocks():
    r = random.Random(5)
    dense = list({0xABCDEF0123456789 ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64)})
    assert set(indexed(dense)) == {0}
    shared = list({0xABC0000000000000 | r.getrandbits(50) for _ in range(700)})
    assert indexed(shared) == plain_components(shared)


def test_gray_rank_orders_neighbours():
    x = np.arange(256, dtype=np.uint64)
    by_rank = x[np.argsort(s.gray_rank(x))].tolist()
    assert all((a ^ b).bit_count() == 1 for a, b in zip(by_rank, by_rank[1:], strict=False))


def test_components_of_chains(spark):
    n = 70
    links = [(i + 1, i) for i in range(n)] + [(200, 201), (203, 202), (201, 203), (500, 500)]
    got = {r.node: r.component for r in s.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 201: 200, 202: 200, 203: 200}
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark, docs_of):
    df = docs_of([None, "", "  ", "same text of six words here", "same text of six words here", "Same TEXT of six words here", "quite another text than that one"])
    got = {r.doc_id: r.component_id for r in s.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    assert s.near_duplicates(df.where("false")).count() == 0
    keyless = df.withColumn("doc_id", s.F.lit(None).cast("long")).where("text LIKE 'same%' OR text LIKE 'quite%'")
    more = keyless.union(keyless.limit(1).withColumn("text", s.F.lit("only here without a key")))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in s.near_duplicates(df.union(more)).where("doc_id IS NULL").collect()) == [("None", "3"), ("None", "3"), ("None", "6"), ("None", "None")]
    assert s.keep_one_each(spark, df.union(df).union(more), "").count() == 4
    kept = s.keep_one_each(spark, df.union(df), "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 6]
    with pytest.raises(TypeError, match="integers"):
        s.near_duplicates(df.withColumn("doc_id", s.F.lit("a")))


def test_hot_blocks_are_split(spark):
    """All prints share a block: its key is split by the other bits, and no link is lost."""
    r = random.Random(8)
    prints = [0xABC0000000000000 | r.getrandbits(48) for _ in range(300)]
    prints = list(dict.fromkeys(prints + [p ^ sum(1 << b for b in r.sample(range(48), r.randint(1, 4))) for p in prints]))
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "print long, rep long")
    for task_rows in (100, 1 << 30):
        found = s.components(s.spanning_links(df, len(rows), 4, task_rows)).collect()
        root = {r.node: r.component for r in found}
        assert [root.get(i, i) for i in range(len(prints))] == plain_components(prints)
    for first, bits in s.blocks(4):
        spans = [x % 64 for a, n in s.sub_blocks(first, bits, 4) for x in range(a, a + n)]
        assert len(spans) == len(set(spans)) and not set(spans) & set(range(first, first + bits))
