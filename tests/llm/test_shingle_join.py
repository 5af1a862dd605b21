import random

import numpy as np
import pandas as pd
import pytest

from rowgrove.llm import shingle_join as sj
from rowgrove.llm import simhash


def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        out.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def plain_kept(keys, texts, links):
    """Smallest keys of the components of given links and of all pairs at 0.8 or more."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = plain_sets(texts)
    pairs = [(keys[i], keys[j]) for i in range(len(keys)) for j in range(i) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for a, b in [*links, *pairs]:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k for k in keys if find(k) == k}


def near_copies(seed, groups=12, words=60):
    """Chains and stars of near copies around 0.8, and texts with a common line."""
    r = random.Random(seed)
    line = [f"common{i}" for i in range(30)]
    out = []
    for g in range(groups):
        text = [f"g{g}w{r.randint(0, 10**6)}" for _ in range(words)] + (line if g % 2 else [])
        for _ in range(6):
            out.append(" ".join(text))
            text = list(text)
            for _ in range(r.randint(0, 3)):
                text[r.randrange(len(text))] = f"new{r.randint(0, 10**6)}"
            if r.random() < 0.3:
                text = text[r.randint(0, 4) :]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_against_all_pairs(spark, docs_of, seed):
    texts = near_copies(seed) + [None, "", "a b", "A  b", "a b c"]
    docs = docs_of(texts)
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    expected = plain_kept(list(range(len(texts))), texts, list(near.items()))
    assert len(expected) < len({*near.values()}), "pairs that op 9's links miss"
    assert {r.doc_id for r in simhash.keep_one_each(spark, docs, "").collect()} == expected


def test_stage_on_the_fixture(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    near = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    expected = plain_kept([r.doc_id for r in rows], [r.text for r in rows], near)
    assert {r.doc_id for r in simhash.keep_one_each(spark, docs, "").collect()} == expected


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 40)).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.92], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64))))
        shared = len(np.intersect1d(a, b))
        if len(b) and 5 * shared >= 4 * (len(a) + len(b) - shared):
            met += 1
            assert set(sj.measured(a)[3]) & set(sj.measured(b)[3])
    assert met > 50


def test_a_text_is_not_lost_by_its_id(spark):
    a, b, c = "one text of its own about nothing much at all", "another text that has copies under two ids here", "a third one that stands for itself with words"
    docs = spark.createDataFrame([(1, b), (5, a), (5, b), (7, c), (None, c), (None, "only here"), (5, a)], "doc_id long, text string")
    kept = simhash.keep_one_each(spark, docs, "")
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, b), (5, a), (7, c), (None, "only here")], key=str)


def test_columns_with_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(2, "a b c", 1, 2, 3), (1, "a b c", 4, 5, 6)], "doc_id long, text string, _one int, id int, component int")
    assert [tuple(r) for r in simhash.keep_one_each(spark, docs, "").collect()] == [(1, "a b c", 4, 5, 6)]


def test_a_group_of_near_copies_makes_few_pairs(spark, docs_of):
    """Pairs to confirm grow with the members of a group, not with their square."""
    r = random.Random(9)
    text = [f"w{i}" for i in range(120)]
    copies = [" ".join(w if i != at else f"new{k}" for i, w in enumerate(text)) for k, at in ((k, r.randrange(120)) for k in range(300))]
    docs = docs_of(copies)
    seen = []
    plain, sj.confirmed = sj.confirmed, lambda pairs, sets: seen.append(pairs.count()) or plain(pairs, sets)
    try:
        assert simhash.keep_one_each(spark, docs, "").count() == 1
    finally:
        sj.confirmed = plain
    assert sum(seen) < 300 * 12


def test_the_first_shingles_of_similar_sets_hold_enough_of_each_other():
    """For all sizes: what a similar set lacks, or its others push out of its first shingles, is at most a fifth."""
    for n in range(1, 130):
        for m in range(1, 130):
            both = -(-4 * (n + m) // 9)
            if both <= min(n, m):
                lacking, others = n - both, m - both
                lost = max(lacking, sj.first_size(n) - sj.first_size(m) + others) if sj.first_size(m) < m else lacking
                assert lost <= n // 5, (n, m)


def test_a_pair_is_made_at_one_place():
    """Sets that share many places are compared once, and none of their pairs is lost."""
    r = np.random.default_rng(11)
    base = np.unique(r.integers(1, 2**62, 200))
    sets = [np.unique(np.where(r.random(len(base)) < 0.05, r.integers(1, 2**62, len(base)), base)) for _ in range(60)]
    count = {}
    for x in sets:
        for v in x.tolist():
            count[v] = count.get(v, 0) + 1
    rows = []
    for k, x in enumerate(sets):
        order = sorted((count[v], v) for v in x.tolist() if count[v] > 1)
        alone = len(x) - len(order)
        first = [v for _, v in order[: max(1, len(x) // 5 + 1 - alone)]]
        rows += [(k, v, len(x), i, alone + i, k, sj.parity_sketch(x.astype(np.uint64)), first[: sj.HEAD]) for i, v in enumerate(first)]
    frame = pd.DataFrame(rows, columns=["node", "shingle", "n", "i", "at", "component", "sketch", "head"])
    by_place = [x for _, x in frame.groupby("shingle")]  # each place in a task of its own, as if there were very many
    made = [tuple(p) for x in by_place for y in sj.other_pairs(iter([x])) for p in y.to_numpy().tolist()]
    similar = {(a, b) for b in range(60) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert similar and similar <= set(made)
    assert len(made) < 1.1 * len(set(made))
