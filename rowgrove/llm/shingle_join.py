"""Exact confirmation for the near-duplicate stage: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A shingle is the 64-bit XXH64 (seed 42) of five lower-cased words; fewer words are one shingle. Equal sets are one node. Of two sets at 0.8 or
more each has at most a fifth of its shingles outside the other. That is used twice:

1. Of each set the first three tenths in order of the hashes are looked at. A set with more than a fifth (of all its shingles) among them that occur in
   no other set's first ones is done; most sets are. (Of a similar set, the first ones hold all but a fifth of them: what it lacks, and what its own others push out.)
2. Of the others, all shingles are counted. A set of which more than a fifth occurs nowhere else is done. The rest meet on their first shingles in order
   of count, the rarest first, so a passage that many texts share isn't a meeting place unless it is most of a text. Similar sets of n and m shingles
   share one of the first n - ceil(0.8 n) + 1 of each in any common order.

Sets that meet are first compared with the smallest node of the place, then those that still aren't in one component with each other: a group of many
copies costs its members, not its pairs. A pair that meets in many places is made at the first one of them. Sizes, places in the order and parity sketches drop pairs that can't reach 0.8; what is left is confirmed
on the whole sets. Counting is combined before shuffles, and hot shingles are met in joins that adaptive execution splits.

Defined results: texts without words have no shingles and no links here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, reliable, relieve

SHINGLE_WORDS = 5
SEED = 42
#: The similarity from which texts are linked, as a fraction: 4 / 5.
OVER, UNDER = 4, 5
#: Rows of (shingle, node) that a task looks at.
TASK_ROWS = 250_000
PAIRS_AT_ONCE = 1 << 16
SKETCH_BITS = 1024
#: First places of a set that go with each of its places, so that a pair is made at the first place it shares among them.
HEAD = 32


def shingles(words: list[bytes]) -> np.ndarray:
    """The sorted set of shingles of lower-cased words."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(SHINGLE_WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def first_size(n: int) -> int:
    """How many shingles of a set are looked at first: a fifth that a similar set may lack, and a tenth that it must have."""
    return min(n, n // UNDER + 1 + n // 10)


def measured(x: np.ndarray) -> tuple[int, int, int, list[int]]:
    """(digest, second digest, size, first shingles in order of their hashes) of a set."""
    import xxhash

    raw = x.tobytes()
    one, two = np.array([xxhash.xxh64_intdigest(raw, SEED), xxhash.xxh64_intdigest(raw, SEED + 1)], np.uint64).view(np.int64).tolist()
    return one, two, len(x), x[: first_size(len(x))].view(np.int64).tolist()


def parity_sketch(x: np.ndarray) -> bytes:
    """Parities of a set's shingles by bucket: two sets differ in at least as many shingles as their sketches in bits."""
    return np.packbits(np.bincount((x & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def whole_sets(text: Column) -> Column:
    """Struct of all shingles of texts (as signed numbers) and their sketch."""

    @F.pandas_udf("struct<shingles:array<long>,sketch:binary>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(words_of(x)) for x in texts]
            yield pd.DataFrame({"shingles": [x.view(np.int64) for x in sets], "sketch": [parity_sketch(x) for x in sets]})
            relieve()

    return made(text)


def counted(rows: DataFrame) -> DataFrame:
    """Rows (shingle, ...) whose shingle occurs more than once, with its count ``df``."""
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    return rows.join(often, "shingle")


def _fits(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of sizes n and m that share the shingle at these places of the order may reach the similarity."""
    most = F.least(at, to) + F.least(n - at, m - to)
    return (OVER * F.greatest(n, m) <= UNDER * F.least(n, m)) & ((OVER + UNDER) * most >= OVER * (n + m))


def other_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of a meeting place in different components that sizes, places and sketches leave possible."""
    held = [x for x in batches if len(x)]
    if not held:
        return
    every = pd.concat(held, ignore_index=True).sort_values(["shingle", "n", "node"], kind="stable")
    shingle, n, node, at, part = (every[c].to_numpy(np.int64) for c in ("shingle", "n", "node", "at", "component"))
    known = np.array([len(x) for x in every["head"]], np.int64)
    head = np.zeros((len(every), HEAD), np.int64)
    head[np.arange(HEAD) < known[:, None]] = np.concatenate(every["head"].to_list())
    # Places of a set stand in one order for all, so those before this one are the beginning of its head.
    before = np.minimum(known, every["i"].to_numpy(np.int64))
    sketch = np.frombuffer(b"".join(every["sketch"]), np.uint64).reshape(len(every), -1)
    del held, every
    cuts = np.concatenate(([0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]))
    out, size = [], 0
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if part[a:b].min() == part[a:b].max():
            continue
        ends = a + np.searchsorted(n[a:b], UNDER * n[a:b] // OVER, side="right")
        for i in range(a, b - 1):
            j = np.arange(i + 1, ends[i - a])
            j = j[part[j] != part[i]]
            most = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
            j = j[(OVER + UNDER) * most >= OVER * (n[i] + n[j])]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            j = j[(OVER + UNDER) * apart <= (n[i] + n[j]) * (UNDER - OVER)]
            if len(j) and before[i]:
                met = np.isin(head[j], head[i, : before[i]]) & (np.arange(HEAD) < before[j][:, None])
                j = j[~met.any(axis=1)]
            if len(j):
                out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
                size += len(j)
                if size >= PAIRS_AT_ONCE:
                    yield pd.DataFrame(np.concatenate(out), columns=["a", "b"]).drop_duplicates()
                    out, size = [], 0
    if size:
        yield pd.DataFrame(np.concatenate(out), columns=["a", "b"]).drop_duplicates()
    relieve()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    similar = UNDER * shared >= OVER * (F.size("x") + F.size("y") - shared)
    return pairs.join(two, "b").join(one, "a").where(similar).select("a", "b").distinct()


def links(rows: DataFrame, texts: DataFrame, known: DataFrame, components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between nodes that span the components of ``known`` links and of all similar pairs.

    ``rows`` is (id, node, one, two, n, prefix), a row or more for each node; ``texts`` is (id, one, two, text), whose rows id and digests name;
    ``components`` makes (node, component) of links.
    """
    spark = rows.sparkSession
    # A shingle of one node only is counted for that node, however many rows it has; both counts are combined before their shuffle.
    firsts = rows.select("node", F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("high"))
    alone = firsts.where("node = high").groupBy("node").agg(F.count("*").alias("alone"))
    each = rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min(F.struct("id", "one", "two")).alias("t"))
    some = each.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) <= F.floor(F.col("n") * (UNDER - OVER) / UNDER))
    # All shingles of the sets that are left, from one text of each node.
    text_of = some.select("node", "t.*")
    chosen = broadcast_small(reliable(text_of))
    same = texts["id"].eqNullSafe(chosen["id"]) & (texts["one"] == chosen["one"]) & (texts["two"] == chosen["two"])
    # A row that is repeated gives its set twice; that only makes its shingles look more frequent.
    sets = reliable(texts.join(chosen, same).select("node", whole_sets(F.col("text")).alias("s")).select("node", "s.*"))
    shared = counted(sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    ranked = shared.groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "shingle"))).alias("common"))
    alone, allowed = F.col("n") - F.size("common"), F.floor(F.col("n") * (UNDER - OVER) / UNDER).cast("int")
    first = F.slice("common", F.lit(1), F.greatest(allowed + 1 - alone, F.lit(1)))
    kept = ranked.where(alone <= allowed).select("node", "n", alone.alias("alone"), first.alias("first"))
    kept = reliable(kept)
    places = reliable(kept.select("node", "n", "alone", F.posexplode("first").alias("i", "x")).select("node", "n", "i", (F.col("alone") + F.col("i")).alias("at"), "x.shingle"))
    leader = places.groupBy("shingle").agg(F.min(F.struct("node", "n", "at")).alias("lead"), F.count("*").alias("here")).where("here > 1")
    met = places.join(leader, "shingle").where((F.col("node") != F.col("lead.node")) & _fits(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    pairs = reliable(met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct())
    state = reliable(components(known.union(confirmed(pairs, sets))))
    here = places.join(broadcast_small(state), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = here.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), places.count() // TASK_ROWS)
    heads = kept.select("node", F.transform(F.slice("first", 1, HEAD), lambda x: x["shingle"]).alias("head"))
    sketched = here.join(several, "shingle").join(sets.select("node", "sketch").join(heads, "node"), "node")
    more = sketched.repartition(tasks, "shingle").mapInPandas(other_pairs, "a long, b long").distinct()
    more = reliable(more.join(pairs, ["a", "b"], "left_anti"))
    return state.select(F.col("node").alias("a"), F.col("component").alias("b")).union(confirmed(more, sets))
