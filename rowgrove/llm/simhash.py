"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits over 4-word shingles (XXH64, seed 42); a bit is set where it is set in over half the shingles' hashes.
Fingerprints at ``MAX_DIFFERENCES`` or fewer differing bits are linked, and a document's component is what it can reach over links.

Exact copies collapse first: one row per distinct fingerprint, with the smallest document. Two linked fingerprints agree
wholly on at least one of ``MAX_DIFFERENCES + 1`` blocks of bits, so each fingerprint is sent to that many block keys and links
are sought among those of equal key. A key with more fingerprints than a task should hold is split by the same argument: within it, two linked
fingerprints also agree on a block of their other bits. In a task, fingerprints are sorted by Gray rank; runs of neighbours form nodes that carry
the bits all below them share (mask and pattern), level above level. Pairs of nodes are searched downwards and dropped as soon as their shared
bits differ too often, or as soon as all below them are linked already: a dense group costs its tree, not its pairs.
Tasks return spanning links only, and stars are contracted until components stand (in tables, never on the driver).

A fingerprint that very many rows have (blank texts, one text copied everywhere) and a node with very many links are hot keys of joins of
a few numbers a row; those joins are plain sort-merge joins in front of no aggregation, which adaptive execution splits.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than four words are
one shingle; repeated rows each get their row; an empty table gives an empty result; columns other than key and text are ignored
(the pipeline stage carries them unchanged). Keys are integers, others are refused before anything runs; rows with a null key take part with their
fingerprint, but name no component, and have a null one where no row of their fingerprint has a key.

The pipeline stage works by row, not by key: of each group of near-duplicates the row of smallest id stays (null ids are largest, equal ids go by
digest of the text), and of rows repeated with id and text one. So a text isn't lost because another has its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingle_join
from .common import broadcast_small, reliable, relieve, ship, table

SHINGLE_WORDS = 4
SEED = 42
MAX_DIFFERENCES = 4
#: Neighbours in a node of the next level; node pairs looked at together.
FAN = 4
PAIRS_AT_ONCE = 1 << 18
#: Rows of (block, fingerprint) that one task indexes, about.
TASK_ROWS = 200_000
BITS = 64


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text, as an unsigned number."""
    return fingerprint_of_words(shingle_join.words_of(text), shingle_words)


def fingerprint_of_words(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> int:
    import xxhash

    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))
            relieve()

    return printed(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of bit patterns in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


class _Forest:
    """Union by smallest index over whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


class GrayIndex:
    """Hierarchy over fingerprints of one block, sorted by Gray rank, with a tree per value of the block."""

    def __init__(self, prints: np.ndarray, block_bits: int):
        """``prints`` are sorted by Gray rank, their block in the uppermost ``block_bits`` bits."""
        self.prints = prints
        block = prints >> np.uint64(BITS - block_bits)
        self.starts = [np.arange(len(prints) + 1)]  # children of node i of level j: starts[j][i] up to starts[j][i + 1] of the level below
        self.low, self.high = [prints], [prints]  # bits set in all, bits set in any
        trees = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(prints) else np.zeros(0, np.int64)
        bounds = np.append(trees, len(prints))
        while len(self.low[-1]) > len(trees):
            size = np.diff(bounds)
            nodes = -(-size // FAN)
            first = np.concatenate(([0], np.cumsum(nodes)))
            tree = np.repeat(np.arange(len(trees)), nodes)
            begin = bounds[tree] + (np.arange(first[-1]) - first[tree]) * FAN
            self.starts.append(np.append(begin, bounds[-1]))
            self.low.append(np.bitwise_and.reduceat(self.low[-1], begin))
            self.high.append(np.bitwise_or.reduceat(self.high[-1], begin))
            bounds = first

    def linked(self, most: int) -> np.ndarray:
        """Root (index) of every fingerprint, linked at ``most`` or fewer differing bits within its tree."""
        forest = _Forest(len(self.prints))
        top = len(self.low) - 1
        if not top:
            return forest.root
        near = np.flatnonzero(np.bitwise_count(self.prints[1:] ^ self.prints[:-1]) <= most)
        forest.link(near, near + 1)
        one, roots = self._joined(forest)
        nodes = np.arange(len(self.low[top]))
        stack = [(top, nodes[a : a + PAIRS_AT_ONCE // 8], nodes[a : a + PAIRS_AT_ONCE // 8]) for a in range(0, len(nodes), PAIRS_AT_ONCE // 8)]
        while stack:
            level, u, v = stack.pop()
            if not level:
                before = forest.root
                forest.link(u, v)
                if stack and forest.root is not before:
                    one, roots = self._joined(forest)
                continue
            done = one[level][u] & one[level][v] & (roots[level][u] == roots[level][v])
            u, v = self._children(level, u[~done], v[~done])
            below = level - 1
            shared = ~(self.low[below][u] ^ self.high[below][u]) & ~(self.low[below][v] ^ self.high[below][v])
            fits = np.bitwise_count((self.low[below][u] ^ self.low[below][v]) & shared) <= most
            fits &= (u != v) if not below else True
            u, v = u[fits], v[fits]
            stack += [(below, u[a : a + PAIRS_AT_ONCE // 8], v[a : a + PAIRS_AT_ONCE // 8]) for a in range(0, len(u), PAIRS_AT_ONCE // 8)]
        return forest.root

    def _joined(self, forest: _Forest) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every node, whether all below it are linked already, and to which root."""
        low, high = [forest.root], [forest.root]
        for starts in self.starts[1:]:
            low.append(np.minimum.reduceat(low[-1], starts[:-1]))
            high.append(np.maximum.reduceat(high[-1], starts[:-1]))
        return [a == b for a, b in zip(low, high, strict=True)], low

    def _children(self, level: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a child of u and one of v, once each."""
        starts = self.starts[level]
        left, right = np.divmod(np.arange(FAN * FAN), FAN)
        x, y = starts[u][:, None] + left, starts[v][:, None] + right
        ok = (x < starts[u + 1][:, None]) & (y < starts[v + 1][:, None]) & (x <= y)
        return x[ok], y[ok]


def blocks(most: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of ``most + 1`` blocks; two prints that differ in ``most`` bits agree on one of them."""
    cuts = [BITS * i // (most + 1) for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def link_within(prints: np.ndarray, first: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (index, root index) among prints that agree on a block."""
    turned = rotate(prints, first)
    order = np.argsort(gray_rank(turned), kind="stable")
    root = GrayIndex(turned[order], bits).linked(most)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return order[moved], order[root[moved]]


def _block(bits: list[tuple[int, int]], first_number: int) -> Column:
    """The blocks of a print as (number, value)."""
    print_ = F.col("print")
    return F.array(*[F.struct(F.lit(first_number + i).alias("block"), F.shiftrightunsigned(F.shiftleft(print_, a), BITS - n).alias("value")) for i, (a, n) in enumerate(bits)])


def sub_blocks(first: int, bits: int, most: int) -> list[tuple[int, int]]:
    """Blocks of the bits outside a block; two prints that agree on the block and differ in ``most`` others agree on one of these."""
    out, rest = [], BITS - bits
    cuts = [rest * i // (most + 1) for i in range(most + 2)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        # Places count from behind the block; a stretch that would run round the end is cut short there, which only makes it coarser.
        at = (first + bits + a) % BITS
        out.append((at, min(b - a, BITS - at)))
    return out


def spanning_links(distinct: DataFrame, rows: int, most: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Links (a, b) between representatives of distinct prints, spanning every block's components."""
    cuts = blocks(most)
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * len(cuts) // task_rows)
    sent = distinct.select("print", "rep", F.explode(_block(cuts, 0)).alias("at")).select("print", "rep", "at.block", "at.value")
    # At most as many keys as a block has values, all blocks together: a small table whatever the input.
    hot = [(r.block, r.value) for r in sent.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > task_rows).collect()] if rows > task_rows else []
    sent = sent.withColumns({"sub": F.lit(-1), "sub_value": F.lit(0).cast("long")})
    if hot:
        split = F.broadcast(distinct.sparkSession.createDataFrame(hot, "block int, value long"))
        finer = None
        for i, (first, bits) in enumerate(cuts):
            mine = sent.where(F.col("block") == i).join(split, ["block", "value"]).select("print", "rep", "block", "value", F.explode(_block(sub_blocks(first, bits, most), 0)).alias("s"))
            mine = mine.select("print", "rep", "block", "value", F.col("s.block").alias("sub"), F.col("s.value").alias("sub_value"))
            finer = mine if finer is None else finer.unionByName(mine)
        sent = sent.join(split, ["block", "value"], "left_anti").unionByName(finer)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [x[["print", "rep", "block"]] for x in batches if len(x)]
        if not held:
            return
        every = pd.concat(held, ignore_index=True).drop_duplicates()
        prints, rep, block = every["print"].to_numpy(np.int64).view(np.uint64), every["rep"].to_numpy(np.int64), every["block"].to_numpy()
        for i, (first, bits) in enumerate(cuts):
            mine = np.flatnonzero(block == i)
            if len(mine) > 1:
                a, b = link_within(prints[mine], first, bits, most)
                yield pd.DataFrame({"a": rep[mine[a]], "b": rep[mine[b]]})
        relieve()

    return sent.repartition(tasks, "block", "value", "sub", "sub_value").mapInPandas(link, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node: stars are contracted until each node points at its component's smallest."""
    edges = reliable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # Larger neighbours move to the smallest node around, then smaller ones do. Rows are dealt by both ends before they are made
        # distinct, so that the joins before may be split where a node has very many neighbours.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").repartition("u", "v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = reliable(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).repartition("u", "v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.toDF("node", "component")
        state = now


def _integer_key(docs: DataFrame, key: str) -> Column:
    kind = docs.schema[key].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"keys are integers, {key} is {kind.simpleString()}")
    return F.col(key).cast("long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = MAX_DIFFERENCES) -> DataFrame:
    """Key, print (signed 64 bits) and component_id (smallest key reachable) of every row."""
    ship(docs.sparkSession)
    printed = reliable(docs.select(_integer_key(docs, key).alias("key"), fingerprints(F.col(text)).alias("print")))
    distinct = reliable(printed.groupBy("print").agg(F.min("key").alias("rep")))
    keyed = distinct.where("rep IS NOT NULL")
    found = components(spanning_links(keyed, keyed.count(), most))
    owner = distinct.join(found, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return printed.join(owner, "print").select(F.col("key").alias(key), "print", "component_id")


MEASURES = "struct<print:long,node:long,second:long,n:int,prefix:array<long>>"


def measures(text: Column) -> Column:
    """Fingerprint, digests and size of the shingle set, and its first shingles, in one pass."""

    @F.pandas_udf(MEASURES)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for x in texts:
                words = shingle_join.words_of(x)
                print_ = int(np.uint64(fingerprint_of_words(words)).view(np.int64))
                out.append((print_, *shingle_join.measured(shingle_join.shingles(words))))
            yield pd.DataFrame(out, columns=["print", "node", "second", "n", "prefix"])
            relieve()

    return made(text)


def groups_of_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, one, two, node, component) of every row: its id, two digests of its text, its shingle set and its group.

    Groups are joined by op 9's links and by all five-word similarities of 0.8 or more (``shingle_join``). Sets whose 64-bit digests clash (a few in
    10^10) are left out of the comparison: their second digests show them.
    """
    ship(docs.sparkSession)
    digests = [F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")]
    every = reliable(docs.select(F.col(key).alias("id"), *digests, measures(F.col(text)).alias("m")).select("id", "one", "two", "m.*"))
    clashing = every.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("node")
    clear = every if clashing.isEmpty() else every.join(F.broadcast(clashing), "node", "left_anti")
    owner = reliable(clear.groupBy("print").agg(F.min("node").alias("rep")))
    same = clear.select("print", "node").distinct().join(owner, "print").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    known = reliable(same.union(spanning_links(owner, owner.count(), MAX_DIFFERENCES)).where("a <> b").distinct())
    wanted = docs.select(F.col(key).alias("id"), *digests, F.col(text).alias("text"))
    found = components(shingle_join.links(clear.select("id", "node", "one", "two", "n", "prefix"), wanted, known, components))
    grouped = every.select("id", "one", "two", "node").join(found.withColumnRenamed("component", "_component"), "node", "left")
    return grouped.select("id", "one", "two", "node", F.coalesce("_component", "node").alias("component"))


def keep_one_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of near-duplicates stays, that of smallest id."""
    rows = reliable(groups_of_rows(docs))
    order = F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("one"), F.col("two"))
    first = rows.groupBy("component").agg(F.min(order).alias("first")).select("component", F.struct("first.id", "first.one", "first.two").alias("first"))
    mine = F.struct("id", "one", "two")
    go = reliable(rows.join(first, "component").where(~mine.eqNullSafe(F.col("first"))).select("id", "one", "two").distinct())
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_one"), F.xxhash64(F.lit(1), "text").alias("_two"))

    def met(other: DataFrame) -> Column:
        return named["_id"].eqNullSafe(other["id"]) & (named["_one"] == other["one"]) & (named["_two"] == other["two"])

    few = broadcast_small(go)
    kept = named.join(few, met(few), "left_anti")
    again = reliable(rows.groupBy("id", "one", "two").agg(F.count("*").alias("n")).where("n > 1").select("id", "one", "two"))
    if again.isEmpty():
        return kept.select("row.*")
    twice = broadcast_small(again)
    repeated = kept.join(twice, met(twice), "left_semi").dropDuplicates(["_id", "_one", "_two"])
    return kept.join(twice, met(twice), "left_anti").union(repeated).select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
