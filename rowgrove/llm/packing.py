"""Packing by first-fit decreasing over a tournament tree, in randomised groups.

Each document is tokenized where it lies and cut at every ``capacity`` ids, so all pieces but a document's last fill a
sequence. A full piece is a sequence of its own and isn't grouped. Of every other piece only a description (a few numbers, no ids) is dealt by
chance into groups of ``group_pieces`` expected pieces; a document has at most one, so their number is known from the number of rows. Chance goes by row,
not by value, so many equal rows spread like any others. Within a group, pieces go in decreasing length to the first sequence with room. A tournament
tree holds at each inner node the largest remaining room below it, so finding the first fit and updating it take log(sequences) steps.

Padding: full pieces waste nothing, and remainders share sequences; a group can leave one sparsely filled sequence.
Defined results: a null or empty text is a document of the end id alone; any length is packed whole; an empty table gives
an empty result; repeated rows are packed once each; ties in length go by (document, start, crc); null
keys are keys; other columns are ignored. Rows are pieces, so ids are never lost: each lies in exactly one piece. Files that aren't plain
byte-level BPE are encoded by their library. A task that is run again deals its rows alike as long as its input comes in the same order, as that
of a scan does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import relieve, ship, table
from .vocab import ids_of, proof

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
#: Expected pieces of a randomised group: large enough to make its one open sequence negligible, small enough for one task.
GROUP_PIECES = 16_384
SEED = 20_011
#: From here on sequences are numbered that one piece fills.
FULL = 1 << 62

PIECE = "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>"


class RoomTree:
    """Tournament tree over sequences in order of opening; every node knows the largest room below it."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, sequences) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """Put ``need`` into the first sequence with room; returns the sequence and the room it had."""
        room, node = self.room, 1
        if room[1] < need:
            raise ValueError("no sequence has room")
        while node < self.leaves:
            node *= 2
            if room[node] < need:
                node += 1
        had = room[node]
        room[node] = had - need
        leaf, node = node - self.leaves, node // 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left >= right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; the order of equal lengths is that of the input."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = int(np.count_nonzero(lengths == capacity))
    sequence[order[:full]] = np.arange(full)  # these fill one sequence each, before any other is opened
    rest = order[full:]
    tree = RoomTree(len(rest), capacity)
    for i, need in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
        leaf, had = tree.place(need)
        sequence[i], offset[i] = full + leaf, capacity - had
    return sequence, offset


def pieces_of(ids: np.ndarray, capacity: int) -> list[dict]:
    """Descriptions of the pieces of one document's ids."""
    n = len(ids)
    raw = ids.astype("<u4", copy=False)
    return [
        {"start": a, "length": min(capacity, n - a), "ids_crc32": zlib.crc32(raw[a : a + capacity].tobytes()), "doc_tokens": n}
        for a in range(0, n, capacity)
    ]


def cut_documents(docs: DataFrame, path: str, *, key: str, text: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: key (as doc), row, start, length, ids_crc32, doc_tokens."""
    by_rank = proof(path).by_rank

    @F.pandas_udf(PIECE)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = ids_of(path, by_rank)
        for texts in batches:
            yield pd.Series([pieces_of(np.append(encode(x or ""), np.uint32(end_id)), capacity) for x in texts], dtype=object)
            relieve()

    numbered = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return numbered.select("doc", "row", F.explode(cut(F.coalesce(F.col("text"), F.lit("")))).alias("piece")).select("doc", "row", "piece.*")


def pack_documents(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, seed: int = SEED
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids.

    Returns, per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. A full piece's sequence_id is 2**62 and more.
    """
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    groups = max(1, -(-docs.count() // group_pieces))
    pieces = cut_documents(docs, path, key=key, text=text, capacity=capacity, end_id=end_id)
    numbers = ["start", "length", "ids_crc32", "doc_tokens"]
    names = [key, *numbers, "sequence_id", "offset"]
    full = F.col("length") == capacity
    own = F.lit(FULL) + F.monotonically_increasing_id()
    dealt = pieces.withColumns({"grp": F.when(~full, F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups))), "own": own})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close_group() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            group = pa.concat_tables(held)
            held.clear()
            sequence, offset = first_fit_decreasing(group["length"].to_numpy(), capacity)
            taken = (group["grp"].to_numpy().astype(np.int64) << 32) + sequence
            yield from pa.table([group["doc"], *(group[c] for c in numbers), pa.array(taken, pa.int64()), pa.array(offset, pa.int64())], names=names).to_batches()

        for batch in batches:  # Arrow keeps null keys and large ones exact
            rows = pa.table(batch)
            alone = rows.filter(pc.is_null(rows["grp"]))
            if len(alone):
                yield from pa.table([alone["doc"], *(alone[c] for c in numbers), alone["own"], pa.array(np.zeros(len(alone), np.int64))], names=names).to_batches()
            rows = rows.filter(pc.is_valid(rows["grp"]))
            grp = rows["grp"].to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts, cuts[1:] if len(grp) else [], strict=False):
                if held and held[-1]["grp"][0].as_py() != grp[a]:
                    yield from close_group()
                held.append(rows.slice(a, b - a))
        yield from close_group()

    # Full pieces may go anywhere; the rest comes group by group, so that a task holds one group.
    spread = dealt.repartition(F.coalesce("grp", "own")).sortWithinPartitions("grp", "doc", "start", "ids_crc32")
    schema = f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return spread.select("doc", *numbers, "grp", "own").mapInArrow(pack, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: sequences of the documents that are left."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(VOCABULARY))
