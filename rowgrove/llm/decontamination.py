"""Benchmark decontamination by an FM-index per training shard.

Texts of a shard become word symbols: the benchmark's words have a symbol each, and every other word is a sentinel of its own
(no phrase can pass it), as is each document's end. The shard's Burrows-Wheeler transform is held as a bit vector (sentinel or not) over a wavelet
matrix of symbols. All benchmark windows are searched backwards together by rank queries, matches are located by walking to
sampled suffix positions, and occurrences are merged into removal spans. Words found through their hash are confirmed by their bytes.

A shard is a bounded stretch of whole documents inside one task (a longer document is a shard of its own), so nothing is shuffled:
documents stream past, and only the benchmark is sent to the tasks, in blocks of ``BLOCK_BYTES``. The driver makes one block at a time, and a task holds
one at a time: it searches some ``TEXTS_BYTES`` of documents for each block in turn. So neither grows with the benchmark.

Defined results: null and empty texts have no words and aren't contaminated, null texts of items have no windows; an item of fewer words than a window is one
window; items with equal ids count as one; an item without an id hits words but isn't named; an empty benchmark contaminates nothing; repeated rows each
get their row; words that share a hash are told apart by their bytes; columns other than those named are ignored (the pipeline stage carries them unchanged).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import relieve, ship, table

WINDOW = 10
#: Text of a shard in bytes, about; the bits that hold a position in a shard.
SHARD_BYTES = 1 << 20
#: Every so many positions of a shard, the suffix position is kept.
SAMPLE = 16
#: Benchmark text in one block, about (a block is broadcast; its windows take some fifteen times as much), and text that is searched for one block after another.
BLOCK_BYTES, TEXTS_BYTES = 4 << 20, 32 << 20
ROWS_AT_ONCE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n + 1, inverse))


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in lower-cased bytes; equal words have equal hashes wherever they stand."""
    inside = np.concatenate(([False], _WORD[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))
    return starts, ends, (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)


@dataclass
class Phrases:
    """A block of benchmark items as windows of symbols (1 upwards)."""

    words: list[bytes]  # by symbol less 1
    hashes: np.ndarray  # of the words, ascending, each once
    symbols: np.ndarray  # of the hashes
    clashing: dict[int, dict[bytes, int]]  # symbols of words that share a hash
    windows: np.ndarray  # a row for each window, padded with 0 behind
    lengths: np.ndarray
    first_item: np.ndarray  # items[first_item[w] : first_item[w + 1]] hold window w
    items: np.ndarray  # places in ids
    ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
        raw = [x.encode("utf-8", "replace") if x else b"" for _, x in items]
        data = _LOWER[np.frombuffer(b"\0".join(raw), np.uint8)]
        starts, ends, hashes = hashed_words(data)
        lower, symbol = data.tobytes(), {}
        text = np.fromiter((symbol.setdefault(lower[a:b], len(symbol) + 1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int32, len(starts))
        words = list(symbol)
        hash_of = np.zeros(len(words), np.uint64)
        hash_of[text - 1] = hashes
        known, first, times = np.unique(hash_of, return_index=True, return_counts=True)
        clashing: dict[int, dict[bytes, int]] = {int(h): {} for h in known[times > 1]}
        for i in np.flatnonzero(np.isin(hash_of, known[times > 1])).tolist():
            clashing[int(hash_of[i])][words[i]] = i + 1
        # Windows begin where as many words follow in the item, or with the first word of a shorter one.
        item_ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]))
        sizes = np.diff(np.concatenate(([0], item_ends)))
        owner = np.repeat(np.arange(len(items)), sizes)
        left = item_ends[owner] - np.arange(len(text))
        begins = np.flatnonzero((left >= window) | (left == sizes[owner]))
        lengths = np.minimum(left[begins], window)
        column = np.arange(window)
        at = np.minimum(begins[:, None] + column, max(0, len(text) - 1))
        rows = np.where(column < lengths[:, None], text[at] if len(text) else 0, 0).astype(np.int32).reshape(-1, window)
        windows, which = np.unique(rows, axis=0, return_inverse=True)
        ids = sorted({name for name, _ in items if name is not None})
        place = {x: i for i, x in enumerate(ids)}
        named = np.array([place.get(name, -1) for name, _ in items], np.int64)[owner[begins]] if len(begins) else np.zeros(0, np.int64)
        pairs = np.unique(which.reshape(-1)[named >= 0] * max(1, len(ids)) + named[named >= 0])
        holders, held = np.divmod(pairs, max(1, len(ids)))
        counts = np.bincount(holders, minlength=len(windows))
        return cls(words, known, (first + 1).astype(np.int64), clashing, windows.astype(np.int64), (windows > 0).sum(axis=1), np.concatenate(([0], np.cumsum(counts))), held, ids)


class WaveletMatrix:
    """Rank of symbols in a sequence, from a bit vector with ranks for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ranks, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            ones = np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32)))
            self.ranks.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            on = bit.astype(bool)
            symbols = np.concatenate((symbols[~on], symbols[on]))

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """Occurrences of each symbol before each of some ends."""
        begin = np.zeros(len(symbol), np.int64)
        ends = list(ends)
        for level, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            on = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            begin, *ends = (np.where(on, zeros + ones[x], x - ones[x]) for x in (begin, *ends))
        return [x - begin for x in ends]


class FMIndex:
    """Index over symbols in which 0 is a sentinel, different at each place and ordered by place; the last symbol is one."""

    def __init__(self, text: np.ndarray, most_symbol: int):
        if not len(text) or text[-1]:
            raise ValueError("a text ends with a sentinel")
        n = self.n = len(text)
        order = self._suffixes(text, most_symbol)
        before = np.where(order > 0, text[order - 1], 0)
        before[order == 0] = 0
        known = before > 0
        self.known = np.concatenate((np.zeros(1, np.int32), np.cumsum(known, dtype=np.int32)))
        self.before = before
        self.wavelet = WaveletMatrix(before[known], max(1, most_symbol.bit_length()))
        self.first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(text, minlength=most_symbol + 1))))
        # A walk back can't pass a sentinel, so places behind one are sampled too.
        kept = (order % SAMPLE == 0) | ~known
        self.kept, self.kept_before, self.places = kept, np.cumsum(kept) - kept, order[kept]
        assert n < 1 << 31

    @staticmethod
    def _suffixes(text: np.ndarray, most_symbol: int) -> np.ndarray:
        """Suffix order. Sentinels end a comparison, so few suffixes need more than the first sort."""
        n = len(text)
        at_bits, bits = max(1, n.bit_length()), max(1, most_symbol.bit_length())
        depth = max(1, (63 - at_bits) // bits)
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for d in range(depth):
            symbol = np.concatenate((text[d:], np.zeros(min(d, n), text.dtype)))
            symbol = np.where(open_, symbol, 0)
            key = (key << bits) | symbol
            open_ &= symbol > 0
        whole = open_  # no sentinel among the first symbols: equal keys aren't settled by place
        keyed = np.sort((key << at_bits) | np.arange(n))
        order = keyed & ((1 << at_bits) - 1)
        if 3 * at_bits > 63:
            return FMIndex._refined_wide(keyed >> at_bits, order, whole, depth)
        same = (keyed[1:] >> at_bits) == (keyed[:-1] >> at_bits)
        same &= whole[order[1:]]
        rank = np.empty(n + depth + 1, np.int64)
        head = np.concatenate(([True], ~same))
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rows = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        reach = depth
        while len(rows):
            at = order[rows]
            follow = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)], 0)
            keyed = np.sort((rank[at] << (2 * at_bits)) | (follow << at_bits) | at)
            at = keyed & ((1 << at_bits) - 1)
            order[rows] = at
            pair = keyed >> at_bits
            same = pair[1:] == pair[:-1]
            head = np.concatenate(([True], ~same))
            rank[at] = np.maximum.accumulate(np.where(head, rows, 0))
            rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            reach *= 2
        return order

    @staticmethod
    def _refined_wide(keys: np.ndarray, order: np.ndarray, whole: np.ndarray, depth: int) -> np.ndarray:
        """The same refinement for texts whose places don't fit three to a number."""
        n = len(order)
        same = (keys[1:] == keys[:-1]) & whole[order[1:]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(n), 0))
        rows = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        reach = depth
        while len(rows):
            at = order[rows]
            follow = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)], 0)
            sort = np.lexsort((at, follow, rank[at]))
            old, follow, at = rank[at][sort], follow[sort], at[sort]
            order[rows] = at
            same = (old[1:] == old[:-1]) & (follow[1:] == follow[:-1])
            rank[at] = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), rows, 0))
            rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            reach *= 2
        return order

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high) of every window that occurs: the rows of the suffixes that begin with it."""
        which = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for d in range(windows.shape[1]):
            column = lengths[which] - 1 - d
            going = column >= 0
            symbol = windows[which, np.maximum(column, 0)]
            a, b = self.wavelet.rank(symbol, self.known[low].astype(np.int64), self.known[high].astype(np.int64))
            low = np.where(going, self.first[symbol] + a, low)
            high = np.where(going, self.first[symbol] + b, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes, by steps back to the next sampled one."""
        rows = rows.copy()
        steps, walking = np.zeros(len(rows), np.int64), np.flatnonzero(~self.kept[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.before[at]
            rows[walking] = self.first[symbol] + self.wavelet.rank(symbol, self.known[at].astype(np.int64))[0]
            steps[walking] += 1
            walking = walking[~self.kept[rows[walking]]]
        return self.places[self.kept_before[rows]] + steps


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, hit spans of words, ids of items found) of each text of one shard."""
    raw = [x.encode("utf-8", "replace") if x else b"" for x in texts]
    data = _LOWER[np.frombuffer(b"\0".join(raw), np.uint8)]
    starts, ends, hashes = hashed_words(data)
    doc_ends = np.cumsum([len(x) + 1 for x in raw])
    words = np.diff(np.concatenate(([0], np.searchsorted(starts, doc_ends))))
    none: list[tuple[int, list[tuple[int, int]], list[str]]] = [(int(n), [], []) for n in words]
    if not len(starts) or not len(phrases.hashes):
        return none
    place = np.minimum(np.searchsorted(phrases.hashes, hashes), len(phrases.hashes) - 1)
    symbol = np.where(phrases.hashes[place] == hashes, phrases.symbols[place], 0)
    if phrases.clashing:
        lower = data.tobytes()
        for i in np.flatnonzero(np.isin(hashes, np.array(list(phrases.clashing), np.uint64))).tolist():
            symbol[i] = phrases.clashing[int(hashes[i])].get(lower[starts[i] : ends[i]], 0)
    # One sentinel behind each text.
    begin = np.concatenate(([0], np.cumsum(words + 1)))
    text = np.zeros(begin[-1], np.int64)
    spot = np.arange(len(starts)) + np.repeat(np.arange(len(words)), words)
    text[spot] = symbol
    confirmed: set[int] = set()
    buffer = data.tobytes()
    while True:
        index = FMIndex(text, len(phrases.words))
        which, low, high = index.search(phrases.windows, phrases.lengths)
        if not len(which):
            return none
        count = high - low
        cut = np.concatenate(([0], np.cumsum(count)))
        hit = np.zeros(len(text) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        for a in range(0, int(cut[-1]), ROWS_AT_ONCE):
            n = np.arange(a, min(int(cut[-1]), a + ROWS_AT_ONCE))
            w = np.searchsorted(cut, n, side="right") - 1
            at = index.locate(low[w] + n - cut[w])
            np.add.at(hit, at, 1)
            np.add.at(hit, at + phrases.lengths[which[w]], -1)
            both = np.unique((np.searchsorted(begin, at, side="right") - 1) * len(phrases.lengths) + which[w])
            pairs.update(zip((both // len(phrases.lengths)).tolist(), (both % len(phrases.lengths)).tolist(), strict=True))
        inside = np.concatenate(([False], np.cumsum(hit[:-1]) > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        wrong = _unlike(text, np.flatnonzero(inside[1:-1]), spot, starts, ends, buffer, phrases, confirmed)
        if not len(wrong):
            break
        text[wrong] = 0  # another word with the hash of a benchmark word
    out = [(int(n), [], set()) for n in words]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        doc = int(np.searchsorted(begin, a, side="right")) - 1
        out[doc][1].append((a - int(begin[doc]), b - int(begin[doc])))
    for doc, w in pairs:
        out[doc][2].update(phrases.items[phrases.first_item[w] : phrases.first_item[w + 1]].tolist())
    return [(n, spans, sorted(phrases.ids[i] for i in items)) for n, spans, items in out]


def _unlike(text, places, spot, starts, ends, buffer: bytes, phrases: Phrases, confirmed: set[int]) -> list[int]:
    """Places whose word isn't, byte by byte, the benchmark word of its symbol."""
    word = np.searchsorted(spot, places)
    wrong = []
    for at, a, b, s in zip(places.tolist(), starts[word].tolist(), ends[word].tolist(), text[places].tolist(), strict=True):
        if at not in confirmed:
            if buffer[a:b] == phrases.words[s - 1]:
                confirmed.add(at)
            else:
                wrong.append(at)
    return wrong


def shards(texts: list[str | None], most: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of whole texts of about ``most`` bytes."""
    a = held = 0
    for i, x in enumerate(texts):
        size = len(x) if x else 0
        if held and held + size > most:
            yield a, i
            a, held = i, 0
        held += size + 1
    if a < len(texts):
        yield a, len(texts)


FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def search_texts(texts: list[str | None], blocks: list) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(words, hit spans of words, ids of items found) of each text, over all blocks of phrases, one held at a time."""
    out: list[tuple[int, list[tuple[int, int]], list[str]]] = []
    for k, block in enumerate(blocks):
        phrases = block.value if hasattr(block, "value") else block
        found = [r for a, b in shards(texts) for r in search_shard(texts[a:b], phrases)]
        out = found if not k else [(n, merge_spans(s + t), sorted({*i, *j})) for (n, s, i), (_, t, j) in zip(out, found, strict=True)]
        if len(blocks) > 1 and hasattr(block, "_value"):
            del block._value  # read again from the worker's disk when its turn comes
    return out


def found_phrases(text: Column, blocks: list) -> Column:
    """What the blocks of phrases (broadcasts) hit in each text."""

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def found(held: list[pd.Series]) -> Iterator[pd.DataFrame]:
            rows = search_texts([x for series in held for x in series.tolist()], blocks)
            for series in held:
                mine, rows = rows[: len(series)], rows[len(series) :]
                spans = [[{"start": s, "end": e} for s, e in r[1]] for r in mine]
                yield pd.DataFrame({"n_words": [r[0] for r in mine], "spans": spans, "items": [r[2] for r in mine]}, columns=["n_words", "spans", "items"])
            relieve()

        held, size = [], 0
        for series in batches:
            held.append(series)
            size += sum(len(x) for x in series if x)
            if len(blocks) == 1 or size >= TEXTS_BYTES:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    return search(text)


def blocks_of_items(benchmark: DataFrame, item: str, text: str, window: int) -> list:
    """The benchmark as broadcast blocks of phrases, made one after another."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // BLOCK_BYTES))
    mine = lambda k: items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
    return [spark.sparkContext.broadcast(Phrases.of([(r.item, r.text) for r in mine(k).collect()], window)) for k in range(parts)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Struct ``row`` of the input's columns with n_words, spans (hit words, from and to) and items (ids as strings, sorted)."""
    ship(docs.sparkSession)
    blocks = blocks_of_items(benchmark, item, item_text, window)
    return docs.select(F.struct("*").alias("row"), found_phrases(F.col(text), blocks).alias("f")).select("row", "f.n_words", "f.spans", "f.items")


def cut_text(text: str | None, spans) -> str | None:
    """A text without its hit words and what stands between words of one span; the rest stays as it is."""
    if not text or not len(spans):
        return text
    raw = text.encode("utf-8", "replace")
    starts, ends, _ = hashed_words(_LOWER[np.frombuffer(raw, np.uint8)])
    out, at = [], 0
    for s in spans:
        out.append(raw[at : starts[s["start"]]])
        at = int(ends[s["end"] - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def without_spans(found: DataFrame, *, text: str = "text") -> DataFrame:
    """The result of ``find_contamination`` with ``clean_text``: each text less its removal spans."""

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([cut_text(x, s) for x, s in zip(texts, spans, strict=True)], dtype=object)

    return found.withColumn("clean_text", cut(F.col(f"row.{text}"), F.col("spans")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without any benchmark window."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0).select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = {
    "op4_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i+least(10, len(w))-1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d CROSS JOIN ns WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND array_to_string(w[i:i+dw.n-1], ' ') = win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
}
