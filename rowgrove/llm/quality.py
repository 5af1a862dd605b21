"""Quality classifier by co-training of two views.

View one reads a document's content (the words that are present); view two its page metadata (language, source, size, and the structure of the page: figures of
its style such as capitals, digits, signs and repeats). Over some rounds each view labels the unlabelled documents it is surest of for the other, then both
are calibrated on held-out labelled rows and their calibrated log-odds are added, each to the extent that it says more than the other. Two targets are learned that way, quality and toxicity; a document is
kept if it is more likely good than not and less likely toxic than not.

Nothing is sampled. Each document's features are made once and kept in the shared folder; what follows reads them. All labelled rows teach (near copies
once): features are admitted by counts over all rows that aren't held out, and weights are fitted on parts of about ``PART_ROWS`` rows, dealt by
hash, and put together by how often each part has a feature, so no task or driver holds all labelled rows. Calibrations, thresholds and the
fusion are fitted on counts of all held-out rows by both views' raw scores, in steps of ``1 / STEPS_OF_SCORE``. Over each round all documents are scored and
those that a view is sure of are counted, for each feature of the view that is taught, as confidently good or bad. Counts are
combined in tasks and summed by Spark; those that depend on the pseudo-label come to the driver, at most as many as there are buckets for features. They are the
prior of the taught view's weights, which its labelled rows then correct. (A caller may bound the labelled rows by ``most``: an equal share for each
combination of labels as far as there are that many, those of smallest hash; weights restore the shares of the combinations.)

A view teaches a class by rank and by an absolute bound: the threshold is where the surest part (one of ``RANKS``) of held-out rows of the class lie, and the
view is silent about the class unless those are right to ``RIGHT`` and twice as seldom wrong as guessing would be.

Defined results: null and empty texts have no words and are scored by metadata; null metadata is a value of its own; repeated rows are scored alike; of labelled
rows with one key and several texts that of smallest hash teaches; empty tables give empty results; with no labelled rows of both kinds a target's
probability is its rate among labels (0.5 without any). Input columns are carried in one struct, so clashing names can't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_small, reliable, relieve, ship, table

#: Labelled rows that weights are fitted on at a time, about.
PART_ROWS = 4_000
#: Held-out raw scores are counted by steps of this fraction, up to this size.
STEPS_OF_SCORE, MOST_SCORE = 32, 20.0
ROUNDS = 3
#: A view teaches by its surest part of a class, the largest of these that is right to this share of held-out rows.
RANKS, RIGHT = (0.5, 0.25, 0.125, 0.0625, 0.03125), 0.95
#: Held-out rows that a threshold needs.
LEAST_HELD = 6
#: Features are seen in so many fitting rows (or such a share) at least, and depend on the target by so much (chi-square, 1 degree; 1 in 10,000 by chance).
MIN_TEXTS, MIN_SHARE = 3, 0.001
MIN_CHI = 15.1
STEPS = 200
#: Buckets of hashed features, of either view.
BUCKETS = (1 << 19, 1 << 14)
#: Log-ratios of pseudo-labels count so much as prior weights, and are cut off there.
PRIOR_SCALE, PRIOR_MOST = 0.25, 1.0
#: Letters of word beginnings that are features too.
BEGINNINGS = (6, 4)
TARGETS = ("quality", "toxic")
#: Words that a worker remembers the buckets of.
REMEMBERED = 40_000
#: The largest gap of packed codes.
GAP = 0xFFFF

_SPLIT = re.compile(r"[^\w']+")
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2
for _c in (9, 10, 11, 12, 13, 32):
    _KIND[_c] = 4
#: Everything else (kind 0) is a sign.
STYLE = ("capitals", "digits", "signs", "repeats", "commonest", "log_words", "word_chars", "doubled", "no_words", "line_words")


def bucket(feature: str, view: int) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % BUCKETS[view]


class WordBuckets(dict):
    """Buckets of a word as it stands between spaces: of its parts and of their beginnings (``lett*``)."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        out = []
        for x in (word,) if word.isalpha() else _SPLIT.split(word):
            if x:
                out.append(bucket(x, 0))
                out += [bucket(x[:n] + "*", 0) for n in BEGINNINGS if len(x) > n and x[n] != "*"]
        self[word] = tuple(out)
        return self[word]


def content(text: str | None, words_at: WordBuckets) -> tuple[np.ndarray, list[float]]:
    """Buckets of the words and word beginnings of a text, and its style figures."""
    text = text or ""
    raw = np.bincount(_KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
    words = text.lower().split()
    total = len(words)
    kinds = Counter(words)
    letters = max(1, raw[1] + raw[2])
    marks = max(1, raw[:4].sum())
    doubled = sum(map(str.__eq__, words, words[1:])) / max(1, total)
    codes = set(chain.from_iterable(map(words_at.__getitem__, kinds)))
    return np.fromiter(codes, np.int64, len(codes)), [
        raw[1] / letters, raw[3] / marks, raw[0] / marks, 1 - len(kinds) / max(1, total) ** 0.9, max(kinds.values(), default=0) / max(1, total),
        np.log1p(total) / 8, letters / max(1, total) / 10, doubled, float(total == 0), np.log1p(total / (1 + text.count("\n"))) / 8,
    ]


def metadata(lang: str | None, source: str | None, chars, style: list[float]) -> np.ndarray:
    """Buckets of a page's metadata. A style figure has a feature for each level that it reaches, so neighbouring levels share what they learn."""
    size = -1 if chars is None or chars != chars else int(np.log2(max(1, chars)))
    names = [f"lang={lang}", f"source={source}", f"size={size}", f"lang={lang},size={size}"]
    names += [f"{name}>={n}" for name, v in zip(STYLE, style, strict=True) for n in range(1, 1 + int(min(20, max(0, v * 20))))]
    return np.unique(np.array([_named(x) for x in names], np.int64))


_names: dict[str, int] = {}


def _named(name: str) -> int:
    got = _names.get(name)
    if got is None:
        if len(_names) > REMEMBERED:
            _names.clear()
        got = _names[name] = bucket(name, 1)
    return got


def packed(codes: np.ndarray) -> bytes:
    """Distinct codes in order as two-byte gaps; ``GAP`` stands for itself and no code."""
    gaps = np.diff(np.sort(codes), prepend=0)
    long, rest = np.divmod(gaps, GAP)
    if not long.any():
        return rest.astype("<u2").tobytes()
    out = np.full(len(gaps) + int(long.sum()), GAP, "<u2")
    out[np.cumsum(long + 1) - 1] = rest
    return out.tobytes()


def unpacked(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, index of the cell) of packed cells."""
    sizes = np.array([len(x) // 2 for x in cells], np.int64)
    gaps = np.frombuffer(b"".join(cells), "<u2").astype(np.int64)
    owner = np.repeat(np.arange(len(cells)), sizes)
    total = np.concatenate(([0], np.cumsum(gaps)))
    begin = np.cumsum(sizes) - sizes
    codes, real = total[1:] - total[begin][owner], gaps != GAP
    return codes[real], owner[real]


def sketch(codes: np.ndarray) -> tuple[int, int]:
    """Two minima over a text's words; near copies mostly share both, so that a group of them teaches once."""
    if not len(codes):
        return 0, 0
    return int(codes.min()), int((codes * 2654435761 & 0xFFFFFFFF).min())


@dataclass
class Linear:
    """Logistic regression over buckets."""

    weights: np.ndarray
    bias: float = 0.0

    def raw(self, codes: np.ndarray) -> float:
        return self.bias + float(self.weights[codes].sum())

    def raws(self, codes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        return self.bias + np.bincount(owner, weights=self.weights[codes], minlength=rows)


def chi_square(both, with_feature, positive: float, rows: float):
    """Pearson's statistic of a feature against a target, of arrays of features."""
    a, b, c = both, with_feature - both, positive - both
    d = rows - a - b - c
    under = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(under > 0, rows * (a * d - b * c) ** 2 / np.where(under > 0, under, 1), 0.0)


def fit_linear(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, least: int, buckets: int, prior: np.ndarray | None = None, l2: float = 2e-3) -> Linear:
    """A regression on rows that lie in memory; features are admitted by their own counts."""
    columns = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    start = np.zeros(buckets, np.float64) if prior is None else prior.astype(np.float64)
    seen = np.bincount(columns, minlength=buckets)
    good = np.bincount(columns, weights=y[owner], minlength=buckets)
    admitted = (seen >= least) & ((chi_square(good, seen, float(y.sum()), len(y)) >= MIN_CHI) | (start != 0))
    bias, at, moved, _ = descend(columns, owner, y, weight, admitted, start, l2)
    start[at] += moved
    return Linear(start.astype(np.float32), bias)


def descend(columns: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, admitted: np.ndarray, start: np.ndarray, l2: float = 2e-3) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Full-batch gradient descent with momentum around prior weights, steps scaled by how often a feature occurs: bias, features, their moves, and rows that have them."""
    rate = float(np.clip((y * weight).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    bias, total, n = float(np.log(rate / (1 - rate))), weight.sum(), len(y)
    if len(set(y.tolist())) < 2:
        return bias, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    kept = admitted[columns] | (start[columns] != 0)
    columns, owner = columns[kept], owner[kept].astype(np.int64)
    # Only the columns that occur are moved, so work goes by them and not by all buckets.
    seen = np.bincount(columns, minlength=len(start))
    at = np.flatnonzero(seen)
    seen, place = seen[at], (np.cumsum(seen > 0) - 1)[columns]
    w_at, move_at, start_at = start[at], np.zeros(len(at)), start[at]
    scale_at = admitted[at] / np.sqrt(np.maximum(1.0, seen) / n + 0.01)
    for _ in range(STEPS):
        z = bias + np.bincount(owner, weights=w_at[place], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gradient = np.bincount(place, weights=error[owner], minlength=len(at)) / total + l2 * (w_at - start_at) / n**0.5
        move_at = 0.9 * move_at - 0.12 * scale_at * gradient
        w_at = w_at + move_at
        bias -= 0.5 * error.sum() / total
    return float(bias), at, w_at - start_at, seen


def fit_calibration(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of the log-odds (Platt), by damped Newton steps; the slope isn't negative."""
    weight = np.ones(len(y)) if weight is None else weight
    good, bad = float((y * weight).sum()), float(((1 - y) * weight).sum())
    b = float(np.log((good + 1) / (bad + 1)))
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    if len(set(y.tolist())) < 2 or z.std() < 1e-9:
        return 0.0, b
    x = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([0.0, b])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - 0.7 * np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-3 * beta * [1, 0])
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (0.0, b)


def fit_fusion(one: np.ndarray, two: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> tuple[float, float, float]:
    """How much either view's log-odds count, and an intercept. Independent views would count (1, 1, -prior), from where held-out rows move it."""
    start = np.array([1.0, 1.0, -prior])
    if len(set(y.tolist())) < 2:
        return tuple(start)
    x, beta = np.stack([one, two, np.ones_like(one)], axis=1), start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(3)
        beta = beta - 0.7 * np.linalg.solve(hessian, x.T @ (weight * (p - y)) + (beta - start))
    return float(max(0.0, beta[0])), float(max(0.0, beta[1])), float(beta[2])


def thresholds(p: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray | None = None) -> tuple[float, float]:
    """(low, high): a view calls documents below ``low`` bad and above ``high`` good; -1 and 2 where it may not teach a class. ``rows``: how many rows each entry stands for."""
    out, rows = [], np.ones(len(p)) if rows is None else rows
    for score, right in ((1 - p, y == 0), (p, y > 0)):
        base = float(weight[right].sum() / max(weight.sum(), 1e-9))
        order = np.argsort(-score, kind="stable")
        reached = np.cumsum(weight[order])
        found = 2.0
        for part in RANKS:  # the largest part of the class that is right often enough; rows of equal score stand or fall together
            at = min(int(np.searchsorted(reached, part * base * weight.sum())), len(order) - 1)
            sure = score >= score[order[at]]
            hit = float(weight[sure & right].sum() / max(weight[sure].sum(), 1e-9))
            if rows[sure].sum() >= LEAST_HELD and hit >= RIGHT and hit >= (1 + base) / 2:
                found = float(score[order[at]])
                break
        out.append(found)
    return (1 - out[0] if out[0] < 2 else -1.0), out[1]


@dataclass
class Target:
    """Both views of one target, their calibrations, the thresholds at which they teach, and how they are put together."""

    views: tuple[Linear, Linear]
    calibration: tuple[tuple[float, float], tuple[float, float]]
    teaches: tuple[tuple[float, float], tuple[float, float]]
    fusion: tuple[float, float, float]

    def odds(self, view: int, raw: np.ndarray) -> np.ndarray:
        a, b = self.calibration[view]
        return a * raw + b

    def score(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        a, b, c = self.fusion
        z = a * self.odds(0, one) + b * self.odds(1, two) + c
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class QualityModel:
    targets: dict[str, Target]

    def score(self, texts: list[str | None], meta: list[tuple], words_at: WordBuckets | None = None) -> np.ndarray:
        words_at, raw = words_at if words_at is not None else WordBuckets(), np.zeros((len(texts), len(self.targets), 2))
        for i, (text, m) in enumerate(zip(texts, meta, strict=True)):
            one, style = content(text, words_at)
            two = metadata(*m, style)
            raw[i] = [(t.views[0].raw(one), t.views[1].raw(two)) for t in self.targets.values()]
        return np.stack([t.score(raw[:, k, 0], raw[:, k, 1]) for k, t in enumerate(self.targets.values())], axis=1)

    def score_features(self, one: list[bytes], two: list[bytes]) -> np.ndarray:
        """The same scores of packed features."""
        views = unpacked(one), unpacked(two)
        return np.stack([t.score(*(t.views[v].raws(*views[v], len(one)) for v in (0, 1))) for t in self.targets.values()], axis=1)


def features(docs: DataFrame, *, key: str = "doc_id", text: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars")) -> DataFrame:
    """Key, digest of the text and packed features of both views of every document; texts are read once, and stay in the tasks."""
    ship(docs.sparkSession)

    @F.pandas_udf("struct<one:binary,two:binary>")
    def made(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        words_at = WordBuckets()
        for texts, langs, sources, sizes in batches:
            out = []
            for x, *m in zip(texts, langs, sources, sizes, strict=True):
                one, style = content(x, words_at)
                out.append((packed(one), packed(metadata(*m, style))))
            yield pd.DataFrame(out, columns=["one", "two"])
            relieve()

    both = made(F.col(text), *map(F.col, meta))
    return reliable(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), both.alias("f")).select("key", "hash", "f.*"))


def chosen_labels(labels: DataFrame, key: str, most: int | None) -> DataFrame:
    """(key, labels, weight) of all labelled keys, or of at most ``most``."""
    known = labels.where(" AND ".join(f"{t} IS NOT NULL" for t in TARGETS) + f" AND `{key}` IS NOT NULL").groupBy(F.col(key).alias("key")).agg(*[F.max(t).alias(f"_{t}") for t in TARGETS])
    if most is None:
        return known.withColumn("_weight", F.lit(1.0))
    kinds = [f"_{t}" for t in TARGETS]
    hashed = known.withColumn("_hash", F.xxhash64(F.col("key"), F.lit(7)))
    counts = {tuple(r[k] for k in kinds): r["n"] for r in hashed.groupBy(*kinds).agg(F.count("*").alias("n")).collect()}
    share, left, take = most, len(counts), {}
    for kind, n in sorted(counts.items(), key=lambda x: x[1]):  # small groups leave their part to the others
        take[kind] = min(n, share // max(1, left))
        share, left = share - take[kind], left - 1
    # Hashes as numbers from 0 to 1: hardly more rows than wanted are left to be put in order.
    place, parts = F.col("_hash") / F.lit(float(1 << 64)) + F.lit(0.5), F.lit(0.0)
    rank = F.row_number().over(Window.partitionBy(*kinds).orderBy("_hash", "key"))
    wanted, weight = F.lit(0), F.lit(1.0)
    for kind, n in take.items():
        here = F.lit(True)
        for c, v in zip(kinds, kind, strict=True):
            here = here & (F.col(c) == v)
        parts = F.when(here, min(1.0, (n + 5 * n**0.5 + 5) / counts[kind])).otherwise(parts)
        wanted, weight = F.when(here, n).otherwise(wanted), F.when(here, counts[kind] / max(1, n)).otherwise(weight)
    return hashed.where(place <= parts).withColumn("_rank", rank).where(F.col("_rank") <= wanted).select("key", *kinds, weight.alias("_weight"))


def labelled(rows: DataFrame, labels: DataFrame, key: str, most: int | None) -> DataFrame:
    """Features, labels and weight of labelled documents, one for each key."""
    met = rows.join(broadcast_small(reliable(chosen_labels(labels, key, most))), "key")
    first = F.min(F.struct("hash", *[f"_{t}" for t in TARGETS], "_weight", "one", "two")).alias("f")
    return met.groupBy("key").agg(first).select("key", "f.*")


def labelled_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, meta: tuple[str, str, str], most: int) -> pd.DataFrame:
    """A bounded number of labelled rows in the driver's memory."""
    return labelled(features(docs, key=key, text=text, meta=meta), labels, key, most).toPandas().sort_values(["key", "hash"], kind="stable", ignore_index=True)


class Part:
    """Rows of one part as they come: weights, targets and the useful codes of either view."""

    def __init__(self):
        self.rows, self.numbers, self.views = 0, [], ([], [])

    def add(self, rows: pd.DataFrame, useful: list[np.ndarray]) -> None:
        self.numbers.append(rows[["_weight", *[f"_{t}" for t in TARGETS]]].to_numpy(float).T)
        for v, name in enumerate(("one", "two")):
            codes, owner = unpacked(rows[name].tolist())
            kept = useful[v][codes]
            self.views[v].append(np.stack([codes[kept], owner[kept] + self.rows]).astype(np.int32))
        self.rows += len(rows)

    def joined(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], int]:
        """Weight and targets by row, (codes, row) of either view, rows; what was held goes."""
        views = []
        for held in self.views:
            views.append(tuple(np.concatenate(held, axis=1)))
            held.clear()
        return np.concatenate(self.numbers, axis=1), views, self.rows


class Labelled:
    """Labelled rows of both views, once for each group of near copies; about every third group is held out. They stay in the tasks."""

    def __init__(self, rows: DataFrame):
        kinds = [f"_{t}" for t in TARGETS]

        def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes, owner = unpacked(batch["one"].tolist())
                cuts = np.searchsorted(owner, np.arange(len(batch) + 1))
                pairs = [sketch(codes[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield batch.assign(s=[a for a, _ in pairs], t=[b for _, b in pairs])
                relieve()

        named = rows.select("key", "hash", *[(F.col(c) > 0).cast("int").alias(c) for c in kinds], "_weight", "one", "two")
        kind = named.schema["key"].dataType.simpleString()
        made = named.mapInPandas(sketched, f"key {kind}, hash long, {', '.join(f'{c} int' for c in kinds)}, _weight double, one binary, two binary, s long, t long")
        once = made.groupBy("s", "t", *kinds).agg(F.min(F.struct("key", "hash", "_weight", "one", "two")).alias("f"), F.count("*").alias("n"))
        held = F.pmod(F.xxhash64("s", "t", F.lit(3)), F.lit(3)) == 2
        share = F.col("n") / F.sum("n").over(Window.partitionBy("s", "t"))  # labels that differ within a group share its weight
        once = reliable(once.select("s", "t", *kinds, held.alias("held"), (F.col("f._weight") * share).alias("_weight"), "f.one", "f.two"))
        sums = once.groupBy("held").agg(F.count("*").alias("n"), F.sum("_weight").alias("w"), *[F.sum(c).alias(c) for c in kinds], *[F.sum(F.col(c) * F.col("_weight")).alias(f"w{c}") for c in kinds]).collect()
        both = {r["held"]: r for r in sums}
        self.rows = sum(r["n"] for r in sums)
        self.fitted = both[False]["n"] if False in both else 0
        self.good = [float(both[False][c]) if False in both else 0.0 for c in kinds]
        unit = sum(r["w"] for r in sums) / self.rows if self.rows else 1.0
        sure = [(sum(r[f"w{c}"] for r in sums) / unit, sum(r["w"] - r[f"w{c}"] for r in sums) / unit) for c in kinds]
        self.prior = [float(np.log((a + 1) / (b + 1))) if self.rows else 0.0 for a, b in sure]
        parts = max(1, -(-self.fitted // PART_ROWS))
        self.held = once.where("held").select(*kinds, (F.col("_weight") / unit).alias("_weight"), "one", "two")
        dealt = once.where("NOT held").select(*kinds, (F.col("_weight") / unit).alias("_weight"), "one", "two", F.pmod(F.xxhash64("s", "t", F.lit(5)), F.lit(parts)).alias("part"))
        self.parts = reliable(dealt.repartition(parts, "part"))
        self._count()

    def _count(self) -> None:
        """Features that enough fitting rows have, and for each target those that depend on it, by counts over all fitting rows."""
        kinds = [f"_{t}" for t in TARGETS]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = [np.zeros((1 + len(kinds), n), np.int32) for n in BUCKETS]
            for batch in batches:
                for v, name in enumerate(("one", "two")):
                    codes, owner = unpacked(batch[name].tolist())
                    np.add.at(sums[v][0], codes, 1)
                    for k, c in enumerate(kinds):
                        np.add.at(sums[v][k + 1], codes[batch[c].to_numpy(int)[owner] > 0], 1)
            for v, x in enumerate(sums):
                at = np.flatnonzero(x[0])
                yield pd.DataFrame({"view": v, "bucket": at, "seen": x[0][at]} | {c: x[k + 1][at] for k, c in enumerate(kinds)})
            relieve()

        least = (max(MIN_TEXTS, int(MIN_SHARE * self.rows)), 2)
        counts = self.parts.mapInPandas(count, f"view int, bucket long, seen long, {', '.join(f'{c} long' for c in kinds)}").groupBy("view", "bucket").agg(*[F.sum(c).alias(c) for c in ("seen", *kinds)])
        found = counts.where(F.col("seen") >= F.when(F.col("view") == 0, least[0]).otherwise(least[1])).toPandas()
        self.enough, self.telling = [], []
        for v, n in enumerate(BUCKETS):
            mine = found[found["view"] == v]
            at, seen = mine["bucket"].to_numpy(np.int64), mine["seen"].to_numpy(float)
            self.enough.append(np.bincount(at, minlength=n) > 0)
            apart = [chi_square(mine[c].to_numpy(float), seen, good, float(self.fitted)) >= MIN_CHI for c, good in zip(kinds, self.good, strict=True)]
            self.telling.append([np.bincount(at[x], minlength=n) > 0 for x in apart])

    def fit(self, priors: dict[str, tuple[np.ndarray | None, np.ndarray | None]]) -> dict[str, Target]:
        at = [(k, v) for k in range(len(TARGETS)) for v in (0, 1)]
        start = {(k, v): np.zeros(BUCKETS[v], np.float32) if priors[TARGETS[k]][v] is None else priors[TARGETS[k]][v] for k, v in at}
        allowed = {(k, v): self.telling[v][k] | self.enough[v] & (start[k, v] != 0) for k, v in at}
        sparse = {a: (np.flatnonzero(start[a]), start[a][np.flatnonzero(start[a])], np.flatnonzero(allowed[a])) for a in at}

        def fit_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Of each batch only codes stay that a regression has a use for, so what a part costs goes by those and not by its texts.
            useful = [np.zeros(n, bool) for n in BUCKETS]
            for (_, v), (places, _, admitted) in sparse.items():
                useful[v][places] = useful[v][admitted] = True
            held: dict[int, Part] = {}
            for batch in batches:
                for part, rows in batch.groupby("part"):
                    held.setdefault(part, Part()).add(rows, useful)
            while held:
                _, mine = held.popitem()
                (weight, *y), views, n = mine.joined()
                del mine
                for (k, v), (places, values, admitted) in sparse.items():
                    may, from_ = np.zeros(BUCKETS[v], bool), np.zeros(BUCKETS[v])
                    may[admitted], from_[places] = True, values
                    bias, features_, moved, seen = descend(*views[v], y[k], weight, may, from_)
                    yield pd.DataFrame({"target": k, "view": v, "bucket": np.append(features_, -1), "moved": np.append(moved * seen, bias * n), "seen": np.append(seen, n)})
                relieve()

        moves = self.parts.mapInPandas(fit_parts, "target int, view int, bucket long, moved double, seen long").groupBy("target", "view", "bucket").agg((F.sum("moved") / F.sum("seen")).alias("moved")).where("moved <> 0").toPandas()
        models = {}
        for k, v in at:
            mine = moves[(moves["target"] == k) & (moves["view"] == v)]
            places, moved = mine["bucket"].to_numpy(np.int64), mine["moved"].to_numpy(float)
            weights = start[k, v].astype(np.float64)
            weights[places[places >= 0]] += moved[places >= 0]
            models[k, v] = Linear(weights.astype(np.float32), float(moved[places < 0].sum()))
        return self._calibrated(models)

    def _calibrated(self, models: dict[tuple[int, int], Linear]) -> dict[str, Target]:
        """Targets of fitted views, by counts of all held-out rows."""

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                views = [unpacked(batch[c].tolist()) for c in ("one", "two")]
                for k, t in enumerate(TARGETS):
                    raw = [np.rint(np.clip(models[k, v].raws(*views[v], len(batch)), -MOST_SCORE, MOST_SCORE) * STEPS_OF_SCORE).astype(np.int32) for v in (0, 1)]
                    yield pd.DataFrame({"target": k, "y": batch[f"_{t}"].to_numpy(np.int32), "one": raw[0], "two": raw[1], "weight": batch["_weight"]})
                relieve()

        cells = self.held.mapInPandas(score, "target int, y int, one int, two int, weight double").groupBy("target", "y", "one", "two").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))
        found = cells.toPandas().sort_values(["target", "one", "two", "y"], ignore_index=True)
        out = {}
        for k, name in enumerate(TARGETS):
            mine = found[found["target"] == k]
            y, w, rows = (mine[c].to_numpy(float) for c in ("y", "weight", "rows"))
            z = [mine[c].to_numpy(float) / STEPS_OF_SCORE for c in ("one", "two")]
            calibration = [fit_calibration(z[v], y, w) if len(y) else (0.0, self.prior[k]) for v in (0, 1)]
            odds = [a * x + b for x, (a, b) in zip(z, calibration, strict=True)]
            teaches = [thresholds(1 / (1 + np.exp(-np.clip(odds[v], -30, 30))), y, w, rows) if len(y) and calibration[v][0] > 0 else (-1.0, 2.0) for v in (0, 1)]
            out[name] = Target((models[k, 0], models[k, 1]), tuple(calibration), tuple(teaches), fit_fusion(*odds, y, w, self.prior[k]))
        return out


def taught(rows: DataFrame, model: QualityModel) -> dict[str, tuple[np.ndarray | None, np.ndarray | None]]:
    """Prior weights of either view for each target, from all documents that the other view labels confidently."""
    names = list(model.targets)
    if all(t.teaches[v] == (-1.0, 2.0) for t in model.targets.values() for v in (0, 1)):
        return {n: (None, None) for n in names}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {(k, v): np.zeros((2, BUCKETS[v]), np.int32) for k in range(len(names)) for v in (0, 1)}
        totals = {at: [0, 0] for at in held}
        for batch in batches:
            views = [unpacked(batch[c].tolist()) for c in ("one", "two")]
            for k, t in enumerate(model.targets.values()):
                for v in (0, 1):  # the view that teaches
                    p = 1 / (1 + np.exp(-np.clip(t.odds(v, t.views[v].raws(*views[v], len(batch))), -30, 30)))
                    low, high = t.teaches[v]
                    codes, owner = views[1 - v]
                    for label, sure in ((0, (p <= low) & (p < high)), (1, p >= high)):
                        np.add.at(held[k, 1 - v][label], codes[sure[owner]], 1)
                        totals[k, 1 - v][label] += int(sure.sum())
            relieve()
        for (k, v), x in held.items():
            at = np.flatnonzero(x[0] + x[1])
            yield pd.DataFrame({"target": k, "view": v, "bucket": np.append(at, -1), "bad": np.append(x[0][at], totals[k, v][0]), "good": np.append(x[1][at], totals[k, v][1])})

    counts = rows.select("one", "two").mapInPandas(count, "target int, view int, bucket long, bad long, good long")
    counts = reliable(counts.groupBy("target", "view", "bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    whole = {(r.target, r.view): (float(r.bad), float(r.good)) for r in counts.where("bucket < 0").collect()}
    # Only features that depend on the pseudo-label come to the driver.
    sums = F.broadcast(counts.where("bucket < 0").select("target", "view", F.col("bad").alias("b"), F.col("good").alias("g")))
    a, f, p, m = F.col("good").cast("double"), (F.col("good") + F.col("bad")).cast("double"), F.col("g").cast("double"), (F.col("g") + F.col("b")).cast("double")
    apart = m * F.pow(a * (m - p - f + a) - (f - a) * (p - a), 2) / F.greatest(f * (m - f) * p * (m - p), F.lit(1e-9))
    found = counts.where((F.col("bucket") >= 0) & (F.col("bad") + F.col("good") >= MIN_TEXTS)).join(sums, ["target", "view"]).where(apart >= MIN_CHI).select("target", "view", "bucket", "bad", "good").toPandas()
    out = {}
    for k, n in enumerate(names):
        priors = []
        for v in (0, 1):
            mine = found[(found["target"] == k) & (found["view"] == v)]
            b, g = whole.get((k, v), (0.0, 0.0))
            if not b or not g:
                priors.append(None)  # pseudo-labels of one class alone say nothing
                continue
            good, bad = mine["good"].to_numpy(float), mine["bad"].to_numpy(float)
            ratio = np.log((good + 1) / (g + 2)) - np.log((bad + 1) / (b + 2))
            prior = np.zeros(BUCKETS[v], np.float32)
            prior[mine["bucket"].to_numpy()] = np.clip(PRIOR_SCALE * ratio, -PRIOR_MOST, PRIOR_MOST)
            priors.append(prior)
        out[n] = tuple(priors)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars"), most: int | None = None, rounds: int = ROUNDS, told=None) -> QualityModel:
    """Co-train both views over some rounds, on all labelled rows or at most ``most``. ``told`` gets the prior weights of every exchange (for tests)."""
    return fit_features(features(docs, key=key, text=text, meta=meta), labels, key=key, most=most, rounds=rounds, told=told)


def fit_features(rows: DataFrame, labels: DataFrame, *, key: str = "doc_id", most: int | None = None, rounds: int = ROUNDS, told=None) -> QualityModel:
    known = Labelled(labelled(rows, labels, key, most))
    model = QualityModel(known.fit({t: (None, None) for t in TARGETS}))
    for _ in range(rounds - 1):
        priors = taught(rows, model)
        if told is not None:
            told.append(priors)
        model = QualityModel(known.fit(priors))
    return model


def quality_scores(model: QualityModel, text: Column, lang: Column, source: Column, chars: Column) -> Column:
    """Struct (quality, toxic) of probabilities."""

    @F.pandas_udf("struct<quality:double,toxic:double>")
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        words_at = WordBuckets()
        for texts, langs, sources, sizes in batches:
            yield pd.DataFrame(model.score(texts.tolist(), list(zip(langs, sources, sizes, strict=True)), words_at), columns=list(TARGETS))
            relieve()

    return scored(text, lang, source, chars)


def classify(docs: DataFrame, model: QualityModel, *, text: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars")) -> DataFrame:
    """Struct ``row`` of the input's columns with quality, toxic (probabilities) and kept."""
    ship(docs.sparkSession)
    scores = quality_scores(model, F.col(text), *map(F.col, meta))
    out = docs.select(F.struct("*").alias("row"), scores.alias("s")).select("row", "s.quality", "s.toxic")
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier keeps."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).where("kept").select("row.*")


def classify_features(rows: DataFrame, model: QualityModel) -> DataFrame:
    """Key with quality, toxic and kept of documents' features, as ``classify`` has them."""

    @F.pandas_udf("struct<quality:double,toxic:double>")
    def scored(one: pd.Series, two: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(model.score_features(one.tolist(), two.tolist()), columns=list(TARGETS))

    out = rows.select("key", scored("one", "two").alias("s")).select("key", "s.quality", "s.toxic")
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(table(spark, sf_dir, "documents"))
    scored = classify_features(rows, fit_features(rows, table(spark, sf_dir, "labels")))
    return scored.select(F.col("key").alias("doc_id"), F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"), "kept")
