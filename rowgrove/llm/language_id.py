"""Language identification by Bayesian fusion of evidence.

Text likelihoods come from trigram models over the whole text. They are combined with three other kinds of evidence, all
counted over all rows by grouped aggregation: how far a declared language (markup) can be trusted, what an address
suffix says, and the languages of a host, smoothed hierarchically (host towards domain, domain towards the whole corpus; a host that is its
own domain, or has no dots, is smoothed towards the corpus at once). A class ``und`` with a flat model takes texts that no trained language explains.

Declarations are normalised to their primary tag ("EN", "en-US" and " en " are ``en``; what isn't two or three letters says nothing). Every language declared on
a text with letters is a class. The query and the pipeline stage fit the text models on all such texts (``fit_all``), and every other count covers all rows too.

Defined results: a text without letters (null, empty, digits) is ``und`` and not accepted, whatever is declared; missing
evidence (null host, suffix or declaration) is neutral; ties go to the first language in alphabetical order; repeated rows each get
their row; an empty table gives an empty result. Input columns are carried in one struct, so clashing names can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import reliable, relieve, ship, table

UNKNOWN = "und"
#: Most rows that ``fit`` takes, shared equally by the languages; rows of each language that are taken however many languages there are.
TRAIN_ROWS, LANGUAGE_ROWS = 4_000, 50
#: Languages that a task holds counts of at once (256 KB each).
LANGUAGES_HELD = 64
#: What a text needs to have trigrams.
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"
#: Size of the hashed trigram space, smoothing of its counts.
BUCKET_BITS = 15
TRIGRAM_PSEUDO = 0.1
#: Trigrams of one text aren't independent: n of them weigh as n / (1 + n / SATURATION).
SATURATION = 60.0
#: Rows' worth of trust in the level above when a host or domain prior is smoothed; pseudo counts of confusion tables.
PRIOR_ROWS = 20.0
PSEUDO = 1.0
MIN_POSTERIOR = 0.6
#: Evidence tables up to this many rows (about 200 bytes each) are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
SLICE = 1 << 18

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_slices(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the text) of every trigram around a letter, in slices of bounded size."""
    raw = [("  " + x + "  ").encode("utf-8", "replace") if x else b"" for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    for a in range(0, max(0, len(data) - 2), SLICE):
        x = _FOLD[data[a : a + SLICE + 2]]
        middle = x[1:-1]
        keep = np.flatnonzero(middle != 32)
        code = ((x[:-2][keep] << 16) | (middle[keep] << 8) | x[2:][keep]) * np.uint32(2654435761)
        yield code >> np.uint32(32 - BUCKET_BITS), np.searchsorted(ends, keep + (a + 1), side="right")


@dataclass(frozen=True)
class TextModel:
    """Trigram log-probabilities: a row for each language (alphabetical), the last for ``und``."""

    languages: tuple[str, ...]
    logp: np.ndarray

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UNKNOWN)

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and their log-likelihood under each class."""
        n, out = np.zeros(len(texts)), np.zeros((len(texts), len(self.logp)))
        for bucket, owner in trigram_slices(texts):
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            who = owner[first]
            n[who] += np.diff(np.append(first, len(owner)))
            for k, row in enumerate(self.logp):
                out[who, k] += np.add.reduceat(row[bucket], first)
        return n, out


def model_of(names: tuple[str, ...], counts: np.ndarray) -> TextModel:
    """The model of counts: a row for each language, a column for each bucket."""
    counts = counts + TRIGRAM_PSEUDO
    logp = np.log(counts / counts.sum(axis=1, keepdims=True))
    size = 1 << BUCKET_BITS
    return TextModel(names, np.vstack([logp, np.full((1, size), -np.log(size))]).astype(np.float32))


def fit_texts(texts: list[str], languages: list[str]) -> TextModel:
    names = tuple(sorted(set(languages)))
    size = 1 << BUCKET_BITS
    at = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), size))
    label = np.array([at[x] for x in languages], np.int64)
    for bucket, owner in trigram_slices(texts):
        counts += np.bincount(label[owner] * size + bucket, minlength=counts.size).reshape(counts.shape)
    return model_of(names, counts)


def trigram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (said, bucket, n) of a task's texts (said, text), combined for as many languages as are held at once."""
    held: dict[str, np.ndarray] = {}

    def told() -> Iterator[pd.DataFrame]:
        for name, x in held.items():
            at = np.flatnonzero(x)
            yield pd.DataFrame({"said": name, "bucket": at.astype(np.int32), "n": x[at]})
        held.clear()

    for batch in batches:
        for name, rows in batch.groupby("said"):
            x = held.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
            for bucket, _ in trigram_slices(rows["text"].tolist()):
                x += np.bincount(bucket, minlength=len(x))
            if len(held) >= LANGUAGES_HELD:
                yield from told()
        relieve()
    yield from told()


def primary_tag(declared: Column) -> Column:
    """The primary tag of a declared language, null where it says nothing."""
    tag = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1))
    return F.nullif(tag, F.lit(""))


def declared_texts(docs: DataFrame, key: str, text: str, declared: str) -> DataFrame:
    """(said, text, hash) of texts with letters and a declared language."""
    known = docs.select(primary_tag(F.col(declared)).alias("said"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.xxhash64(text)).alias("hash"))
    return known.where(F.col("said").isNotNull() & F.col("text").rlike(LETTER))


def fit_all(docs: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str = "lang") -> TextModel:
    """Fit the text models of all declared languages on all rows.

    Trigrams are counted in tasks and summed by Spark; a number for each language and bucket comes to the driver.
    """
    ship(docs.sparkSession)
    known = declared_texts(docs, key, text, declared).select("said", "text")
    counts = known.mapInPandas(trigram_counts, "said string, bucket int, n long").groupBy("said", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = tuple(sorted(counts["said"].unique()))
    held = np.zeros((len(names), 1 << BUCKET_BITS))
    held[counts["said"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)] = counts["n"]
    return model_of(names, held)


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str = "lang", rows: int = TRAIN_ROWS) -> TextModel:
    """Fit on at most ``rows`` rows, or ``LANGUAGE_ROWS`` of each language where that is more, for a caller who wants a quick model.

    The languages are counted over all rows; of each, rows whose key has a small hash are taken: so small that hardly more than wanted are
    left to be put in order.
    """
    known = declared_texts(docs, key, text, declared)
    place = F.col("hash") / F.lit(float(1 << 64)) + F.lit(0.5)  # hashes as numbers from 0 to 1
    counts = known.groupBy("said").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    most = max(LANGUAGE_ROWS, rows // max(1, len(counts)))
    share = {r.said: max(r.first, min(1.0, (most + 5 * most**0.5) / r.n)) for r in counts}
    wanted = F.element_at(F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))]), F.col("said")) if share else F.lit(0.0)
    turn = F.row_number().over(Window.partitionBy("said").orderBy("hash", "text"))
    sample = known.where(place <= wanted).withColumn("turn", turn).where(F.col("turn") <= most).select("text", "said").toPandas()
    return fit_texts(sample["text"].tolist(), sample["said"].tolist())


def text_evidence(text: Column, model: TextModel) -> Column:
    """Struct (n, logs): letters' trigrams and the tempered log-likelihood of each class."""

    @F.pandas_udf("struct<n:double,logs:array<double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, logs = model.scores(texts.tolist())
            yield pd.DataFrame({"n": n, "logs": list(logs / (1.0 + n / SATURATION)[:, None])})
            relieve()

    # Else a filter on a score is moved below and scores texts once more, by a second worker of each task.
    return scored.asNondeterministic()(text)


def suffix_of(url: Column) -> Column:
    """Address suffix of a URL: the last label of its host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    return F.nullif(F.substring_index(host, ".", -1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _best(logs: Column, classes: tuple[str, ...]) -> Column:
    names = F.array(*map(F.lit, classes))
    return F.element_at(names, F.array_position(logs, F.array_max(logs)).cast("int"))


def _counts(classes: tuple[str, ...]) -> Column:
    return F.array(*[F.sum(F.when(F.col("vote") == c, F.col("rows")).otherwise(0)).cast("double") for c in classes])


def _plus(a: Column, b: Column, times: float) -> Column:
    """Smooth counts ``a`` towards the distribution ``b`` and normalise."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) + F.lit(times)
    return F.zip_with(a, b, lambda x, p: (x + F.lit(times) * p) / total)


def _join(rows: DataFrame, evidence: DataFrame, on: str) -> DataFrame:
    """Evidence beside rows. Where it is too large to be broadcast, rows without a value are spread over keys of their own."""
    if evidence.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(evidence), on, "left")
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("t"), F.lit(10_000)).cast("string"))
    found = evidence.withColumnRenamed(on, "_key")
    return rows.withColumn("_at", F.coalesce(F.col(on), spread)).join(found, F.col("_at") == F.col("_key"), "left").drop("_at", "_key")


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1), F.lit(""))


def identify(
    docs: DataFrame, model: TextModel, *, text: str = "text", declared: str | None = None, host: str | None = None, url: str | None = None, carry: list[str] | None = None
) -> DataFrame:
    """Struct ``row`` of the input's columns with lang, posterior, text_lang, n_trigrams and accepted.

    With ``carry`` the struct holds those columns alone and texts are scored once, their scores being kept in the shared folder;
    without it whole rows are carried, so nothing is written and texts are scored a second time.
    """
    ship(docs.sparkSession)
    none = F.lit(None).cast("string")
    classes, k = model.classes, len(model.classes)
    named = [F.nullif(F.lower(F.trim(F.col(host))), F.lit(""))] if host else []
    columns = {
        "host": F.coalesce(*named, host_of(F.col(url)) if url else none), "said": primary_tag(F.col(declared)) if declared else none,
        "suffix": suffix_of(F.col(url)) if url else none, "t": text_evidence(F.col(text), model),
    }
    row = F.struct(*map(F.col, carry)) if carry else F.struct("*")
    every = docs.select(row.alias("row"), *[c.alias(n) for n, c in columns.items()])
    every = reliable(every) if carry else every

    # What texts alone say, counted over all rows by host, declaration and suffix.
    alone = every if carry else docs.select(*[c.alias(n) for n, c in columns.items()])
    votes = reliable(alone.where("t.n > 0").withColumn("vote", _best(F.col("t.logs"), classes)).groupBy("host", "said", "suffix", "vote").agg(F.count("*").alias("rows")))
    whole = [x or 0.0 for x in votes.agg(_counts(classes).alias("c")).collect()[0]["c"]]
    prior = [(x + PSEUDO) / (sum(whole) + PSEUDO * k) for x in whole]
    flat = F.array(*map(F.lit, prior))
    at = votes.where("host IS NOT NULL").groupBy("host").agg(_counts(classes).alias("c")).withColumn("domain", domain_of(F.col("host")))
    above = votes.where("host IS NOT NULL").groupBy(domain_of(F.col("host")).alias("domain")).agg(_plus(_counts(classes), flat, PRIOR_ROWS).alias("domain_prior"))
    upper = F.when(F.col("host") == F.col("domain"), flat).otherwise(F.col("domain_prior"))
    hosts = at.join(above, "domain").select("host", F.transform(_plus(F.col("c"), upper, PRIOR_ROWS), lambda x: F.log(x)).alias("host_logs"))

    def ratio(by: str) -> DataFrame:
        """log P(value | class) for each value of a kind of evidence, up to a constant of the value."""
        smooth = F.zip_with(_counts(classes), F.array(*map(F.lit, whole)), lambda x, n: F.log((x + PSEUDO) / (n + PSEUDO * k)))
        return votes.where(F.col(by).isNotNull()).groupBy(by).agg(smooth.alias(f"{by}_logs"))

    nothing = F.array(*[F.lit(0.0)] * k)
    out = _join(every, hosts, "host")
    for by, used in (("said", declared), ("suffix", url)):
        out = _join(out, ratio(by), by) if used else out.withColumn(f"{by}_logs", nothing)
    total = F.coalesce(F.col("host_logs"), F.transform(flat, lambda x: F.log(x)))
    for c in ("t.logs", "said_logs", "suffix_logs"):
        total = F.zip_with(total, F.coalesce(F.col(c), nothing), lambda a, b: a + b)
    top = F.array_max("logs")
    share = F.lit(1.0) / F.aggregate(F.transform("logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    has = F.col("t.n") > 0
    out = out.withColumn("logs", total).select(
        "row",
        F.when(has, _best(F.col("logs"), classes)).otherwise(UNKNOWN).alias("lang"),
        F.when(has, share).otherwise(0.0).alias("posterior"),
        F.when(has, _best(F.col("t.logs"), classes)).otherwise(UNKNOWN).alias("text_lang"),
        F.col("t.n").cast("long").alias("n_trigrams"),
    )
    return out.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("posterior") >= MIN_POSTERIOR))


def texts_of_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, lang) of raw pages: visible text and the language declared in the markup."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    said = F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return pages.select("page_id", "url", bare.alias("text"), said.alias("lang"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is accepted."""
    model = fit_all(docs)
    return identify(docs, model, declared="lang", host="source").where("accepted").select("row.*")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (declared language, source as host) and pages (markup's language, url) together, so that all kinds of evidence are counted.

    A document's row has its doc_id, a page's row its page_id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", "source", F.lit(None).cast("string").alias("url"))
    pages = texts_of_pages(table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "lang", F.lit(None).cast("string").alias("source"), "url")
    found = identify(docs.unionByName(pages), fit_all(docs), declared="lang", host="source", url="url", carry=["doc_id", "page_id"])
    return found.select("row.doc_id", "row.page_id", F.col("lang").alias("language"), F.round("posterior", 6).alias("posterior"), "text_lang", "n_trigrams", "accepted")
