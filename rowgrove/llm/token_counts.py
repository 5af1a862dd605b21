"""Token counts by a whole-token shortcut.

Offline, each vocabulary string is put to the tokenizer alone; those that come back as one id are proven whole tokens (``vocab.prove``).
A text is cut into pre-tokens, pre-tokens among the proven strings count one each without any merging, and only the
rest are merged (a bounded table remembers their counts within a worker). Strings that aren't proven are merged like any other.

Counts equal the library's for whole texts: no begin, end or added tokens, special strings inside texts count as the
library's default takes them (one token), no truncation. Files that aren't plain byte-level BPE (``vocab``) are counted by their library alone.
Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any length and any characters are counted whole; repeated rows each get
their row; an empty table gives an empty result; other columns are passed by (only the named ones are read), so clashing names can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table
from .vocab import Proof, library, merged_count, pre_tokens, proof, whole_words

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of a worker's table of merged pre-tokens before it starts anew (some 100 bytes each).
REMEMBERED = 400_000


class _Counts(dict):
    """Tokens of a pre-token: 1 for the proven, merged once for the rest."""

    def __init__(self, path: str, known: Proof):
        super().__init__()
        self.proven = dict.fromkeys(whole_words(path, known.unproven), 1)
        self.merged = merged_count(path, known.by_rank)
        self.update(self.proven)

    def __missing__(self, piece: str) -> int:
        if len(self) - len(self.proven) > REMEMBERED:
            self.clear()
            self.update(self.proven)
        n = self[piece] = self.merged(piece.encode("utf-8"))
        return n


def counter(path: str, known: Proof | None = None):
    """A function from text to its token count under the tokenizer file ``path`` (.json or .model)."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    known = known or proof(path)
    if not known.plain:  # another kind of vocabulary: the library itself
        plain = library(path)
        return lambda text: len(plain.encode(text, add_special_tokens=False).ids)
    counts, cut = _Counts(path, known), pre_tokens(path)

    def count(text: str) -> int:
        pieces, special = cut(text)
        return special + sum(map(counts.__getitem__, pieces))

    return count


def token_count(text: Column, path: str) -> Column:
    """Tokens of ``text``, 0 for null."""
    known = proof(path)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, known)
        for texts in batches:
            yield pd.Series([count(x) if x else 0 for x in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Key, n_bytes (UTF-8), n_tokens and over_limit of every row."""
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key), F.octet_length(body).cast("long").alias("n_bytes"), token_count(body, path).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
