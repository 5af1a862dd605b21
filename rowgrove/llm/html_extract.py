"""HTML extraction: a recurrent labeller classifies every block of a page in the context of the whole document.

Each leaf block has a tag-path vector and a hashed-word vector (and some figures); a bidirectional LSTM in numpy reads the page's sequence and
gives every block a probability of being main text. Blocks above one half are joined in page order by line ends.
Weights come from ``html_train``, which generates its own labelled pages.

Defined results: a null, empty or text-free page has an empty text; a page is read whole at any length and a broken one as far as it can be;
repeated rows each get their row; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_lstm
from .common import relieve, ship, table
from .html_blocks import Block, Features, blocks_of

MAIN = 0.5
#: Blocks whose features are held at once.
BLOCKS_AT_ONCE = 20_000


@functools.lru_cache(maxsize=1)
def _model() -> dict[str, np.ndarray]:
    return html_lstm.load()


def label_pages(pages: list[list[Block]], features: Features) -> Iterator[np.ndarray]:
    """Probability of every block, page by page."""
    w = _model()
    a = 0
    while a < len(pages):
        b, held = a, 0
        while b < len(pages) and (b == a or held + len(pages[b]) <= BLOCKS_AT_ONCE):
            held += len(pages[b])
            b += 1
        found = [features.of(p) for p in pages[a:b] if p]
        lengths = [len(p) for p in pages[a:b]]
        if found:
            x, _ = html_lstm.inputs([p for f in found for p in f[0]], [q for f in found for q in f[1]], np.concatenate([f[2] for f in found]), w)
            yield from np.split(html_lstm.label(x, lengths, w), np.cumsum(lengths)[:-1])
        else:
            yield from (np.zeros(0) for _ in lengths)
        a = b


def main_texts(pages: list[str | None], features: Features | None = None) -> list[str]:
    blocks = [blocks_of(p) if p else [] for p in pages]
    labels = label_pages(blocks, features or Features())
    return ["\n".join(b.text for b, p in zip(page, found, strict=True) if p >= MAIN) for page, found in zip(blocks, labels, strict=True)]


def main_text(html: Column) -> Column:
    """The main text of each page."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for series in batches:
            yield pd.Series([t for a in range(0, len(series), 1000) for t in main_texts(series.iloc[a : a + 1000].tolist(), features)], dtype=object)
            relieve()

    return extracted(html)


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with text and n_chars (code points) of every page."""
    ship(pages.sparkSession)
    return pages.select(*keep, main_text(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
