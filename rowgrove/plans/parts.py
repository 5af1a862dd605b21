"""Planning of storage parts: where to cut a written object, and which chunks go into which part."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

# Limits of multipart object stores.
MIN_PART_BYTES = 5 * 1024 * 1024
MAX_PARTS = 10_000


def plan_parts(wanted: int, offsets: Sequence[int], min_bytes: int = MIN_PART_BYTES) -> list[int] | None:
    """Cut points chosen among ``offsets`` (ascending, from 0) for about ``wanted`` parts of at least ``min_bytes``.

    None where the whole is smaller than a part may be. A last part that would be too small joins the one before it.
    """
    if not offsets or offsets[0] != 0:
        raise ValueError("offsets begin with 0")
    if wanted < 1:
        raise ValueError("at least one part")
    total = offsets[-1]
    if total < min_bytes:
        return None
    space = max(-(-total // wanted), min_bytes)
    cuts = [0]
    while cuts[-1] < total:
        i = bisect_left(offsets, cuts[-1] + space)
        cut = offsets[i] if i < len(offsets) else total
        cuts.append(total if total - cut < min_bytes else cut)
    return cuts


def plan_table(chunks: DataFrame, wanted: int, min_bytes: int = MIN_PART_BYTES) -> DataFrame:
    """(file, n, cut): cut points for each file's chunks (start_off from 0, sz); a file too small for a part has none.

    A file's chunk list is its footer, which fits one process by nature, so files are planned in groups.
    """
    if "file" not in chunks.columns:
        chunks = chunks.withColumn("file", F.lit(""))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        ends = sorted({0, *(group["start_off"] + group["sz"]).tolist()})
        cuts = plan_parts(wanted, ends, min_bytes) or []
        return pd.DataFrame({"file": group["file"].iloc[0], "n": range(len(cuts)), "cut": cuts})

    ship(chunks.sparkSession)
    return chunks.select("file", "start_off", "sz").groupBy("file").applyInPandas(plan, "file string, n long, cut long")


def single_part(cuts: list[int] | None, total: int, last: bool) -> list[int] | None:
    """What an upload buffer does with a plan: None means keep buffering, unless this is the last, which goes as one part."""
    return [0, total] if cuts is None and last else cuts


def buffer_flushes(sizes: DataFrame, min_bytes: int = MIN_PART_BYTES) -> DataFrame:
    """(file, rg, part, buffered) of row groups (file, rg, bytes) that reach an upload buffer one after another.

    A buffer is kept until it holds ``min_bytes`` and then goes as one part; the last goes whatever it holds. A file's groups are its footer, so files are
    walked in groups.
    """
    if "file" not in sizes.columns:
        sizes = sizes.withColumn("file", F.lit(""))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rg")
        part, held, out = 0, 0, []
        for n in group["bytes"].tolist():
            held += n
            full = single_part(plan_parts(1, [0, held], min_bytes), held, last=len(out) == len(group) - 1) is not None
            out.append((part, held))
            part, held = (part + 1, 0) if full else (part, held)
        return pd.DataFrame({"file": group["file"], "rg": group["rg"], "part": [p for p, _ in out], "buffered": [h for _, h in out]})

    ship(sizes.sparkSession)
    return sizes.select("file", "rg", "bytes").groupBy("file").applyInPandas(walk, "file string, rg long, part long, buffered long")


def group_chunks(chunks: DataFrame, cuts: DataFrame, magic: int, footer: int) -> DataFrame:
    """(n, num_chunks, bytes) of each part; the first part carries the leading magic too, the last the footer."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("file").orderBy("n")
    spans = cuts.withColumns({"p_start": F.col("cut"), "p_end": F.lead("cut").over(order)}).where("p_end IS NOT NULL")
    spans = spans.withColumn("last", F.lead("n").over(order).isNull())
    if "file" not in chunks.columns:
        chunks = chunks.withColumn("file", F.lit(""))
    met = chunks.join(spans, "file").where("start_off >= p_start AND start_off < p_end")
    out = met.groupBy("file", "n", "last").agg(F.count("*").alias("num_chunks"), F.sum("sz").cast("long").alias("sz"))
    extra = F.when(F.col("n") == 0, magic).otherwise(0) + F.when(F.col("last"), footer).otherwise(0)
    return out.select("file", "n", "num_chunks", (F.col("sz") + extra).cast("long").alias("bytes"))


def within_limits(cuts: DataFrame, most: int = MAX_PARTS) -> DataFrame:
    """(file, num_parts, ok): whether each file keeps to the number of parts that a store takes."""
    return cuts.groupBy("file").agg((F.count("*") - 1).alias("num_parts")).withColumn("ok", F.col("num_parts") <= most)
