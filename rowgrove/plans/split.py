"""Splitting a table into one file per row group, and the byte arithmetic of ranges and footers that goes with it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import delete_folder, exists, reliable, uri
from ..functions.shipping import ship
from ..functions.sizes import MAGIC_BYTES
from ..sources import chunks, footer, stores, thrift
from .ordinals import FILE, ORD, RG, few, group_keys, number_groups, row_group_index
from .parts import MIN_PART_BYTES, plan_parts


class SplitError(ValueError):
    """Row groups that don't lie one behind another."""


def split_by_row_group(df: DataFrame, path: str, *, codec: str = "zstd") -> None:
    """Write one file for each row group, in folders ``rg=k`` (k numbers the groups of all files), rows in order; an existing target is refused.

    Rows are dealt by row group, so each group is one task's one file, and different groups are written in parallel. If it fails, what was written goes.
    """
    keys = group_keys(df)
    if FILE in keys:
        numbers = few(number_groups(row_group_index(df)).select(*keys, F.col("group_no").alias("_no")))
        df = df.join(numbers, keys).withColumn(RG, F.col("_no")).drop("_no", FILE)
    if exists(df.sparkSession, path):
        raise SplitError(f"{path} already exists")
    try:
        df.repartition(RG).sortWithinPartitions(RG, ORD).write.mode("errorifexists").option("compression", codec).partitionBy(RG).parquet(path)
    except Exception:
        delete_folder(df.sparkSession, path)
        raise


def split_files(spark: SparkSession, path: str, target: str) -> DataFrame:
    """Cut every file under ``path`` into one file for each row group, bytes copied as they are, footers written anew.

    Returns (path, row_group, file, length). Each file's footer is parsed once; groups are dealt out to tasks and read and written one by one. An existing
    target is refused, and if one fails all files written go. Rows of the result are read from a written table, so that nothing is cut twice.
    """
    if exists(spark, target):
        raise SplitError(f"{target} already exists")
    files = footer.list_files(spark, path).select(uri(F.col("path")).alias("path"), "length")  # listed once for both
    groups = footer.footers(spark, path, "group_entries", files=files if stores.scheme(path) in stores.KNOWN_SCHEMES else None)
    count, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    numbers = few(files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("no")))
    schema = "path string, row_group long, file string, length long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = stores.file_system(target)
        for batch in batches:
            made = []
            for r in batch.itertuples(index=False):
                content = chunks.cut_group(r.path, thrift.parse(r.head)[0], thrift.parse(r.entry)[0], int(r.row_group), int(r.data_end))
                system.create_dir(folder, recursive=True)
                name = f"part-{r.no:05d}-{r.row_group:05d}.parquet"
                with system.open_output_stream(written := f"{folder}/.{name}-{uuid.uuid4().hex}") as f:
                    f.write(content)
                system.move(written, f"{folder}/{name}")
                made.append((r.path, r.row_group, f"{target}/{name}", len(content)))
            yield pd.DataFrame(made, columns=["path", "row_group", "file", "length"])

    ship(spark)
    met = groups.join(numbers, "path").select("path", "row_group", "data_end", "head", "entry", "no")
    # Groups aren't counted, which would parse all footers twice: files and their bytes tell how many tasks, a few for each core at least.
    tasks = max(footer.tasks_for(spark, count, size), 4 * spark.sparkContext.defaultParallelism)
    report = f"{target}.report-{uuid.uuid4().hex}"
    try:
        met.repartition(tasks).mapInPandas(cut, schema).write.parquet(report)
    except Exception:
        delete_folder(spark, target)
        delete_folder(spark, report)
        raise
    return spark.read.schema(schema).parquet(report)


def assemble_files(spark: SparkSession, sources: DataFrame, target: str, columns: Sequence[str], *, wanted_parts: int = 1, min_bytes: int = MIN_PART_BYTES, pairs: Sequence[tuple[str, str]] | None = None) -> int:
    """Put one file together from chunks of other files without decoding or a local copy, and upload it in parts; returns its size.

    ``sources`` is (position, column, path, row_group): the row groups of the file in order of position, with a chunk for each of ``columns``. Parts are cut at
    ends of chunks (``plan_parts``); each is read by ranges and put by a task of its own. The driver holds the file's own footer and nothing else.
    Missing or repeated columns and unequal row counts in a group are errors before anything is uploaded.
    """
    found = footer.footers(spark, "", "chunk_entries", files=sources.select("path").distinct())
    facts = ["start", "length", "num_values", "num_rows", "entry"]
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column"))
    met = sources.join(found.where(F.col("column").isin(*columns)), ["path", "row_group", "column"], "left").withColumn("col", place)
    listed = reliable(met.select("position", "col", "column", "path", "row_group", *facts))
    _check_groups(listed, columns)
    before = Window.orderBy("position", "col").rowsBetween(Window.unboundedPreceding, -1)  # over one file's chunks
    laid = listed.withColumn("at", (F.coalesce(F.sum("length").over(before), F.lit(0)) + MAGIC_BYTES).cast("long"))
    rows = laid.select("at", "length").orderBy("at").collect()
    if not rows:
        raise SplitError("a file without row groups can't be written")
    ends = [0, *(r["at"] + r["length"] for r in rows)]
    cuts = plan_parts(wanted_parts, ends, min_bytes) or [0, ends[-1]]
    part = F.size(F.filter(F.array(*map(F.lit, cuts[:-1])), lambda a: F.col("at") >= a))
    dealt = laid.withColumn("part", part.cast("long"))
    first = laid.orderBy("at").select("path").first()["path"]
    with stores.Upload(target) as upload:
        name = upload.id

        def put(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("at")
            picked = [chunks.Chunk(r.column, int(r.num_rows), r.entry, stores.Range(r.path, int(r.start), int(r.length))) for r in group.itertuples(index=False)]
            number = int(group["part"].iloc[0])
            data = b"".join([chunks.MAGIC if number == 1 else b"", *chunks.read_each(picked)])
            stores.Upload(target, upload=name).put_part(number, data)
            entries = [thrift.dump(c.moved(int(at))) for c, at in zip(picked, group["at"], strict=True)]
            return pd.DataFrame({"position": group["position"], "col": group["col"], "rows": [c.rows for c in picked], "entry": entries})

        last = len(cuts) - 1
        ship(spark)
        done = dealt.groupBy("part").applyInPandas(put, "position long, col long, rows long, entry binary").collect()
        done.sort(key=lambda r: (r["position"], r["col"]))
        base = chunks.file_head(first)
        more = []
        if set(columns) - {e[4][1].decode() for e in base[chunks.SCHEMA][1][1][1:]}:
            others = footer.footers(spark, "", "schemas", files=sources.select("path").distinct()).select("schema").distinct().collect()
            more = [e for r in others for e in thrift.parse(bytes(r["schema"]))[0][chunks.SCHEMA][1][1][1:]]
        groups, count = [], 0
        for _, members in groupby(done, key=lambda r: r["position"]):
            members = list(members)
            groups.append(thrift.dump(chunks.group_of_entries([thrift.parse(bytes(r["entry"]))[0] for r in members], members[0]["rows"], len(groups))))
            count += members[0]["rows"]
        tail = chunks.footer_bytes(base, groups, schema=chunks.schema_of(base, columns, more), pairs=pairs, rows=count)
        upload.put_part(last + 1, tail)
        return upload.known(range(1, last + 1)).finish()


def _check_groups(listed: DataFrame, columns: Sequence[str]) -> None:
    """Each row group has each column once, all with equal row counts."""
    per = listed.groupBy("position").agg(
        F.count("*").alias("n"), F.count_distinct("column").alias("kinds"), F.count("length").alias("there"), F.min("num_values").alias("low"), F.max("num_values").alias("high"), F.count_if(F.col("col") == 0).alias("odd")
    )
    wrong = per.where((F.col("n") != len(columns)) | (F.col("kinds") != F.col("n")) | (F.col("there") != F.col("n")) | (F.col("low") != F.col("high")) | (F.col("odd") > 0)).orderBy("position").first()
    if wrong is not None:
        raise SplitError(f"row group {wrong['position']}: {wrong['n']} chunks of {wrong['kinds']} columns, {wrong['there']} of them found, {wrong['low']} to {wrong['high']} rows, for {len(columns)} columns")


def overlap(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """Bytes that each part (n, p_start, p_end) shares with each row group (rg, r_start, r_end).

    Both lists are metadata of one file; parts meet row groups in buckets of the mean group's size, so it is an equi-join.
    """
    width = max(1, int(groups.agg(F.avg(F.col("r_end") - F.col("r_start"))).first()[0] or 1))
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    p = parts.where("p_end > p_start").withColumn("_bucket", buckets("p_start", "p_end"))
    g = groups.where("r_end > r_start").withColumn("_bucket", buckets("r_start", "r_end"))
    met = p.join(g, "_bucket").where("p_start < r_end AND r_start < p_end")
    # A pair can meet in several buckets: it counts in the first that both stand in.
    met = met.where(F.col("_bucket") == F.floor(F.greatest("p_start", "r_start") / width))
    return met.select("n", RG, (F.least("p_end", "r_end") - F.greatest("p_start", "r_start")).cast("long").alias("bytes"))


def data_parts(parts: DataFrame, data_start: int, footer_start: int) -> DataFrame:
    """Parts without those that lie wholly in the footer, the first trimmed of the leading magic."""
    cut = parts.where(F.col("p_start") < footer_start).withColumn("p_start", F.greatest("p_start", F.lit(data_start)).cast("long"))
    return cut.withColumn("p_end", F.least("p_end", F.lit(footer_start)).cast("long")).where("p_start < p_end")


def fixed_parts(df: DataFrame, total: str, size: int) -> DataFrame:
    """(n, p_start, p_end) of parts of ``size`` bytes that cover ``total`` bytes (a column of a one-row table)."""
    n = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(total) / size).cast("int") - 1)))
    return df.select(total, n.alias("n")).select(
        F.col("n").cast("long").alias("n"), (F.col("n") * F.lit(size).cast("long")).alias("p_start"), F.least((F.col("n") + 1) * F.lit(size).cast("long"), F.col(total)).alias("p_end")
    )


def part_offsets(sizes: DataFrame) -> DataFrame:
    """(part_no, start, size): prefix sums of one object's part sizes (part_no, size)."""
    before = Window.partitionBy(F.lit(0)).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part_no", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"), "size")


def split_footers(placed: DataFrame) -> DataFrame:
    """Chunk offsets in a file of the row group alone: shifted so that the group begins behind the magic."""
    first = Window.partitionBy(*group_keys(placed))
    return placed.withColumn("moved_off", (F.col("start_off") - F.min("start_off").over(first) + MAGIC_BYTES).cast("long"))


def contiguity(groups: DataFrame) -> DataFrame:
    """Flags row groups (rg, r_start, r_end): sizes above 0, each beginning where the one before ended."""
    keys = group_keys(groups)[:-1]
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(RG)
    follows = F.coalesce(F.lag("r_end").over(order) == F.col("r_start"), F.col("r_start") == MAGIC_BYTES)
    return groups.withColumn("contiguous", follows & (F.col("r_end") > F.col("r_start")))


def require_contiguous(groups: DataFrame) -> DataFrame:
    broken = contiguity(groups).where("NOT contiguous").orderBy(RG).first()
    if broken is not None:
        raise SplitError(f"row group {broken[RG]} doesn't begin where the one before ends")
    return groups
