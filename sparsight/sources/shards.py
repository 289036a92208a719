"""Writers: numbered shards, repacked files, statistics, and recovery."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparsight.operators.ordering import index_documents
from sparsight.session import released_shuffles

# Fixed values of the file layout.
TARGET_BYTES = 1 << 29
ROW_GROUP_ROWS = 8_192
PAGE_BYTES = 1 << 20
GROUP_BYTES = 1 << 25  # what a task holds of a shard before it writes a row group
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SPLIT_PREFIX = "train_"  # before the number, of five digits at least


def assign_shards(
    df: DataFrame, key: str, rows: int, splits: list[float] | None = None
) -> DataFrame:
    """``split`` train_00000, train_00001, ... of ``rows`` rows in key order."""
    return name_shards(index_documents(df, key, "_idx", splits), "_idx", rows).drop("_idx")


def name_shards(df: DataFrame, number: str, rows: int) -> DataFrame:
    """``split`` of ``rows`` rows each, for rows that ``number`` numbers without a gap."""
    n = F.expr(f"`{number}` div {int(rows)}")
    # format_string would cost more per row than writing it
    text = F.when(n.between(0, 99_999), F.lpad(n.cast("string"), 5, "0")).otherwise(n.cast("string"))
    return df.withColumn("split", F.concat(F.lit(SPLIT_PREFIX), text))


def named_batches(run: Run, number: str, rows: int, keep: Sequence[str]) -> Run:
    """``run``, giving the columns ``keep`` and the ``split`` that ``name_shards`` gives."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            numbers, place = np.unique(batch.column(number).to_numpy() // rows, return_inverse=True)
            splits = pa.array([f"{SPLIT_PREFIX}{n:05d}" for n in numbers], pa.string()).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), splits], names=[*keep, "split"])

    return named


def write_shards(
    df: DataFrame, path: str, mode: str = "append", clustered: bool = False, steps: Sequence[str] = (),
    through: Run | None = None,
) -> None:
    """One folder per split.

    Rows as ``assign_shards`` leaves them are ``clustered``: a task holds a
    range of keys and so whole splits but for its ends, and they are written
    where they are, see ``_write_in_place``. Otherwise one exchange brings each
    split into one task. Of ``steps``, whole numbers that hardly change from row
    to row, the changes are stored. ``through`` makes the clustered rows from
    those of ``df`` in the worker that writes them.
    """
    if clustered and mode == "append":
        _write_in_place(df, path, steps, through)
        return
    if through is not None:
        raise ValueError("only clustered rows can be made where they are appended")
    placed = df if clustered else df.repartition("split")
    placed.write.mode(mode).partitionBy("split").parquet(path)


def _write_in_place(df: DataFrame, path: str, steps: Sequence[str], through: Run | None = None) -> None:
    """Write rows into the folders of their splits as they come.

    Spark's own writer sorts the rows of a task by split first, and with
    vectors in them the sort goes to disk. Here a task has one file open at a
    time and holds ``GROUP_BYTES`` of it. Files lie in a hidden folder until the
    job is over, and only those of tasks that count are then moved.
    """
    spark = df.sparkSession
    uri = _store_uri(spark, path)
    job = uuid.uuid4().hex
    hidden = f"{uri}/_{job}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(hidden)
        names = (f"{context.taskAttemptId()}-{i:05d}" for i in range(1 << 62))
        split, name, writer, held, size = None, None, None, [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 62)
            held, size = [], 0

        for batch in through(batches) if through else batches:
            for part in _runs(batch, "split"):
                if writer is None or part[0] != split:
                    if writer is not None:
                        flush()
                        writer.close()
                        yield _written(split, name, context.partitionId())
                    split, name = part[0], next(names)
                    kept = part[1].schema
                    plain = [f.name for f in kept if pa.types.is_integer(f.type)]
                    writer = pq.ParquetWriter(
                        f"{root}/{name}", kept, filesystem=store, compression="zstd", compression_level=1,
                        data_page_size=PAGE_BYTES, column_encoding={c: "DELTA_BINARY_PACKED" for c in steps if c in plain},
                        use_dictionary=[_leaf(f) for f in kept if f.name not in plain],
                    )
                held.append(part[1])
                size += part[1].nbytes
                if size >= GROUP_BYTES:
                    flush()
        if writer is not None:
            flush()
            writer.close()
            yield _written(split, name, context.partitionId())

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(hidden))
    try:
        with released_shuffles(spark):
            # a row per file
            written = df.mapInArrow(write, "split string, file string, part int").collect()
        for r in written:
            folder = hadoop(f"{uri}/split={r.split}")
            store.mkdirs(folder)
            final = hadoop(folder, f"part-{r.part:05d}-{r.file}-{job}.parquet")
            if not store.rename(hadoop(f"{hidden}/{r.file}"), final):
                raise OSError(f"{hidden}/{r.file} could not be moved to {final.toString()}")
    finally:
        store.delete(hadoop(hidden), True)


def _written(split: str, name: str, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"split": [split], "file": [name], "part": pa.array([part], pa.int32())}
    )


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Stretches of equal values of a column, without it."""
    values = batch.column(column)
    if values.null_count:
        raise ValueError("a row without the name of a split")
    rest = batch.drop_columns([column])
    ends = pc.indices_nonzero(pc.not_equal(values[1:], values[:-1])).to_numpy() + 1 if len(values) else []
    for lo, hi in zip([0, *ends], [*ends, len(values)]):
        if hi > lo:
            name = values[int(lo)].as_py()
            if not re.fullmatch(r"[\w.-]+", name, re.ASCII):
                raise ValueError("the name of a split must be letters, digits, '_', '.' or '-'")
            yield name, rest.slice(lo, hi - lo)


def _leaf(field: pa.Field) -> str:
    """Name by which the Parquet writer knows a column: that of its elements, if it is a list."""
    return f"{field.name}.list.element" if pa.types.is_list(field.type) else field.name


def _store_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its store: a bare one means the cluster's default store, not a task's own disk."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    uri = hadoop.getFileSystem(conf).makeQualified(hadoop).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and "://" not in uri else uri


def rows_per_file(width: int, element_bytes: int = 2, target: int = TARGET_BYTES) -> int:
    return max(1, target // (width * element_bytes))


def repack(
    df: DataFrame, path: str, width: int, element_bytes: int = 2, target: int = TARGET_BYTES
) -> None:
    """Rewrite vectors into files of a target size, without a shuffle.

    Large inputs are split, and small ones merged: a task takes several of them.
    """
    files = max(1, -(-df.count() // rows_per_file(width, element_bytes, target)))
    merged = df.coalesce(files) if df.rdd.getNumPartitions() > files else df
    (
        merged.write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file(width, element_bytes, target))
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_ROWS * width * element_bytes)
        .option("parquet.page.size", PAGE_BYTES)
        .parquet(path)
    )


def packed_files(sizes: list[int], target: int, spill: float = 1.05) -> list[list[int]]:
    """Which files go into one output: the largest first, each into the first output that it still fits.

    A file over the target has outputs of its own. ``spill`` is how far an
    output may exceed the target. A tree over the outputs finds the first fit,
    so many files take little time.
    """
    limit = int(target * spill)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    width = 1
    while width < max(1, len(sizes)):
        width *= 2
    room = [limit] * (2 * width)
    bins: list[list[int]] = []
    for i in order:
        if sizes[i] > limit:
            bins.append([i])
            continue
        node = 1
        while node < width:
            node = 2 * node if room[2 * node] >= sizes[i] else 2 * node + 1
        slot = node - width
        room[node] -= sizes[i]
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        bins.append([i, slot])
    # outputs in the order they were opened; those of large files stand alone
    whole = [b for b in bins if len(b) == 1]
    shared: dict[int, list[int]] = {}
    for b in bins:
        if len(b) == 2:
            shared.setdefault(b[1], []).append(b[0])
    return whole + [shared[k] for k in sorted(shared)]


def repack_files(spark: SparkSession, source: str, path: str, target: int = TARGET_BYTES) -> DataFrame:
    """Rewrite Parquet files into files of about ``target`` bytes by what the files measure; no rows are counted.

    Small files are merged, each wholly into one output; a larger one is cut
    into as many outputs as it fills, by a hash of its rows and their place.
    Only listed names and sizes reach the driver. Returns (file, size) of what
    was written.
    """
    names, sizes = listed_files(spark, source)
    plan, number = [], 0
    for group in packed_files(sizes, target):
        shares = max(1, round(sizes[group[0]] / target)) if len(group) == 1 else 1
        plan += [(names[i], number, shares) for i in group]
        number += shares
    outputs = spark.createDataFrame(plan, "_file string, _first int, _shares int")
    rows = spark.read.parquet(source).withColumn("_file", F.col("_metadata.file_path"))
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_shares")).cast("int")
    # outputs: a name and two numbers per input file
    placed = rows.join(F.broadcast(outputs), "_file").withColumn("_out", F.col("_first") + share)
    # a range partition per output
    spread = placed.repartitionByRange(max(1, number), "_out").drop("_file", "_first", "_shares")
    spread.write.mode("overwrite").partitionBy("_out").option("compression", "zstd").parquet(path)
    written = listed_files(spark, path)
    return spark.createDataFrame(list(zip(*written)), "file string, size long")


def listed_files(spark: SparkSession, path: str) -> tuple[list[str], list[int]]:
    """Names and sizes of the Parquet files below a path, without reading them."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        .select(F.col("_metadata.file_path").alias("name"), "length").orderBy("name").collect()
    )
    return [r.name for r in found], [r.length for r in found]


def write_vectors_f16(
    df: DataFrame, path: str, vector: str = "activation", target: int = TARGET_BYTES
) -> int:
    """Write vectors as fixed-size lists of half floats, a type Spark has not.

    Each task writes files named after its partition, under a passing name
    first, so that a repeated task replaces its own files and nothing else.
    ``path`` is on storage all executors share. Returns the number of files.
    """
    width = df.select(F.size(vector).alias("n")).first()["n"]
    limit = rows_per_file(width, 2, target)
    uri = _store_uri(df.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        held, rows, files = [], 0, 0

        def flush() -> None:
            nonlocal held, rows, files
            table = pa.Table.from_batches(held)
            flat = table[vector].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            half = pa.FixedSizeListArray.from_arrays(
                pa.array(flat.astype(np.float16), pa.float16()), width
            )
            at = table.column_names.index(vector)
            table = table.set_column(at, vector, half)
            final = f"{root}/part-{context.partitionId():05d}-{files:05d}.parquet"
            passing = f"{root}/.{context.taskAttemptId()}-{files:05d}"
            with store.open_output_stream(passing) as sink:
                pq.write_table(
                    table, sink, compression="zstd", row_group_size=ROW_GROUP_ROWS,
                    data_page_size=PAGE_BYTES,
                )
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(passing, final)
            held, rows, files = [], 0, files + 1

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, limit - rows)
                held.append(part)
                rows += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows == limit:
                    flush()
        if rows:
            flush()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return df.mapInArrow(write, "files long").agg(F.sum("files")).first()[0]


def write_jsonl(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or ["text"])).write.mode("overwrite").json(path)


def write_batches(df: DataFrame, path: str, batches_per_lot: int, batch: str = "batch_id") -> None:
    """Batches in compressed folders of ``batches_per_lot`` each."""
    lots = df.withColumn("lote", F.expr(f"{batch} div {int(batches_per_lot)}"))
    lots.repartition("lote").write.mode("overwrite").partitionBy("lote").option(
        "compression", "zstd"
    ).parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The one-row statistics as a JSON file."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_with_fallback(
    df: DataFrame, target: str, fallback: str, split: str
) -> tuple[str, str | None]:
    """Write a split to ``target``, or elsewhere where that fails.

    Returns the location and the error text, if any, for the manifest.
    """
    try:
        df.write.mode("overwrite").parquet(f"{target}/split={split}")
        return target, None
    except Exception as error:
        # only what storage refuses; a failing computation would fail again
        if not any(x in str(error) for x in ("java.io.", "org.apache.hadoop.fs.", "UnsupportedFileSystem")):
            raise
        df.write.mode("overwrite").parquet(f"{fallback}/split={split}")
        return fallback, str(error).splitlines()[0]


def manifest(spark: SparkSession, rows: list[tuple[str, str, str | None]]) -> DataFrame:
    """(split, location, error): one row per written split."""
    return spark.createDataFrame(rows, "split string, location string, error string")


def pending(df: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """What no manifest row names yet."""
    return df.join(done.select(key), key, "left_anti")


def compare_keys(listed: DataFrame, stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, status, n): keys that a manifest lists against those stored, repeats counted.

    ``missing``: listed more often than stored, by ``n``; ``extra`` the other
    way round; ``stored`` what both have. A null key is a key.
    """
    listed, stored = listed.select(key), stored.select(key)
    parts = {"missing": listed.exceptAll(stored), "extra": stored.exceptAll(listed), "stored": listed.intersectAll(stored)}
    counted = [p.groupBy(key).agg(F.count("*").alias("n")).withColumn("status", F.lit(name)) for name, p in parts.items()]
    return union_shards(*counted).select(key, "status", "n")


def next_shard(done: DataFrame) -> DataFrame:
    """Number that the next split gets."""
    number = F.regexp_extract("split", r"([0-9]+)$", 1).cast("long")
    return done.agg((F.coalesce(F.max(number), F.lit(-1).cast("long")) + 1).alias("next_shard"))


def verify_shards(df: DataFrame, width: int, key: str = "doc_id") -> DataFrame:
    """Per split: rows, vector lengths, missing keys, values that are not finite."""
    cells = F.col("activation")
    # NaN sorts above every number, so the two ends tell of any strange value
    lo, hi, endless = F.array_min(cells), F.array_max(cells), F.lit(float("inf"))
    strange = F.isnan(hi) | (hi == endless) | (lo == -endless)
    return df.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.min(F.size(cells)).alias("min_len"),
        F.max(F.size(cells)).alias("max_len"),
        F.count_if(F.size(cells) != width).alias("wrong_len"),
        F.count_if(F.col(key).isNull()).alias("no_key"),
        F.count_if(strange).alias("not_finite"),
        F.count_distinct(F.col(key)).alias("n_keys"),
    )


def union_shards(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
