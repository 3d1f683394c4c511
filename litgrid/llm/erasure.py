"""Cascading erasure: tables in sorted files, and the files that hold erased clients' rows written anew.

Writing. Rows of all tables are one RDD of composite tuples (table, crc32 of the client, all columns left to right, a number within the batch); `sortBy` puts them in order, `zipWithIndex`
ranks them, and the rank gives the file. Sorted rows are packed column by column, and a partitioner by file number sends each file's chunks to one task, in order, which streams
them to a pyarrow writer. The number at the end of a tuple lets a hot group of equal rows fall into several partitions.

Erasing. Links are distinct (key, file) pairs read from the files, so a hot key has as many as there are files at most. Victims go along them by cogrouping: masters to files of clients, whose
tasks read off the clients; clients to files of clicks and sales, whose tasks read off the sales; sales to files of lines. Marks (file, key) are kept in the shared folder before anything is
written; each marked file is then streamed by one task to a new file without the marked rows. Old files stay until all new ones are there, so a lost executor's work can be done again.

Cases: a null client_id (and a line of no sale, or of a sale without client) sorts as the empty text and links to nothing; a client row is erased by its own master_id; of several sales of one
sale_id the smallest client_id counts for sorting, and lines go if any of them goes; repeated rows all stay or all go; null masters are nobody's; an empty table has no files; a table whose rows
all go has none left. Very long texts are values like others. Columns may be numbers, booleans, dates, timestamps and strings; others are refused with a ValueError; names don't matter, but for
the keys and the amount. `sale_lines` has no client of its own: sales of more than a thousandth of all lines (a thousand at most) are joined by broadcast, all others by a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir

FILES = 250
SHARE = 200
HEAVY = 1_000
#: Rows of a sorted partition, of a chunk and of a row group.
PART_ROWS, CHUNK_ROWS, GROUP_ROWS = 100_000, 20_000, 100_000
MOST_PARTS = 20_000
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
NULL = float("-inf")
RESULT = "table_no int, file_no bigint, n_rows bigint, n_erased bigint, cents bigint, ids_sha256 string, path string"


class Table(NamedTuple):
    """What every task must know of a table: rows per file, and the numbers of its first row and first file among all tables'."""

    number: int
    name: str
    schema: pa.Schema
    amount: str
    rows: int
    per_file: int
    first_row: int
    first_file: int

    @property
    def files(self) -> int:
        return -(-self.rows // self.per_file)


class FileNumber:
    """The partitioner: a key begins with its file's number."""

    def __call__(self, key) -> int:
        return key[0] if isinstance(key, tuple) else key

    def __eq__(self, other) -> bool:
        return isinstance(other, FileNumber)

    def __hash__(self) -> int:
        return hash(FileNumber)


# --- rows as tuples that sort ----------------------------------------------------------------------------------------------------------


def plain(column: pa.Array) -> list:
    """Values of a column without nulls; by numpy, as Arrow's own list makes an object of its own for each value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def sortable(column: pa.Array) -> list:
    """Values of a column as Python values in the column's order, nulls first."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return plain(pc.fill_null(pc.binary_join_element_wise(pa.scalar("=", kind), column, pa.scalar("", kind)), ""))
    if pa.types.is_floating(kind):
        bits = column.fill_null(0).cast(pa.float64()).to_numpy(zero_copy_only=False).view(np.int64)
        values = (bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).tolist()
    elif pa.types.is_date32(kind):
        values = plain(column.cast(pa.int32()).fill_null(0))
    elif pa.types.is_integer(kind) or pa.types.is_boolean(kind) or pa.types.is_timestamp(kind):
        values = plain(column.cast(pa.int64()).fill_null(0))
    else:
        raise ValueError(f"columns of type {kind} are not sorted here")
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            values[i] = NULL
    return values


def column_of(values: Iterable, kind: pa.DataType) -> pa.Array:
    """The column of sortable values."""
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        marked_text = pa.array(values, kind)
        return pc.if_else(pc.equal(marked_text, pa.scalar("", kind)), pa.scalar(None, kind), pc.utf8_slice_codeunits(marked_text, 1))
    found = pa.array([None if v == NULL else v for v in values] if NULL in values else values, pa.int64())
    if pa.types.is_floating(kind):
        bits = found.fill_null(0).to_numpy(zero_copy_only=False)
        floats = pa.array((bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64))
        return pc.if_else(found.is_valid(), floats, pa.scalar(None, pa.float64())).cast(kind)
    return found.cast(pa.int32()).cast(kind) if pa.types.is_date32(kind) else found.cast(kind)


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def of_blob(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def packed(df: DataFrame, number: int, client: str) -> DataFrame:
    """(number, n, rows): batches of df with the crc32 of the client's number before their columns."""
    crc = F.crc32(F.coalesce(F.col(client).cast("string"), F.lit("")).cast("binary"))
    placed = df.select(crc.alias("crc"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != "__client"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([batch.num_rows], pa.int64()), pa.array([to_blob(batch)], pa.binary())], names=["number", "n", "rows"])

    return placed.mapInArrow(run, "number int, n bigint, rows binary")


def with_client(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """lines and __client, the smallest client_id of their sale."""
    owner = sales.where("sale_id is not null and client_id is not null").groupBy(F.col("sale_id").alias("__sale")).agg(F.min("client_id").alias("__client"))
    total = lines.count()
    # at most HEAVY rows, as each has more than total / HEAVY lines
    heavy = cut(lines.where("sale_id is not null").groupBy(F.col("sale_id").alias("__sale")).count().where(F.col("count") * HEAVY > total).select("__sale"))
    hot = lines.join(F.broadcast(heavy), lines["sale_id"] == heavy["__sale"], "left_semi")
    rest = lines.join(F.broadcast(heavy), lines["sale_id"] == heavy["__sale"], "left_anti")
    few = owner.join(F.broadcast(heavy), "__sale", "left_semi")
    joined = lambda part, side: part.join(side, part["sale_id"] == side["__sale"], "left").drop("__sale")
    return joined(hot, F.broadcast(few)).unionByName(joined(rest, owner))


# --- files -----------------------------------------------------------------------------------------------------------------------------


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


class Writer:
    """One file: rows are streamed to it, and it appears under its name when it is whole."""

    def __init__(self, folder: str, table: Table, name: str) -> None:
        self.files, root = opened(folder)
        self.table, self.path = table, f"{root}/{table.name}/{name}"
        self.draft = f"{root}/_drafts/{uuid.uuid4().hex}"
        for d in (f"{root}/{table.name}", f"{root}/_drafts"):
            self.files.create_dir(d, recursive=True)
        self.sink = self.out = None
        self.waiting: list[pa.RecordBatch] = []
        self.n_rows = self.cents = 0
        self.sha = hashlib.sha256()

    def write(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        first = batch.column(0)
        shown = plain(first.cast(pa.string()).fill_null("")) if pa.types.is_integer(first.type) else ["" if v is None else str(v) for v in first.to_pylist()]
        self.sha.update((("," if self.n_rows else "") + ",".join(shown)).encode())
        money = batch.column(batch.schema.get_field_index(self.table.amount)).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
        self.cents += int(np.floor(100 * np.where(np.isfinite(money), money, 0) + 0.5).astype(np.int64).sum())
        self.n_rows += batch.num_rows
        self.waiting.append(batch)
        if sum(b.num_rows for b in self.waiting) >= GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            if self.out is None:
                self.sink = self.files.open_output_stream(self.draft)
                self.out = pq.ParquetWriter(self.sink, self.table.schema)
            self.out.write_table(pa.Table.from_batches(self.waiting, self.table.schema))
            self.waiting = []

    def close(self, file_no: int, n_erased: int) -> tuple:
        """The file's row of the result; a file without rows doesn't come to be."""
        self.flush()
        if self.out is not None:
            self.out.close()
            self.sink.close()
            self.files.move(self.draft, self.path)
        return (self.table.number, file_no, self.n_rows, n_erased, self.cents, self.sha.hexdigest(), self.path)


def file_name(file_no: int, erased: bool = False) -> str:
    return f"file-{file_no:05d}{'-erased' if erased else ''}.parquet"


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    return min(MOST_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows // each))


def ranked(blobs: DataFrame, n_rows: int) -> RDD:
    """((table, crc, columns ..., number), rank) of all rows in order."""

    def rows(row) -> Iterator[tuple]:
        batch = of_blob(bytes(row["rows"]))
        return zip(itertools.repeat(row["number"]), *[sortable(c) for c in batch.columns], range(batch.num_rows), strict=False)

    return blobs.select("number", "rows").rdd.flatMap(rows).sortBy(lambda r: r, numPartitions=tasks(blobs.sparkSession, n_rows, PART_ROWS)).zipWithIndex()


def write_sorted(spark: SparkSession, blobs: DataFrame, tables: list[Table], folder: str) -> DataFrame:
    """Writes all files; RESULT of each."""

    def chunks(rows: Iterable[tuple]) -> Iterator[tuple]:
        def packed_up() -> tuple:
            t = tables[number]
            columns = list(zip(*held, strict=True))[2:-1]
            batch = pa.RecordBatch.from_arrays([column_of(c, f.type) for c, f in zip(columns, t.schema, strict=True)], schema=t.schema)
            return (file, first), to_blob(batch)

        held, number, file, first = [], -1, -1, 0
        for row, rank in rows:
            t = tables[row[0]]
            at = t.first_file + (rank - t.first_row) // t.per_file
            if held and (at != file or len(held) >= CHUNK_ROWS):
                yield packed_up()
                held = []
            if not held:
                number, file, first = row[0], at, rank
            held.append(row)
        if held:
            yield packed_up()

    def write(pairs: Iterable[tuple]) -> Iterator[tuple]:
        for file, group in itertools.groupby(pairs, lambda p: p[0][0]):
            t = next(t for t in tables if t.first_file <= file < t.first_file + t.files)
            out = Writer(folder, t, file_name(file - t.first_file))
            for _, blob in group:
                out.write(of_blob(blob))
            yield out.close(file - t.first_file, 0)

    n_rows = sum(t.rows for t in tables)
    parts = min(sum(t.files for t in tables), tasks(spark, n_rows, PART_ROWS // 2))
    done = ranked(blobs, n_rows).mapPartitions(chunks).repartitionAndSortWithinPartitions(parts, FileNumber()).mapPartitions(write)
    # kept at once: files are written by this one job
    return cut(spark.createDataFrame(done, RESULT))


# --- links -----------------------------------------------------------------------------------------------------------------------------


class Links:
    """The files of the tables, as a graph between keys and files."""

    def __init__(self, spark: SparkSession, tables: list[Table], folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.tables = {t.name: t for t in tables}
        self.parts = min(sum(t.files for t in tables), tasks(spark, sum(t.rows for t in tables), PART_ROWS))

    def frame(self, name: str) -> DataFrame:
        """A table's written rows with file, the number of their file."""
        number = F.regexp_extract(F.col("_metadata.file_name"), r"file-(\d+)\.parquet", 1).cast("bigint")
        return self.spark.read.parquet(f"{self.folder}/{name}").withColumn("__file", number + self.tables[name].first_file)

    def empty(self, *names: str) -> bool:
        return any(not self.tables[n].rows for n in names)

    def reach(self, victims: RDD, name: str, key: str) -> RDD:
        """(file, key) of the files of a table in which a victim stands under the key."""
        if self.empty(name):
            return self.spark.sparkContext.emptyRDD()
        links = self.frame(name).where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), "__file").distinct().rdd.map(tuple)
        both = victims.map(lambda v: (v, None)).cogroup(links, self.parts)
        return both.flatMap(lambda kv: [(file, kv[0]) for file in kv[1][1]] if len(kv[1][0]) else [])

    def read_off(self, marks: RDD, name: str, key: str, wanted: str) -> RDD:
        """Distinct non-null values of `wanted` in the rows that the marks of a table name by `key`."""
        table, folder = self.tables[name], self.folder

        def run(pairs: Iterable[tuple]) -> Iterator[int]:
            for file, keys in by_file(pairs).items():
                files, root = opened(folder)
                with files.open_input_file(f"{root}/{name}/{file_name(file - table.first_file)}") as f:
                    for batch in pq.ParquetFile(f).iter_batches(GROUP_ROWS, columns=list(dict.fromkeys([key, wanted]))):
                        yield from plain(pc.unique(batch.column(wanted).filter(pa.array(marked(batch.column(key), keys)))).drop_null())

        return marks.partitionBy(self.parts, FileNumber()).mapPartitions(run).distinct(self.parts)


def by_file(pairs: Iterable[tuple]) -> dict[int, np.ndarray]:
    """The distinct keys of each file, eight bytes each."""
    out: dict[int, array] = defaultdict(lambda: array("q"))
    for file, key in pairs:
        out[file].append(key)
    return {f: np.unique(np.frombuffer(keys, np.int64)) for f, keys in out.items()}


def marked(column: pa.Array, keys: np.ndarray) -> np.ndarray:
    return np.isin(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), keys) & column.is_valid().to_numpy(zero_copy_only=False)


def masters_to_erase(links: Links, share: int) -> RDD:
    """Masters whose number's crc32 is divisible by `share`, and the one whose clients have most clicks (the smallest of several)."""
    clients = links.frame("clients").where("master_id is not null").select(F.col("client_id").cast("bigint"), F.col("master_id").cast("bigint")).distinct().rdd.map(tuple)
    clicks = links.spark.sparkContext.emptyRDD()
    if not links.empty("clicks"):
        clicks = links.frame("clicks").where("client_id is not null").groupBy(F.col("client_id").cast("bigint")).count().rdd.map(tuple)
    known = clients.filter(lambda r: r[0] is not None).cogroup(clicks, links.parts).flatMap(lambda kv: [(m, sum(kv[1][1])) for m in kv[1][0]])
    masters = known.union(clients.filter(lambda r: r[0] is None).map(lambda r: (r[1], 0))).reduceByKey(lambda a, b: a + b, links.parts)
    best = masters.aggregate((0, None), lambda a, kv: min(a, (-kv[1], kv[0])) if a[1] is not None else (-kv[1], kv[0]), lambda a, b: b if a[1] is None else a if b[1] is None else min(a, b))
    top = best[1]
    return masters.keys().filter(lambda m: m == top or zlib.crc32(str(m).encode()) % share == 0)


def marks(links: Links, share: int) -> DataFrame:
    """(file, key) of all rows to erase; a table's key is master_id, client_id or sale_id."""
    masters = masters_to_erase(links, share)
    in_clients = links.reach(masters, "clients", "master_id")
    clients = links.read_off(in_clients, "clients", "master_id", "client_id")
    in_clicks, in_sales = links.reach(clients, "clicks", "client_id"), links.reach(clients, "sales", "client_id")
    sales = links.read_off(in_sales, "sales", "client_id", "sale_id")
    in_lines = links.reach(sales, "sale_lines", "sale_id")
    return cut(links.spark.createDataFrame(in_clients.union(in_clicks).union(in_sales).union(in_lines), "file bigint, key bigint"))


KEYS = {"clients": "master_id", "clicks": "client_id", "sales": "client_id", "sale_lines": "sale_id"}


def rewrite(found: DataFrame, tables: list[Table], folder: str) -> DataFrame:
    """Writes each marked file anew without its marked rows; RESULT of each, those without rows too."""

    def run(pairs: Iterable[tuple]) -> Iterator[tuple]:
        for file, keys in by_file(pairs).items():
            t = next(t for t in tables if t.first_file <= file < t.first_file + t.files)
            files, root = opened(folder)
            out, gone = Writer(folder, t, file_name(file - t.first_file, erased=True)), 0
            with files.open_input_file(f"{root}/{t.name}/{file_name(file - t.first_file)}") as f:
                for batch in pq.ParquetFile(f).iter_batches(GROUP_ROWS):
                    erased = marked(batch.column(batch.schema.get_field_index(KEYS[t.name])), keys)
                    gone += int(erased.sum())
                    out.write(batch.filter(pa.array(~erased)))
            yield out.close(file - t.first_file, gone)

    parts = min(sum(t.files for t in tables), tasks(found.sparkSession, sum(t.rows for t in tables), PART_ROWS // 2))
    return cut(found.sparkSession.createDataFrame(found.rdd.map(tuple).partitionBy(parts, FileNumber()).mapPartitions(run), RESULT))


def erase(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, files: int = FILES, share: int = SHARE) -> DataFrame:
    """Writes the four tables into a new folder under the checkpoint folder and erases; one row per final file."""
    spark = clients.sparkSession
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{base.rstrip('/')}/erasure-{uuid.uuid4().hex}"
    frames = {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": sale_lines}
    keyed = [packed(with_client(df, sales) if name == "sale_lines" else df, i, "__client" if name == "sale_lines" else "client_id") for i, (name, df) in enumerate(frames.items())]
    blobs = cut(keyed[0].union(keyed[1]).union(keyed[2]).union(keyed[3]))
    counts = dict(blobs.groupBy("number").agg(F.sum("n")).collect())
    tables, row, file = [], 0, 0
    for i, (name, df) in enumerate(frames.items()):
        n = counts.get(i, 0)
        tables.append(Table(i, name, df.limit(0).toArrow().schema, AMOUNTS[name], n, 1 + n // files, row, file))
        row, file = row + n, file + tables[-1].files
    if not row:
        return named(spark.createDataFrame([], RESULT + ", rewritten boolean"), frames)
    written = write_sorted(spark, blobs, tables, folder)
    again = spark.createDataFrame([], RESULT)
    if tables[0].rows:
        again = rewrite(marks(Links(spark, tables, folder), share), tables, folder)
    store, root = opened(folder)
    for number, file_no in again.select("table_no", "file_no").collect():  # at most as many as there are files
        store.delete_file(f"{root}/{tables[number].name}/{file_name(file_no)}")
    if store.get_file_info(f"{root}/_drafts").type == pa.fs.FileType.Directory:
        store.delete_dir(f"{root}/_drafts")
    untouched = written.join(F.broadcast(again.select("table_no", "file_no")), ["table_no", "file_no"], "left_anti").withColumn("rewritten", F.lit(False))
    return named(untouched.unionByName(again.where("n_rows > 0").withColumn("rewritten", F.lit(True))), frames)


def named(found: DataFrame, frames: dict[str, DataFrame]) -> DataFrame:
    names = list(frames)
    columns = F.element_at(F.array(*[F.lit(",".join(df.columns)) for df in frames.values()]), F.col("table_no") + 1)
    table = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("table_no") + 1)
    return found.select(table.alias("table_name"), "file_no", "n_rows", "n_erased", "cents", "rewritten", "ids_sha256", columns.alias("columns"), "path")
