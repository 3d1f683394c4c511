"""Many workbooks at once, written by executors: one for each key.

Rows are sorted by key and order in range partitions, each of which deflates its stretches of sheet rows on its own; a key with most of the rows is deflated by many
tasks. A deflate stream that ends at a byte's edge can be followed by another, and check sums of stretches combine, so one task for each workbook only strings the finished
stretches together, as a stream, without unpacking any. Nothing goes through the driver.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litgrid.sources.sheets import MAIN, NOT_XML, SHEET_ROWS, workbook_frame

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STRETCH = "key string, sheet int, part int, seq int, n long, crc long, size long, data binary"
WRITTEN = "key string, path string, sheet string, n_rows long, n_bytes long"

#: Bytes of sheet rows that are deflated as one stretch.
STRETCH_BYTES = 1 << 20

# The reflected polynomial of CRC-32; the end of a deflate stream; the largest size of an archive's member without 64-bit fields.
POLYNOMIAL = 0xEDB88320
LAST_BLOCK = b"\x03\x00"
LARGEST = 0xFFFFFFFF


def product(a: int, b: int) -> int:
    """Of two polynomials over GF(2), modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def shift(size: int) -> int:
    """x to the power of the bits of `size` bytes."""
    out, power = 1 << 31, 1 << 23
    while size:
        if size & 1:
            out = product(power, out)
        power = product(power, power)
        size >>= 1
    return out


def joined_crc(first: int, second: int, second_size: int) -> int:
    """The check sum of two stretches in a row, from theirs."""
    return product(shift(second_size), first) ^ second


def deflated(data: bytes) -> bytes:
    """A raw deflate stream that more may follow."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush(zlib.Z_FULL_FLUSH)


def row_xml(values: list) -> str:
    """A sheet's row. Rows and cells carry no addresses, so that a stretch does not depend on what stands before it; None is an empty cell."""

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v in (float("inf"), float("-inf")):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(NOT_XML.sub("", str(v)))}</t></is></c>'
        return f"<c><v>{v!r}</v></c>"

    return "<row>" + "".join(map(cell, values)) + "</row>"


def stretches(sheet: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows (key, part, cells ...): deflated stretches of each key's rows, one batch each."""

    def run(batches):
        key = part = None
        seq, n, size, held = 0, 0, 0, []

        def packed():
            raw = "".join(held).encode()
            return pa.RecordBatch.from_pylist([{"key": key, "sheet": sheet, "part": part, "seq": seq, "n": n, "crc": zlib.crc32(raw), "size": len(raw), "data": deflated(raw)}], schema=ARROW)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                k = columns[0][i]
                if held and (k != key or size >= STRETCH_BYTES):
                    yield packed()
                    seq, n, size, held = seq + 1, 0, 0, []
                key, part = k, columns[1][i]
                held.append(row_xml([columns[j][i] for j in range(2, width + 2)]))
                n, size = n + 1, size + len(held[-1])
        if held:
            yield packed()

    return run


ARROW = pa.schema([("key", pa.string()), ("sheet", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


class Archive:
    """A zip archive written front to back, whose members may come deflated in stretches."""

    def __init__(self, out):
        self.out, self.at, self.entries, self.member = out, 0, [], None

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        self.member = (name.encode(), self.at)
        self.crc = self.raw = 0
        # sizes follow the member (flag 8); names are UTF-8 (flag 2048)
        self.put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x808, 8, 0, 33, 0, 0, 0, len(self.member[0]), 0) + self.member[0])
        self.start = self.at

    def stretch(self, data: bytes, crc: int, size: int) -> None:
        self.put(data)
        self.crc, self.raw = joined_crc(self.crc, crc, size), self.raw + size

    def text(self, text: str) -> None:
        raw = text.encode()
        self.stretch(deflated(raw), zlib.crc32(raw), len(raw))

    def close(self) -> None:
        self.put(LAST_BLOCK)
        packed = self.at - self.start
        if max(self.raw, self.at) > LARGEST:
            raise ValueError("too much text for a workbook; write parquet")
        self.put(struct.pack("<IIII", 0x08074B50, self.crc, packed, self.raw))
        self.entries.append((*self.member, self.crc, packed, self.raw))

    def finish(self) -> None:
        start = self.at
        for name, at, crc, packed, raw in self.entries:
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0x808, 8, 0, 33, crc, packed, raw, len(name), 0, 0, 0, 0, 0, at) + name)
        self.put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, len(self.entries), len(self.entries), self.at - start, start, 0))


class Workbook:
    """One workbook being written; its stretches come in order of sheets."""

    def __init__(self, out, heads: list[tuple[str, list[str]]]):
        self.archive, self.heads, self.next, self.counts = Archive(out), heads, 0, [0] * len(heads)
        for name, text in workbook_frame([n for n, _ in heads], MAIN[1:-1], REL).items():
            self.archive.open(name)
            self.archive.text(text)
            self.archive.close()

    def until(self, sheet: int) -> None:
        """Ends the sheet at hand and begins all up to this one."""
        while self.next <= sheet:
            self.end()
            self.archive.open(f"xl/worksheets/sheet{self.next + 1}.xml")
            self.archive.text(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>' + row_xml(self.heads[self.next][1]))
            self.next += 1

    def end(self) -> None:
        if self.next:
            self.archive.text("</sheetData></worksheet>")
            self.archive.close()

    def add(self, sheet: int, n: int, crc: int, size: int, data: bytes) -> None:
        self.until(sheet)
        self.counts[sheet] += n
        if self.counts[sheet] >= SHEET_ROWS:
            raise ValueError("too many rows for a sheet; write parquet")
        self.archive.stretch(data, crc, size)

    def finish(self) -> None:
        self.until(len(self.heads) - 1)
        self.end()
        self.archive.finish()


def assembled(folder: str, heads: list[tuple[str, list[str]]], name: Callable[[str], str]):
    """Of stretches sorted by key, sheet, part and place: the workbooks, written one after the other. A file gets its name when it is whole, so a lost task's work is not seen."""

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/_parts", recursive=True)
        key = book = out = None

        def done():
            book.finish()
            out.close()
            files.move(part, f"{root}/{name(key)}")
            rows = [{"key": key, "path": f"{folder}/{name(key)}", "sheet": h, "n_rows": n, "n_bytes": book.archive.at} for (h, _), n in zip(heads, book.counts, strict=True)]
            return pa.RecordBatch.from_pylist(rows, schema=LISTED)

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if book:
                        yield done()
                    key, part = r["key"], f"{root}/_parts/{uuid.uuid4().hex}"
                    out = files.open_output_stream(part)
                    book = Workbook(out, heads)
                book.add(r["sheet"], r["n"], r["crc"], r["size"], r["data"])
        if book:
            yield done()

    return run


LISTED = pa.schema([("key", pa.string()), ("path", pa.string()), ("sheet", pa.string()), ("n_rows", pa.int64()), ("n_bytes", pa.int64())])


def file_name(key: str) -> str:
    """A key as a file's name; what may not stand in one is spelt in hex, so different keys have different names."""
    return "".join(c if c.isalnum() or c in "-_." and key.strip(".") else f"%{ord(c):X}" for c in key) + ".xlsx"


def write_workbooks(sheets: dict[str, tuple[DataFrame, list[str]]], key: str, folder: str, name: Callable[[str], str] = file_name) -> DataFrame:
    """Writes a workbook for each value of the key column, with all the sheets (title: rows and their order; a sheet without rows of a key has its header alone) into a folder that every
    executor sees. Rows of equal order may come in any order among themselves; rows without a key are in none. Returns (key, path, sheet, n_rows, n_bytes) of what was written.

    A sheet of more rows than one can hold, or a file above 4 GB, is a ValueError. No rows at all give no file. Other columns than numbers and truth values are written as Spark spells them as text."""
    if not sheets:
        raise ValueError("a workbook needs a sheet")
    spark = next(iter(sheets.values()))[0].sparkSession
    heads, parts = [], []
    for k, (title, (df, order)) in enumerate(sheets.items()):
        names = [c for c in df.columns if c != key]
        heads.append((title, names))
        kinds = dict(df.dtypes)
        plain = {c: F.col(f"`{c}`") if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") else F.col(f"`{c}`").cast("string") for c in names}
        by = [f"`{c}`" for c in order]
        # names of their own, so that no two columns clash
        given = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("__k"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(by)], *[plain[c].alias(f"__c{i}") for i, c in enumerate(names)])
        ranks = ["__k", *[f"__o{i}" for i in range(len(by))]]
        dealt = given.repartitionByRange(*ranks).sortWithinPartitions(*ranks)
        shown = dealt.select("__k", F.spark_partition_id().alias("__p"), *[f"__c{i}" for i in range(len(names))])
        parts.append(shown.mapInArrow(stretches(k, len(names)), STRETCH))
    every = reduce(DataFrame.unionByName, parts)
    whole = every.repartition("key").sortWithinPartitions("key", "sheet", "part", "seq")
    listed = f"{folder}/_written/{uuid.uuid4().hex}"
    whole.mapInArrow(assembled(folder, heads, name), WRITTEN).write.parquet(listed)
    return spark.read.parquet(listed)
