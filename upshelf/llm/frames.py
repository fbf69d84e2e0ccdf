"""Operator 8: token ids in independent zstandard frames with a seek table.

A file holds one frame per document (its ids as little-endian uint32, end id
included, with zstandard's own content checksum), then a skippable frame with
the document ids, then the seek table of the public zstandard seekable format:
per frame the compressed size, the size, and the low 32 bits of the content's
XXH64, closed by a footer. A reader seeks to the footer, then to the frames it
wants, and decompresses only those.

The table is range-partitioned and sorted by doc_id, every task writes its
files under a name of its own into the shared folder, and only the files named
by the manifest (written by Spark, so committed whole) exist for a reader: a
task that was lost and run again leaves no trace in it.

Rules: null text counts as empty; every row is written, repeated ids in order
of their text; null ids come first. An empty table gives no file and no rows."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upshelf.llm.bpe import coder
from upshelf.llm.common import parts_for, pick, scratch, small_batches, written

#: Fixed values of the public seekable format.
SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

#: A file is closed once it holds so many bytes.
FILE_BYTES = 128 << 20


def _xxh(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF


def filesystem(path: str):
    """(file system, path in it) for a Hadoop-style path, as pyarrow opens it."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Frames into an open stream."""

    def __init__(self, out, level: int = 3):
        import zstandard
        self.out, self.at, self.ids, self.table = out, 0, [], []
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.pack(raw)
        self.out.write(frame)
        self.ids.append(doc_id)
        self.table.append((len(frame), len(raw), _xxh(raw)))
        self.at += len(frame)

    def close(self) -> None:
        # a null id is marked by a flag byte: any number may be an id
        body = b"".join(struct.pack("<qB", i if i is not None else 0, i is None) for i in self.ids)
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        rows = b"".join(struct.pack("<III", *r) for r in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(rows) + len(foot)) + rows + foot)
        self.out.close()


class FrameReader:
    """Documents of one file; only the frames asked for are read and decompressed."""

    def __init__(self, source):
        import zstandard
        self.f, size = source, source.size()
        self.unpack = zstandard.ZstdDecompressor().decompress
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.table = [struct.unpack("<III", source.read(12)) for _ in range(n)]
        source.seek(size - 9 - 12 * n - 8 - 9 * n)
        ids = [struct.unpack("<qB", source.read(9)) for _ in range(n)]
        self.ids = [None if null else i for i, null in ids]
        self.starts = np.concatenate([[0], np.cumsum([r[0] for r in self.table], dtype=np.int64)]).tolist()

    def frame(self, n: int) -> bytes:
        packed, size, check = self.table[n]
        self.f.seek(self.starts[n])
        raw = self.unpack(self.f.read(packed), max_output_size=size)
        if len(raw) != size or _xxh(raw) != check:
            raise ValueError(f"frame {n} does not match its checksum")
        return raw


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = 0, partitions: int | None = None) -> DataFrame:
    """Write all documents; returns the manifest (file, part, nth, low, n_docs, n_ids, start), one row a file,
    with ``start`` = ids in all files before."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, doc_id="long", text="string")
    ranged = (rows.repartitionByRange(partitions or parts_for(docs), "doc_id")
              .sortWithinPartitions("doc_id", "text"))
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches):
        pieces, _, _ = coder(path)
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        w, name, docs_in, ids_in, nth, low = None, "", 0, 0, 0, None

        def done():
            w.close()
            return pa.RecordBatch.from_pydict({"file": [name], "low": pa.array([low], pa.int64()), "nth": [nth],
                                               "n_docs": [docs_in], "n_ids": [ids_in]})
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w is None:
                    name = f"{uuid.uuid4().hex}.zst"
                    w, docs_in, ids_in, low = FrameWriter(system.open_output_stream(f"{root}/{name}", compression=None)), 0, 0, doc_id
                raw = pieces.ids(text or "") + tail
                w.add(doc_id, raw)
                docs_in, ids_in = docs_in + 1, ids_in + len(raw) // 4
                if w.at >= FILE_BYTES:
                    yield done()
                    w, nth = None, nth + 1
        if w is not None:
            yield done()

    files = ranged.mapInArrow(run, "file string, low long, nth long, n_docs long, n_ids long")
    files = written(files.withColumn("part", F.spark_partition_id()), "frames-manifest")
    # one row a file: the running total is over files, not documents
    before = Window.orderBy(F.asc_nulls_first("part"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) from the files of a manifest; ``wanted`` reads only those documents."""
    return _read(manifest, folder, True, wanted)


def _read(manifest: DataFrame, folder: str, ids: bool, wanted: list[int] | None = None) -> DataFrame:
    spark = manifest.sparkSession
    small_batches(spark)
    pick_ids = None if wanted is None else frozenset(wanted)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches):
        system, root = filesystem(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_file(f"{root}/{name}") as f:
                    r = FrameReader(f)
                    out: list[tuple] = []
                    for n, doc_id in enumerate(r.ids):
                        size = r.table[n][1] // 4
                        if pick_ids is None or doc_id in pick_ids:
                            raw = r.frame(n)
                            out.append((doc_id, start, size, zlib.crc32(raw) & 0xFFFFFFFF,
                                        *[np.frombuffer(raw, "<i4")] * ids))
                        start += size
                        if len(out) == 1000:
                            yield batch(out)
                            out = []
                    yield batch(out)

    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def batch(rows):
        cols = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    files = manifest.select("file", "start")
    return files.repartition(max(1, min(10_000, files.count()))).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write, then read back: (doc_id, start, n_tokens, ids_crc32) of every document."""
    folder = scratch(docs.sparkSession, "frames")
    return _read(write(docs, path, folder), folder, False)

