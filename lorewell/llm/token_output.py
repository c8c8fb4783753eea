"""Token-ID files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is zstandard frames one after the other, a skippable frame with the first
and last doc_id of each, and a skippable frame with the seek table: compressed and
decompressed size and the low half of the XXH64 of each frame's content, then the
number of frames, a descriptor and a magic number (the public seekable format).  A
frame's content is, little-endian: u32 n, u32 k, n i64 doc_id (the first k stand for null), n u32
lengths, all u32 ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.llm._shared import scratch_path, small_batches, written
from lorewell.llm._tokens import encoded, tokenizer_path

#: Production tokenizer, end id, zstandard level, and ids after which a frame is closed.
TOKENIZER, END_ID, LEVEL, FRAME_IDS = "word_bpe_49k.json", 1, 3, 1 << 18
# Magic numbers of the seekable format and its descriptor (checksums present).
SEEK_FRAME, SEEK_MAGIC, WITH_CHECKSUMS, RANGE_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x80, 0x184D2A50
#: Written in the place of a null doc_id (nulls come first, so their number tells them from this id).
NULL_ID = -(1 << 63)


class FrameWriter:
    """Collects documents in ascending order and writes frames to an open stream."""

    def __init__(self, out, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.ranges: list[tuple[int, int]] = []
        self.n_docs = self.n_tokens = self.held = self.nulls = 0
        self.docs: list[int] = []
        self.ids: list[np.ndarray] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.nulls += doc_id is None
        self.docs.append(NULL_ID if doc_id is None else doc_id)
        self.ids.append(ids)
        self.held += len(ids)
        self.n_docs += 1
        self.n_tokens += len(ids)
        if self.held >= self.frame_ids:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if not self.docs:
            return
        lengths = np.fromiter(map(len, self.ids), np.uint32, len(self.ids))
        plain = struct.pack("<II", len(self.docs), self.nulls) + np.array(self.docs, "<i8").tobytes() + lengths.astype("<u4").tobytes() + np.concatenate(self.ids).astype("<u4").tobytes()
        frame = self.press.compress(plain)
        self.out.write(frame)
        self.table.append((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.ranges.append((self.docs[0], self.docs[-1]))
        self.docs, self.ids, self.held, self.nulls = [], [], 0, 0

    def close(self) -> None:
        self.flush()
        ranges = b"".join(struct.pack("<qq", *r) for r in self.ranges)
        self.out.write(struct.pack("<II", RANGE_FRAME, len(ranges)) + ranges)
        table = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


def read_frames(source, wanted: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids (null ones masked), lengths and ids of each frame of a random-access file; with `wanted`, only of frames that may hold one of these."""
    import xxhash
    import zstandard

    size = source.size()
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEK_MAGIC or not flags & WITH_CHECKSUMS:
        raise ValueError("no seek table")
    tail = 9 + 12 * count + 8
    source.seek(size - tail - 16 * count)
    ranges = np.frombuffer(source.read(16 * count), "<i8").reshape(-1, 2)
    source.seek(size - tail + 8)
    table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3)
    begin = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
    wish = None if wanted is None else np.unique(np.asarray(list(wanted), np.int64))
    for k in range(count):
        if wish is not None and np.searchsorted(wish, ranges[k, 0]) == np.searchsorted(wish, ranges[k, 1], "right"):
            continue
        source.seek(int(begin[k]))
        plain = zstandard.ZstdDecompressor().decompress(source.read(int(table[k, 0])), max_output_size=int(table[k, 1]))
        if len(plain) != table[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        n, nulls = struct.unpack_from("<II", plain)
        yield np.ma.array(np.frombuffer(plain, "<i8", n, 8), mask=np.arange(n) < nulls), np.frombuffer(plain, "<u4", n, 8 + 8 * n), np.frombuffer(plain, "<u4", offset=8 + 12 * n)


def _open_folder(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def write_token_files(documents: DataFrame, folder: str | None = None, path: str | None = None, end_id: int | None = END_ID, text: str = "text") -> DataFrame:
    """Encodes whole texts and writes them to files in ascending doc_id order.

    Documents are dealt by range of doc_id (equal ids: by a hash of the text), each
    task writes one file under a name of its own, so a repeated task does no harm,
    and only files named in the returned manifest count.  Returns the manifest:
    ordinal (files in order), file, n_docs, n_tokens.  Null and empty texts have the
    end id alone; a null doc_id comes first; repeated rows are repeated documents; a
    very long text is a frame of its own; an empty table gives no files.
    """
    spark, path = documents.sparkSession, path or tokenizer_path(TOKENIZER)
    folder = folder or scratch_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, out, name = None, None, f"{uuid.uuid4().hex}.tokens.zst"
        system, base = _open_folder(folder)
        for batch in batches:
            if writer is None and batch.num_rows:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = FrameWriter(out)
            docs = batch.column("doc_id").to_pylist()
            for i, flat, lengths in encoded(batch.column("text"), path):
                stops = np.cumsum(lengths)
                for k, stop in enumerate(stops.tolist()):
                    ids = flat[stop - lengths[k] : stop]
                    writer.add(docs[i + k], ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"ordinal": [TaskContext.get().partitionId()], "file": [name], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    rows = small_batches(documents).select(documents["doc_id"].cast("long").alias("doc_id"), documents[text].alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    manifest = written(dealt.mapInArrow(write, "ordinal long, file string, n_docs long, n_tokens long"), "token-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, wanted: Iterable[int] | None = None) -> DataFrame:
    """Reads files of a manifest back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A file is a task; its frames are decompressed and checked one at a time.  With
    `wanted` only frames that may hold these documents are decompressed, and start,
    which would need the others, is left out.  The running total is over the manifest, a row for each file.
    """
    n = max(1, manifest.count())
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("ordinal", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wish = None if wanted is None else sorted(set(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, base = _open_folder(row["folder"])
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    start = row["base"]
                    for docs, lengths, ids in read_frames(source, wish):
                        stops = np.cumsum(lengths, dtype=np.int64)
                        begins = stops - lengths
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
                        own = pa.array(docs.data, mask=np.ma.getmaskarray(docs))
                        out = pa.RecordBatch.from_arrays([own, pa.array(start + begins), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(lengths.sum())
                        yield out if wish is None else out.filter(pc.is_in(own, pa.array(wish, pa.int64())))

    out = based.select("folder", "file", "base").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out if wish is None else out.drop("start")


def token_output(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back: the digest of each document as it stands in them.

    Null and empty texts have the end id alone; documents without an id come first;
    equal ids follow one another in the order of a hash of the text; repeated rows are
    repeated documents; an empty table gives no rows.  Returns doc_id, start,
    n_tokens, ids_crc32.
    """
    return read_token_files(write_token_files(documents, path=path))
