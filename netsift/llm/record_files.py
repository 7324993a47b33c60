"""Token ids in length-delimited binary record files.

Layout of ``part-<k>-<attempt>.rec``, little endian, one frame per document in ascending doc_id order:

    u64 length | u32 masked checksum of the length | payload | u32 masked checksum of the payload

The payload is u8 flags (1: the doc_id is null; 2: ids of two bytes), i64 doc_id, then the ids, as u16 if
all of them are below 65,536 and as u32 else. Checksums are CRC-32,
masked as ((crc >> 15 | crc << 17) + 0xa282ead8), so a checksum stored among data it covers stays
harmless. ``.idx`` beside it is the offset index for shuffled reads: u64 offset and u64 length of each
frame's payload, again little endian.

A task writes its own pair of files under a name of its own and only reports them; the reported files
make the manifest, a small table. A task that is lost and run again writes new files, those of the lost
attempt are in no manifest. Files go through the file system of the folder's address.
"""

from __future__ import annotations

import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.llm.common import docs_of
from netsift.session import materialize, shared_dir

END_ID = 2
#: Words whose ids a worker process remembers at most; beyond, it starts afresh.
CACHE_WORDS = 900_000
GROUP_CHARS = 8_000_000


class CorruptRecord(ValueError):
    """A frame whose length or payload does not match its checksum."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    short = not len(ids) or int(ids.max()) < 1 << 16
    payload = struct.pack("<Bq", (doc_id is None) | short << 1, doc_id or 0) + ids.astype("<u2" if short else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack("<Bq", payload[:9])
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=9).astype("<u4")
    return (None if flags & 1 else doc_id), ids


def read_frames(stream) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each frame of an open file, in order."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise CorruptRecord("length of a record")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise CorruptRecord("payload of a record")
        yield unpacked(body[:size])


def _open(uri: str):
    from pyarrow import fs

    where = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(where if "://" in where else f"file://{where}")


def encoder_of(path: str) -> WordEncoder:
    """The encoder of this worker process, kept from task to task with the words it has learned."""
    kept = sys.modules.setdefault("netsift_word_encoders", types.ModuleType("netsift_word_encoders")).__dict__
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


class Numbering(dict):
    """Numbers words in order of first sight; new ones are listed."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class WordEncoder:
    """``encode_batch`` of a tokenizer that drops white space and lower-cases, with each distinct word
    encoded once: no token of it crosses ASCII white space, so the ids of a text are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.index = Numbering()
        self.flat, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        got = self.tokenizer.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        at = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(words) + 1))
        self.flat = np.concatenate([self.flat, np.array(got.ids, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + at[1:]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > CACHE_WORDS:
            self.index, self.flat, self.starts = Numbering(), np.empty(0, np.uint32), np.zeros(1, np.int64)
        # ASCII letters are lowered here already, but for texts that may hold a special token
        cut = [(t.encode() if "<|" in t else t.encode().lower()).split() for t in texts]
        numbers = [np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)) for words in cut]
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        starts = self.starts.astype(np.int32)
        sizes = np.diff(starts)
        out = []
        for k in numbers:
            many = sizes[k]
            ends = np.cumsum(many, dtype=np.int32)
            at = np.repeat(starts[k] - ends + many, many)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self.flat[at])
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_records(
    documents: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Encode the whole text of each row (null: empty), append ``end_id`` and write record files, in
    ascending doc_id order over all files (null first, ties by text). Returns the manifest: file (address
    without suffix), records, tokens, start (tokens in all files before), lowest. An empty table writes
    nothing. ``folder`` must be reachable by all executors; unset, it is one of the shared folder."""
    spark = documents.sparkSession
    target = f"{folder or shared_dir(spark) + '/netsift/records'}-{uuid.uuid4().hex}"
    vocabulary = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        data = index = None
        name, offset, records, tokens, lowest = "", 0, 0, 0, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                if data is None:
                    encoder = encoder_of(vocabulary)
                    files, path = _open(target)
                    files.create_dir(path, recursive=True)
                    name, lowest = f"part-{uuid.uuid4().hex}", ids[0]
                    data = files.open_output_stream(f"{path}/{name}.rec")
                    index = files.open_output_stream(f"{path}/{name}.idx")
                group, chars = [], 0
                while at + len(group) < len(ids) and (not group or chars < GROUP_CHARS):
                    group.append(texts[at + len(group)].as_py() or "")
                    chars += len(group[-1])
                for doc_id, got in zip(ids[at : at + len(group)], encoder.encode(group), strict=True):
                    framed = frame(doc_id, np.append(got, np.uint32(end_id)))
                    data.write(framed)
                    index.write(struct.pack("<QQ", offset + 12, len(framed) - 16))
                    offset += len(framed)
                    records += 1
                    tokens += len(got) + 1
                at += len(group)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": f"{target}/{name}", "records": records, "tokens": tokens, "lowest": lowest}],
                schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("lowest", pa.int64())]),
            )

    rows = docs_of(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = materialize(
        ordered.mapInArrow(write, "file string, records bigint, tokens bigint, lowest bigint"), "record-files"
    )
    # one row per file: equal ids share a file, so the lowest id orders the files
    before = Window.orderBy(F.col("lowest").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each record of the files of a manifest; ids are left
    out on request."""

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in frames:
            for name, start in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                files, path = _open(f"{name}.rec")
                with files.open_input_stream(path, buffer_size=1 << 20) as stream:
                    rows: list = []
                    held = 0
                    for doc_id, ids in read_frames(stream):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids), ids if with_ids else None))
                        start += len(ids)
                        held += 4 * len(ids) if with_ids else 64
                        if held > 8_000_000:
                            yield _batch(rows, with_ids)
                            rows, held = [], 0
                    yield _batch(rows, with_ids)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "start").repartition(spread, "file")
    return files.mapInArrow(read, schema)


def _batch(rows: list, with_ids: bool) -> pa.RecordBatch:
    doc_id, start, n, crc, ids = zip(*rows, strict=True) if rows else ((),) * 5
    columns = [pa.array(c, pa.int64()) for c in (doc_id, start, n, crc)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if with_ids:
        offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        flat = np.concatenate(ids).view("<i4") if ids else np.empty(0, np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def read_at(name: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by place, through the offset index."""
    files, path = _open(name)
    table = np.frombuffer(files.open_input_stream(f"{path}.idx").read(), "<u8").reshape(-1, 2)
    out = []
    with files.open_input_file(f"{path}.rec") as data:
        for k in places:
            offset, size = (int(x) for x in table[k])
            data.seek(offset)
            body = data.read(size + 4)
            if masked(body[:size]) != struct.unpack("<I", body[size:])[0]:
                raise CorruptRecord("payload of a record")
            out.append(unpacked(body[:size]))
    return out
