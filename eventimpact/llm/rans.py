"""Binary token files: a static range asymmetric numeral system with interleaved lanes in independent blocks."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import cut_ids, library_coder
from .common import file_system, partitions, slices, tidy, utf8, written

MAGIC = b"RANSTOK1"
SCALE, LANES, STEPS = 20, 64, 256
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
CHECKPOINT = np.dtype([("offset", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("payload_crc", "<u4"), ("ids_crc", "<u4")])


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2 ** SCALE, every symbol at least 1."""
    total = 1 << SCALE
    f = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    left = total - f.sum()
    order = np.argsort(-f, kind="stable")
    if left >= 0:
        f[order[0]] += left
    for i in order:
        if left >= 0:
            break
        less = min(f[i] - 1, -left)
        f[i] -= less
        left += less
    return f


def encode_blocks(ids: np.ndarray, symbols: np.ndarray, freq: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(payload of every block of BLOCK ids, words in each). A payload is the lanes' end states, then the words that
    the lanes gave out, in the order in which a decoder asks for them."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, symbols[freq.argmax()], ids.dtype)
    padded[:len(ids)] = ids
    number = np.zeros(int(symbols[-1]) + 1, np.int32)
    number[symbols] = np.arange(len(symbols))
    sym = number[padded].reshape(n, STEPS, LANES)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    x = np.full((n, LANES), LOW, np.uint64)
    words, blocks = [], []
    shift = np.uint64(63 - SCALE)
    for t in range(STEPS - 1, -1, -1):
        f = freq[sym[:, t]]
        full = x >> shift >= f
        if full.any():
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            blocks.append(np.nonzero(full)[0])
            x[full] >>= np.uint64(32)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + start[sym[:, t]]
    words, blocks = words[::-1], blocks[::-1]
    word = np.concatenate(words) if words else np.zeros(0, "<u4")
    block = np.concatenate(blocks) if blocks else np.zeros(0, np.int64)
    word = word[np.argsort(block, kind="stable")]
    count = np.bincount(block, minlength=n)
    ends = np.cumsum(count)
    return [x[b].astype("<u8").tobytes() + word[ends[b] - count[b]:ends[b]].tobytes() for b in range(n)], count


def decode_blocks(payloads: list[bytes], symbols: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Ids (with the padding of a last block) of any blocks of a file."""
    n = len(payloads)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    slot_symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    x = np.stack([np.frombuffer(p, "<u8", LANES) for p in payloads]).astype(np.uint64)
    word = np.concatenate([np.frombuffer(p, "<u4", offset=8 * LANES) for p in payloads]).astype(np.uint64)
    at = np.cumsum([0] + [(len(p) - 8 * LANES) // 4 for p in payloads])[:-1]
    out = np.empty((n, STEPS, LANES), np.int32)
    f64, s64 = freq.astype(np.uint64), start.astype(np.uint64)
    for t in range(STEPS):
        slot = x & np.uint64((1 << SCALE) - 1)
        s = slot_symbol[slot]
        out[:, t] = s
        x = f64[s] * (x >> np.uint64(SCALE)) + slot - s64[s]
        need = x < LOW
        if need.any():
            got = at[:, None] + np.cumsum(need, 1) - 1
            x[need] = (x[need] << np.uint64(32)) | word[got[need]]
            at = at + need.sum(1)
    return symbols[out.reshape(-1)]


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: the blocks, then the tables (shared frequencies, documents, checkpoints), then a footer of the
    tables' size and checksum."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    freq = frequencies(counts) if len(ids) else np.zeros(0, np.int64)
    payloads, words = encode_blocks(ids, symbols, freq) if len(ids) else ([], np.zeros(0, np.int64))
    marks = np.zeros(len(payloads), CHECKPOINT)
    offset = len(MAGIC)
    for b, p in enumerate(payloads):
        own = ids[b * BLOCK:(b + 1) * BLOCK]
        marks[b] = (offset, words[b], len(own), zlib.crc32(p), zlib.crc32(own.astype("<u4").tobytes()))
        offset += len(p)
    known = np.array([d is not None for d in doc_ids], "u1")
    names = np.array([d or 0 for d in doc_ids], "<i8")
    tables = b"".join([struct.pack("<QQQ", len(symbols), len(doc_ids), len(payloads)), symbols.astype("<u4").tobytes(),
                       freq.astype("<u4").tobytes(), known.tobytes(), names.tobytes(), lengths.astype("<u8").tobytes(),
                       marks.tobytes()])
    return b"".join([MAGIC, *payloads, tables, struct.pack("<QI", len(tables), zlib.crc32(tables)), MAGIC])


class TokenFile:
    """Random access to one file: ``ids(first, end)`` decodes only the blocks that hold these ids."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size, foot = self.file.size(), struct.calcsize("<QI") + len(MAGIC)
        tail = self.file.read_at(foot, size - foot)
        n, crc = struct.unpack_from("<QI", tail)
        tables = self.file.read_at(n, size - foot - n)
        if tail[-len(MAGIC):] != MAGIC or zlib.crc32(tables) != crc:
            raise ValueError(f"damaged token file {uri}")
        symbols, docs, blocks = struct.unpack_from("<QQQ", tables)
        at = 24

        def take(kind, count):
            nonlocal at
            got = np.frombuffer(tables, kind, count, at)
            at += got.nbytes
            return got
        self.symbols, self.freq = take("<u4", symbols), take("<u4", symbols).astype(np.int64)
        self.known, self.doc_ids, self.lengths = take("u1", docs), take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.marks = take(CHECKPOINT, blocks)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, first: int, end: int) -> np.ndarray:
        if end <= first:
            return np.zeros(0, np.uint32)
        lo, hi = first // BLOCK, -(-end // BLOCK)
        marks = self.marks[lo:hi]
        begin = int(marks["offset"][0])
        sizes = 8 * LANES + 4 * marks["words"].astype(np.int64)
        raw, at, payloads = self.file.read_at(int(sizes.sum()), begin), 0, []
        for m, n in zip(marks, sizes):
            payloads.append(raw[at:at + n])
            at += n
            if zlib.crc32(payloads[-1]) != m["payload_crc"]:
                raise ValueError("damaged block")
        got = decode_blocks(payloads, self.symbols, self.freq)
        for b, m in enumerate(marks):
            if zlib.crc32(got[b * BLOCK:b * BLOCK + int(m["ids"])].astype("<u4").tobytes()) != m["ids_crc"]:
                raise ValueError("block decodes to other ids")
        return got[first - lo * BLOCK:end - lo * BLOCK]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, ids_per_file: int = 1 << 22) -> DataFrame:
    """Encodes every whole text (null: empty) with its end id and writes the ids in ascending order of ``id_col``
    (an integer; nulls first, equal ids in the order of their texts). Returns the manifest: path, documents, ids
    and ``base``, the ids in all files before.

    A range of ids is a task, and a task closes a file after ``ids_per_file`` ids, so that its memory is bounded
    (a longer document makes a longer file). Only files in the manifest count: what a lost attempt wrote has
    another name.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id", "text")

    def write(parts):
        coder = library_coder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        task, seq = TaskContext.get().partitionId(), 0
        names, sizes, held, n = [], [], [], 0

        def close():
            nonlocal names, sizes, held, n, seq
            name = f"{task:07d}-{seq:05d}-{uuid.uuid4().hex}.rans"
            with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(encode_file(names, np.array(sizes, np.int64), np.frombuffer(b"".join(held), "<u4")))
            row = [[task], [seq], [f"{folder}/{name}"], [len(names)], [n]]
            names, sizes, held, n, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                              names=["part", "seq", "path", "docs", "ids"])

        for b in parts:
            for i, j in slices(utf8(b.column(1))[1], 1 << 20):
                got = cut_ids(*coder(*utf8(b.column(1).slice(i, j - i))))
                for name, ids in zip(b.column(0).slice(i, j - i).to_pylist(), got):
                    names.append(name)
                    sizes.append(len(ids) // 4 + 1)
                    held.append(ids + end)
                    n += sizes[-1]
                    if n >= ids_per_file:
                        yield close()
        if names:
            yield close()

    files = written(src.mapInArrow(tidy(write), "part int, seq int, path string, docs long, ids long"), "manifest")
    upto = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0))  # one row a file
    return files.withColumn("base", upto - F.col("ids")).select("path", "docs", "ids", "base")


def read_tokens(manifest: DataFrame, id_out: str = "doc_id", span: int = 1 << 20) -> DataFrame:
    """Documents of the files: id, ``start`` (ids of all documents before), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit). Spans of a file are decoded in parallel through its checkpoints; checksums are verified."""
    spans = manifest.select("path", "base", F.explode(F.sequence(F.lit(0), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(span))).alias("lo"))
    spans = spans.repartition(partitions(manifest.sparkSession), "path", "lo")

    def decode(parts):
        for b in parts:
            for path, base, lo in zip(*(c.to_pylist() for c in b.columns)):
                f = TokenFile(path)
                first, end = np.searchsorted(f.starts[:-1], [lo, lo + span])
                while first < end:                      # documents of about 256 thousand ids at a time
                    stop = min(max(int(np.searchsorted(f.starts, f.starts[first] + (1 << 18), "right")) - 1, first + 1), int(end))
                    ids = f.ids(int(f.starts[first]), int(f.starts[stop])).astype("<u4")
                    cut = f.starts[first:stop + 1] - f.starts[first]
                    names = [int(d) if k else None for d, k in zip(f.doc_ids[first:stop], f.known[first:stop])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.int64()), pa.array(base + f.starts[first:stop]), pa.array(f.lengths[first:stop]),
                        pa.array([ids[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())],
                        names=[id_out, "start", "n_tokens", "ids"])
                    first = stop

    return spans.mapInArrow(tidy(decode), f"`{id_out}` long, start long, n_tokens long, ids binary")
