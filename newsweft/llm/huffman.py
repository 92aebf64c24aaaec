"""Token ids in files of canonical, length-limited Huffman codes.

A file of the format is a Parquet table of independent blocks. A block holds whole documents in ascending order: their
ids and lengths, the code bits of their tokens from a byte on, and the bit offset of every 256th token of each. Beside the blocks stands the
code book: the code length of each token id, from which the codes follow. Blocks are decoded with one table look-up
for each token; all stretches between the offsets of many blocks are decoded side by side.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweft.llm.seeds import LAST
from newsweft.llm.tokens import encoded, with_end
from newsweft.llm.units import SLICE_BYTES, slices
from newsweft.session import ensure_checkpoint_dir

#: Tokens of a block (whole documents, so the last one may go beyond), tokens from one offset to the next, bits of the longest code.
BLOCK_TOKENS, STRETCH, MOST_BITS = 65_536, 256, 17
TOGETHER = 16

BLOCKS = "file int, block int, tokens_before long, tokens long, doc_ids binary, lengths binary, offsets binary, bits binary"


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of each symbol's code: the best code without one over ``most`` bits, by package-merge; 0 if it never occurs."""
    out = np.zeros(len(counts), np.uint8)
    used = np.nonzero(counts)[0]
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    most = max(most, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    levels = [(weight, np.arange(len(used)))]
    # Each round pairs what is there and adds the single symbols again; pairs are numbered after the symbols.
    for _ in range(most - 1):
        value, _ = levels[-1]
        pairs = value[: len(value) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, pairs])
        order = np.argsort(merged, kind="stable")
        levels.append((merged[order], order))
    depth = np.zeros(len(used), np.int64)
    take = 2 * len(used) - 2
    for _, order in reversed(levels):
        chosen = order[:take]
        depth[chosen[chosen < len(used)]] += 1
        take = 2 * int((chosen >= len(used)).sum())
    out[used] = depth
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in ascending order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.nonzero(lengths)[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    if len(order):
        top = int(lengths.max())
        room = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(room)[:-1]]).astype(np.uint64)
        codes[order] = (start >> (top - lengths[order]).astype(np.uint64)).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and bits of every string of as many bits as the longest code has."""
    top = int(lengths.max()) if len(lengths) else 0
    used = np.nonzero(lengths)[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (top - lengths[order].astype(np.int64))
    size = 1 << top
    symbol, bits = np.zeros(size, np.uint32), np.ones(size, np.int64)
    filled = int(room.sum())
    symbol[:filled] = np.repeat(order, room)
    bits[:filled] = np.repeat(lengths[order], room)
    return symbol, bits, top


def to_bits(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Code bits of texts, each from a byte on, the first bit highest: the bytes, where each text's begin, the bit offset of
    every stretch from the first bit of its text, and the first stretch of each text."""
    length = lengths[ids].astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(length)])
    byte_at = np.concatenate([[0], np.cumsum((np.diff(sums[at]) + 7) // 8)])
    size = np.diff(at)
    offset = sums[:-1] + np.repeat(8 * byte_at[:-1] - sums[at[:-1]], size)
    word = offset >> 5
    placed = codes[ids].astype(np.uint64) << (64 - (offset & 31) - length).astype(np.uint64)
    words = int(byte_at[-1]) // 4 + 3
    filled = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    stretches = -(-size // STRETCH)
    stretch_at = np.concatenate([[0], np.cumsum(stretches)])
    text = np.repeat(np.arange(len(size)), stretches)
    token = at[text] + (np.arange(len(text)) - stretch_at[text]) * STRETCH
    return filled.astype(">u4").tobytes()[: int(byte_at[-1])], byte_at, offset[token] - 8 * byte_at[text], stretch_at


def from_bits(blocks: list[tuple[np.ndarray, np.ndarray, bytes]], table: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """Ids of the blocks, each given by the tokens of its stretches, their bit offsets and the bits."""
    symbol, bits, top = table
    data = np.frombuffer(b"".join(b + bytes(8) for _, _, b in blocks), np.uint8).astype(np.uint32)
    windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    first_bit = 8 * np.cumsum([0, *(len(b) + 8 for _, _, b in blocks)])[:-1]
    at = np.concatenate([o.astype(np.int64) + f for (_, o, _), f in zip(blocks, first_bit, strict=True)])
    rows = np.cumsum([0, *(len(o) for _, o, _ in blocks)])
    out = np.zeros((len(at), STRETCH), np.uint32)
    mask = np.uint32((1 << top) - 1)
    last = len(windows) - 1
    for k in range(STRETCH):
        seen = (windows[np.minimum(at >> 3, last)] >> (32 - top - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbol[seen]
        at += bits[seen]
    real = [np.arange(STRETCH)[None, :] < n[:, None] for n, _, _ in blocks]
    return [out[a:b][r] for r, a, b in zip(real, rows[:-1], rows[1:], strict=True)]


def stretch_sizes(sizes: np.ndarray) -> np.ndarray:
    """Tokens of each stretch of texts of these sizes."""
    number = -(-sizes // STRETCH)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    return np.minimum(STRETCH, np.repeat(sizes, number) - place * STRETCH)


def token_rows(docs: DataFrame, tokenizer: str, keeps_space: bool, end: int, size: int) -> DataFrame:
    """``doc_id`` (a null counts as the last) and the token ids of each whole text with ``end`` after them, 32 bits each.

    After its texts each task gives one side row of ``used`` ids and how often it met each (``times``), so nothing has to be read
    again to be counted.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            own = batch.column("doc_id")
            for i, j, ids, at in encoded(batch.column("text"), tokenizer, keeps_space):
                ids, at = with_end(ids, at, end)
                found += np.bincount(ids, minlength=size)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                none = pa.nulls(j - i, pa.binary())
                yield pa.RecordBatch.from_arrays([own.slice(i, j - i), held.cast(pa.binary()), none, none], names=["doc_id", "ids", "used", "times"])
        used = np.nonzero(found)[0]
        if len(used):
            side = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in (used.astype("<u4"), found[used].astype("<i8")))]
            yield pa.RecordBatch.from_arrays(side, names=["doc_id", "ids", "used", "times"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(encode, "doc_id long, ids binary, used binary, times binary")


def count_ids(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs, from the side rows; the driver gets one number for each id of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            for used, times in zip(batch.column("used").to_pylist(), batch.column("times").to_pylist(), strict=True):
                found[np.frombuffer(used, "<u4")] += np.frombuffer(times, "<i8")
        at = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    side = rows.filter("used IS NOT NULL").select("used", "times")
    for row in side.mapInArrow(add, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write_ids(rows: DataFrame, path: str, size: int) -> None:
    """Writes rows of ``token_rows`` as files of the format, in ascending order of ``doc_id``."""
    spark = rows.sparkSession
    lengths = code_lengths(count_ids(rows, size))
    rows = rows.filter("used IS NULL").select("doc_id", "ids")
    codes = canonical(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/book")
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(*binary(batch.column("ids")), SLICE_BYTES):
                bits, byte_at, offsets, stretch_at = to_bits(data.view("<u4"), at // 4, codes, lengths)
                cut = lambda raw, places: pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at) // 4), cut(offsets.astype("<u4").tobytes(), stretch_at * 4), cut(bits, byte_at)],
                    names=["doc_id", "n", "offsets", "bits"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before, held, tokens = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            base = np.cumsum([0, *(len(r["bits"]) for r in held)])
            offsets = np.concatenate([np.frombuffer(r["offsets"], "<u4") + 8 * b for r, b in zip(held, base, strict=False)])
            row = {
                "file": held[0]["file"], "block": block, "tokens_before": before, "tokens": tokens, "doc_ids": np.array([r["doc_id"] for r in held], "<i8").tobytes(),
                "lengths": np.array([r["n"] for r in held], "<u4").tobytes(), "offsets": offsets.astype("<u4").tobytes(), "bits": b"".join(r["bits"] for r in held),
            }
            return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.int32()), ("block", pa.int32()), ("tokens_before", pa.int64()), ("tokens", pa.int64()), *((c, pa.binary()) for c in ("doc_ids", "lengths", "offsets", "bits"))]))

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                tokens += row["n"]
                if tokens >= BLOCK_TOKENS:
                    yield close()
                    block, before, held, tokens = block + 1, before + tokens, [], 0
        if held:
            yield close()

    # The ranges are found on the ids alone, so nothing is encoded twice; what moves is encoded already.
    bounds = rows.approxQuantile("doc_id", [k / number for k in range(1, number)], 0.1 / number) if number > 1 else []
    bounds = sorted({int(b) for b in bounds})
    coded = rows.mapInArrow(encode, "doc_id long, n long, offsets binary, bits binary")
    file = F.lit(0)
    if bounds:
        file = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b <= F.col("doc_id")))
    ranges = coded.withColumn("file", file.cast("int")).repartition(number, "file").sortWithinPartitions("file", "doc_id", "bits")
    written = ranges.mapInArrow(by_file(gather), BLOCKS)
    written.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def by_file(gather: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Runs ``gather`` over the rows of each file by themselves, where a task has several in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (
            (int(f), batch.slice(i, j - i))
            for batch in batches
            for files in [batch.column("file").to_numpy()]
            for cuts in [[0, *(np.nonzero(np.diff(files))[0] + 1).tolist(), len(files)]]
            for i, j in zip(cuts, cuts[1:], strict=False)
            if i < j
            for f in [files[i]]
        )
        for _, group in itertools.groupby(pieces, key=lambda x: x[0]):
            yield from gather(b for _, b in group)

    return run


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each value begins."""
    wide = column.cast(pa.large_binary())
    _, at, data = wide.buffers()
    at = np.frombuffer(at, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before), ``n_tokens`` and ``ids``, decoded from the files."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/book").head().lengths), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(k, TOGETHER).to_pylist()
                found = from_bits([(stretch_sizes(np.frombuffer(r["lengths"], "<u4").astype(np.int64)), np.frombuffer(r["offsets"], "<u4"), r["bits"]) for r in rows], table)
                for r, ids in zip(rows, found, strict=True):
                    sizes = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(sizes), r["file"], np.int32)), pa.array(np.frombuffer(r["doc_ids"], "<i8")), pa.array(r["tokens_before"] + at[:-1]), pa.array(sizes), held.cast(pa.binary())],
                        names=["file", "doc_id", "inside", "n_tokens", "ids"],
                    )

    docs = blocks.mapInArrow(decode, "file int, doc_id long, inside long, n_tokens long, ids binary")
    # One row for each file, and there are no more files than the shuffle partitions of the session that wrote them.
    before = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = blocks.groupBy("file").agg(F.sum("tokens").alias("tokens")).select("file", F.coalesce(before, F.lit(0)).alias("file_start"))
    return docs.join(F.broadcast(files), "file").select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids"
    )


def huffman_store(docs: DataFrame, tokenizer: str, size: int = 50_257, keeps_space: bool = True, end: int = 2, path: str | None = None) -> DataFrame:
    """Encodes every text, writes the ids, reads them back.

    A null text is empty and gives the end id alone; a null ``doc_id`` comes last; rows that share a ``doc_id`` stand side by side,
    in the order of their ids. An empty table gives no rows. Columns besides ``doc_id`` and ``text`` are not looked at.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = f"{path}/rows"
    token_rows(docs, tokenizer, keeps_space, end, size).write.option("compression", "zstd").parquet(rows)
    write_ids(spark.read.parquet(rows), path, size)
    return read_ids(spark, path)


def checksum(ids: DataFrame) -> DataFrame:
    """CRC-32 of the ids as unsigned 32-bit little-endian numbers."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
