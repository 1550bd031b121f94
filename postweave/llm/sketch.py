"""Count-min sketches of partitions, merged cell by cell; only cells of 2 or more come back.

A sketch of fixed size either grows too full for the corpus or must be broadcast at the corpus's
size. Here each chunk of documents makes its own sketch and sends the cells that it touches, with
their counts, as plain rows; a shuffle by block of cells merges the chunks' sketches by adding
counts, and the cells that reached 2 go back to the chunks that named them. Rows are at most the
items of the corpus, whatever the number of chunks or tasks; a cell that every chunk has is one row
a chunk; sums are spillable windows; nothing is collected or broadcast.

The sketch is blocked: an item's cells in all depth rows lie in one block of 2^16 cells a row, so
that an item travels once. An estimate is the least of the item's cells, never below the true count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, arrow_limits, partitions
from .kernels import U64, mix, pieces, text_buffer

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
CHUNK_SCHEMA = "chunk_id bigint, n_bytes bigint, doc_ids binary, no_id binary, offsets binary, body binary"
CELL_SCHEMA = "cell bigint, chunk_id bigint, n int"
#: Bits of a position within a block, and of the number of a block.
POSITION, BLOCK = 16, 31
#: Chunks that one task may make; chunk_id is its number and the chunk's.
MADE_BITS = 24


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """Columns (arrays or sequences) as a batch of a DDL schema of plain types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def int_list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """The list of integers in a column's row; empty for null."""
    found = batch.column(batch.schema.names.index(name))[row].values
    return np.empty(0, np.int64) if found is None else found.to_numpy(zero_copy_only=False)


class Chunk:
    """Documents' ids (0 where no_id), texts one after another, and their offsets."""

    def __init__(self, doc_ids: np.ndarray, no_id: np.ndarray, offsets: np.ndarray, data: np.ndarray):
        self.doc_ids, self.no_id, self.offsets, self.data = doc_ids, no_id, offsets, data

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int) -> Chunk:
        own = {n: batch.column(batch.schema.names.index(n))[row].as_py() for n in ("doc_ids", "no_id", "offsets", "body")}
        return cls(np.frombuffer(own["doc_ids"], np.int64), np.frombuffer(own["no_id"], bool), np.frombuffer(own["offsets"], np.int64), unsqueeze(own["body"], np.uint8))

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=self.no_id)


def pack_chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0

    def out(held: list) -> pa.RecordBatch:
        nonlocal made
        ids, no_id, offsets, data = zip(*held)
        data = np.concatenate(data)
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for o in offsets]))]).astype(np.int64)
        row = ((task << MADE_BITS) + made, len(data), np.concatenate(ids).tobytes(), np.concatenate(no_id).tobytes(), at.tobytes(), squeeze(data))
        made += 1
        if made >> MADE_BITS:
            raise ValueError("too many chunks in one task: read the documents in more partitions")
        return batch_of(CHUNK_SCHEMA, [[x] for x in row])

    held, n = [], 0
    for batch in batches:
        ids, no_id = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in pieces(offsets, limit):
            size = int(offsets[hi] - offsets[lo])
            if held and n + size > limit:
                yield out(held)
                held, n = [], 0
            held.append((ids[lo:hi], no_id[lo:hi], offsets[lo: hi + 1] - offsets[lo], data[offsets[lo]: offsets[hi]]))
            n += size
    if held:
        yield out(held)


class Layout:
    """depth rows of cells, cut into blocks; a packed cell is its block's number and a position
    in each row."""

    def __init__(self, depth: int, blocks: int):
        if not 1 <= depth <= 2:
            raise ValueError("one or two rows of cells")
        self.depth, self.blocks = depth, min(blocks, 1 << BLOCK)

    def pack(self, items: np.ndarray) -> np.ndarray:
        """The packed cell of each item, as signed integers that aren't negative."""
        h, spot = mix(items ^ U64(0xA5A5)), mix(items ^ U64(0x5A5A5A))
        block = (h >> U64(64 - BLOCK)) * U64(self.blocks) >> U64(BLOCK)
        low = spot >> U64(64 - POSITION * self.depth)
        return (block << U64(POSITION * self.depth) | low).astype(np.int64)

    def merged(self, sent: DataFrame) -> DataFrame:
        """sent (CELL_SCHEMA) with estimate, where it is 2 or more: in each row the counts of all
        chunks for the cell are added up; the least of these sums counts."""
        block = F.shiftright("cell", POSITION * self.depth)
        dealt = sent.repartition(block).withColumn("block", block)
        sums = []
        for r in range(self.depth):
            place = F.shiftright("cell", POSITION * r).bitwiseAND(F.lit((1 << POSITION) - 1))
            dealt = dealt.withColumn(f"place_{r}", place)
            dealt = dealt.withColumn(f"sum_{r}", F.sum("n").over(W.partitionBy("block", f"place_{r}")))
            sums.append(F.col(f"sum_{r}"))
        estimate = F.least(*sums) if len(sums) > 1 else sums[0]
        return dealt.filter(estimate >= 2).select("chunk_id", "cell", estimate.alias("estimate"))

    def estimates(self, items: np.ndarray, cells: np.ndarray, estimates: np.ndarray) -> np.ndarray:
        """The estimate of each item, from the cells that came back; 1 for all others."""
        if not len(cells) or not len(items):
            return np.ones(len(items), np.int64)
        order = np.argsort(cells)
        cells, own = cells[order], self.pack(items)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        return np.where(cells[at] == own, estimates[order][at], 1)


class Exchange:
    """The chunks of a corpus, bucketed by chunk so that answers join them without moving texts."""

    def __init__(self, spark: SparkSession, docs: DataFrame, name: str, chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.scratch = spark, Scratch(spark, name)
        arrow_limits(spark)
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.chunks = self.scratch.bucketed(rows.mapInArrow(lambda b: pack_chunks(b, chunk_bytes), CHUNK_SCHEMA), "chunks", partitions(spark), "chunk_id")
        self.n_bytes = self.chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    def estimate(self, items_of: Callable[[Chunk], np.ndarray], depth: int, share: float, slack_bits: int = 4) -> tuple[DataFrame, Layout]:
        """items_of(chunk) -> 64-bit hashes with repeats, about `share` of its words. Returns
        (chunk_id, cells, estimates), lists of the cells of estimate 2 or more, and the layout.

        The width follows the corpus: 2^slack_bits cells a row for each item."""
        items = int(self.n_bytes // 4 * share)  # words are rarely shorter with their space
        layout = Layout(depth, max(256, items << slack_bits >> POSITION))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    cells, n = np.unique(layout.pack(items_of(Chunk.of(batch, row))), return_counts=True)
                    chunk_id = batch.column(batch.schema.names.index("chunk_id"))[row].as_py()
                    for i in range(0, len(cells), 1 << 17):
                        part = cells[i: i + (1 << 17)]
                        yield batch_of(CELL_SCHEMA, [part, np.full(len(part), chunk_id), n[i: i + (1 << 17)].astype(np.int32)])

        merged = layout.merged(self.chunks.mapInArrow(send, CELL_SCHEMA))
        lists = merged.groupBy("chunk_id").agg(F.collect_list("cell").alias("cells"), F.collect_list("estimate").alias("estimates"))
        return self.scratch.save(lists, "counts"), layout

    def joined(self, *answers: DataFrame) -> DataFrame:
        """Each chunk with the columns of its answers, at most a row a chunk each; only the answers are shuffled."""
        out = self.chunks
        for a in answers:
            out = out.join(a.hint("merge"), "chunk_id", "left")
        return out
