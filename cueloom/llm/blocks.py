"""Blocks of whole documents: the unit of pre-aggregation before a shuffle.

A block is a run of documents of one task, up to a number of bytes, as one
compressed Arrow payload. An operator first reduces each block to its distinct
keys (lines, anchors, words), so a key that stands in a third of all documents
is shuffled once a block, not once a document; what is decided for a key goes
back to the blocks that hold it, and each block is rewritten on its own.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_batches, written

BLOCK_BYTES = 12 << 20


def pack_rows(batches) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def rows_of(payload: bytes):
    """The block's batches, as they were read."""
    import pyarrow as pa

    return pa.ipc.open_stream(payload)


def runs_of(batches, block_bytes: int):
    """(block, its batches) for each block of the running task, in order."""
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= block_bytes:
            yield (part << 24) + n, held
            n, held, size = n + 1, [], 0
    if held:
        yield (part << 24) + n, held


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block long, payload binary), computed lazily.

    The numbers follow the input's tasks, so use written_blocks() where two
    readers have to agree on them.
    """

    def run(batches):
        import pyarrow as pa

        from .common import trim

        for block, held in runs_of(batches, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack_rows(held)], pa.binary())], ["block", "payload"])
        trim()

    text_batches(docs.sparkSession)
    return docs.mapInArrow(run, "block long, payload binary")


def written_blocks(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return written(blocked(docs, block_bytes), name)


def parts_for(blocks: DataFrame) -> int:
    """Buckets in which the hashes of written blocks meet: as many as shuffle partitions, or one for four blocks."""
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks.count() // 4))


#: Hashes of one block that fall into one bucket: their lanes one after the other, and which of them stand twice in the block.
PIECES = "bucket long, of long, h binary, often binary"
PIECE_BATCH = 4 << 20


def distinct(lanes: list):
    """(lanes of the distinct hashes in order, where each hash went, how often each stands); lanes: uint64 arrays of one length."""
    import numpy as np

    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [x[order] for x in lanes]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lanes])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    return [x[first] for x in lanes], place, np.bincount(place, minlength=int(first.sum()))


def spans(h, parts: int):
    """(bucket, first, end) of runs of ordered hashes; buckets follow the order of the hashes."""
    import numpy as np

    if not len(h):
        return []
    bucket = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[start].tolist(), start.tolist(), [*start[1:].tolist(), len(h)]))


def pieces(block: int, lanes: list, count, parts: int):
    """Batches of PIECES for a block's distinct() hashes."""
    import numpy as np
    import pyarrow as pa

    rows, size = [], 0

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["bucket", "of", "h", "often"])

    for bucket, a, b in spans(lanes[0], parts):
        rows.append((bucket, block, b"".join(x[a:b].tobytes() for x in lanes), np.packbits(count[a:b] > 1).tobytes()))
        size += 8 * len(lanes) * (b - a)
        if size >= PIECE_BATCH:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def twice(found: DataFrame, lanes: int) -> DataFrame:
    """(of, bucket, bits): which hashes of each piece stand twice, in the block or in two. Pieces without any are left out.

    A bucket's hashes are in one task: a share of all hashes, and of one that
    stands in every document 8 * lanes bytes a block.
    """
    import pyarrow as pa

    schema = pa.schema([("of", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        held = [np.frombuffer(x.as_py(), np.uint64).reshape(lanes, -1) for x in group.column("h")]
        _, place, count = distinct([np.concatenate([h[i] for h in held]) for i in range(lanes)])
        sizes = [h.shape[1] for h in held]
        often = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(group.column("often"), sizes)])
        more = count > 1
        more[place[often]] = True
        hit, out, at = more[place], [], 0
        for of, bucket, n in zip(group.column("of").to_pylist(), group.column("bucket").to_pylist(), sizes):
            if hit[at : at + n].any():
                out.append((of, bucket, np.packbits(hit[at : at + n]).tobytes()))
            at += n
        return pa.Table.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(3)], schema=schema)

    return found.groupBy("bucket").applyInArrow(run, "of long, bucket long, bits binary")


def unpacked(h, parts: int, bits: dict[int, bytes]):
    """Which of a block's ordered hashes are set in bits, by bucket."""
    import numpy as np

    out = np.zeros(len(h), bool)
    for bucket, a, b in spans(h, parts):
        if (x := bits.get(bucket)) is not None:
            out[a:b] = np.unpackbits(np.frombuffer(x, np.uint8), count=b - a)
    return out
