"""Packing: concatenate and cut into fixed windows.

Pass one encodes each document once and keeps, in the order of its input
partition, the number of ids before it there. The partition totals (one row a
task) are summed up to global offsets, which are broadcast up to MAX_PARTS tasks
and joined beyond that. Pass two is plain column arithmetic: a document covers
the windows from start // length to its last id's window, and each window it
touches gives one boundary record. No text or id is shuffled; one row a task is
gathered.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own, text_batches, written

LENGTH = 4096
END_ID = 2
#: Task totals that are broadcast, of 16 bytes each.
MAX_PARTS = 1 << 20


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, before, id, n, ids): ids as little-endian unsigned 32-bit bytes, with end_id last.

    part and before are the task and the number of ids before the document in
    it. They hold for this result alone: write it before it is used twice.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from .common import working
        from .wordbpe import encoder

        working("packing")
        enc, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [x + end for x in enc.encode_many(b.column(1).to_pylist())]
            n = [len(x) // 4 for x in ids]
            at = []
            for x in n:
                at.append(before)
                before += x
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "before", "id", "n", "ids"],
            )

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"part int, before long, id {kind}, n long, ids binary")


def cut(tokens: DataFrame, length: int = LENGTH, max_parts: int = MAX_PARTS) -> DataFrame:
    """Cuts the written result of encoded() into windows of `length` ids."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # One row a task of pass one, which the driver's scheduler holds anyway.
    first = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    if (tokens.agg(F.max("part")).first()[0] or 0) < max_parts:
        first = F.broadcast(first)
    at = F.col("first") + F.col("before")
    placed = tokens.join(first, "part").select("id", "n", "ids", at.alias("at"))
    seq = F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length))).alias("sequence_id")
    pieces = placed.select("id", "n", "ids", "at", seq)
    low = F.greatest(F.col("at"), F.col("sequence_id") * length)
    high = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    return pieces.select(
        "id",
        (low - F.col("at")).alias("start"),
        (high - low).alias("length"),
        F.col("n").alias("doc_tokens"),
        F.col("sequence_id").cast("long").alias("sequence_id"),
        (low - F.col("sequence_id") * length).alias("offset"),
        F.substring("ids", ((low - F.col("at")) * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("ids"),
    )


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document; one row a piece, with its ids.

    Columns: id_col, start, length, doc_tokens, sequence_id, offset, ids
    (binary, little-endian unsigned 32-bit). Every id lies in exactly one piece
    and each sequence but the last is full, so only the last one is padded.

    Null and empty texts give end_id alone. Very long texts are encoded whole
    and cut over as many sequences as they fill. Repeated rows are documents of
    their own. An empty table gives no rows. Other columns are ignored,
    whatever their names. A null id is kept as null. Which of equal rows comes first
    (ties) follows the input's tasks and files.
    """
    tokens = written(encoded(own(docs, *[c for c in docs.columns if c not in (id_col, text_col)]), vocabulary, end_id, id_col, text_col), "pack")
    return cut(tokens, length).withColumnRenamed("id", id_col)
