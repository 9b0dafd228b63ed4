"""BPE encoding and decoding through a distinct-word table.

1. Texts are split into the vocabulary's words, block by block. A block's
   distinct words are put in the order of (hash bucket, word).
2. The distinct-word table: the words meet by bucket, one bucket after the other
   in a task, and each distinct word is encoded once. A block's words of a bucket
   go back with their ids as one piece.
3. A block joins the pieces to its words by position in that order, and the
   words' ids to its texts by position there. Decoding joins the ids of the
   block's distinct words to the vocabulary's id-to-piece table, whose size is the
   vocabulary's.

What is shuffled is a block's distinct words, not its words, so a word that
stands in every document counts once a block. The number of buckets follows the
input's size, so a bucket's words stay a small share. Block numbers may differ if
a lost task is computed anew over another order of rows; each piece therefore
carries a checksum of its words, and a block whose words differ encodes them in
place. The result doesn't depend on the blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, rows_of, runs_of
from .common import own

BLOCK_BYTES = 6 << 20
#: Bytes of input, by the plan's statistics, for which there is a bucket.
BUCKET_BYTES = 128 << 20


def in_buckets(words: set[str], buckets: int) -> list[tuple[int, list[str]]]:
    """(bucket, its words in order), in the order of the buckets."""
    from zlib import crc32

    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(crc32(w.encode()) % buckets, []).append(w)
    return [(b, sorted(by[b])) for b in sorted(by)]


def checksum(words: list[str]) -> int:
    from zlib import crc32

    return crc32(" ".join(words).encode())


def squeezed(data: bytes) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(data)


def block_words(docs: DataFrame, vocabulary: str, buckets: int, block_bytes: int) -> DataFrame:
    """(bucket, of, words): a block's distinct words of each bucket, in one compressed piece.

    It reads docs itself: a second Python stage over blocked() would hold twice the workers.
    """

    def run(batches):
        import pyarrow as pa

        from .common import trim
        from .wordbpe import encoder

        split = encoder(vocabulary).splitter.words
        for block, held in runs_of(batches, block_bytes):
            found: set[str] = set()
            for rows in held:
                for text in rows.column(1).to_pylist():
                    found.update(split(text))
            pieces = in_buckets(found, buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in pieces], pa.int32()), pa.array([block] * len(pieces), pa.int64()), pa.array([squeezed(" ".join(w).encode()) for _, w in pieces], pa.binary())],
                ["bucket", "of", "words"],
            )
        trim()

    return docs.mapInArrow(run, "bucket int, of long, words binary")


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as shuffle partitions, or one for BUCKET_BYTES of input."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # A plan without statistics claims more bytes than any input has.
    more = size // BUCKET_BYTES if size < 1 << 60 else 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), more)


def word_ids(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """(of, bucket, check, ids): the ids of each piece's words. A bucket's pieces come one after the other, and each word is encoded once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import working
        from .wordbpe import encoder

        working("bpe")
        enc = encoder(vocabulary)
        bucket, known = None, {}
        for b in batches:
            checks, packed = [], []
            for at, words in zip(b.column(0).to_pylist(), b.column(2)):
                if at != bucket:
                    bucket, known = at, {}
                words = unsqueezed(words.as_py()).decode().split(" ")
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 4096):
                    known.update(zip(new[i : i + 4096], enc.ids_of(new[i : i + 4096])))
                ids = [known[w] for w in words]
                checks.append(checksum(words))
                packed.append(squeezed(np.array([len(x) // 4 for x in ids], "<u4").tobytes() + b"".join(ids)))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(checks, pa.int64()), pa.array(packed, pa.binary())], ["of", "bucket", "check", "ids"])

    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "of long, bucket int, check long, ids binary")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_tokens, ids binary of little-endian unsigned 32-bit, decoded) for each row.

    Null and empty texts give no ids and an empty string. Whole texts are coded,
    however long. Repeated rows give repeated results, an empty table none. Other
    columns are ignored, whatever their names. Merges of equal rank are those of the
    vocabulary, so there are no ties.
    """
    named = own(docs, *[c for c in docs.columns if c not in (id_col, text_col)]).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(named)
    table = word_ids(block_words(named, vocabulary, buckets, block_bytes), vocabulary)
    return rejoined(blocked(named, block_bytes), table, vocabulary, buckets, named.schema["id"].dataType).withColumnRenamed("id", id_col)


def rejoined(blocks: DataFrame, table: DataFrame, vocabulary: str, buckets: int, kind) -> DataFrame:
    """(id, n_tokens, ids, decoded) of the blocks' rows (id of type kind, text), from the table's pieces by block.

    Words of pieces that are absent or belong to other words are encoded in place.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    done = pa.schema([("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def rewrite(left, right):
        import numpy as np

        from .common import working
        from .wordbpe import encoder

        working("bpe")
        enc = encoder(vocabulary)
        split, piece_of = enc.splitter.words, enc.pieces
        back = {b: (c, ids) for b, c, ids in zip(right.column("bucket").to_pylist(), right.column("check").to_pylist(), right.column("ids"))}
        out = []
        for payload in left.column("payload"):
            found: set[str] = set()
            for rows in rows_of(payload.as_py()):
                for text in rows.column(1).to_pylist():
                    found.update(split(text))
            coded: dict[str, bytes] = {}
            said: dict[str, str] = {}
            for bucket, words in in_buckets(found, buckets):
                check, packed = back.get(bucket, (None, None))
                if check == checksum(words):
                    packed = unsqueezed(packed.as_py())
                    n = np.frombuffer(packed, "<u4", len(words))
                    ids, ends = packed[4 * len(words) :], np.cumsum(n) * 4
                    coded.update((w, ids[b - 4 * k : b]) for w, b, k in zip(words, ends.tolist(), n.tolist()))
                else:
                    coded.update(zip(words, enc.ids_of(words)))
            for w, ids in coded.items():
                said[w] = " ".join([piece_of[i] for i in np.frombuffer(ids, "<u4").tolist()] if len(ids) > 4 else [piece_of[int.from_bytes(ids, "little")]])
            del found
            for rows in rows_of(payload.as_py()):
                words = [split(t) for t in rows.column(1).to_pylist()]
                ids = pa.array([b"".join(map(coded.__getitem__, w)) for w in words], pa.binary())
                text = pa.array([" ".join(map(said.__getitem__, w)) for w in words], pa.string())
                n = pa.compute.divide(pa.compute.binary_length(ids), 4).cast(pa.int64())
                out.append(pa.RecordBatch.from_arrays([rows.column(0), n, ids, text], schema=done))
                del words
        return pa.Table.from_batches(out, schema=done)

    names = f"id {kind.simpleString()}, n_tokens long, ids binary, decoded string"
    return blocks.groupBy("block").cogroup(table.groupBy("of")).applyInArrow(rewrite, names)
