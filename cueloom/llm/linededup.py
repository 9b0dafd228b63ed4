"""Line dedup: hash normalised lines, count documents per hash, drop, reassemble.

Each block of documents is reduced to its distinct line hashes with the number
of its documents and the largest id that holds the line. Counts and largest ids
are summed up by hash, which combines before the shuffle, so a line that stands
everywhere is a row a task. The hashes over the threshold go back to the blocks
that hold them, the commonest ones by salted keys, and the blocks are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, rows_of, written_blocks
from .common import SPACE_BYTES, own, written

#: A hash is common with over 1 / (4 * SALTS) of all (block, hash) rows, so there are fewer than 4 * SALTS common ones; each goes to SALTS tasks.
SALTS = 32
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE_BYTES).lower()


def _long_key(line: bytes, min_chars: int) -> bytes | None:
    key = line_key(line)
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _to_blocks(held: DataFrame, verdicts: DataFrame, n: int, salts: int = SALTS) -> DataFrame:
    """(of, h, top): the verdicts (h, top, blocks) for the n rows held (of, h)."""
    common = verdicts.where(F.col("blocks") * 4 * salts > n).select(F.col("h").alias("c"))
    common = F.broadcast(common)  # fewer than 4 * salts hashes
    salt = lambda yes, no: F.when(F.col("c").isNotNull(), yes).otherwise(no)
    rows = held.join(common, F.col("h") == F.col("c"), "left").select("of", "h", salt(F.pmod("of", F.lit(salts)), F.lit(0)).cast("int").alias("salt"))
    copies = verdicts.join(common, F.col("h") == F.col("c"), "left").select("h", "top", F.explode(salt(F.sequence(F.lit(0), F.lit(salts - 1)), F.array(F.lit(0)))).alias("salt"))
    return rows.join(copies, ["h", "salt"]).select("of", "h", "top")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the lines dropped from text_col, and n_lines and n_dropped.

    A key (see line_key) of at least min_chars code points that is found in at
    least min_docs documents keeps its lines only in the row of the largest id
    that holds it. Hashes have 128 bits.

    A null or empty text is one empty line, and a null comes back as empty. Very
    long texts and lines are read whole. A row is a document: repeated rows with the largest id (ties) all keep the line. A
    null id is smaller than any other. Other columns pass through, except that
    columns named n_lines or n_dropped are replaced. An empty table gives none.
    """
    docs = own(docs, "n_lines", "n_dropped")
    blocks = written_blocks(docs, "lines", block_bytes)
    i_id, i_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def keys(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        from .common import eased, working

        working("linededup")
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                found: dict[bytes, list] = {}
                size = 0
                for rows in rows_of(payload.as_py()):
                    for doc, text in zip(rows.column(i_id).to_pylist(), rows.column(i_text).to_pylist()):
                        seen = set()
                        size += len(text or "")
                        for line in text.encode().split(b"\n") if text else ():
                            if len(line) >= min_chars and (key := _long_key(line, min_chars)) is not None:
                                seen.add(digest(key))
                        for h in seen:
                            if (x := found.get(h)) is None:
                                found[h] = [1, doc]
                            else:
                                x[0] += 1
                                if doc is not None and (x[1] is None or doc > x[1]):
                                    x[1] = doc
                items = list(found.items())
                found.clear()
                for i in range(0, len(items), 50_000):
                    part = items[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(part), pa.int64()), pa.array([h for h, _ in part], pa.binary()), pa.array([x[0] for _, x in part], pa.int64()), pa.array([x[1] for _, x in part], pa.int64())],
                        ["of", "h", "n", "top"],
                    )
                del items
                eased(2 * size)

    held = written(blocks.mapInArrow(keys, "of long, h binary, n long, top long"), "line-hashes")
    counted = held.groupBy("h").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.count(F.lit(1)).alias("blocks"))
    verdicts = written(counted.where(F.col("n") >= min_docs).select("h", "top", "blocks"), "frequent-lines")
    frequent = _to_blocks(held.select("of", "h"), verdicts, held.count())

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    out_type = StructType([f for f in docs.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType())
    out_schema = to_arrow_schema(out_type)

    def rewrite(left, right):
        from xxhash import xxh3_128_digest as digest

        from .common import eased, working

        working("linededup")
        eased(2 * BLOCK_BYTES)
        drop = dict(zip(right.column("h").to_pylist(), right.column("top").to_pylist()))
        out = []
        for payload in left.column("payload"):
            for rows in rows_of(payload.as_py()):
                texts, n_lines, n_dropped = [], [], []
                for doc, text in zip(rows.column(i_id).to_pylist(), rows.column(i_text).to_pylist()):
                    lines = (text or "").encode().split(b"\n")
                    kept = []
                    for line in lines:
                        if drop and len(line) >= min_chars and (key := _long_key(line, min_chars)) is not None and (h := digest(key)) in drop and drop[h] != doc:
                            continue
                        kept.append(line)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    texts.append(b"\n".join(kept).decode() if len(kept) < len(lines) else text or "")
                cols = [pa.array(texts, pa.string()) if i == i_text else rows.column(i) for i in range(rows.num_columns)]
                out.append(pa.Table.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=out_schema.names).cast(out_schema))
        return pa.concat_tables(out) if out else out_schema.empty_table()

    return blocks.groupBy("block").cogroup(frequent.groupBy("of")).applyInArrow(rewrite, out_type)
