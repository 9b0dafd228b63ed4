"""Substring dedup by difference-cover anchors.

A match of `window` words at word positions p and q has a shift k < PERIOD at
which both p + k and q + k are cover positions modulo PERIOD, since the cover's
differences give every residue. So only the ANCHOR words from cover positions
are hashed (5 of 21), and any two equal windows share an aligned anchor.

1. Each block of documents gives its distinct anchor hashes (64 bits), cut into
   pieces by ranges of hashes. An anchor that stands twice in a block, or in two
   blocks, is shared; each piece gets a bit a hash back.
2. Blocks extend their shared anchors: each window around one is hashed as a
   whole (128 bits in two independent lanes), and the distinct hashes meet as before.
3. Windows that stand twice are removed from their block's documents.

Anchors only find windows, so their collisions cost time alone. A passage in a
third of all documents is one entry a block in both shuffles; no pairs are
formed. All windows are judged on the input.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import PIECES, distinct, parts_for, pieces, rows_of, twice, unpacked, written_blocks
from .common import own, written

WINDOW = 35
#: A block's text; the arrays of its words and windows take some ten times as much.
BLOCK_BYTES = 8 << 20
#: A perfect difference set of 21 (all differences but 0 once).
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes or words hashed in one go, and the length from which a word is hashed on its own.
CHUNK, LONG = 1 << 16, 256
#: Each lane's odd multiplier of the positional sums and seed of its byte values, and the multipliers of the final mixer.
LANES = ((0x9E3779B97F4A7C15, 20240229), (0xD1342543DE82EF95, 20240301))
MIX1, MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@lru_cache(maxsize=2)
def _tables(lane: int):
    """Powers of the lane's multiplier, of its inverse, a random value for each byte, and which bytes are white space."""
    import numpy as np

    base, seed = LANES[lane]
    powers = [np.full(CHUNK + 1, x, np.uint64) for x in (base, pow(base, -1, 2**64))]
    for p in powers:
        p[0] = 1
        np.cumprod(p, out=p)
    values = np.random.default_rng(seed).integers(1, 2**64, 256, np.uint64)
    space = np.zeros(256, bool)
    space[list(b" \t\n\x0b\x0c\r")] = True
    return *powers, values, space


def _mixed(h):
    import numpy as np

    h ^= h >> np.uint64(30)
    h *= np.uint64(MIX1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(31)
    return h


def _sums(values, lane: int):
    """(prefix sums of values weighted by position, inverse powers): any run's hash is a difference of two."""
    import numpy as np

    power, inverse, *_ = _tables(lane)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return total, inverse


def _long_hash(word: bytes, lane: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word, LANES[lane][1])


def _chunk_hashes(raw: bytes, lane: int):
    import numpy as np

    *_, values, space = _tables(lane)
    b = np.frombuffer(raw, np.uint8)
    word = np.zeros(len(b) + 2, np.int8)
    word[1:-1] = ~space[b]
    step = np.diff(word)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    total, inverse = _sums(values[b], lane)
    h = (total[end] - total[start]) * inverse[start]
    size = end - start
    h = _mixed(h + size.astype(np.uint64))
    if len(size) and size.max() > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = _long_hash(raw[start[i] : end[i]], lane)
    return h


def word_hashes(text: str | None, lane: int = 0):
    """A 64-bit hash of each word, the same wherever the word stands; lanes are independent."""
    return byte_word_hashes(text.encode() if text else b"", lane)


def byte_word_hashes(raw: bytes, lane: int = 0):
    """word_hashes() of a text's UTF-8 bytes."""
    import numpy as np

    if len(raw) <= CHUNK:
        return _chunk_hashes(raw, lane)
    out, at = [], 0
    cut = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(raw):
        part = raw[at : at + CHUNK]
        if at + CHUNK < len(raw):
            last = max(part.rfind(x) for x in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if last < 0:  # one word that is longer than a chunk
                m = cut.search(raw, at + CHUNK)
                end = m.start() if m else len(raw)
                out.append(np.array([_long_hash(raw[at:end], lane)], np.uint64))
                at = end
                continue
            part = part[: last + 1]
        out.append(_chunk_hashes(part, lane))
        at += len(part)
    return np.concatenate(out)


def rolled(h, width: int, lane: int = 0):
    """A hash of each run of `width` words; h: the words' hashes of that lane."""
    import numpy as np

    n = len(h) - width + 1
    if n < 1:
        return h[:0]
    out = []
    for i in range(0, n, CHUNK - width):
        part = h[i : i + CHUNK]
        total, inverse = _sums(part, lane)
        k = min(len(part) - width + 1, CHUNK - width)
        out.append(_mixed((total[width : width + k] - total[:k]) * inverse[:k] + np.uint64(width)))
    return out[0] if len(out) == 1 else np.concatenate(out)


@lru_cache(maxsize=1)
def _cover_upto(n: int):
    import numpy as np

    at = (np.arange(0, n + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
    return at[at < n]


def anchors(h, width: int):
    """(positions, hashes) of the anchors of one document."""
    import numpy as np

    runs = rolled(h, width)
    at = _cover_upto(1 << 10)
    at = at[: np.searchsorted(at, len(runs))] if len(runs) <= 1 << 10 else np.flatnonzero(np.isin(np.arange(len(runs)) % PERIOD, COVER))
    return at, runs[at]


def around(at, shared, n_words: int, window: int):
    """Starts of the windows that hold a shared anchor; at: the anchors' positions, shared: which of them are."""
    import numpy as np

    at = at[shared]
    mark = np.zeros(n_words + 1, np.int32)
    np.add.at(mark, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: n_words - window + 1] > 0)


class BlockWindows:
    """The anchors of a block's texts, and the windows around the shared ones."""

    def __init__(self, texts: list, window: int):
        import numpy as np

        self.texts, self.window = texts, window
        self.words, self.at, parts = [], [], []
        for t in texts:
            h = word_hashes(t)
            self.words.append(len(h))
            at, a = anchors(h, window - PERIOD + 1) if len(h) >= window else (np.zeros(0, np.int64), h[:0])
            self.at.append(at)
            parts.append(a)
        self.hashes, self.place, self.count = distinct([np.concatenate(parts) if parts else np.zeros(0, np.uint64)])

    def extend(self, shared):
        """(starts of each text's windows, their distinct hashes, places in these, counts); shared: which distinct anchors are."""
        import numpy as np

        starts, lanes, first = [], ([], []), 0
        for t, n, at in zip(self.texts, self.words, self.at):
            hit = shared[self.place[first : first + len(at)]]
            first += len(at)
            found = around(at, hit, n, self.window) if hit.any() else np.zeros(0, np.int64)
            starts.append(found)
            if len(found):
                for lane in (0, 1):
                    lanes[lane].append(rolled(word_hashes(t, lane), self.window, lane)[found])
        return starts, *distinct([np.concatenate(x) if x else np.zeros(0, np.uint64) for x in lanes])


def cut_out(text: str, removed) -> str:
    """text without the words marked in removed, each with the white space after it."""
    raw = text.encode()
    starts = [m.start() for m in WORDS.finditer(raw)]
    spans = zip(starts, [*starts[1:], len(raw)], removed)
    return (raw[: starts[0]] + b"".join(raw[a:b] for a, b, gone in spans if not gone)).decode()


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with each word removed that a repeated window covers; adds n_words and n_removed.

    Words are runs without ASCII white space. A window is `window` consecutive
    words of one document; it is repeated if the same words also start anywhere
    else, in the same document too. The text keeps its own white space between
    kept words. Windows are told apart by 128-bit hashes.

    A null text has no words and stays null; empty and shorter texts stay as
    they are. A repeated row is elsewhere, so both lose their windows. Other
    columns pass through; columns named n_words or n_removed are replaced. An
    empty table gives none.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    docs = own(docs, "n_words", "n_removed")
    blocks = written_blocks(docs, "passages", block_bytes)
    i_text = docs.columns.index(text_col)

    parts = parts_for(blocks)

    def block_of(payload: bytes) -> BlockWindows:
        from .common import eased, working

        working("substring")
        eased(block_bytes)
        return BlockWindows([t for rows in rows_of(payload) for t in rows.column(i_text).to_pylist()], window)

    def anchor_pieces(batches):
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                held = block_of(payload.as_py())
                yield from pieces(block, held.hashes, held.count, parts)

    def bits_of(table, kind: int) -> dict[int, bytes]:
        return {k: x for k, x, of in zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist(), table.column("kind").to_pylist()) if of == kind}

    def window_pieces(left, right):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int64()), ("of", pa.int64()), ("h", pa.binary()), ("often", pa.binary())])
        found = []
        if right.num_rows:  # else the block has no shared anchor
            for block, payload in zip(left.column("block").to_pylist(), left.column("payload")):
                held = block_of(payload.as_py())
                _, hashes, _, count = held.extend(unpacked(held.hashes[0], parts, bits_of(right, 0)))
                found += pieces(block, hashes, count, parts)
        return pa.Table.from_batches(found, schema)

    shared = written(twice(blocks.mapInArrow(anchor_pieces, PIECES), 1), "anchors").withColumn("kind", F.lit(0))
    windows = blocks.groupBy("block").cogroup(shared.groupBy("of")).applyInArrow(window_pieces, PIECES)
    repeated = shared.unionByName(twice(windows, 2).withColumn("kind", F.lit(1)))

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    out_type = StructType([f for f in docs.schema.fields]).add("n_words", LongType()).add("n_removed", LongType())
    out_schema = to_arrow_schema(out_type)

    def rewrite(left, right):
        import numpy as np

        anchor_bits, window_bits = bits_of(right, 0), bits_of(right, 1)
        out = []
        for payload in left.column("payload"):
            payload = payload.as_py()
            gone = None
            if window_bits:
                held = block_of(payload)
                starts, hashes, place, _ = held.extend(unpacked(held.hashes[0], parts, anchor_bits))
                gone = unpacked(hashes[0], parts, window_bits)[place]
            k = first = 0
            for rows in rows_of(payload):
                kept, n_words, n_removed = [], [], []
                for t in rows.column(i_text).to_pylist():
                    hit = ()
                    if gone is None:
                        n = len(WORDS.findall(t.encode())) if t else 0
                    else:
                        n, found = held.words[k], starts[k]
                        hit = found[gone[first : first + len(found)]]
                        k, first = k + 1, first + len(found)
                    n_words.append(n)
                    if not len(hit):
                        n_removed.append(0)
                        kept.append(t)
                        continue
                    mark = np.zeros(n + 1, np.int32)
                    np.add.at(mark, hit, 1)
                    np.add.at(mark, hit + window, -1)
                    removed = np.cumsum(mark[:n]) > 0
                    n_removed.append(int(removed.sum()))
                    kept.append(cut_out(t, removed.tolist()))
                cols = [pa.array(kept, pa.string()) if i == i_text else rows.column(i) for i in range(rows.num_columns)]
                out.append(pa.Table.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=out_schema.names).cast(out_schema))
        return pa.concat_tables(out) if out else out_schema.empty_table()

    return blocks.groupBy("block").cogroup(repeated.groupBy("of")).applyInArrow(rewrite, out_type)
