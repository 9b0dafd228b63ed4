"""SimHash near-duplicates: candidate keys, tables of distances to references, comparison.

* Keys. Only rows under a common key can become a pair. For fingerprints at most
  r bits apart, every choice of s - r of s segments of the bits is a key and no
  link is lost (`segment_keys`); other users bring keys of their own.
* Discard. In a key each fingerprint's Hamming distances to REFERENCES reference
  fingerprints ("pivots") are computed once. A pair whose distances to any of
  them differ by over r cannot be r bits apart (triangle inequality), so the
  largest coordinate difference discards it.
* Verify. Survivors are compared bit by bit.

The distance tables alone can't find the pairs: distances of 64-bit fingerprints
to a reference lie within a few bits of 32, so each range of 2 r + 1 of them holds
a large part of the table (the README has figures).

Copies with equal fingerprints are one node. A key with more than CAP nodes is
dealt out in cells, block against block, so no task holds a hot key and all its
pairs are still compared. Cells return a spanning forest of their links, not
all pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, shared_dir, text_batches, written

SHINGLE = 4
RADIUS = 4
REFERENCES = 16
CAP = 4096
#: Parts of a hot fingerprint's rows.
SALTS = 64
#: Hot keys that are broadcast, of 16 bytes each.
MAX_HOT = 1 << 20
#: The seed of a shingle's XXH64, and the multipliers of the 64-bit mixer of further lanes.
SEED = 42
MIX1, MIX2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 of each run of `shingle` words, A-Z lower-cased, repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    first = np.concatenate([[0], ends[: n - 1] + 1])
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), np.uint64, n)


def majority(h, lanes: int) -> list[int]:
    """The fingerprint's lanes as unsigned integers: a bit is set if over half the hashes have it."""
    import numpy as np

    wide = np.empty((len(h), lanes), np.uint64)
    for lane in range(lanes):
        x = h
        if lane:
            x = h + np.uint64(STEP * lane % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
            x = x ^ (x >> np.uint64(31))
        wide[:, lane] = x
    raw = wide.astype(">u8").view(np.uint8).reshape(len(h), 8 * lanes)
    count = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), 1 << 15):  # counts of a part fit 16 bits
        count += np.add.reduce(np.unpackbits(raw[i : i + (1 << 15)], axis=1), axis=0, dtype=np.uint16)
    return [int.from_bytes(x.tobytes(), "big") for x in np.packbits(count * 2 > len(h)).reshape(lanes, 8)]


def lane_names(lanes: int) -> list[str]:
    return [f"fp{i}" for i in range(lanes)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp0, ...): 64 bits a lane, as signed longs. Texts without words have zero."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import trim, working

        working("simhash")
        for b in batches:
            rows = [majority(shingle_hashes(t, shingle), lanes) for t in b.column(1).to_pylist()]
            fps = np.array(rows, np.uint64).reshape(len(rows), lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, i].copy()) for i in range(lanes)]], [id_col, *lane_names(lanes)])
        trim()

    text_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{x} long" for x in lane_names(lanes)))


def cover(radius: int, segments: int) -> list[int]:
    """Bit masks: each union of segments - radius of the 64 bits' segments."""
    cuts = [round(i * 64 / segments) for i in range(segments + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, segments - radius)]


def segment_keys(masks: list[int]) -> Column:
    """A key for each mask over the column fp0."""
    return F.array(*[F.xxhash64(F.lit(t), F.col("fp0").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def _pieces(found, lanes: int, radius: int):
    """Links of runs of equal (key, i, j); found: an iterator of sorted batches."""
    import numpy as np
    import pyarrow as pa

    from .common import working

    working("simhash")
    references = np.random.default_rng(SEED).integers(0, 2**64, (REFERENCES, lanes), np.uint64)

    def links(group, node, fps):
        table = np.stack([np.bitwise_count(fps ^ p).sum(1, dtype=np.int16) for p in references], 1)
        a_out, b_out = [], []

        def near(a, b):
            ok = np.abs(table[a] - table[b]).max(1) <= radius
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int16) <= radius
            return a[ok], b[ok]

        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([start, [len(group)]]))
        small = np.repeat(size <= 32, size)
        left, lag = np.flatnonzero(small), 1
        while len(left := left[left + lag < len(group)]) and len(left := left[group[left] == group[left + lag]]):
            a, b = near(left, left + lag)
            a_out.append(a)
            b_out.append(b)
            lag += 1
        for s, n in zip(start[size > 32], size[size > 32]):
            # Breadth first: each node is compared with those that no link has reached yet. What is
            # reached from one node is linked to the smallest of it, in place of all its pairs.
            rest = np.arange(s, s + n)
            while len(rest):
                queue, rest = [int(rest[0])], rest[1:]
                reached = list(queue)
                while queue and len(rest):
                    _, b = near(np.full(len(rest), queue.pop()), rest)
                    rest = rest[~np.isin(rest, b, assume_unique=True)]
                    queue.extend(b.tolist())
                    reached.extend(b.tolist())
                if len(reached) > 1:
                    together = np.array(reached)
                    least = together[node[together].argmin()]
                    a_out.append(np.full(len(together), least))
                    b_out.append(together)
        a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
        b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
        x, y = node[a], node[b]
        # A batch's links once each: near copies meet under many keys.
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    held = None
    for b in found:
        if not b.num_rows:
            continue
        cols = np.stack([c.to_numpy() for c in b.columns], 1)
        cols = cols if held is None else np.concatenate([held, cols])
        change = np.flatnonzero((cols[1:, :3] != cols[:-1, :3]).any(1))
        if len(cols) < 1 << 15 or not len(change):
            held = cols
            continue
        cut = change[-1] + 1
        held, cols = cols[cut:], cols[:cut]
        yield from _emit(cols, links)
    if held is not None:
        yield from _emit(held, links)


def _emit(cols, links):
    import numpy as np

    group = np.cumsum(np.concatenate([[0], (cols[1:, :3] != cols[:-1, :3]).any(1)]))
    yield links(group, cols[:, 3], np.ascontiguousarray(cols[:, 4:]).view(np.uint64))


def links(nodes: DataFrame, radius: int, lanes: int = 1, cap: int = CAP) -> DataFrame:
    """(a, b) links between rows of nodes (node long, fp0, ..., keys array<long>) under a common key, at most radius bits apart.

    Under each key the links connect what is connected; pairs that other links
    join already may be left out.
    """
    names = lane_names(lanes)
    rows = nodes.select("node", *names, F.explode("keys").alias("key"))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
    split = written(hot.select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / (cap // 2)).cast("int").alias("nb")), "hot-keys")
    if split.count() <= MAX_HOT:  # else the rows are shuffled to them
        split = F.broadcast(split)
    own_block = F.pmod(F.xxhash64("node", "key"), F.col("nb")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = (
        rows.join(split, F.col("key") == F.col("hot_key"), "left")
        .withColumn("nb", F.coalesce("nb", F.lit(1)))
        .withColumn("own", own_block)
        .select("key", "node", *names, F.explode(cell).alias("c"))
        .select("key", F.col("c.i").cast("long").alias("i"), F.col("c.j").cast("long").alias("j"), "node", *names)
    )
    ordered = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = ordered.mapInArrow(lambda found: _pieces(found, lanes, radius), "a long, b long").distinct()
    # A node has at most a few smaller neighbours under each key. Its smallest takes over the others,
    # so that a group that meets under many keys keeps a few links a node, not one a key.
    lists = found.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("low"))
    first = F.col("low")[0]
    thin = F.concat(F.array(F.struct(first.alias("a"), F.col("b").alias("b"))), F.transform(F.slice("low", 2, F.size("low")), lambda x: F.struct(first.alias("a"), x.alias("b"))))
    return lists.select(F.explode(thin).alias("e")).select("e.a", "e.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Large-star and small-star steps until nothing changes, each cut by checkpoint():
    neighbours are only ever reduced to their smallest, so a hub is a sum, not a
    list.
    """
    shared_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "w")
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.toDF("v", "u")
        least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = down.join(least, F.col("u") == F.col("w"))
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).where("a <> b").distinct()
        now = small.checkpoint()
        # Settled when a round leaves the same edges.
        after = now.agg(F.count(F.lit(1)), F.countDistinct("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def spread(rows: DataFrame, named: DataFrame, key: str, of: str, salts: int = SALTS) -> DataFrame:
    """rows left-joined to named (one row a key `of`) on key = of; keys with many rows are salted.

    A key is hot with over 1 / (4 * salts) of all rows, so there are fewer than 4 * salts hot keys.
    """
    n = rows.count()
    hot = rows.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") * 4 * salts > max(n, 4 * salts)).select("__hot")
    hot = F.broadcast(hot)
    salted = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int")).drop("__hot")
    copies = named.join(hot, F.col(of) == F.col("__hot"), "left").withColumn("__of_salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return salted.join(copies, (F.col(key) == F.col(of)) & (F.col("__salt") == F.col("__of_salt")), "left").drop("__salt", "__of_salt")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """(id_col, fp0, component_id) for each row: component_id is the smallest id that links reach.

    Rows link when their 64-bit fingerprints differ in at most radius bits; no link is lost.

    Null, empty and blank texts have fingerprint zero and link like any other;
    very long ones are read whole.
    Repeated rows have the same component. A row whose id is null takes no part
    in linking and has a null component. Other columns are ignored, whatever
    their names. An empty table gives none. Ids are integers.
    """
    docs = own(docs, *[c for c in docs.columns if c not in (id_col, text_col)])
    fps = written(fingerprints(docs, shingle, 1, id_col, text_col), "fingerprints")
    nodes = fps.where(F.col(id_col).isNotNull()).groupBy("fp0").agg(F.min(id_col).cast("long").alias("node"))
    roots = components(links(nodes.withColumn("keys", segment_keys(cover(radius, radius + 2))), radius, 1, cap))
    named = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(F.col("fp0").alias("of_fp0"), F.coalesce("root", "node").alias("component"))
    out = spread(fps, named, "fp0", "of_fp0").select(id_col, "fp0", "component")
    kind = fps.schema[id_col].dataType
    return out.select(id_col, "fp0", F.when(F.col(id_col).isNotNull(), F.col("component")).cast(kind).alias("component_id"))
