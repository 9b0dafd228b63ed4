"""Groups of documents whose shingle sets have a Jaccard similarity of a stated value or more.

1. Candidate keys: BANDS keys a set, each made of ROWS min-hashes of its shingles.
   Sets of similarity j share a key with chance 1 - (1 - j ** ROWS) ** BANDS,
   0.999997 at 0.8; sets that share little share no key, whatever the table's size.
2. SimHash (`simhash.links`): under a key, pairs are discarded by their
   fingerprints' distances to the references, and survivors are compared.
3. Inside a component of what is left, the whole shingle sets are compared, and
   only what these comparisons link is a group: first each text with the
   component's leader, then those that are not near it with all others.

Texts with the same set are one node. A candidate component is a key: over BLOCK
texts or BLOCK_SHINGLES shingles it is dealt out in blocks, so no task holds a hot
one. A group whose texts are near its leader takes linear work, however large.
Cells return links that connect what is connected, not all pairs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own, text_batches, written
from .simhash import CAP, components, lane_names, links, majority, spread
from .substring import byte_word_hashes, rolled

#: The similarity, 0.8, as a fraction.
SIMILAR = (4, 5)
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
BANDS, ROWS = 24, 4
#: Seed of the min-hashes' multipliers, and shingles that are multiplied by all of them at once.
SEED, CHUNK = 20240229, 1024


def hash_family():
    """(BANDS * ROWS odd multipliers of min-hashes, ROWS odd multipliers that make a key of them)."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int):
    """The text's distinct shingles as ordered 64-bit hashes, A-Z lower-cased; of fewer words the whole sequence."""
    import numpy as np

    h = byte_word_hashes(text.encode().lower()) if text else np.zeros(0, np.uint64)
    return np.unique(rolled(h, min(shingle, len(h)))) if len(h) else h


def band_keys(held, multipliers, mixers):
    """BANDS keys of a set of 64-bit hashes: the smallest 32-bit products with each multiplier, ROWS of them to a key."""
    import numpy as np

    short = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 2**32 - 1, np.uint32)
    for i in range(0, len(short), CHUNK):
        np.minimum(least, (short[i : i + CHUNK, None] * multipliers).min(0), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * mixers).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys ^= keys >> np.uint64(32)
    return keys * mixers[0]


def signatures(docs: DataFrame, shingle: int, lanes: int) -> DataFrame:
    """(doc_id, s0, s1, size, fp0, ..., keys): 128 bits of the text's shingle set, its size, the set's fingerprint and its keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["s0", "s1", "size", *lane_names(lanes)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .common import trim, working

        working("simhash")
        multipliers, mixers = hash_family()
        for b in batches:
            rows, keys = np.zeros((b.num_rows, len(names)), np.uint64), np.zeros((b.num_rows, BANDS), np.uint64)
            for i, t in enumerate(b.column(1).to_pylist()):
                held = shingle_set(t, shingle)
                rows[i, :2] = np.frombuffer(hashlib.blake2b(held.tobytes(), digest_size=16).digest(), np.uint64)
                rows[i, 2], rows[i, 3:] = len(held), majority(held, lanes)
                keys[i] = band_keys(held, multipliers, mixers)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c.copy()) for c in rows.view(np.int64).T], lists], ["doc_id", *names, "keys"])
        trim()

    text_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} long" for x in names) + ", keys array<long>")


def similar(both, size_a, size_b):
    """Whether sets of these sizes, `both` elements in common, are similar enough."""
    most, over = SIMILAR
    return over * both >= most * (size_a + size_b - both)


def linked(ids, sets, todo):
    """(a, b) links that connect what similar sets connect, as far as one of them is in todo; ids and todo (booleans) go with the sets.

    Sets not in todo are one class already, so a set in todo is linked to one of them at most.
    """
    import numpy as np

    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    # Postings: which sets hold a shingle. A set meets only those that it shares shingles with.
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(term, kind="stable")]
    start = np.concatenate([[0], np.cumsum(np.bincount(term))]).astype(np.int64)
    end = np.cumsum(size)
    out, rest = [], todo.copy()
    for first in np.flatnonzero(todo).tolist():
        if not rest[first]:
            continue
        rest[first], queue, reached, settled = False, [first], [first], False
        while queue and (rest.any() or not settled):
            q = queue.pop()
            own_terms = term[end[q] - size[q] : end[q]]
            count = start[own_terms + 1] - start[own_terms]
            at = np.repeat(start[own_terms] - np.cumsum(count) + count, count) + np.arange(count.sum())
            near = similar(np.bincount(owner[at], minlength=n), size[q], size)
            if not settled and (near & ~todo).any():
                settled = True
                reached.append(int((near & ~todo).argmax()))
            near = np.flatnonzero(near & rest)
            rest[near] = False
            queue += near.tolist()
            reached += near.tolist()
        if len(reached) > 1:
            least = min(int(ids[i]) for i in reached)
            out += [(int(ids[i]), least) for i in reached if ids[i] != least]
    return out


def _near_leader(members, leader, shingle: int, schema):
    """(node, root, near) of a block's members and their component's leader, its smallest node."""
    import numpy as np
    import pyarrow as pa

    from .common import eased, working

    working("simhash")
    found = []
    if members.num_rows and leader.num_rows:
        leads = [shingle_set(t, shingle) for t in leader.column("text").to_pylist()]  # several if rows share its id
        for node, root, text in zip(members.column("node").to_pylist(), members.column("root").to_pylist(), members.column("text")):
            own_set = shingle_set(text.as_py(), shingle)
            both = [len(np.intersect1d(own_set, lead, assume_unique=True)) for lead in leads]
            found.append((node, root, any(similar(n, len(own_set), len(lead)) for n, lead in zip(both, leads))))
    eased(members.nbytes)
    return pa.Table.from_arrays([pa.array([x[i] for x in found], schema.field(i).type) for i in range(3)], schema=schema)


def _verify(cell, shingle: int, schema):
    import numpy as np
    import pyarrow as pa

    from .common import eased, working

    working("simhash")
    eased(cell.nbytes)
    sets = [shingle_set(t, shingle) for t in cell.column("text").to_pylist()]
    found = linked(cell.column("node").to_numpy(), sets, np.array(cell.column("todo").to_pylist(), bool))
    return pa.Table.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)


def verified(docs: DataFrame, nodes: DataFrame, roots: DataFrame, shingle: int) -> DataFrame:
    """(a, b) links, by the whole sets, between the nodes of each candidate component (node, root).

    First every node is compared with its component's leader, which is linear
    work; a near one is linked to it. Only pairs with a node that isn't near its
    leader can join anything further: these nodes meet all of their component.
    """
    import pyarrow as pa

    blocks = lambda count, size: F.greatest(F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sized = roots.join(nodes.groupBy("node").agg(F.max("size").alias("size")), "node")
    dealt = sized.groupBy("root").agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("nb"))
    # Rows without texts, salted where a component is large; texts only ever meet by node and by block.
    members = spread(sized, dealt.withColumnRenamed("root", "of"), "root", "of").drop("of")
    members = written(members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")), "near-members")
    every = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    texts = written(every.join(members, "node").dropDuplicates(["node", "text"]), "near-texts")
    leaders = texts.where("node = root").select("root", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("own"), "text")
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("near", pa.bool_())])
    led = texts.where("node <> root").select("root", "own", "node", "text").groupBy("root", "own").cogroup(leaders.groupBy("root", "own"))
    led = written(led.applyInArrow(lambda a, b: _near_leader(a, b, shingle, schema), "node long, root long, near boolean"), "near-led")
    first = led.where("near").select(F.col("node").alias("a"), F.col("root").alias("b"))

    # A component's todo nodes are dealt to `tb` blocks and all of its nodes to `nb`; each todo block meets each block of all.
    todo = led.where("not near").select("node").distinct()
    counts = members.join(todo, "node").groupBy(F.col("root").alias("of")).agg(blocks(F.count(F.lit(1)), F.sum("size")).alias("tb"))
    rest = spread(members, counts, "root", "of").where("tb is not null").select("node", "root", "nb", "own", "tb")
    rest = rest.join(todo.withColumn("todo", F.lit(True)), "node", "left").withColumn("todo", F.coalesce("todo", F.lit(False))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tb")).cast("int"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("tb") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))
    as_todo = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j")))
    # A todo node that is also among the cell's block of all stands there once, as todo.
    cells = F.when(F.col("todo"), F.concat(as_todo, F.filter(as_any, lambda c: c["i"] != F.col("mine")))).otherwise(as_any)
    met = texts.select("node", "text").join(rest.select("node", "root", "todo", cells.alias("cells")), "node")
    met = met.select("root", "node", "text", "todo", F.explode("cells").alias("c")).select("root", "c.i", "c.j", "node", "text", "todo")
    links_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    second = met.groupBy("root", "i", "j").applyInArrow(lambda t: _verify(t, shingle, links_schema), "a long, b long")
    return first.unionByName(second).distinct()


def groups(docs: DataFrame, shingle: int, radius: int, lanes: int, cap: int = CAP) -> DataFrame:
    """(doc_id, component_id) for each row: component_id is the smallest id that verified links reach.

    Texts whose shingle sets have a similarity of SIMILAR or more link. Null,
    empty and blank texts have the same empty set and are copies. Rows that share
    an id are one document. A row without an id takes no part and has a null component.
    Texts are read whole, however long. Ties have no part in it: similarity is
    compared exactly. Other columns are left behind, whatever their names. An
    empty table gives none.
    """
    docs = own(docs, *[c for c in docs.columns if c not in ("doc_id", "text")])
    sets = written(signatures(docs, shingle, lanes), "signatures")
    names = lane_names(lanes)
    nodes = sets.where(F.col("doc_id").isNotNull()).groupBy("s0", "s1", "size", *names).agg(F.min("doc_id").cast("long").alias("node"), F.any_value("keys").alias("keys"))
    candidates = components(links(nodes.select("node", *names, "keys"), radius, lanes, cap))
    roots = components(verified(docs, nodes, candidates, shingle))
    named = nodes.join(roots, "node", "left").select(F.struct("s0", "s1").alias("of"), F.coalesce("root", "node").alias("component"))
    out = spread(sets.select("doc_id", F.struct("s0", "s1").alias("set")), named, "set", "of")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component")).cast(sets.schema["doc_id"].dataType).alias("component_id"))
