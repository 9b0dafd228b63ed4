"""Exact top-k inner products by KD-trees per shard.

The top splits of one KD-tree, built on a bounded sample, deal all candidates to
regions of space, whose tight boxes are then computed over every row. A region is
cut into cells of about CELL vectors by hash. Inside a cell are trees: median
splits on the widest component, each node with its tight bounding box. A query
goes through a tree best first: the box bound (per component the better of its
two ends) orders the nodes, and the search ends when no open node's bound
reaches the query's kth score. A bound equal to the kth score is still opened,
since ties go to the smaller id.

The kth score is carried on twice: from tree to tree in a cell, and from a first
round to all other cells. In that round each query meets one cell of the region
whose box promises most. A query's kth best there is at most its kth best of all,
so regions whose box doesn't reach it are pruned before the query or a candidate
is copied or shuffled to them.

Per cell and query at most k rows are shuffled on.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches, written

K = 10
SCALE = 1024
CELL = 8192
#: Queries of one block.
BLOCK = 4096
TREE = 2048
LEAF = 64
#: Vectors of the sample that the regions come from, regions at most, numbers in all their boxes at most, and lengths that have regions.
SAMPLE, REGIONS, BOX_NUMBERS, LENGTHS = 1 << 16, 4096, 1 << 22, 16
#: Vectors with a quantised component of this or more meet the others apart, so that these keep their fast arithmetic.
LARGEST = 1 << 26


class Tree:
    """A KD-tree over the rows of an integer matrix."""

    def __init__(self, ids, rows):
        import numpy as np

        self.ids, self.rows = ids, rows
        self.nodes: list[tuple[int, int, int, int]] = []  # left child, right child, first row, last row
        lows, highs = [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = rows[order[a:b]]
            lows.append(part.min(0))
            highs.append(part.max(0))
            me = len(self.nodes)
            self.nodes.append((-1, -1, a, b))
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (me, *p[1:]) if side == 0 else (p[0], me, *p[2:])
            if b - a > LEAF:
                wide = int((highs[-1] - lows[-1]).argmax())
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
                todo += [(a, a + mid, me, 0), (a + mid, b, me, 1)]
        self.low, self.high = np.stack(lows), np.stack(highs)
        self.ids, self.rows = ids[order], rows[order]

    def bounds(self, queries):
        """For each query and node, the largest score that a vector in the node's box could have."""
        import numpy as np

        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, q_id, query, bound, best: list, k: int, floor: int | None) -> None:
        """Adds this tree's vectors to best, a heap of (score, -id) of at most k entries, none below the floor."""
        opened = [(-bound[0], 0)]
        while opened:
            most, node = heapq.heappop(opened)
            least = best[0][0] if len(best) == k and (floor is None or best[0][0] > floor) else floor
            if least is not None and -most < least:
                return
            left, right, a, b = self.nodes[node]
            if left >= 0:
                heapq.heappush(opened, (-bound[left], left))
                heapq.heappush(opened, (-bound[right], right))
                continue
            scores = self.rows[a:b] @ query
            rows = range(a, b) if least is None else ((scores >= least).nonzero()[0] + a).tolist()
            for i in rows:
                entry = (int(scores[i - a]), -int(self.ids[i]))
                if -entry[1] == q_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _matrix(column):
    """Rows of a list column by length: length -> (row numbers, matrix)."""
    import numpy as np

    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    ends = np.cumsum(lengths)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        out[int(d)] = (at, flat[(ends[at] - d)[:, None] + np.arange(d)].reshape(len(at), int(d)))
    return out


def _most(rows) -> int:
    return max(int(rows.max(initial=0)), -int(rows.min(initial=0)))


def _exact(queries, rows):
    """The type that holds every score exactly: doubles, longs or else Python's integers."""
    import numpy as np

    most = _most(queries) * _most(rows) * rows.shape[1]
    return np.float64 if most < 2**52 else np.int64 if most < 2**63 else object


def _by_size(rows):
    """Row numbers of the vectors under LARGEST, and of the others."""
    large = ((rows >= LARGEST) | (rows <= -LARGEST)).any(1)
    return [at for at in ((~large).nonzero()[0], large.nonzero()[0]) if len(at)]


def _cell(left, right, k: int, schema):
    """A cell's k best of each query; a score below all longs is null, since it may be a cell's best without being one of all."""
    import pyarrow as pa

    out: list[tuple[int, int, int]] = []
    if left.num_rows and right.num_rows:
        c_ids, q_ids, floors = left.column("c_id").to_numpy(), right.column("q_id").to_numpy(), right.column("floor").to_pylist()
        cands, asks = _matrix(left.column("c_vec")), _matrix(right.column("q_vec"))
        for d, (q_at, queries) in asks.items():
            if d not in cands:
                continue
            at, rows = cands[d]
            best: list[list] = [[] for _ in q_at]
            for those, js in ((x, y) for x in _by_size(rows) for y in _by_size(queries)):
                kind = _exact(queries[js], rows[those])
                asked = queries[js].astype(kind)
                for i in range(0, len(those), TREE):
                    part = those[i : i + TREE]
                    tree = Tree(c_ids[at[part]], rows[part])
                    tree.rows, tree.low, tree.high = tree.rows.astype(kind), tree.low.astype(kind), tree.high.astype(kind)
                    bounds = tree.bounds(asked)
                    for n, j in enumerate(js.tolist()):
                        tree.search(q_ids[q_at[j]], asked[n], bounds[n], best[j], k, floors[q_at[j]])
            out += [(int(q_ids[q]), -x, s if s >= -(2**63) else None) for j, q in enumerate(q_at) for s, x in best[j]]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=schema)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    fits = F.forall("x", lambda c: F.coalesce((c * scale >= -(2.0**63)) & (c * scale < 2.0**63), F.lit(False)) & ~F.isnan(c))
    return raw.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(fits).select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _routes(sample, leaves: int):
    """(dim, threshold, left, right) of the inner nodes of median splits into about `leaves` parts; children below zero are parts."""
    import numpy as np

    nodes: list[list] = []
    parts = 0
    todo = [(sample, leaves, -1, 0)]
    while todo:
        rows, n, parent, side = todo.pop()
        wide = int((rows.max(0) - rows.min(0)).argmax()) if len(rows) else 0
        at = np.median(rows[:, wide]) if len(rows) else 0.0
        left = rows[:, wide] < at
        if n < 2 or not left.any():
            me, parts = -parts - 1, parts + 1
        else:
            me = len(nodes)
            nodes.append([wide, float(at), 0, 0])
            todo += [(rows[left], n // 2, me, 2), (rows[~left], n - n // 2, me, 3)]
        if parent >= 0:
            nodes[parent][side] = me
    return [np.array(c) for c in zip(*nodes)] if nodes else None


class Space:
    """Regions of the vectors' space, by length: splits from a sample of SAMPLE rows, boxes over all rows."""

    def __init__(self, rows: DataFrame):
        import numpy as np

        sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(LENGTHS).collect()
        counts = {r.d: r.n for r in sizes if r.d}
        total = sum(counts.values())
        share = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < max(1, int(min(1.0, SAMPLE / max(1, total)) * (1 << 20)))
        drawn = rows.where(F.size("v").isin(list(counts) or [-1]) & share).select("v").limit(2 * SAMPLE).collect()  # bounded
        self.routes: dict[int, list | None] = {}
        for d, n in counts.items():
            mine = np.array([r.v for r in drawn if len(r.v) == d], "f8").reshape(-1, d)
            leaves = min(-(-n // CELL), max(1, REGIONS * n // total), max(1, BOX_NUMBERS // (2 * d * len(counts))), max(1, len(mine) // 4))
            self.routes[d] = _routes(mine, leaves)
        self.boxes: dict[int, tuple] = {}
        self.subs: dict[str, int] = {}
        self.many = False

    def _regions(self, d: int, rows):
        """The region of each row of length d; large vectors have one of their own, lengths without splits share a few."""
        import numpy as np

        if d not in self.routes:
            return np.full(len(rows), f"other/{d % 64}", object)
        out = np.full(len(rows), f"{d}/0", object)
        if (nodes := self.routes[d]) is not None:
            dim, at, left, right = nodes
            node = np.zeros(len(rows), np.int64)
            while (inner := node >= 0).any():
                k = np.flatnonzero(inner)
                n = node[k]
                node[k] = np.where(rows[k, dim[n]] < at[n], left[n], right[n])
            out = np.array([f"{d}/{-x - 1}" for x in node.tolist()], object)
        large = ((rows >= LARGEST) | (rows <= -LARGEST)).any(1)
        out[large] = f"{d}/large"
        return out

    def placed(self, rows: DataFrame) -> DataFrame:
        """(id, v, region)"""

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    region = np.empty(b.num_rows, object)
                    for d, (at, matrix) in _matrix(pa.chunked_array([b.column("v")])).items():
                        region[at] = self._regions(d, matrix)
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(region, pa.string())], ["id", "v", "region"])

        return rows.select("id", "v").mapInArrow(run, "id long, v array<long>, region string")

    def cells(self, placed: DataFrame) -> DataFrame:
        """(c_id, c_vec, cell) of placed rows; finds the regions' boxes and their numbers of cells."""
        import numpy as np

        def partly(batches):
            import pyarrow as pa

            found: dict[tuple, list] = {}
            for b in batches:
                names = np.array(b.column("region").to_pylist(), object)
                for d, (at, matrix) in _matrix(pa.chunked_array([b.column("v")])).items() if b.num_rows else ():
                    for name in np.unique(names[at].astype(str)).tolist():
                        part = matrix[names[at] == name]
                        low, high, n = found.get((name, d), (part[0], part[0], 0))
                        found[name, d] = [np.minimum(low, part.min(0)), np.maximum(high, part.max(0)), n + len(part)]
            for (name, d), (low, high, n) in found.items():
                box = not name.startswith("other/")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([low.tolist() if box else []], pa.list_(pa.int64())), pa.array([high.tolist() if box else []], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["region", "low", "high", "n"])

        parts = placed.select("v", "region").mapInArrow(partly, "region string, low array<long>, high array<long>, n long")
        ends = parts.select("region", F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy("region", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        boxes = ends.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high"))).alias("box"))
        sizes = parts.groupBy("region").agg(F.sum("n").alias("n"))
        found = sizes.join(boxes, "region", "left").orderBy("region").collect()  # REGIONS and a few, BOX_NUMBERS numbers at most
        self.subs = {r.region: -(-r.n // CELL) for r in found}
        self.many = sum(self.subs.values()) > 1
        by_length: dict[int, list] = {}
        for r in found:
            if r.box:
                by_length.setdefault(len(r.box), []).append((r.region, [x.low for x in r.box], [x.high for x in r.box]))
        self.boxes = {d: ([x[0] for x in of], np.array([x[1] for x in of], "f8"), np.array([x[2] for x in of], "f8")) for d, of in by_length.items()}
        subs = F.broadcast(placed.sparkSession.createDataFrame(list(self.subs.items()), "region string, subs int"))  # a row a region
        cell = F.concat("region", F.lit("#"), F.pmod(F.xxhash64("id", "v"), F.col("subs")))
        return placed.join(subs, "region").select(F.col("id").alias("c_id"), F.col("v").alias("c_vec"), cell.alias("cell"))

    def deal(self, homes: DataFrame) -> dict[str, tuple[int, int]]:
        """region -> (first block, blocks) of the queries that begin there: neighbours share a block up to BLOCK queries, a full region has several."""
        found = homes.groupBy(F.substring_index("q_cell", "#", 1).alias("region")).agg(F.count(F.lit(1)).alias("n")).orderBy("region").collect()  # a row a region
        out, at, held = {}, 0, 0
        for r in found:
            if held and held + r.n > BLOCK:
                at, held = at + 1, 0
            blocks = -(-r.n // BLOCK)
            out[r.region] = (at, blocks)
            at, held = (at + blocks, 0) if blocks > 1 else (at, held + r.n)
        return out

    def opened(self, queries: DataFrame, first: bool, deal: dict[str, tuple[int, int]] | None = None) -> DataFrame:
        """(q_id, q_vec, floor, q_cell, q_part) of queries (id, v, floor): the cell that each meets first, or all others that may reach its floor.

        q_part: the block of the query, by deal().
        """
        boxes, subs = self.boxes, self.subs

        def of(d: int, rows, floors):
            """For each query its first region and the regions that it opens."""
            import numpy as np

            if d not in boxes:
                name = f"other/{d % 64}"
                return [(name, [name] if name in subs else [])] * len(rows)
            names, low, high = boxes[d]
            q = rows.astype("f8")
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            bounds = up @ high.T + down @ low.T
            # Rounding of d products and sums is far below this.
            bounds += 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) + 1
            best = bounds.argmax(1)
            least = np.array([-np.inf if f is None else float(f) for f in floors])
            return [(names[h], [names[j] for j in np.flatnonzero(bounds[i] >= least[i]).tolist()]) for i, h in enumerate(best.tolist())]

        def run(batches):
            import zlib

            import pyarrow as pa

            for b in batches:
                ids, floors, out = b.column("id").to_pylist(), b.column("floor").to_pylist(), []
                for d, (at, matrix) in _matrix(pa.chunked_array([b.column("v")])).items() if b.num_rows else ():
                    for i, (home, regions) in zip(at.tolist(), of(d, matrix, [floors[i] for i in at])):
                        mixed = zlib.crc32(str(ids[i]).encode())
                        if home not in subs:
                            continue
                        own = f"{home}#{mixed % subs[home]}"
                        if first:
                            out.append((i, own, 0))
                        else:
                            start, blocks = deal[home]
                            part = start + mixed // subs[home] % blocks
                            out += [(i, c, part) for r in regions for c in (f"{r}#{k}" for k in range(subs[r])) if c != own]
                for a in range(0, len(out), 4096):
                    rows = out[a : a + 4096]
                    at = pa.array([r[0] for r in rows])
                    yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("v").take(at), b.column("floor").take(at), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())], ["q_id", "q_vec", "floor", "q_cell", "q_part"])

        return queries.mapInArrow(run, "q_id long, q_vec array<long>, floor long, q_cell string, q_part long")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank int, id_col, score): each query's k best of all other rows.

    is_query: a function of the id column that says which rows are queries.
    Components become floor(scale * x); the score is the integer inner product;
    ties go to the smaller id.

    A vector that is null, or has a null or non-finite component or one whose
    floor a long can't hold, takes no part, nor does a row without id. A score
    among the best that a long can't hold is an error. Vectors of different lengths don't meet. Rows with
    the query's own id are its own; other repeated rows count as often as they
    stand, and a query repeated with other values is asked once, with its
    smallest. Other columns are ignored. An empty table gives none.
    """
    import pyarrow as pa

    text_batches(vectors.sparkSession)
    rows = quantised(vectors, id_col, vec_col, scale)
    space = Space(rows)
    cands = space.cells(written(space.placed(rows), "top-k-cells"))
    asked = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def meet(cands: DataFrame, queries: DataFrame) -> DataFrame:
        return cands.groupBy("cell", "part").cogroup(queries.groupBy("q_cell", "q_part")).applyInArrow(lambda a, b: _cell(a, b, k, schema), "query_id long, id long, score long")

    # Each query meets one cell first, so the candidates aren't copied; a cell's queries are a share of all of them.
    home = written(space.opened(asked.withColumn("floor", F.lit(None).cast("long")), first=True), "top-k-homes")
    met = meet(cands.withColumn("part", F.lit(0).cast("long")), home)  # as q_part: a cogroup deals ints and longs apart
    if space.many:
        first = written(met, "top-k")
        floors = first.groupBy("query_id").agg(F.when(F.count("score") >= k, F.min("score")).alias("floor"))
        again = written(space.opened(asked.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "floor"), False, space.deal(home)), "top-k-queries")
        # A candidate is copied for the blocks of queries that reach its cell, and for no others.
        pairs = again.select(F.col("q_cell").alias("cell"), F.col("q_part").alias("part")).distinct()
        met = first.unionByName(meet(cands.join(pairs, "cell"), again))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    score = F.coalesce("score", F.raise_error(F.lit("Overflow: a score among the best is below all longs")).cast("long"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), score.alias("score"))
