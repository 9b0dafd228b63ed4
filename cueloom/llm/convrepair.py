"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

Rows are dealt by conversation and sorted, and one pass over the sorted rows
repairs each conversation by a forward Viterbi search over four grammar states:
nothing yet, after `s`, after `u`, after `a`. A layer holds the least (cost,
audit) of each state; a row extends it by Keep, Rerole or Delete, and inserts
close it (two at most are ever of use).

The search sees marks of the rows, not their texts. Its audit then meets the
texts in a second sorted pass, which writes or digests the repaired rows as they
come by. So a conversation of any length is never held: what is kept of it is
its audit, a letter a row, and the strings of the four states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches

#: The costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from a state.
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What a reroled or inserted row becomes after a state.
TURN = {EMPTY: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
LEGAL = {"su", "ua", "au"}
#: White space of the contract, for trimming.
SPACES = " \t\n\x0b\x0c\r"
#: Rows after which the states' audits are put aside, so that strings under comparison stay short.
STRIDE = 2048


class Search:
    """The Viterbi search over one conversation's rows."""

    def __init__(self):
        self.layer = {EMPTY: (0, "0")}
        self.done: list[dict[str, tuple[int, str]]] = []  # by stretch: rank letter -> (state's audit so far)
        self.rows = 0
        self._close()

    def _close(self) -> None:
        now = self.layer
        for states, to in (((EMPTY, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
            for s in states:
                if s in now:
                    cost, audit = now[s]
                    if to not in now or (cost + INSERT, audit + "I") < now[to]:
                        now[to] = (cost + INSERT, audit + "I")

    def row(self, initial: str, delete: bool, truncated: bool) -> None:
        out: dict[int, tuple[int, str]] = {}

        def reach(state, cost, audit):
            if state not in out or (cost, audit) < out[state]:
                out[state] = (cost, audit)

        keeps = NEXT.get(initial, {})
        for state, (cost, audit) in self.layer.items():
            reach(state, cost + DELETE, audit + "D")
            if not delete:
                if state in keeps:
                    reach(keeps[state], cost + truncated * TRUNCATED, audit + "K")
                reach(TURN[state][1], cost + REROLE + truncated * TRUNCATED, audit + "R")
        self.layer = out
        self.rows += 1
        if self.rows % STRIDE == 0:
            self._put_aside()
        self._close()

    def _put_aside(self) -> None:
        """Replaces each audit by its rank among the states.

        Right after a row no audit is the beginning of another: inserts apart
        each has a letter a row, and none ends in an insert. So their order
        stands whatever follows.
        """
        ranked = sorted(self.layer, key=lambda s: self.layer[s][1])
        self.done.append({str(k): self.layer[s][1] for k, s in enumerate(ranked)})
        self.layer = {s: (self.layer[s][0], str(k)) for k, s in enumerate(ranked)}

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, the ASCII-least among equals."""
        cost, audit = min(self.layer[s] for s in (EMPTY, ASSISTANT) if s in self.layer)
        parts = [audit[1:]]
        for stretch in reversed(self.done):
            audit = stretch[audit[0]]
            parts.append(audit[1:])
        return cost, "".join(reversed(parts))


def applied(audit: str, rows: Iterator) -> Iterator[tuple]:
    """(edit, row or None, role or None) in order: the edits of an audit met with a conversation's rows.

    The role is None where the row's own stays or the row goes.
    """
    state = EMPTY
    for edit in audit:
        row = None if edit == "I" else next(rows)
        role = None
        if edit in "IR":
            role, state = TURN[state]
        elif edit == "K":
            state = NEXT[row["role"][:1]][state]
        yield edit, row, role


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) with nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    return out.withColumn("digest", F.md5(F.col("text").cast("binary")))


ORDER = ("turn", "role", "digest")


def plans(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """A row a conversation of rows (conv_id, turn, role, text): its faults and cheapest edits.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost longs, audit). A
    row's first fault counts: blank (nothing but ASCII white space), duplicate
    (role and text seen earlier), truncated (the last other character is none of
    .!?). gaps: turns missing between the least and the largest. illegal: pairs
    of neighbours whose roles' initials are not su, ua or au. Keep costs 0, Rerole
    to user or assistant 2, Delete 3 (the only edit of a blank or duplicate row),
    Insert of an empty turn 2, and a truncated row that stays 1.

    every: (conv_id) of conversations that get a row even without rows, with
    zeros and an empty audit. Rows count in the order of turn (nulls first), then
    role, then the text's MD5. A null role or text is one space; null ids are one
    conversation. Repeated rows are duplicates. Texts are read whole. Other
    columns are left behind. Empty tables give no rows.
    """
    m = _marked(rows)
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    m = m.select("conv_id", "turn", "role", "digest", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"), F.lit(True).alias("real"))
    if every is not None:
        none = every.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(m.schema[c].dataType).alias(c) for c in m.columns[1:-1]], F.lit(False).alias("real"))
        m = m.unionByName(none)
    # One exchange: the window finds its rows together, since they are dealt by a part of its key.
    nth = F.row_number().over(Window.partitionBy("conv_id", "real", "role", "digest").orderBy("turn"))
    # Of rows that agree in all of the order the one that isn't a duplicate comes first.
    m = m.repartition("conv_id").withColumn("again", nth > 1).sortWithinPartitions("conv_id", *ORDER, "again")

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        kinds = [schema.field(n).type for n in names]

        def ended():
            low, high, distinct, faults, illegal, search = now
            cost, audit = search.best()
            return (key, high - low + 1 - distinct if distinct else 0, *faults, illegal, cost, audit)

        key, now, out = None, None, []
        for b in batches:
            for conv, turn, role, blank, cut, real, again in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "real", "again")]):
                if now is None or conv != key:
                    if now is not None:
                        out.append(ended())
                    key, now, last, seen = conv, [None, None, 0, [0, 0, 0], 0, Search()], None, None
                if not real:
                    continue
                if turn is not None and turn != seen:
                    now[0], now[1], now[2], seen = turn if now[0] is None else now[0], turn, now[2] + 1, turn
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    now[3][fault] += 1
                initial = role[:1]
                if last is not None and last + initial not in LEGAL:
                    now[4] += 1
                last = initial
                now[5].row(initial, fault in (0, 1), fault == 2)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if now is not None:
            out.append(ended())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    kind = StructType().add("conv_id", m.schema["conv_id"].dataType)
    for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
        kind = kind.add(n, LongType())
    kind = kind.add("audit", StringType())
    schema = to_arrow_schema(kind)
    return m.mapInArrow(run, kind)


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and their conversation's audit, dealt by conversation and sorted, the audit first."""
    text_batches(rows.sparkSession)
    m = _marked(rows).withColumn("audit", F.lit(None).cast("string"))
    heads = found.select("conv_id", *[F.lit(None).cast(m.schema[c].dataType).alias(c) for c in m.columns[1:-1]], "audit")
    return m.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("audit"), *ORDER)


def _conversations(batches) -> Iterator[tuple]:
    """(conv_id, audit, rows) of sorted batches; the rows of one come by before the next."""
    from itertools import groupby

    rows = (r for b in batches for r in b.to_pylist())
    for conv, mine in groupby(rows, key=lambda r: r["conv_id"]):
        yield conv, next(mine)["audit"], mine


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the edited rows of conversations, by their plans.

    place counts a conversation's repaired rows from 0; it is null for a row that
    goes (edit D). Inserted rows (I) have an empty text and no turn.
    """
    met = _met(rows, found)

    def run(batches):
        import pyarrow as pa

        out = []
        for conv, audit, mine in _conversations(batches):
            place = 0
            for edit, row, role in applied(audit, mine):
                out.append((conv, None if edit == "D" else place, edit, row and row["turn"], role or row["role"], row["text"] if row else ""))
                place += edit != "D"
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], names=schema.names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), schema.types)], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructType

    kind = StructType().add("conv_id", met.schema["conv_id"].dataType).add("place", LongType()).add("edit", StringType()).add("turn", LongType()).add("role", StringType()).add("text", StringType())
    schema = to_arrow_schema(kind)
    return met.mapInArrow(run, kind)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256: the hex SHA-256 of a conversation's repaired `role:text`, joined by newlines.

    SHA-256 is sequential, so a conversation's texts pass by in one task; none of them is kept.
    """
    met = _met(rows, found.select("conv_id", F.to_json(F.struct(*[c for c in found.columns if c != "conv_id"])).alias("audit")))
    kind = found.schema.add("repaired_sha256", "string")

    def run(batches):
        import json

        import pyarrow as pa

        out = []
        for conv, plan, mine in _conversations(batches):
            plan, sha, first = json.loads(plan), hashlib.sha256(), True
            for edit, row, role in applied(plan["audit"], mine):
                if edit != "D":
                    sha.update(f"{'' if first else chr(10)}{role or row['role']}:{row['text'] if row else ''}".encode())
                    first = False
            out.append({"conv_id": conv, **plan, "repaired_sha256": sha.hexdigest()})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return met.mapInArrow(run, kind)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) damaged by crc32(`conv_id:turn`) % 20: a way to make cases of known faults.

    0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it in the
    same turn, 4 makes its role user. Nulls in the key, the role or the text are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    d = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how")).where("how <> 0")
    d = d.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
