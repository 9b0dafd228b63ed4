"""Folds over ordered rows whose state depends on what was kept, cut into stretches of bounded length.

A row starts a run or is absorbed by the current one, as a *rule* says from the
run's state and the row before. Runs of a medium can't be told apart by looking
at one stretch of it alone, but what a stretch does to every state that may
enter it can be summed up: the rows at which such a state would first be broken
are the running maxima of the rows' thresholds, and from each of them on all is
known. So

1. each stretch is summed up by itself,
2. the summaries of a medium, a few numbers a stretch, are joined in order, which
   gives the state that enters each stretch,
3. each stretch is run through with its state.

No array is longer than a stretch. Both passes over the rows read one exchange.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds: as `high`, one that every value and one that no value lies under; as `low`, ALWAYS is above all values.
ALWAYS, NEVER = 1 << 62, -(1 << 62)
#: Ids of one stretch.
STRETCH = 4096


@dataclass(frozen=True)
class Rule:
    """A fold whose state is (value, fresh): a number of the row that started the run, and whether all rows since were blank.

    A row starts a run if value <= high (high_fresh in a fresh state), or value >= low.
    columns: what limits, value, blank and after see of a row, as a tuple.
    """

    columns: tuple[str, ...]
    limits: Callable[[tuple | None, tuple], tuple[int, int, int]]  # (row before, row) -> (high, high_fresh, low)
    value: Callable[[tuple], int]
    blank: Callable[[tuple], bool] = lambda row: False
    after: Callable[[tuple | None, tuple], tuple | None] = lambda before, row: None  # what the next row sees as the one before
    joined: Callable[[tuple | None, tuple | None], tuple | None] = lambda before, tail: tail  # `after` of a stretch, given the one before it

    def starts(self, state, before, row) -> bool:
        if state is None:
            return True
        high, fresh, low = self.limits(before, row)
        return (fresh if state[1] else high) >= state[0] or low <= state[0]


State = tuple  # (value, fresh, id of the row that started the run)


def summary(rule: Rule, ids: list[int], rows: list[tuple], first: bool) -> dict:
    """What a stretch does: where a run that starts at its first row ends, and which row breaks a state that comes in.

    In a medium's first stretch (first) no state comes in.
    """
    n = len(rows)
    limits, tail = [None], rule.after(None, rows[0])
    for i in range(1, n):
        limits.append(rule.limits(tail, rows[i]))
        tail = rule.after(tail, rows[i])
    blank, value = [rule.blank(r) for r in rows], [rule.value(r) for r in rows]
    ends: dict[int, tuple] = {}

    def end(i: int) -> tuple:
        path = []
        while i not in ends:
            fresh, j = blank[i], i + 1
            while j < n and not ((limits[j][1] if fresh else limits[j][0]) >= value[i] or limits[j][2] <= value[i]):
                fresh = fresh and blank[j]
                j += 1
            path.append(i)
            if j == n:
                ends[i] = (value[i], fresh, ids[i])
                break
            i = j
        for k in path:
            ends[k] = ends[i]
        return ends[i]

    out = {"end": end(0), "row": rows[0], "tail": tail, "high": [], "low": [], "blank": all(blank[1:]), "blank0": blank[0]}
    if first:
        return out
    lows, low = [], None
    for i in range(1, n):
        if limits[i][2] < ALWAYS and (low is None or limits[i][2] < low):
            low = limits[i][2]
            lows.append((low, i, end(i)))
    turns = {i for _, i, _ in lows}
    out["low"] = lows
    for fresh in (False, True):
        found: list[tuple] = []
        top, turned = None, False
        for i in range(1, n):
            high = limits[i][1] if fresh else limits[i][0]
            fresh = fresh and blank[i]
            turned = turned or i in turns
            if high > NEVER and (top is None or high > top):
                top = high
                # Paths soon run together: thresholds that lead to the same end are one, unless a low one lies between.
                if found and found[-1][2] == end(i) and not turned:
                    found.pop()
                found.append((high, i, end(i)))
                turned = False
            if top == ALWAYS:
                break
        out["high"].append(found)
    return out


def through(rule: Rule, state: State | None, before, s: dict) -> State:
    """The state after a stretch, from the one before it and the stretch's summary."""
    if rule.starts(state, before, tuple(s["row"])):
        return tuple(s["end"])
    value, fresh, start = state
    fresh = fresh and s["blank0"]
    high = next(((i, e) for h, i, e in s["high"][fresh] if h >= value), None)
    low = next(((i, e) for h, i, e in s["low"] if h <= value), None)
    found = min((x for x in (high, low) if x is not None), key=lambda x: x[0], default=None)
    return tuple(found[1]) if found else (value, fresh and s["blank"], start)


def _groups(batches, columns: tuple[str, ...]) -> Iterator[tuple]:
    """(medium, stretch, ids, rows) of sorted batches."""
    key, ids, rows = None, [], []
    for b in batches:
        keys = zip(b.column("media_id").to_pylist(), b.column("stretch").to_pylist())
        for k, i, row in zip(keys, b.column("id").to_pylist(), zip(*[b.column(c).to_pylist() for c in columns])):
            if k != key:
                if ids:
                    yield (*key, ids, rows)
                key, ids, rows = k, [], []
            ids.append(i)
            rows.append(row)
    if ids:
        yield (*key, ids, rows)


def runs(rows: DataFrame, rule: Rule, stretch: int = STRETCH) -> DataFrame:
    """rows (media_id, id, ...) with `run`: the id of the row that started the run a row belongs to.

    Ids are whole numbers, unique in a medium. Rows without a medium are one
    medium in each stretch. Other columns pass through.
    """
    place = F.greatest(F.lit(0), F.floor(F.col("id") / stretch)).cast("long")
    dealt = rows.withColumn("stretch", place).repartition("media_id", "stretch")
    ordered = dealt.sortWithinPartitions("media_id", "stretch", "id")

    def batch(out, names):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.int64(), pa.string()))], names)

    def summed(batches):
        out = []
        for medium, at, ids, of in _groups(batches, rule.columns):
            out.append((medium, at, json.dumps(summary(rule, ids, of, at == 0))))
            if len(out) == 1000:
                yield batch(out, ["media_id", "stretch", "summary"])
                out = []
        if out:
            yield batch(out, ["media_id", "stretch", "summary"])

    def entering(batches):
        medium = state = before = None
        for b in batches:
            out = []
            for m, at, text in zip(*[c.to_pylist() for c in b.columns]):
                if m != medium or at == 0:
                    medium, state, before = m, None, None
                if state is not None:
                    out.append((m, at, json.dumps([state, before])))
                s = json.loads(text)
                state, before = through(rule, state, before, s), rule.joined(before, s["tail"] and tuple(s["tail"]))
            if out:
                yield batch(out, ["media_id", "stretch", "state"])

    def labelled(batches):
        import pyarrow as pa

        key = state = before = None
        for b in batches:
            out = []
            keys = zip(b.column("media_id").to_pylist(), b.column("stretch").to_pylist())
            enters = b.column("state")
            for n, (k, i, row) in enumerate(zip(keys, b.column("id").to_pylist(), zip(*[b.column(c).to_pylist() for c in rule.columns]))):
                if k != key:
                    key, (state, before) = k, json.loads(enters[n].as_py() or "[null, null]")
                    before = before and tuple(before)
                if rule.starts(state, before, row):
                    state = (rule.value(row), rule.blank(row), i)
                else:
                    state = (state[0], state[1] and rule.blank(row), state[2])
                before = rule.after(before, row)
                out.append(state[2])
            keep = [x for x in b.schema.names if x not in ("stretch", "state")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.int64())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import LongType, StructType

    kind = to_arrow_type(rows.schema["media_id"].dataType)
    summaries = ordered.mapInArrow(summed, StructType([rows.schema["media_id"]]).add("stretch", "long").add("summary", "string"))
    states = summaries.repartition("media_id").sortWithinPartitions("media_id", "stretch").mapInArrow(entering, StructType([rows.schema["media_id"]]).add("stretch", "long").add("state", "string"))
    # An outer join asks nothing of the left side, so both passes have the same exchange; an inner one would drop null media before it.
    known = dealt.join(states, ["media_id", "stretch"], "left").sortWithinPartitions("media_id", "stretch", "id")
    out = StructType([rows.schema["media_id"], *[f for f in rows.schema.fields if f.name != "media_id"]]).add("run", LongType())
    schema = to_arrow_schema(out)
    return known.mapInArrow(labelled, out)
