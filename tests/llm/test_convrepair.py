"""Conversation repair against all edit sequences of small conversations, and against its SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cueloom.llm import convrepair, queries, sql

SPACE = " \t\n\x0b\x0c\r"


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits of each row and up to two inserts at each place."""
    fault = faults_of(rows)
    inserts = [()] + [x for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    choices = []
    for (_, role, text), f in zip(rows, fault):
        of = [("D", 3, None)]
        if f not in ("blank", "duplicate"):
            more = f == "truncated"
            of += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        choices.append(of)
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + 2 * sum(map(len, gaps))
            if best and cost > best[0]:
                continue
            made, audit = [], ""
            for k, gap in enumerate(gaps):
                made += [("user" if x == "u" else "assistant", "") for x in gap]
                audit += "I" * len(gap)
                if k < len(edits):
                    audit += edits[k][0]
                    made += [edits[k][2]] if edits[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def expected(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    f = faults_of(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = cheapest(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[f.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()), made


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    role = lambda: r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
    text = lambda: r.choice(["Yes.", "No!", "cut off", "cut off. and ", " \t", "", None, "é?\n"])
    return {c: [(r.choice([None, 0, 1, 2, 3, 9]), role(), text()) for _ in range(r.choice([1, 2, 2, 3, 3]))] for c in range(60)} | {None: [(1, "user", "Hi."), (1, "user", "Hi."), (4, "assistant", "Oh")]}


def test_against_all_edits(spark, talks):
    rows = spark.createDataFrame([(c, *x, 1) for c, of in talks.items() for x in of], "conv_id long, turn long, role string, text string, audit int").repartition(3)
    found = convrepair.plans(rows)
    got = {x.conv_id: tuple(x)[1:] for x in convrepair.digests(rows, found).collect()}
    made = {c: [] for c in talks}
    for x in convrepair.repaired(rows, found).orderBy("conv_id", "place").collect():
        assert (x.edit == "D") == (x.place is None) and (x.edit != "I" or (x.turn is None and x.text == ""))
        if x.place is not None:
            assert x.place == len(made[x.conv_id])
            made[x.conv_id].append((x.role, x.text))
    assert set(got) == set(talks)
    for c, of in talks.items():
        want, repaired = expected(of)
        assert got[c] == want, (c, of)
        assert made[c] == repaired


@pytest.mark.parametrize("stride", [1, 2, 7])
def test_stretches_of_a_long_conversation(monkeypatch, stride):
    """Audits put aside after some rows give what whole audits give."""
    r = random.Random(stride)
    for n in (0, 1, 5, 40, 200):
        for kinds in ("sua", "u", "ua", "suaax"):
            rows = [(r.choice(kinds), r.random() < 0.1, r.random() < 0.3) for _ in range(n)]
            found = []
            for size in (stride, 10**9):
                monkeypatch.setattr(convrepair, "STRIDE", size)
                search = convrepair.Search()
                for row in rows:
                    search.row(*row)
                found.append(search.best())
            assert found[0] == found[1]


def test_a_long_conversation_is_one_row(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), "id", F.lit(".")).alias("text"))
    out = convrepair.digests(rows, convrepair.plans(rows)).collect()
    assert [(x.cost, x.audit) for x in out] == [(0, "K" * n)]
    assert out[0].repaired_sha256 == hashlib.sha256("\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:Turn {i}." for i in range(n)).encode()).hexdigest()


def test_one_exchange_before_the_search(spark, sf_dir):
    rows = convrepair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = convrepair.plans(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert convrepair.plans(none).collect() == [] and convrepair.repaired(none, convrepair.plans(none)).collect() == []
    every = spark.createDataFrame([(5,), (5,), (None,)], "conv_id int")
    out = convrepair.digests(none, convrepair.plans(none, every)).collect()
    assert sorted((str(x.conv_id), *tuple(x)[1:]) for x in out) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in ("5", "None")]


def test_query_equals_sql(spark, sf_dir, tmp_path, talks):
    """On the given table, and on odd rows."""
    odd = spark.createDataFrame([(c, *x) for c, of in talks.items() for x in of], "conv_id long, turn long, role string, text string")
    odd.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for d, files in ((sf_dir, "conversations.parquet"), (str(tmp_path), "conversations.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/{files}'")
        mine = queries.op13_conversation_repair(spark, d)
        assert mine.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        want = con.execute(f"SELECT {', '.join(mine.columns)} FROM ({sql.OP13})").fetchall()
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(want, key=str)
        assert len({tuple(x)[7] for x in want}) > 10
