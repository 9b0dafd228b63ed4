"""The toxicity grammar's transducers, learned stems, and accuracy on held-out documents."""

import itertools
import math
import zlib

import pytest
from pyspark.sql import functions as F

from cueloom.llm import queries, toxicity
from cueloom.llm.toxicity import Grammar, Model

GRAMMAR = Grammar({"idiot": 4.0, "scum": 3.0, "lowei": 2.0})


@pytest.mark.parametrize(
    "clause, want",
    [
        ("the idiot of the house", ("plain", 4.0)),
        ("you are an idiot", ("aimed", 4.0)),
        ("an idiot are you", ("aimed", 4.0)),
        ("idiots and scum and scum", ("plain", 7.0)),  # a word counts once a clause
        ("he is not an idiot", ("negated", 4.0)),
        ("not one two three idiot", ("plain", 4.0)),  # beyond the negation's reach
        ("not an idiot nor scum and more scum far off", ("negated", 7.0)),
        ("not now idiot and then some way off scum", ("plain", 7.0)),  # one match is not negated
        ("she said idiot", ("reported", 4.0)),
        ("idiot she said", ("plain", 4.0)),
        ("i will kill you", ("threat", 3.0)),
        ("you idiot i will kill", ("threat", 7.0)),
        ("i will kill time", None),
        ("you and not me", None),
        ("skidiot", None),  # a stem begins a word
        ("loweister", ("plain", 2.0)),
        ("", None),
    ],
)
def test_clauses(clause, want):
    assert GRAMMAR.clause(clause) == want


def test_the_composed_table_is_the_transducers_side_by_side():
    parts = [toxicity.negation(), *[toxicity.flag(s, n) for s, n in ((toxicity.REPORT, "reported"), (toxicity.TARGET, "aimed"), (toxicity.THREAT, "threat"))]]
    moves, says = toxicity.composed(*parts)
    assert len(moves) == 4 * 2 * 2 * 2
    for word in itertools.product(range(6), repeat=5):
        at, state = [0] * len(parts), 0
        for symbol in word:
            at, state = [p.next(s, symbol) for p, s in zip(parts, at)], moves[state][symbol]
        assert says[state] == {p.says[s] for p, s in zip(parts, at) if s in p.says}


def test_texts():
    found = GRAMMAR.matches("Good day. You IDIOT, not scum!\nLong " + "w " * 50_000 + "lowei")
    assert [(k, w) for k, w, _ in found] == [("aimed", 4.0), ("negated", 3.0), ("plain", 2.0)]
    assert GRAMMAR.matches(None) == GRAMMAR.matches("") == GRAMMAR.matches(" \n") == []
    assert toxicity.features([("aimed", 4.0, ""), ("aimed", 1.0, "")], "three small words") == [0, 5.0, 0, 0, 0, 3]


def corpus(spark, n=600, toxic=lambda i: i % 5 == 0):
    """Documents of random words in which toxic ones hold a word of one of two stems; a third are copies of one toxic document."""
    word = lambda i, k: f"{'bcdfg'[zlib.crc32(f'{i}:{k}'.encode()) % 5]}a{'lmnrs'[zlib.crc32(f'{k}:{i}'.encode()) % 5]}o{k % 7}x".replace("0", "e")
    text = lambda i: ", ".join(" ".join(word(i, k) for k in range(j, j + 4)) for j in range(0, 40, 4))
    rows = [(i, text(i) + (f". {word(i, 90)} zorg{'abcde'[i // 5 % 5]}n {word(i, 91)}. {word(i, 92)} krulm" if toxic(i) else "")) for i in range(n)]
    rows += [(n + i, "unlucky ordinary words stand here, zorgan. krulm") for i in range(n // 2)]
    labels = [(i, 1 if i >= n or toxic(i) else 0) for i, _ in rows]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic long")


def test_stems_are_learned_and_copies_prove_nothing(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, labels)
    assert set(model.stems) == {"zorg", "krulm"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    assert all((got[i] >= 0.7) == (want[i] == 1) for i in got)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs, labels = corpus(spark)
    odd = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, odd)


def test_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (2, 7), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    assert model == Model()
    assert {round(r.score, 6) for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.fit(empty, none) == Model() and toxicity.fit(odd, none.limit(0)) == Model()


def test_odd_rows(spark, odd, empty):
    model = Model({"passage": 4.0}, (1.0,) * 5, 0.0, -2.0)
    docs = odd.withColumn("score", F.lit("mine")).withColumn("Clauses", F.lit(1))
    out = toxicity.score(docs, model)
    assert out.columns == [*odd.columns, "score", "clauses"] and out.count() == odd.count()
    for r in out.collect():
        assert 0 <= r.score <= 1
        assert (r.score > 0.5) == ("passage" in (r.text or "").lower()) == bool(r.clauses)
    assert toxicity.score(empty, model).collect() == []


def test_scores_of_held_out_documents(spark):
    """At sf0.1, where labels suffice: nearly all toxic ones are caught and clean ones left alone."""
    d = "/root/testdata/sf0.1"
    out = queries.op12_toxicity(spark, d)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and math.isfinite(r.score) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.toxic) for x in spark.read.parquet(f"{d}/labels.parquet").collect() if rows[x.doc_id].held_out]
    caught, toxic = sum(p for p, t in held if t), sum(t for _, t in held)
    alarms, clean = sum(p for p, t in held if not t), sum(1 - t for _, t in held)
    assert caught >= 0.85 * toxic and alarms <= 0.005 * clean and toxic > 100
