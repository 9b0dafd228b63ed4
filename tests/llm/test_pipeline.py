"""Each stage of the pipeline against a brute-force version on its own input."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from cueloom.llm.common import tables_written, written
from cueloom.llm.queries import VOCABULARY

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(input, output) rows of each stage, by doc_id."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in C.STAGES:
        done = written(stage(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), done.collect(), docs.columns, done.columns)
        docs = done
    return out


def test_columns_stay(stages):
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after == ["doc_id", "text", "lang", "source", "n_chars"]


def rejected(text):
    w = words(text)
    n = len(w)
    windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    repeated = {i + k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    letters = sum(c.isalpha() for c in text)
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    chars = sum(map(len, w))
    return (
        n < 10
        or 100 * len(repeated) > 20 * n
        or 10 * sum(c in "#*$%&|<>" for c in text) > n
        or 2 * chars < 5 * n
        or chars > 12 * n
        or 2 * (len(lines) - len(set(lines))) > len(lines)
        or 10 * sum(any(c.isalpha() for c in x) for x in w) < 7 * n
        or 10 * upper > 6 * letters
        or 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * n
    )


def test_quality_rules(stages):
    before, after, *_ = stages["quality_rules"]
    assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before if not rejected(r.text or "")}


def test_line_dedup(stages):
    before, after, *_ = stages["line_dedup"]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for r in before:
        for x in r.text.split("\n"):
            holders[key(x)].add(r.doc_id)
    frequent = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if frequent.get(key(x), r.doc_id) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)


def shingles(text, k=5):
    w = words(lower(text))
    return Counter(" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def test_near_dedup(stages):
    """One document of each group that all pairs of a similarity of 0.8 or more link."""
    before, after, *_ = stages["near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    sets = [shingles(r.text).keys() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert [r.doc_id for r in sorted(after, key=lambda r: r.doc_id)] == [rows[i].doc_id for i in range(len(rows)) if find(i) == i]


def test_substring_dedup(stages):
    before, after, *_ = stages["substring_dedup"]
    count = Counter(tuple(w[k : k + 35]) for r in before for w in [words(r.text)] for k in range(len(w) - 34))
    got = {r.doc_id: words(r.text) for r in after}
    for r in before:
        w = words(r.text)
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert got[r.doc_id] == [x for i, x in enumerate(w) if i not in gone]


def test_packing(stages):
    before, after, *_ = stages["packing"]
    tok = Tokenizer.from_file(VOCABULARY)
    tok.no_truncation()
    tok.no_padding()
    parts = defaultdict(list)
    for p in after:
        parts[p.doc_id].append(p)
    for r in before:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in sorted(parts[r.doc_id], key=lambda p: p.start)) == ids


def test_run_applies_the_stages_and_tidies_up(spark, sf_dir, stages):
    before = tables_written()
    assert C.run(spark, sf_dir).count() == len(stages["packing"][1])
    # The last stage's documents and its encoded ids are still read by the result.
    assert len(tables_written()) == len(before) + 2


def test_stages_take_odd_rows(spark, odd, sf_dir):
    docs = odd
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        assert name == "packing" or docs.columns == odd.columns
    assert docs.count() > 0
    docs = odd.limit(0)
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0
