"""Near-dedup of the pipeline: groups by the whole shingle sets, against all pairs, on both sides of 0.8."""

import numpy as np

import corpus_pipeline as C
from cueloom.llm import shinglesets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def shared(tag, same, own):
    """Two texts with `same` common shingles and `own` of each alone."""
    head = [f"{tag}c{i}" for i in range(same + 4)]
    return [" ".join([*head, *[f"{tag}{x}{i}" for i in range(own)]]) for x in "ab"]


def kept(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return {r.doc_id for r in C.near_dedup(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "").collect()}


def test_pairs_on_both_sides_of_the_similarity(spark):
    # 160 / 200 is 0.8, 159 / 201 and 144 / 216 are less, though 0.67 is often within the radius.
    pairs = [shared(f"at{k}", 160, 20) for k in range(15)] + [shared(f"under{k}", 159, 21) for k in range(15)] + [shared(f"far{k}", 144, 36) for k in range(15)]
    assert kept(spark, [t for p in pairs for t in p]) == {*range(0, 30, 2), *range(30, 90)}


def test_chains_of_less_similar_documents_stay(spark):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words[s : s + 204]) for s in range(0, 390, 30)]
    assert all(not similar(sets(a), sets(b)) for i, a in enumerate(texts) for b in texts[:i])
    assert kept(spark, texts) == set(range(len(texts)))


def test_equal_fingerprints_are_no_proof(spark):
    # The fingerprint of a text that repeats itself is that of what it repeats, if repeats count.
    texts = [" ".join(["again"] * 400 + [f"{x}{i}" for i in range(80)]) for x in "ab"]
    assert kept(spark, texts) == {0, 1}


def test_cells_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(shinglesets, "BLOCK", 4)
    rng = np.random.default_rng(1)
    base, texts = [f"b{i}" for i in range(300)], []
    for k in range(40):
        w = list(base)
        for i in rng.choice(300, int(rng.integers(0, 9)), False):
            w[i] = f"x{k}y{i}"
        texts.append(" ".join(w))
    found = [sets(t) for t in texts]
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if similar(found[a], found[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert kept(spark, texts) == {i for i in range(40) if root[i] == i} and len(set(root)) > 1


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for k in range(60):
        held = [np.unique(rng.integers(0, 14, int(rng.integers(0, 14))).astype(np.uint64)) for _ in range(12)]
        # All of them to do, or some of them one class already.
        todo = np.ones(12, bool) if k % 2 else rng.random(12) < 0.5
        settled = np.flatnonzero(~todo).tolist()
        classes = [(a, settled[0]) for a in settled[1:]]
        pairs = [(a, b) for a in range(12) for b in range(a) if (todo[a] or todo[b]) and similar(set(held[a].tolist()), set(held[b].tolist()))]
        want, got = list(range(12)), list(range(12))
        for root, edges in ((want, classes + pairs), (got, classes + shinglesets.linked(np.arange(12), held, todo))):
            for a, b in edges:
                x, y = root[a], root[b]
                root[:] = [min(x, y) if r in (x, y) else r for r in root]
        assert want == got


def test_documents_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    found = [sets(r.text) for r in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if similar(found[a], found[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert {r.doc_id for r in C.near_dedup(spark, docs, sf_dir).collect()} == {rows[i].doc_id for i in range(len(rows)) if root[i] == i}


def test_links_do_not_depend_on_other_rows(spark):
    pair = shared("pair", 160, 20)
    others = [" ".join(f"o{k}w{i}" for i in range(30)) for k in range(400)]
    assert kept(spark, pair) == {0} and kept(spark, [*pair, *others]) == {0, *range(2, 402)}


def test_bands_find_pairs_at_the_similarity():
    # 0.8 ** 4 a band: of 2000 pairs at exactly 0.8 a miss is expected in 0.006 of them, and at 0.2 keys are rarely shared.
    rng = np.random.default_rng(5)
    multipliers, mixers = shinglesets.hash_family()
    met = {}
    for same, own in ((160, 20), (40, 80)):
        h = rng.integers(0, 2**64, (2000, same + 2 * own), np.uint64)
        met[same] = sum(bool((shinglesets.band_keys(x[: same + own], multipliers, mixers) == shinglesets.band_keys(np.concatenate([x[:same], x[same + own :]]), multipliers, mixers)).any()) for x in h)
    assert met[160] == 2000 and met[40] < 200


def test_hot_sets_are_salted(spark):
    texts = ["same words here again and again"] * 300 + ["other words of another text stand here"] * 5 + [f"text number {i} stands alone in its group" for i in range(10)]
    assert kept(spark, texts) == {0, 300, *range(305, 315)}


def test_rows_that_share_an_id(spark):
    a, b = shared("one", 160, 20)
    c, d = shared("two", 160, 20)
    rows = [(7, a, "en", "s", 1), (7, c, "en", "s", 1), (7, c, "en", "s", 1), (8, b, "en", "s", 1), (9, d, "en", "s", 1), (10, "nothing like the others stands in this one", "en", "s", 1), (None, a, "en", "s", 1)]
    out = C.near_dedup(spark, spark.createDataFrame(rows, COLUMNS).repartition(3), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["10", "7", "7", "7", "None"]


def test_a_chain_away_from_its_leader(spark, monkeypatch):
    """Texts that only neighbours link: hardly any is near the leader, over many blocks."""
    monkeypatch.setattr(shinglesets, "BLOCK", 5)
    words = [f"w{i}" for i in range(2000)]
    chain = [" ".join(words[s : s + 400]) for s in range(0, 1200, 40)]
    assert all(similar(sets(a), sets(b)) == (abs(i - j) < 2) for i, a in enumerate(chain) for j, b in enumerate(chain[:i]))
    assert kept(spark, chain + [" ".join(f"z{k}x{i}" for i in range(50)) for k in range(5)]) == {0, *range(30, 35)}
