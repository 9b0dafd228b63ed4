"""Operators against brute-force versions, on the small tables and on odd rows."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueloom.llm.common import written
from cueloom.llm import bpe, knn, licenses, linededup, packing, quality, queries, sharding, simhash, substring, urlfilter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def ids_of(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_packing_is_a_round_trip(request, tok, which):
    docs = request.getfixturevalue(which)
    pieces = packing.pack(docs, VOCABULARY, 256).collect()
    want = Counter((i, np.append(ids_of(tok, t), 2).astype("<u4").tobytes()) for i, t in texts_of(docs))
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length and 0 < p.length <= 256
    assert sorted(by_seq) == list(range(len(by_seq)))
    fill = []
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        fill.append(at)
    assert all(x == 256 for x in fill[:-1])
    stream = b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)))
    got, open_ = Counter(), {}
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        open_.setdefault("x", []).append(bytes(p.ids))
        assert p.start == sum(map(len, open_["x"][:-1])) // 4
        if sum(map(len, open_["x"])) == 4 * p.doc_tokens:
            got[p.doc_id, b"".join(open_.pop("x"))] += 1
    assert got == want and len(stream) == sum(4 * len(b) // 4 * n for (_, b), n in want.items()) and at == 0


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_bpe_equals_the_library(request, tok, which):
    docs = request.getfixturevalue(which)
    want = Counter()
    for i, t in texts_of(docs):
        ids = ids_of(tok, t)
        want[i, len(ids), ids.tobytes(), tok.decode(ids.tolist(), skip_special_tokens=False)] += 1
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_decode(docs, VOCABULARY, block_bytes=40_000).collect())
    assert got == want


@pytest.mark.parametrize("fault", ["none", "words differ", "pieces lost", "other blocks"])
def test_bpe_survives_other_blocks(documents, odd, tok, fault):
    """A block whose words don't fit its pieces encodes them in place, with the library's ids."""
    for docs in (documents, odd):
        named = docs.select(F.col("doc_id").alias("id"), "text").coalesce(2)
        pieces = bpe.block_words(named, VOCABULARY, 8, 40_000)
        table = bpe.word_ids(pieces, VOCABULARY)
        # Ids of other words stand where the checksum is wrong, so using them would show.
        table = {
            "none": table,
            "words differ": table.withColumn("check", F.col("check") + 1).withColumn("ids", F.lit(None).cast("binary")),
            "pieces lost": table.where("(of + bucket) % 2 = 0"),
            "other blocks": table.withColumn("of", F.col("of") + 1),
        }[fault]
        got = bpe.rejoined(bpe.blocked(named, 40_000), table, VOCABULARY, 8, named.schema["id"].dataType)
        want = Counter((i, x.tobytes(), tok.decode(x.tolist(), skip_special_tokens=False)) for i, t in texts_of(docs) for x in [ids_of(tok, t)])
        assert Counter((r.id, bytes(r.ids), r.decoded) for r in got.collect()) == want


def test_bpe_encodes_each_word_of_a_bucket_once(spark, documents):
    """The table's pieces of a bucket stand together in a task, in which its words are kept."""
    pieces = bpe.block_words(documents.select("doc_id", "text"), VOCABULARY, 8, 40_000)
    plan = bpe.word_ids(pieces, VOCABULARY)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Sort \[bucket", plan) and "hashpartitioning(bucket" in plan


def key_of(line):
    return ascii_lower(line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_line_dedup(request, which):
    docs = request.getfixturevalue(which)
    rows = texts_of(docs)
    holders, top = Counter(), {}
    for i, t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            holders[k] += 1
            top[k] = max((x for x in (top.get(k), i) if x is not None), default=None)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < 20 or holders[key_of(x)] < 3 or top[key_of(x)] == i]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = linededup.dedup_lines(docs, block_bytes=30_000)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert set(docs.columns) <= set(out.columns)


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_substring_dedup(request, which):
    docs = request.getfixturevalue(which)
    rows = texts_of(docs)
    count = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [words(t)] for k in range(len(w) - 34))
    want = Counter()
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(35)}
        want[i, len(w), len(gone), tuple(x for k, x in enumerate(w) if k not in gone)] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, tuple(words(r.text))) for r in substring.dedup_substrings(docs, block_bytes=30_000).collect())
    assert got == want


def test_word_hashes_over_chunks():
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["a", "bc", "x" * 300, "é" * 40, "\n\t"]) for _ in range(3000)) + " " + "z" * 200_000 + " tail"
    h = substring.word_hashes(text)
    by = defaultdict(set)
    for w, x in zip(words(text), h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    a = substring.rolled(h, 35)
    assert np.array_equal(a, np.concatenate([substring.rolled(h[i : i + 35], 35) for i in range(len(h) - 34)]))


def test_cover_has_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def fingerprint(text, k=4):
    w = words(ascii_lower(text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash_groups(request, which):
    docs = request.getfixturevalue(which)
    rows = sorted((x for x in texts_of(docs) if x[0] is not None), key=lambda x: x[0])
    fps = [fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    want = Counter((rows[i][0], fps[i], rows[root[i]][0]) for i in range(len(rows)))
    got = simhash.groups(docs).collect()
    assert Counter((r.doc_id, r.fp0 % 2**64, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [None] * sum(i is None for i, _ in texts_of(docs))


def test_hot_keys_lose_no_link(spark):
    rnd = random.Random(1)
    found = set()
    for _ in range(3):
        base = rnd.getrandbits(64)
        for _ in range(150):
            x = base
            for _ in range(rnd.randrange(8)):
                x ^= 1 << rnd.randrange(64)
            found.add(x)
    fps = sorted(found)
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    nodes = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "node long, fp0 long").withColumn("keys", simhash.segment_keys(simhash.cover(4, 6)))
    for cap in (40, 4096):
        got = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, 1, cap)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_components_of_a_chain_and_none(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}
    assert simhash.components(chain.limit(0)).count() == 0


def test_top_k(spark, sf_dir, monkeypatch):
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = [(9001, None), (9002, [1.0, None]), (9003, [float("nan")] * 64), (9004, [float("inf")] * 64), (9100, [0.5, 0.25]), (9005, [1.0, 2.0]), (9006, [-1e300] * 64), (None, [0.1] * 64)]
    ties = [(9200, [0.5] * 64), (9201, [0.5] * 64), (9202, [0.5] * 64)]
    rows = raw.union(spark.createDataFrame(bad + ties, raw.schema))
    got = sorted(tuple(r) for r in knn.top_k(rows, lambda i: i % 100 == 0).collect())
    vecs = {r.vec_id: np.floor(np.array(r.embedding) * 1024).astype(int) for r in raw.collect()} | {i: np.floor(np.array(v) * 1024).astype(int) for i, v in [*ties, bad[4], bad[5]]}
    want = []
    for q in (i for i in vecs if i % 100 == 0):
        best = sorted((-int(vecs[q] @ v), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert knn.top_k(rows.limit(0), lambda i: i % 100 == 0).count() == 0
    # Many cells and blocks: the first round's kth score prunes the others.
    monkeypatch.setattr(knn, "CELL", 20)
    monkeypatch.setattr(knn, "LENGTHS", 1)
    assert sorted(tuple(r) for r in knn.top_k(rows, lambda i: i % 100 == 0).collect()) == sorted(want)


def test_top_k_with_groups_in_many_partitions(spark, sf_dir, monkeypatch):
    """Candidates and queries of a cell meet where partitions aren't joined into one, with one cell and with many."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vecs = {r.vec_id: np.floor(np.array(r.embedding, "f8") * 1024).astype(int) for r in rows.collect()}
    want = []
    for q in (i for i in vecs if i % 100 == 0):
        best = sorted((-int(vecs[q] @ v), i) for i, v in vecs.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for cell in (knn.CELL, 20):
            monkeypatch.setattr(knn, "CELL", cell)
            assert sorted(map(tuple, knn.top_k(rows, lambda i: i % 100 == 0).collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_regions_are_pruned_before_the_shuffle(spark, monkeypatch):
    """Clustered vectors: far fewer (query, cell) pairs than all are formed, candidates are copied for few blocks, and no neighbour is lost."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(16, 8)) * 40
    points = np.concatenate([c + rng.normal(size=(100, 8)) for c in centres] + [np.repeat(centres[:1], 400, 0)])  # a fifth are copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(knn, "CELL", 50)
    monkeypatch.setattr(knn, "BLOCK", 8)
    formed = []
    opened = knn.Space.opened
    monkeypatch.setattr(knn.Space, "opened", lambda self, *a, **k: formed.append((self, opened(self, *a, **k))) or formed[-1][1])
    got = sorted(map(tuple, knn.top_k(rows, lambda i: i % 20 == 0).collect()))
    whole = np.floor(points * 1024).astype(np.int64)
    want = []
    for q in range(0, len(points), 20):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    space, pairs = formed[1]
    cells, queries = sum(space.subs.values()), len(range(0, len(points), 20))
    assert cells >= 20 and len(space.subs) >= 12 and pairs.count() < queries * cells / 2
    assert pairs.select("q_part").distinct().count() >= 4 and pairs.groupBy("q_cell", "q_part").count().agg(F.max("count")).first()[0] <= 16


def test_packing_offsets_beyond_a_broadcast(odd):
    tokens = written(packing.encoded(odd.select("doc_id", "text"), VOCABULARY), "pack")
    key = lambda df: Counter((r.id, r.start, r.length, r.sequence_id, r.offset, bytes(r.ids)) for r in df.collect())
    assert key(packing.cut(tokens, 256)) == key(packing.cut(tokens, 256, 0))


def test_packing_query(spark, sf_dir, tok):
    """The query at its own length: pieces' checksums, gapless sequences, every id once."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: np.append(ids_of(tok, t), 2).astype("<u4").tobytes() for i, t in docs.items()}
    seqs, seen = defaultdict(list), Counter()
    for r in queries.op1_packing(spark, sf_dir).collect():
        part = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert (r.ids_crc32, r.doc_tokens, len(part)) == (zlib.crc32(part), len(ids[r.doc_id]) // 4, 4 * r.length)
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id] += r.length
    assert seen == {i: len(x) // 4 for i, x in ids.items()}
    ends = {s: [a + n for a, n in sorted(v)] for s, v in seqs.items()}
    assert all([0, *e[:-1]] == [a for a, _ in sorted(seqs[s])] and e[-1] <= 4096 for s, e in ends.items())
    assert [e[-1] for _, e in sorted(ends.items())][:-1] == [4096] * (len(ends) - 1)


def test_clashing_working_columns(spark, odd):
    """Columns named like the operators' own working columns pass through unchanged."""
    names = ["__work", "__row", "__found", "__host", "__path", "__rule", "__h", "__bucket", "__number", "__place", "__side", "of", "block", "payload", "h", "id", "bucket", "key", "node", "part"]
    docs = odd.select("doc_id", "text", *[F.lit(f"kept {n}").alias(n) for n in names])
    for out in (quality.judge(docs), linededup.dedup_lines(docs), substring.dedup_substrings(docs), sharding.assign(docs, ["doc_id", "text"]), urlfilter.judge(docs.withColumn("url", F.col("text")), queries.URL_RULES), urlfilter.judge(docs.withColumn("url", F.col("text")), queries.URL_RULES, max_trie_bytes=0)):
        rows = out.collect()
        assert len(rows) == 24 and all(r[n] == f"kept {n}" for r in rows for n in names)
    for out in (packing.pack(docs, VOCABULARY), bpe.encode_decode(docs, VOCABULARY), simhash.groups(docs), licenses.scan(docs.withColumn("path", F.lit("a/b")))):
        assert out.count() >= 24


def test_url_filter(spark, sf_dir):
    extra = [(-1, None), (-2, "x"), (-3, "HTTP://A.Example.ORG"), (-4, "a://example.org/en/1?x"), (-5, "a://example.org/en/2"), (-6, "a://x.com/de/"), (-7, "a://com/fr/q#z"), (-8, "a://notexample.org/es/a"), (-9, "a://org/?"), (-10, "a\nb://org//x://y"), (-11, "://"), (-11, "://")]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").union(spark.createDataFrame(extra, "page_id long, url string")).withColumn("host", F.lit(1))
    rules = [*queries.URL_RULES, ("example.com/en/7", "allow"), ("example.com/en/7", "block"), ("", "allow")]

    def brute(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (ascii_lower(m[1]), m[2]) if m else ("", "")
        best = max(((len(h.split(".")) if h else 0, len(p), v == "block", r, v) for r, v in rules for h, p in [urlfilter.split_rule(r)] if (not h or host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, 0, None, "allow"))
        return host, path, *best[3:]

    for limit in (urlfilter.MAX_TRIE_BYTES, 0):
        got = urlfilter.judge(pages, rules, max_trie_bytes=limit)
        assert got.count() == pages.count()
        for r in got.collect():
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url)
    table = spark.createDataFrame(rules, "rule string, verdict string")
    assert urlfilter.judge(pages, table).where("verdict = 'block'").count() == urlfilter.judge(pages, table, max_trie_bytes=0).where("verdict = 'block'").count() > 0


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 5, 24, 25, 100, 901, 4000):
        a = math.isqrt(n - 1) + 1
        rows = spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(a).cast("long")).alias("p"), sharding.root_above(F.lit(n).cast("long")).alias("a")).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and {r.a for r in rows} == {a}


def xxh(seed, *numbers):
    """XXH64 of each number's little-endian bytes, (value, width) each, with the hash before it as seed; signed."""
    for value, width in numbers:
        seed = xxhash.xxh64_intdigest(value.to_bytes(width, "little", signed=True), seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_places(ids, shards):
    """id -> (shard, slot) by plain integers: ids in the order of their hashes, a network over a square, cycles walked."""
    n = len(ids)
    a = math.isqrt(n - 1) + 1

    def network(x):
        left, right = divmod(x, a)
        for k in range(sharding.ROUNDS):
            left, right = right, (left + xxh(42, (right, 8), (sharding.SEED, 4), (k, 4))) % a
        return left * a + right

    out = {}
    for number, i in enumerate(sorted(ids, key=lambda i: xxh(42, (i, 8)))):
        place = network(number)
        while place >= n:
            place = network(place)
        out[i] = (place % shards, place // shards)
    return out


@pytest.mark.parametrize("n", [1, 2, 23, 24, 500, 5000])
def test_shards_by_brute_force(spark, n):
    rows = spark.range(n).select((F.col("id") * 7 - 3).alias("doc_id"))
    want = brute_places([7 * i - 3 for i in range(n)], 24)
    for bits in (None, 0, 3, 16):
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign(rows, ["doc_id"], bits=bits).collect()} == want


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_shards(request, which):
    docs = request.getfixturevalue(which).withColumn("__h", F.lit(1)).withColumn("__bucket", F.lit("x"))
    first, again = (sharding.assign(d, ["doc_id", "text"], 7).collect() for d in (docs, docs.repartition(2)))
    key = lambda rows: Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows)
    assert key(first) == key(again) and first[0]["__h"] == 1
    slots = defaultdict(list)
    for r in first:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def features_of(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return w, len(repeated), lines, sum(c in "#*$%&|<>" for c in text)


def rejected(text):
    """The names of all rules that reject a text, each computed on its own."""
    w, n_repeated, lines, n_symbols = features_of(text)
    n, chars = len(w), sum(map(len, w))
    letters, upper = (sum(unicodedata.category(c) in kinds for c in text) for kinds in (("Lu", "Ll", "Lt", "Lm", "Lo"), ("Lu",)))
    found = {
        "few_words": n < 10,
        "repetition": 100 * n_repeated > 20 * n,
        "symbols": 10 * n_symbols > n,
        "word_length": 2 * chars < 5 * n or chars > 12 * n,
        "repeated_lines": 2 * (len(lines) - len(set(lines))) > len(lines),
        "few_letters": 10 * sum(any(unicodedata.category(c)[0] == "L" for c in x) for x in w) < 7 * n,
        "upper_case": 10 * upper > 6 * letters,
        "stuttering": 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * n,
    }
    return {k for k, v in found.items() if v}


def test_quality(spark, odd, documents):
    more = [(900 + i, t) for i, t in enumerate(["a b c d e f g h i j " * 3, "one two three four five six\nseven eight nine ten\televen", "WORD IN UPPER CASE THROUGHOUT ALL OF THE TEXT HERE", " ".join(f"x{i}" for i in range(40)) + " x0 x1 x2 x3 x4 x5", "# a * b $ c % d & e | f < g > h i j k l m n"])]
    for docs in (odd.withColumnRenamed("n_words", "__work"), documents, spark.createDataFrame(more, "doc_id long, text string")):
        got = quality.judge(docs).collect()
        for r in got:
            t = r.text or ""
            w, n_repeated, lines, n_symbols = features_of(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), n_symbols, len(lines) - len(set(lines)), n_repeated)
            why = rejected(t)
            assert r.base_failed == bool(why & {"few_words", "repetition"}) and r.kept == (not why) and (r.rejected_by in why if why else r.rejected_by is None)
        assert Counter((r.doc_id, r.text) for r in quality.kept(docs).collect()) == Counter((r.doc_id, r.text) for r in got if r.kept)
        assert quality.kept(docs).columns == docs.columns


def test_quality_order_changes_no_verdict(documents):
    names = list(quality.rules(quality.measures(F.col("text"), F.array()), F.col("text"), F.array()))
    kept = [sorted(r.doc_id for r in documents.where(quality.rejected_by(F.col("text"), o).isNull()).select("doc_id").collect()) for o in (names, names[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) > 0
    assert quality.ordered({"slow": (2.0, 0.5), "fast": (0.1, 0.1), "never": (0.1, 0.0)}) == ["fast", "slow", "never"]


def test_quality_sample_is_drawn_over_the_table(spark):
    rows = spark.range(20000).selectExpr("cast(id as string) AS text")
    drawn = [int(r.text) for r in quality.sampled(rows, "text", 256).collect()]
    assert 128 < len(drawn) <= 512 and min(drawn) < 2000 and max(drawn) > 18000
    assert quality.sampled(rows.limit(5), "text", 256).count() == 5


def test_quality_follows_the_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    j = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).join(labels, "doc_id")
    bad = j.where("quality = 0")
    good = j.where("quality = 1 and n_words >= 10 and not base_failed")
    assert bad.where("kept").count() <= 0.05 * bad.count() and good.where("not kept").count() == 0


def brute_license(text, templates, df, n, threshold=0.6):
    """All units against all templates, with dictionaries and no bound."""
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in {w for ts in templates.values() for t in ts for w in licenses.terms(t)}}
    weigh = lambda ws: {w: k * idf.get(w, math.log(n + 1) + 1) for w, k in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, v, norm(v)) for name, ts in sorted(templates.items()) for t in ts for v in [weigh(licenses.terms(t))]]
    lines = (text or "").split("\n")
    best = lambda unit: max(((round(sum(x * u.get(w, 0) for w, x in v.items()) / nv / norm(u), 9), -j) for u in [weigh(unit)] for j, (_, v, nv) in enumerate(vectors)), default=(0, 0)) if unit else (0, 0)
    found = [licenses.terms(x) for x in lines]
    units = [(i, u) for i, u in enumerate(found)] + [(i, licenses.terms(x)) for i, line in enumerate(lines) for x in re.split(r"(?<=[.!?;])\s+", line)] + [(0, [w for u in found for w in u])]
    start = None
    for i, line in enumerate([*lines, ""]):
        if line.strip():
            start = i if start is None else start
        elif start is not None:
            units.append((start, [w for u in found[start:i] for w in u]))
            start = None
    top = max((s, -i, j) for i, u in units for s, j in [best(u)])
    return (vectors[-top[2]][0], top[0], -top[1]) if top[0] >= threshold else (None, 0.0, -1)


@pytest.mark.parametrize("which", ["documents", "odd", "written"])
def test_licenses_against_all_units(request, spark, which):
    templates = licenses.standard_templates()
    mit, bsd = templates["MIT"][-1], templates["BSD-3-Clause"][-2]
    wrapped = "\n".join("# " + " ".join(mit.split()[i : i + 2]) for i in range(0, len(mit.split()), 2))
    texts = [
        "Licensed under the MIT License zeta eta theta iota kappa lambda", "Licensed under the ISC License", "GNU General Public License, version 2", "licensed under the GNU Lesser General Public License, version 2.1",
        mit, "Copyright Someone Unknown\n\n" + wrapped + "\n\ncode = here", bsd.replace(". ", ".\n"), "SPDX-License-Identifier: MPL-2.0", "zeta eta theta", "a word or two", "prose first. Released under CC0 1.0. prose after it",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") if which == "written" else request.getfixturevalue(which).where(F.length("text") < 20000).select("doc_id", "text")
    rows = texts_of(docs)
    known = {w for ts in templates.values() for t in ts for w in licenses.terms(t)}
    df = Counter(w for _, t in rows for w in known.intersection(licenses.terms(t or "")))
    got = Counter((r.doc_id, r.own_license, round(r.score, 7), r.line) for r in licenses.scan(docs.withColumn("path", F.lit("a/b")).withColumn("line", F.lit("clash"))).collect())
    want = Counter((i, name, round(score, 7), line) for i, t in rows for name, score, line in [brute_license(t, templates, df, len(rows))])
    if which == "written":
        # Runs of lines that could match by themselves are units of the operator alone; a paragraph or the whole text holds these here.
        by_id = {i: name for i, name, *_ in got}
        assert [by_id[i] for i in range(1, 11)] == ["ISC", "GPL-2.0", "LGPL-2.1", "MIT", "MIT", "BSD-3-Clause", "MPL-2.0", None, None, "CC0-1.0"]
        assert len(wrapped.split("\n")) > 80
    assert got == want


def test_a_license_among_more_unknown_terms(spark):
    """Five known and six unknown terms: under half of them known, yet over the threshold where licenses are rare."""
    one = spark.createDataFrame([(-1, "Licensed under the MIT License zeta eta theta iota kappa lambda")], "doc_id long, text string")
    files = one.unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("filler"), "id").alias("text"))).withColumn("path", F.lit("x"))
    assert [(r.doc_id, r.own_license) for r in licenses.scan(files).where("own_license is not null").collect()] == [(-1, "MIT")]


def test_licenses(spark, odd, documents, tmp_path):
    wanted = {i for i, t in texts_of(documents) if re.search("licensed under|released under the mit", (t or "").lower())}
    files = documents.withColumn("path", F.concat(F.lit("a/b/"), "doc_id", F.lit(".txt")))
    assert {r.doc_id for r in licenses.scan(files).where("own_license is not null").collect()} == wanted
    (tmp_path / "House.txt").write_text("Members of the house may read this. Others may not.")
    assert licenses.read_templates(spark, str(tmp_path)) == {"House": ["Members of the house may read this. Others may not."]}
    tree = [(1, "LICENSE", "Released under the MIT License."), (2, "a/LICENSE.txt", "words\nLicensed under the Apache License, Version 2.0."), (3, "a/b/c.py", "code"), (4, "x/y.py", None), (5, "z.py", ""), (6, None, "x"), (7, "a/b/d.py", "# Licensed under CC BY-NC 4.0."), (8, "a/COPYING", "Licensed under CC BY 4.0. see"), (3, "a/b/c.py", "code")]
    got = {r.doc_id: (r.own_license, r.license, r.license_dir) for r in licenses.scan(spark.createDataFrame(tree, "doc_id long, path string, text string").withColumn("line", F.lit("clash"))).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: ("Apache-2.0",) * 2 + (None,), 3: (None, "CC-BY-4.0", "a"), 4: (None, "MIT", ""), 5: (None, "MIT", ""), 6: (None, None, None), 7: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 8: ("CC-BY-4.0", "CC-BY-4.0", None)}
    assert licenses.scan(files.limit(0)).count() == 0
    inside = spark.createDataFrame([(1, "f", "Some words go first, as they do. Licensed under the Apache License, Version 2.0. More of them follow after it."), (2, "g", "the weather of the town is the talk of the day and of the evening")], "doc_id long, path string, text string")
    assert {r.doc_id: r.own_license for r in licenses.scan(inside).collect()} == {1: "Apache-2.0", 2: None}


def test_empty_tables(empty):
    assert packing.pack(empty, VOCABULARY).count() == 0
    assert bpe.encode_decode(empty, VOCABULARY).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert substring.dedup_substrings(empty).count() == 0
    assert simhash.groups(empty).count() == 0
    assert sharding.assign(empty, ["doc_id"]).count() == 0
    assert quality.judge(empty).count() == 0
    assert urlfilter.judge(empty.withColumnRenamed("text", "url"), queries.URL_RULES).count() == 0


def test_contract_columns(spark, sf_dir):
    """The thin queries: digests of what the operators return."""
    q = queries.queries()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in q["op9_sharding"](spark, sf_dir).collect():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 24
    for r in q["op4_substring_dedup"](spark, sf_dir).where("n_removed = 0").collect():
        assert r.kept_sha256 == hashlib.sha256(" ".join(words(docs[r.doc_id])).encode()).hexdigest()
    for r in q["op8_simhash"](spark, sf_dir).collect():
        assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id <= r.doc_id


def test_common_lines_go_to_many_tasks(spark):
    """A hash of a third of all rows is salted; each block gets its verdicts all the same."""
    held = spark.createDataFrame([(b, h) for b in range(300) for h in (b"everywhere", f"own{b}".encode(), f"pair{b // 2}".encode())], "of long, h binary")
    verdicts = spark.createDataFrame([(b"everywhere", 7, 300), *[(f"pair{b}".encode(), b, 2) for b in range(150)]], "h binary, top long, blocks long")
    got = linededup._to_blocks(held, verdicts, 900)
    assert sorted((r.of, bytes(r.h), r.top) for r in got.collect()) == sorted([(b, b"everywhere", 7) for b in range(300)] + [(b, f"pair{b // 2}".encode(), b // 2) for b in range(300)])
    assert got.where("h = X'65766572797768657265'").select(F.spark_partition_id()).distinct().count() > 1 or "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_license_scores_are_those_of_dense_vectors():
    """Postings give the cosine of whole vectors, also where templates share few terms."""
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    templates = {f"l{k}": [" ".join(r.choices(vocabulary[k : k + 30], k=40))] for k in range(20)}
    df = {w: r.randrange(50) for w in vocabulary}
    scanner = licenses.Scanner(templates, df, 60, 0.2)
    for _ in range(50):
        unit = r.choices([*vocabulary, "x", "y"], k=r.randrange(1, 50))
        idf = lambda w: scanner.idf.get(w, scanner.unseen)
        vector = lambda c: {w: k * idf(w) for w, k in c.items()}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        u = vector(Counter(unit))
        scores = []
        for name in scanner.names:
            t = vector(Counter(licenses.terms(templates[name][0])))
            scores.append(round(sum(x * t.get(w, 0) for w, x in u.items()) / norm(u) / norm(t), 9))
        score, j = scanner.best(unit)
        assert (score, j) == (0.0, 0) and max(scores) < 0.2 or abs(score - max(scores)) < 1e-8 and scores[j] >= max(scores) - 1e-8
