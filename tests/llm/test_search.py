"""SimHash classes, ranked search and spelling variants against brute force, and on odd rows."""

import collections
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oarframe.llm import bktree, fmindex, lexical, registry, simhash, spelling

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ODD = [(1, "ab cd ef gh"), (2, "ab cd ef gh"), (2, "ab cd ef gh"), (3, None), (4, ""), (5, " \t\n"), (None, "AB cd ef gh"), (6, "a"), (7, "A"), (8, "word " * 30000), (9, None), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with outputs."""
    clash = ("fingerprint", "component_id", "code", "id", "n", "terms", "item", "score", "rank", "word", "form")
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("x") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


# 11: SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(codes, radius):
    """The smallest key that each key of {key: code} reaches over codes within radius."""
    parent = {k: k for k in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(codes)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


@needs_data
def test_op11_equals_brute_force(spark, docs):
    codes = {r[0]: brute_fingerprint(r[1]) for r in docs.collect()}
    classes = brute_classes(codes, 2)
    got = registry.queries()["op11_simhash_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{codes[d]:016x}", classes[d]) for d in codes}
    assert len(got) == len(codes)


def near_each_other(rng, n):
    """Codes in balls around a few centres, at distances around the radius, and some far ones."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = {rng.getrandbits(64) for _ in range(40)}
    while len(out) < n:
        code = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            code ^= 1 << rng.randrange(64)
        out.add(code)
    return sorted(out)


@pytest.mark.parametrize("radius, limit", [(2, 4096), (2, 8), (0, 4096), (3, 5)])
def test_op11_links_lose_none(spark, radius, limit):
    """Also where shards are cut again and again."""
    codes = near_each_other(random.Random(radius + limit), 400)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = [tuple(r) for r in simhash.near_codes(spark.createDataFrame([(c,) for c in signed], "code long").repartition(5), radius, limit).collect()]
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 64 for a, b in links)
    parent = {c: c for c in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = collections.defaultdict(set)
    for c in signed:
        groups[root(c)].add(c)
    want = collections.defaultdict(set)
    for c, r in brute_classes(dict(zip(signed, codes)), radius).items():
        want[r].add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_op11_trees_are_those_of_single_insertions_and_prune():
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(3000)]
    forest = bktree.Forest(np.array(codes, np.uint64), np.zeros(3000, np.int64))
    children = {}
    for i in range(1, 3000):
        at = 0
        while (at, d := (codes[at] ^ codes[i]).bit_count()) in children:
            at = children[at, d]
        children[at, d] = i
    assert {(s // 65, s % 65): k for s, k in zip(forest._slots.tolist(), forest._kids.tolist())} == children
    query = codes[7] ^ 0b101
    found = [n for _, nodes in forest.within(np.array([query], np.uint64), np.array([0]), 2) for n in nodes.tolist()]
    assert found == [i for i, c in enumerate(codes) if (c ^ query).bit_count() <= 2]


def test_op11_shard_masks_share_a_part():
    for masks in simhash.shard_masks(3, 3):
        for bits in ((0, 63), (5, 6), (21, 22), (40, 41)):
            apart = sum(1 << b for b in bits)
            assert any(not m & apart for m in masks)


def test_op11_long_texts_in_parts(spark):
    rng = random.Random(2)
    text = "  ".join(rng.choice(["Ab", "c", "déf", "x" * 300]) for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    for limit in (64, 1000, 10000):
        assert int(simhash.fingerprints_of(data, np.array([0, len(data)]), limit)[0]) == brute_fingerprint(text.decode())
    for short in (b"", b" ", b"a", b"a b", b"y" * 5000, b"y" * 5000 + b" z"):
        one = np.frombuffer(short, np.uint8)
        assert int(simhash.fingerprints_of(one, np.array([0, len(one)]), 64)[0]) == brute_fingerprint(short.decode())


def test_op11_odd_rows(spark, odd):
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr)
    zero, four, a, many = "0" * 16, f"{brute_fingerprint('ab cd ef gh'):016x}", f"{brute_fingerprint('a'):016x}", f"{brute_fingerprint('word ' * 9):016x}"
    want = [(1, four, 1), (2, four, 1), (2, four, 1), (None, four, 1), (6, a, 6), (7, a, 6), (8, many, 8), *[(d, zero, 3) for d in (3, 4, 5, 9, None)]]
    assert got == sorted(want, key=repr)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.near_duplicates(odd.filter("doc_id is null")).select("component_id").distinct().collect() == [(None,)]


# 12: ranked search


def brute_ranking(docs, items, k=10):
    terms = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    size = [sum(c.values()) for _, c in counts]
    n_docs, total, held = sum(n > 0 for n in size), sum(size), collections.Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        asked, scores = set(terms(text)), []
        for (d, c), n in zip(counts, size):
            m = 10 + (90 * n * n_docs) // total if total else 0
            s = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held[t] + 1)))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out[item] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def ranked(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("item_id", "rank").collect():
        out[r["item_id"]].append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return dict(out)


def test_op12_ties_blocks_and_shards(spark, monkeypatch):
    """Small shards, several blocks of items, copies and ties."""
    monkeypatch.setattr(lexical, "CELLS", 1 << 10)
    rng = random.Random(4)
    words = ["Ä", "the", "of", *(f"w{i}" for i in range(60))]
    docs = [(i, " ".join(rng.choices(words, [1, 30, 20, *[60 / (j + 1) for j in range(60)]], k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[i % 5][1]) for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(23)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string").repartition(3)
    want = {i: r for i, r in brute_ranking(docs, items).items() if r}
    for block in (512, 5):
        assert ranked(lexical.ranked_search(frame(docs, "doc_id"), frame(items, "item_id"), block=block)) == want


def test_op12_blocks_are_skipped():
    """Documents of several topics: most blocks of the common terms stay unread, and nothing is lost."""
    rng = np.random.default_rng(1)
    topics = [np.arange(10 + 20 * t, 30 + 20 * t) for t in range(10)]
    impacts = np.zeros((2000, 210), np.int32)
    for d in range(2000):
        impacts[d, rng.choice(topics[d % 10], 8, replace=False)] = rng.integers(200_000, 900_000, 8)
        impacts[d, rng.choice(10, 5, replace=False)] = rng.integers(1000, 500_000, 5)
    weights = np.concatenate([np.full(10, 300), np.full(200, 3000)]).astype(np.int64)
    items = [np.unique(np.concatenate([rng.choice(10, 4, replace=False), rng.choice(topics[q % 10], 6, replace=False)])) for q in range(40)]
    found = lexical.Searcher(items, weights, 10)
    found.search(np.arange(2000), impacts)
    for q, terms in enumerate(items):
        scores = impacts[:, terms].astype(np.int64) @ weights[terms]
        best = np.lexsort((np.arange(2000), -scores))[:10]
        assert found.best.ids[q].tolist() == best.tolist() and found.best.scores[q].tolist() == scores[best].tolist()
    assert found.skipped > 2 * found.visited


def test_op12_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "AB word"), (1, "ef"), (2, None), (3, ""), (4, "nowhere"), (None, "ab"), (5, "A")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    want = brute_ranking([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "ab word ef"), (5, "a")])
    got = ranked(lexical.ranked_search(odd, items))
    assert got == {i: r for i, r in want.items() if r} and [d for d, _ in got[5]] == [6, 7]
    assert lexical.ranked_search(odd.limit(0), items).count() == 0 and lexical.ranked_search(odd, items.limit(0)).count() == 0


def test_op12_long_text(spark):
    rows = [(1, "rare " + "filler " * 400_000), (2, "rare")]
    got = ranked(lexical.ranked_search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "rare filler")], "item_id long, text string")))
    assert got == {i: r for i, r in brute_ranking(rows, [(1, "rare filler")]).items()}


# 13: spelling variants


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, ratio=5):
    near = {w: [x for x in n if x != w and is_near(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def shown(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in rows}


@needs_data
def test_op13_equals_brute_force(spark, docs):
    n = collections.Counter()
    for d, text in docs.collect():
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = brute_variants({w: c for w, c in n.items() if len(w) >= 6 and c >= 5})
    assert shown(registry.queries()["op13_spelling_variants"](spark, SF)) == want and len(want) > 100


@pytest.mark.parametrize("limit", [8192, 7])
def test_op13_dense_vocabulary(spark, limit):
    """Words that are near to many, repeated letters, and shards that are cut into blocks."""
    rng = random.Random(limit)
    n = {}
    while len(n) < 700:
        n["".join(rng.choice("aabé") for _ in range(rng.randint(6, 8)))] = rng.choice([5, 6, 30, 200, 1000])
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert shown(spelling.spelling_variants(frame, limit=limit)) == brute_variants(n)


def test_op13_short_words_and_ratio(spark):
    n = {w: c for c, w in enumerate(["a", "b", "ab", "abc", "ac", "ba", "bac", "zz", "日本", "日本語", "𝒳y", "𝒳yz"], 1)}
    n["ab"] = 40
    frame = spark.createDataFrame(list(n.items()), "word string, n long")
    assert shown(spelling.spelling_variants(frame, min_length=1, ratio=2)) == brute_variants(n, 2)
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame, ratio=1)


def test_op13_index_keeps_both_directions_in_step():
    words = sorted({"banana", "bananas", "ananas", "nab", "ban"})
    index = fmindex.BidirectionalIndex(words)
    text = "$" + "$".join(words) + "$"
    symbol = {c: i + 2 for i, c in enumerate("".join(chr(x) for x in index.alphabet))} | {"$": 1}
    rng = random.Random(3)
    for _ in range(200):
        at = rng.randrange(len(text))
        lo, size, a, z = np.zeros((2, 1), np.int64), np.array([index.size]), at, at
        for _ in range(6):
            side = rng.randrange(2)
            if (side == 0 and a == 0) or (side == 1 and z == len(text)):
                continue
            c = text[a - 1] if side == 0 else text[z]
            lo, size = index.extend(side, np.array([symbol[c]]), lo, size)
            a, z = (a - 1, z) if side == 0 else (a, z + 1)
            part = text[a:z]
            places = {i for i in range(len(text)) if text.startswith(part, i)}
            assert set(index.sides[0].suffixes[lo[0, 0] : lo[0, 0] + size[0]].tolist()) == places
            assert {len(text) - len(part) - int(i) for i in index.sides[1].suffixes[lo[1, 0] : lo[1, 0] + size[0]]} == places


def test_op13_odd_rows(spark, odd):
    texts = odd.select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(20, "Wörter wörter WÖRTER worter " * 9 + "x" * 20000)], "id long, text string"))
    vocabulary = spelling.vocabulary(spelling.with_slips(spelling.lettered_runs(texts), 10**9), 4, 5)
    n = {r["word"]: r["n"] for r in vocabulary.collect()}
    assert n == {"word": 30000, "wörter": 18, "wÖrter": 9, "worter": 9}
    assert shown(spelling.spelling_variants(vocabulary, min_length=4, ratio=2)) == brute_variants(n, 2)
    assert spelling.spelling_variants(vocabulary.limit(0)).count() == 0
    long = {"x" * 3000: 5, "x" * 3001: 50, "x" * 2999 + "y": 7}
    assert shown(spelling.spelling_variants(spark.createDataFrame(list(long.items()), "word string, n long"))) == brute_variants(long)
