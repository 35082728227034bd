import random
import re

import numpy as np

from stratamol.llm.jaccard import jaccard_components, trie_components

SCHEMA = "doc_id long, text string, key string, block string"


def brute(rows, k=4, percent=85):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=70)
    rows, i = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (6, "a b c d"), (7, "x " * 5000), (8, "X " * 6000)], 9
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([20, 60, 150, 400]))
        if g % 3 == 0:
            base[5:5] = passage
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, len(t) // 40])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append((i, " ".join(t)))
            i += 1
    return [(a, b, "k", None) for a, b in rows]


def test_matches_brute_force(spark):
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(5), 4, 85).collect()}
    assert got == brute(rows)


def test_empty_and_repeated(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e", None, None)] * 3 + [(None, "a b c d e", None, None), (None, None, None, None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(1, 2, 1)] * 3 + [(None, 2, 1), (None, 0, None)], key=str)


def test_split_blocks(spark, monkeypatch):
    import stratamol.llm.jaccard as j

    monkeypatch.setattr(j, "BLOCK", 6)
    monkeypatch.setattr(j, "CHUNK", 3)
    rows = corpus()
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_trie():
    rng = np.random.default_rng(1)
    for _ in range(60):
        base = rng.choice(80, 30, replace=False)
        sets, sizes = [], []
        for _ in range(25):
            s = np.unique(np.concatenate([rng.permutation(base)[: rng.integers(24, 31)], rng.integers(100, 110, rng.integers(0, 3))]))
            sets.append(s.astype(np.int64))
            sizes.append(len(s) + int(rng.integers(0, 3)))
        n = len(sets)
        comp = list(range(n))
        for _ in range(n):
            for a in range(n):
                for b in range(n):
                    i = len(np.intersect1d(sets[a], sets[b]))
                    if a != b and 100 * i >= 85 * (sizes[a] + sizes[b] - i):
                        comp[a] = comp[b] = min(comp[a], comp[b])
        assert trie_components(sizes, sets) == comp


def test_trie_of_two_sides():
    rng = np.random.default_rng(7)
    for _ in range(40):
        base = rng.choice(60, 24, replace=False)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(19, 25)], rng.integers(100, 106, 2)])).astype(np.int64) for _ in range(18)]
        sizes, sides = [len(s) for s in sets], rng.integers(1, 3, 18).tolist()
        comp = list(range(18))
        for _ in range(18):
            for a in range(18):
                for b in range(18):
                    i = len(np.intersect1d(sets[a], sets[b]))
                    if sides[a] != sides[b] and 100 * i >= 85 * (sizes[a] + sizes[b] - i):
                        comp[a] = comp[b] = min(comp[a], comp[b])
        assert trie_components(sizes, sets, sides=sides) == comp


def test_packed_rows_of_large_numbers():
    import pyarrow as pa

    import stratamol.llm.jaccard as j

    tok, idx, many = np.arange(5, dtype=np.uint64) << np.uint64(60), np.array([0, 1, 70_000, 2, 3]), np.array([1 << 63], np.uint64)
    for top in (9, 1 << 20):
        t = pa.Table.from_batches([j._batch([j._row(3, 1 << 40, [5, -6], [7, 8], tok, idx, many, [top])])])
        assert j._sized(t, "idx", [5])[0].tolist() == idx.tolist() and j._sized(t, "counts", [1])[0].tolist() == [top]
        assert j._column(t, "tok", np.uint64)[0].tolist() == tok.tolist() and j._joined_column(t, "keys", np.int64).tolist() == [5, -6]


def test_frequent_shingles_over_many_packs(spark, monkeypatch):
    """A passage in most texts, small packs and many tasks: counts above those of a pack, heads and singles together."""
    import stratamol.llm.jaccard as j

    monkeypatch.setattr(j, "PACK", 400)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [f"d{i // 3 if i % 3 < 2 else i}w{k}" for k in range(rng.choice([3, 30, 90]) if i % 3 != 1 else len(rows[-1][1].split()) - 40)]
        if i % 3 == 1 and len(own) > 20:
            own[rng.randrange(len(own))] = "changed"
        rows.append((i, " ".join(passage + own)))
    docs = spark.createDataFrame([(a, b, None, None) for a, b in rows], SCHEMA).repartition(9)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(docs).collect()}
    assert got == brute(rows)
