"""The mix against a walk in plain Python, and inclusion frequencies against the documents' own probabilities."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor, sqrt

from stratamol.llm import mixing
from test_ops import waterfill

SCHEMA = "doc_id long, text string, source string, target string, class string, step string"


def walk(rows, seed=7):
    """(source, doc, size, copies) of (doc, text, source), document by document."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    target = waterfill(total, {s: 1 + k % 3 for k, s in enumerate(order)}, 3, sum(total.values()))
    out = []
    for s in order:
        own = [(i, t) for i, t, x in rows if x == s]
        k = {i: max(1, size[i].bit_length()) for i, _ in own}
        full = set()  # classes at three copies
        while True:
            free = sum(k[i] * size[i] for i, _ in own if k[i] not in full)
            c = (target[s] - sum(3 * size[i] for i, _ in own if k[i] in full)) / free if free else 0
            more = {x for x in k.values() if x not in full and c * x > 3}
            if not more:
                break
            full.add(max(more))
        rate = {i: 0 if not total[s] else 3.0 if k[i] in full else min(3.0, c * k[i]) for i, _ in own}
        sure = {i: floor(rate[i]) for i in rate}
        left, steps = target[s] - sum(sure[i] * size[i] for i in sure), {}
        for i, t in own:
            p = rate[i] - sure[i]
            if p > 0 and size[i]:
                u = (int(hashlib.md5(f"{seed}|{i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                odds = u / (1 - u) / (p / (1 - p))
                steps[i] = floor(odds / (1 + odds) * mixing.STEPS)
        took = set()
        for step in sorted(set(steps.values())):
            these = {i for i in steps if steps[i] == step}
            n = sum(size[i] for i in these)
            if n > left:
                break
            took |= these
            left -= n
        for x in sorted(set(k.values()), reverse=True):
            for step in sorted({steps[i] for i in steps if k[i] == x and i not in took}):
                these = {i for i in steps if steps[i] == step and k[i] == x and i not in took}
                n = sum(size[i] for i in these)
                if n > left:
                    break
                took |= these
                left -= n
        out += [(s, i, size[i], sure[i] + (i in took)) for i, _ in own]
    return out


def table(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice(["hot"] * 4 + ["a", "é", None])
        out.append((i, None if i % 97 == 0 else "w " * int(rng.paretovariate(0.7) * (3 if s == "hot" else 40)) if i % 53 else " ", s))
    return out


def test_matches_the_walk(spark):
    for n, seed in ((700, 1), (40, 2), (7, 3)):
        rows = [r if not r[1] or len(r[1]) < 60_000 else (r[0], r[1][:60_000], r[2]) for r in table(n, seed)]
        docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
        got = sorted(((r["source"], r["doc_id"], r["size"], r["copies"]) for r in mixing.pareto_mix(docs).collect()), key=str)
        assert got == sorted(walk(rows), key=str)


def test_targets_are_met(spark):
    rows = [r if not r[1] or len(r[1]) < 60_000 else (r[0], r[1][:60_000], r[2]) for r in table(3000, 5)]
    got = mixing.pareto_mix(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)).collect()
    taken, smallest = Counter(), defaultdict(lambda: 1 << 60)
    for r in got:
        taken[r["source"]] += r["taken"]
        if r["p"] > 0 and r["size"] and r["copies"] < 1 + r["target"] // max(1, r["source_size"]):
            smallest[r["source"]] = min(smallest[r["source"]], r["size"])
    for r in got:
        assert 0 <= r["target"] - taken[r["source"]] + 1e-6 and r["target"] - taken[r["source"]] <= max(1, 0.001 * r["target"])


def test_inclusion_frequencies(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "repeat('w ', int(1 + (id div 3) % 127)) as text").cache()
    seen, want, var = Counter(), Counter(), Counter()
    for seed in range(5):
        for r in mixing.pareto_mix(docs, weights=(1.0, 2.0, 4.0), seed=seed).selectExpr("source", "length(bin(size)) AS k", "copies", "p", "target / source_size AS rate").collect():
            key = (r["source"], r["k"])
            seen[key] += r["copies"]
            want[key] += r["p"]
            var[key] += r["p"] * (1 - r["p"])
    for s in ("s0", "s1", "s2"):
        ps = {k: want[s, k] for k in range(1, 8)}
        sure = {k: round((seen[s, k] - want[s, k]) / (5 * (3000 * 2 ** (k - 1) / 127))) for k in ps}
        for k in range(3, 8):  # each class at its own probability
            n = 5 * sum(1 for i in range(3000) if (1 + i % 127).bit_length() == k)
            assert abs(seen[s, k] - sure[k] * n - want[s, k]) <= 4 * sqrt(var[s, k]) + 10, (s, k)
        rates = [(seen[s, k]) / 2 ** (k - 1) for k in range(4, 8)]
        assert rates == sorted(rates)  # larger documents have more copies


def test_repeated_ids_have_numbers_of_their_own(spark):
    docs = spark.createDataFrame([(1, f"t{i} x", "a") for i in range(400)] + [(2, f"u{i} x y", "b") for i in range(400)], "doc_id long, text string, source string")
    got = mixing.pareto_mix(docs, weights=(1.0, 3.0)).collect()
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) > 1
    assert sum(r["taken"] for r in got) in range(1995, 2001)
