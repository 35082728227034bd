"""Every source has a queue, however many there are."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from stratamol.llm import packing

SHARES = {"s3": 0.5, "s8": 2.0, "é": 0.25, "gone": 3.0}


def merged(docs, shares, window, power):
    """(source, doc) in the order of deficit round-robin: credits, whole documents, what is left carried on."""
    queues = defaultdict(list)
    for i, source, n in docs:
        queues[source].append((i, n))
    total = {s: sum(n for _, n in q) for s, q in queues.items()}
    own = {s: (t / sum(total.values())) ** power for s, t in total.items()}
    share = {s: max((shares or {}).get(s, own[s] / sum(own.values())), 1e-9) for s in own}
    q = {s: max(1, int(np.ceil(window * share[s] / sum(share.values()) * 65536))) for s in share}
    out, credit = [], dict.fromkeys(share, 0)
    while any(queues.values()):
        for s in sorted(queues, key=lambda s: (s is None, s or "")):
            credit[s] += q[s]
            while queues[s] and queues[s][0][1] << 16 <= credit[s]:
                i, n = queues[s].pop(0)
                credit[s] -= n << 16
                out.append((s, i))
    return out


@pytest.mark.parametrize("shares", [None, SHARES])
@pytest.mark.parametrize("power", [1.0, 0.5])
def test_every_source_has_a_queue(spark, shares, power):
    names = [None, "é", *(f"s{k}" for k in range(9))]
    rows = [(i, " ".join(f"t{i}w{k}" for k in range(3 + 7 * i % 50)), names[i * i % 11]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)  # one task: queues in the rows' order
    got = sorted(packing.pack(docs, 64, shares, power).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    size = {r["doc_id"]: r["doc_tokens"] for r in got}
    want = merged([(i, s, size[i]) for i, _, s in rows], shares, 64, power)
    assert [(r["source"], r["doc_id"], k) for r in got for k in range(r["start"], r["start"] + r["length"])] == [(s, i, k) for s, i in want for k in range(size[i])]
    assert len(got) <= len(rows) + got[-1]["sequence_id"]  # cut at the windows' bounds alone
    at = 0
    for r in got:
        assert r["sequence_id"] * 64 + r["offset"] == at and r["offset"] + r["length"] <= 64
        at += r["length"]
    ids = defaultdict(list)
    for r in sorted(got, key=lambda r: r["start"]):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    enc = packing.encoder(packing.tokenizer_path(), None)
    assert all(ids[i] == [*enc(t).tolist(), packing.END_ID] for i, t, _ in rows)


def test_proportions_hold_over_tasks(spark):
    """While no queue is dry, each has what its share gives it but for one document and one round."""
    rows = [(i, "w " * (1 + i * 37 % 90), "ab"[i % 2] if i % 5 else "c") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = packing.pack(docs, 256, shares).collect()
    total, at, sent = Counter(), 0, Counter()
    for r in got:
        total[r["source"]] += r["length"]
    longest = max(r["doc_tokens"] for r in got)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 256 + r["offset"] == at
        sent[r["source"]] += r["length"]
        at += r["length"]
        if any(sent[s] == total[s] for s in total):
            break
        assert all(abs(sent[s] - at * shares[s]) <= 2 * longest + 256 for s in shares)
    assert at > 0.5 * sum(total.values())


def test_many_sources(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t ', id) as text", "concat('s', id % 1500) as source")
    got = packing.pack(docs, 128, power=0.5).collect()
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == dict.fromkeys(range(3000), 1)
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
