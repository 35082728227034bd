"""N-gram Jaccard join by prefix trees: exact links between texts whose shingle sets nearly agree, as components.

1. Each text becomes a set of 64-bit shingle hashes; equal sets share one key and count once.
2. Packs of sets deal their shingles by hash; a shingle that many sets of a pack have goes as one entry with its count, and
   who has it stays with the pack. Counts come back to the packs. A shingle in one set only can't be shared; a set with
   fewer shared shingles than its least possible overlap has no partner and drops out (an exact bound).
3. The sets left are ordered by the shingles' frequency over all sets, rarest first. Sets that share a shingle of their
   prefixes form blocks; two linked sets always do. Shingles of prefixes are combined task by task before they meet.
4. Each block's sets go into a trie, in one order for the whole block, its most frequent shingles first, so that near copies
   share long paths; a traversal shares partial overlaps and prunes subtrees by remaining length and by what is known to be
   connected. In a large block every set is first held against a few pivots, which settles most of a group of near copies
   in linear time; the rest is cut into chunks by length, and of these only those meet that share a shingle of their
   prefixes, whose lengths allow a link, and which aren't settled together.
"""

from __future__ import annotations

from bisect import bisect_right
from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytescan import mix, shingle_sets
from .common import join_null_safe, mark, materialise, release, text_slices
from .components import connected_components

#: Sets of a block above which it is split, of each chunk, and its pivots.
BLOCK, CHUNK, PIVOTS = 1024, 512, 4
#: Shingle occurrences for each hash partition.
PER_PART = 2_000_000
#: Occurrences that a task packs before it sends them; sets of a pack from which a shingle goes as one entry.
PACK, MANY = 1_000_000, 8
#: Copies of the rows that name a group of copies or links, so that its members meet them in several tasks.
SALTS = 8


def least_overlap(nx, ny, percent: int = 85):
    """The least shared count with 100 * shared >= percent * union."""
    return -(-(percent * (nx + ny)) // (100 + percent))


def least_shared(n, percent: int = 85):
    """The least overlap of a set of n with any partner: with one of its least size."""
    return -(-(percent * n) // 100)


def set_key(h: np.ndarray) -> int:
    """Order-free key of a set of hashes; 0 only for the empty set."""
    if not len(h):
        return 0
    total = mix(np.array([mix(h ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) ^ np.uint64(len(h))], np.uint64))
    return int(total.view(np.int64)[0]) or 1


def set_table(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, key) of each row; null or wordless text: 0 and key 0."""

    def run(batches):
        for batch in batches:
            ids, ns, keys = batch.column(0), [], []
            for _, _, data, offsets in text_slices(batch.column(1)):
                for h in shingle_sets(data, offsets, k):
                    ns.append(len(h))
                    keys.append(set_key(h))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, key long")


_PACK = "part int, pack long, keys binary, ns binary, tok binary, idx binary, many binary, counts binary"
_NAMES = ["part", "pack", "keys", "ns", "tok", "idx", "many", "counts"]
_EMPTY = np.zeros(0, np.uint64)


def _row(part, pack, keys=_EMPTY, ns=_EMPTY, tok=_EMPTY, idx=_EMPTY, many=_EMPTY, counts=_EMPTY):
    """A packed row. idx and counts take 2 bytes each where all fit; how many there are follows from tok, many and counts."""

    def small(x):
        return np.asarray(x).astype(np.uint16 if np.max(x, initial=0) < 1 << 16 else np.uint32)

    cols = (np.asarray(keys, np.int64), np.asarray(ns, np.int64), tok.astype(np.uint64), small(idx), many.astype(np.uint64), small(counts))
    return [int(part), int(pack), *(x.tobytes() for x in cols)]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], (pa.int32(), pa.int64())[i] if i < 2 else pa.binary()) for i in range(8)], _NAMES)


def _column(table, name, kind):
    return [np.frombuffer(x.as_py(), kind) for x in table.column(name)]


def _sized(table, name, numbers):
    """The values of each row, whose number is known: 2 or 4 bytes each."""
    return [np.frombuffer(x.as_py(), np.uint16 if len(x.as_py()) == 2 * n else np.uint32) for x, n in zip(table.column(name), numbers, strict=True)]


def _joined_column(table, name, kind):
    return np.concatenate([np.zeros(0, kind), *_column(table, name, kind)])


def _dealt(docs, k, parts, id_col, text_col):
    """Rows of packs. Of each pack a head: its sets' keys and sizes, and the shingles many of them have (many, counts, and
    idx, their sets); and for each hash partition (tok, idx) with idx the set in the pack, and (many, counts)."""

    def run(batches):
        held, state = [], [0, 0]  # occurrences held, packs sent

        def sent():
            done = {}
            for key, h in held:
                done.setdefault(key, h)
            held.clear()
            if not done:
                return
            pack = (TaskContext.get().partitionId() << 24) + state[1]
            state[0], state[1] = 0, state[1] + 1
            keys, ns = np.fromiter(done, np.int64, len(done)), np.array([len(h) for h in done.values()], np.int64)
            h = np.concatenate(list(done.values()))
            done.clear()
            order = np.argsort(h, kind="stable")
            tok, idx = h[order], np.repeat(np.arange(len(ns), dtype=np.uint32), ns)[order]
            del h, order
            first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            counts = np.diff(np.append(first, len(tok)))
            often = counts >= MANY
            apart = np.repeat(often, counts)
            many, many_counts = tok[first[often]], counts[often]
            yield _batch([_row(pack % parts, pack, keys, ns, _EMPTY, idx[apart], many, many_counts)])
            tok, idx = tok[~apart], idx[~apart]
            part = ((tok >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            tok, idx, part = tok[order], idx[order], part[order]
            many_part = ((many >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(many_part, kind="stable")
            many, many_counts, many_part = many[order], many_counts[order], many_part[order]
            at, many_at = (np.searchsorted(x, np.arange(parts + 1)) for x in (part, many_part))
            for p in range(parts):
                a, b, c, d = at[p], at[p + 1], many_at[p], many_at[p + 1]
                if b > a or d > c:
                    yield _batch([_row(p, pack, _EMPTY, _EMPTY, tok[a:b], idx[a:b], many[c:d], many_counts[c:d])])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                for h in shingle_sets(data, offsets, k):
                    if len(h) > 1:  # a single shingle links equal sets only
                        held.append((set_key(h), h))
                        state[0] += len(h)
                if state[0] >= PACK:
                    yield from sent()
        yield from sent()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, _PACK)


def _shared(table: pa.Table) -> pa.Table:
    """In one hash partition: every pack's shingles found in two sets at least, with their counts over all packs.

    Equal sets of several packs count several times: that changes the order and the bound's sharpness, not the links."""
    heads = [r for r in zip(*(table.column(n).to_pylist() for n in _NAMES), strict=True) if r[2]]
    rows = [list(r) for r in heads]
    table = table.filter(pa.array([not len(x.as_py()) for x in table.column("keys")]))
    toks, manys = _column(table, "tok", np.uint64), _column(table, "many", np.uint64)
    idxs, counts = _sized(table, "idx", map(len, toks)), _sized(table, "counts", map(len, manys))
    every = np.concatenate([_EMPTY, *toks, *manys])
    weight = np.concatenate([np.ones(sum(map(len, toks)), np.uint32), *counts])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    del every
    df = np.empty(len(order), np.uint32)
    if len(order):
        total = np.minimum(np.add.reduceat(weight[order], first, dtype=np.int64), (1 << 32) - 1).astype(np.uint32)
        df[order] = np.repeat(total, np.diff(np.append(first, len(order))))
    del order, weight
    at, many_at = 0, sum(map(len, toks))
    for pack, tok, idx, many in zip(table.column("pack").to_pylist(), toks, idxs, manys, strict=True):
        own, own_many = df[at : at + len(tok)], df[many_at : many_at + len(many)]
        at, many_at = at + len(tok), many_at + len(many)
        keep = own >= 2
        # counts: of tok, then of many
        rows.append(_row(0, pack, _EMPTY, _EMPTY, tok[keep], idx[keep], many, np.concatenate((own[keep], own_many))))
    return pa.Table.from_batches([_batch(rows)])


_SETS = "key long, n long, tokens binary, prefix int"


def _candidates(percent: int):
    """In one pack: the sets whose shared shingles can reach the least overlap, rarest first."""

    def run(table: pa.Table) -> pa.Table:
        is_head = [bool(len(x.as_py())) for x in table.column("keys")]
        head = table.filter(pa.array(is_head))
        keys, ns = _joined_column(head, "keys", np.int64), _joined_column(head, "ns", np.int64)
        table = table.filter(pa.array([not x for x in is_head]))
        toks, manys = _column(table, "tok", np.uint64), _column(table, "many", np.uint64)
        idxs, counts = _sized(table, "idx", map(len, toks)), _sized(table, "counts", [len(t) + len(m) for t, m in zip(toks, manys, strict=True)])
        none = np.zeros(0, np.uint16)
        tok, row = np.concatenate([_EMPTY, *toks]), np.concatenate([none, *idxs])
        df = np.concatenate([none, *(c[: len(t)] for c, t in zip(counts, toks, strict=True))])
        # the shingles that many sets of the pack have: their counts are here, who has them is in the head
        many, many_df = np.concatenate([_EMPTY, *manys]), np.concatenate([none, *(c[len(t) :] for c, t in zip(counts, toks, strict=True))])
        order = np.argsort(many)
        heads = _column(head, "many", np.uint64)
        numbers = _sized(head, "counts", map(len, heads))
        own, own_n, who = np.concatenate([_EMPTY, *heads]), np.concatenate([none, *numbers]), np.concatenate([none, *_sized(head, "idx", [int(n.sum()) for n in numbers])])
        if len(own):
            own_df = many_df[order][np.searchsorted(many[order], own)]
            tok, row, df = np.concatenate((tok, np.repeat(own, own_n))), np.concatenate((row, who)), np.concatenate((df, np.repeat(own_df, own_n)))
        order = np.lexsort((tok, df, row))
        row, tok = row[order], tok[order]
        sets, first = np.unique(row, return_index=True)
        ends, out = np.append(first, len(row))[1:], []
        for i, a, b in zip(sets.tolist(), first.tolist(), ends.tolist(), strict=True):
            n = int(ns[i])
            least = least_shared(n, percent)
            if b - a >= least:
                out.append((int(keys[i]), n, tok[a:b].tobytes(), b - a - least + 1))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"key": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "tokens": pa.array(cols[2], pa.binary()), "prefix": pa.array(cols[3], pa.int32())})

    return run


def _prefixes(batches):
    """(key, token, low): of each shingle of the task's prefixes the least key, and (key, low) of the others that have it."""
    keys, toks, size = [], [], 0

    def sent():
        key, tok = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *toks])
        keys.clear()
        toks.clear()
        order = np.lexsort((key, tok))
        key, tok = key[order], tok[order]
        first = np.ones(len(tok), bool)
        first[1:] = tok[1:] != tok[:-1]
        low = key[first][np.cumsum(first) - 1] if len(key) else key
        other = ~first & (key != low)
        own, low = key[other], low[other]
        order = np.lexsort((low, own))
        own, low = own[order], low[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (low[1:] != low[:-1])
        own, low, n = own[new], low[new], int(first.sum())
        edge = np.arange(n + len(own)) >= n
        a = pa.array(np.concatenate((key[first], own)))
        b = pa.array(np.concatenate((tok[first], own)), mask=edge)
        c = pa.array(np.concatenate((key[first], low)), mask=~edge)
        return pa.RecordBatch.from_arrays([a, b, c], ["key", "token", "low"])

    for b in batches:
        for key, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            toks.append(np.frombuffer(t.as_py(), np.int64)[:p])
            keys.append(np.full(p, key, np.int64))
            size += p
            if size >= PACK:
                yield sent()
                size = 0
    yield sent()


class Trie:
    """A path-compressed trie over sorted rank lists, held as arrays; leaves are in lexicographic order."""

    def __init__(self, paths: list[list[int]], sizes: list[int]):
        self.order = sorted(range(len(paths)), key=paths.__getitem__)
        self.paths = p = [paths[i] for i in self.order]
        self.sizes = [sizes[i] for i in self.order]
        #: of each node: run of ranks, first leaf, end leaf, children, most ranks below its run, least size
        self.nodes: list[list] = []
        self.root = 0
        todo = [(0, len(p), 0, -1)]
        while todo:
            lo, hi, depth, above = todo.pop()
            me, first, last = len(self.nodes), p[lo], p[hi - 1]
            end = len(first)
            if hi - lo > 1:
                k, m = depth, min(len(first), len(last))
                while k < m and first[k] == last[k]:
                    k += 1
                end = k
            self.nodes.append([first[depth:end], lo, hi, [], 0, self.sizes[lo]])
            if above >= 0:
                self.nodes[above][3].append(me)
            if hi - lo > 1:
                i = lo
                while i < hi and len(p[i]) == end:  # sets that end here are leaves with empty runs
                    todo.append((i, i + 1, end, me))
                    i += 1
                while i < hi:
                    j = bisect_right(p, p[i][end], i, hi, key=lambda x: x[end])
                    todo.append((i, j, end, me))
                    i = j
        for node in reversed(self.nodes):  # children come after their parents
            if node[3]:
                node[4] = max(self.nodes[c][4] + len(self.nodes[c][0]) for c in node[3])
                node[5] = min(self.nodes[c][5] for c in node[3])


def trie_components(sizes: list[int], sets: list[np.ndarray], percent: int = 85, groups: list | None = None, sides: list[int] | None = None) -> list[int]:
    """Of each set the least index reachable by links. sets: shared shingles of each; sizes: with those in one set only.

    groups: what is known to be connected already, None where nothing is. sides: where given, 1 or 2 of each set, and only
    sets of two sides are held against each other."""
    n = len(sets)
    if n < 2:
        return list(range(n))
    every, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -df))] = np.arange(len(every))
    ranks, alone = rank[inverse], df[inverse] < 2
    paths, at = [], 0
    for s in sets:
        own = ranks[at : at + len(s)][~alone[at : at + len(s)]]
        paths.append(np.sort(own).tolist())
        at += len(s)
    trie = Trie(paths, sizes)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, at in enumerate(trie.order if groups else []):
        if groups[at] is not None:
            parent[i] = first.setdefault(groups[at], i)
    nodes, uniform = trie.nodes, [-1] * len(trie.nodes)
    side = [sides[at] for at in trie.order] if sides else None
    seen = np.concatenate(([0], np.cumsum(np.array(side or [], np.int64) == 1)))
    runs = [frozenset(x[0]) for x in nodes]
    for i in range(n):
        x, nx = trie.paths[i], trie.sizes[i]
        xs = set(x)
        stack = [(trie.root, 0, 0)]
        while stack:
            k, shared, used = stack.pop()
            run, lo, hi, kids, rest, low = nodes[k]
            if hi <= i + 1:
                continue
            if side and (seen[hi] - seen[lo] == (hi - lo if side[i] == 1 else 0)):  # all on this set's side
                continue
            if uniform[k] >= 0 and find(uniform[k]) == find(i):
                continue
            if run:
                shared += len(xs & runs[k]) if len(runs[k]) > 8 else sum(t in xs for t in run)
                used = bisect_right(x, run[-1], used)
            if shared + min(len(x) - used, rest) < least_overlap(nx, low, percent):
                continue
            if kids:
                roots = {find(lo)}
                for j in kids:
                    roots.add(find(nodes[j][1]))
                if len(roots) == 1 and hi - lo <= 64 and len({find(j) for j in range(lo, hi)}) == 1:
                    uniform[k] = lo
                    if find(lo) == find(i):
                        continue
                stack.extend((j, shared, used) for j in kids)
            elif hi - lo == 1 and shared >= least_overlap(nx, trie.sizes[lo], percent):
                a, b = find(i), find(lo)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i in range(n):
        r = find(i)
        least[r] = min(least.get(r, n), trie.order[i])
    out = [0] * n
    for i in range(n):
        out[trie.order[i]] = least[find(i)]
    return out


def _joined(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.array(table.column("key").to_pylist(), np.int64)
        order = np.argsort(keys, kind="stable")
        tokens, ns = table.column("tokens"), table.column("n").to_pylist()
        sets = [np.frombuffer(tokens[int(i)].as_py(), np.int64) for i in order]
        groups, sides = table.column("settled").to_pylist(), table.column("side").to_pylist()
        found = trie_components([ns[i] for i in order], sets, percent, [groups[i] for i in order], [sides[i] for i in order] if sides[0] else None)
        keys = keys[order]
        return pa.table({"key": pa.array(keys), "root": pa.array(keys[np.array(found, np.int64)])})

    return run


def key_components(docs: DataFrame, sets: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, component key) of the sets linked to a different set."""
    since, total = mark(), sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts, packs = max(8, -(-total // PER_PART)), max(8, -(-total // PACK))
    dealt = _dealt(docs, k, parts, id_col, text_col)
    shared = dealt.repartition(parts, "part").groupBy("part").applyInArrow(_shared, _PACK)
    found = shared.repartition(packs, "pack").groupBy("pack").applyInArrow(_candidates(percent), _SETS)
    found = materialise(found, "found")
    # equal sets of several packs have the same shingles
    edges = found.select("key", "tokens", "prefix").mapInArrow(_prefixes, "key long, token long, low long")
    edges = materialise(edges, "prefixes")
    low = edges.where("token is not null").groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").drop("most")
    stars = edges.where("token is not null").join(low, "token").select("key", F.col("least").alias("low")).where("key <> low")
    stars = stars.unionByName(edges.where("token is null").select("key", "low"))
    blocks = materialise(connected_components(stars, "key", "low").withColumnsRenamed({"node": "key", "component": "block"}), "blocks")
    sized = materialise(blocks.groupBy("block").agg(F.count("*").alias("members")), "sizes")
    found = found.join(blocks.join(sized, "block"), "key").groupBy("key").agg(F.first("block").alias("block"), F.first("members").alias("members"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("prefix").alias("prefix"))
    members = materialise(found, "members")
    release(since, keep=[members, sized])
    small = members.where(F.col("members") <= BLOCK).withColumn("settled", F.lit(None).cast("long")).withColumn("side", F.lit(0)).drop("prefix")
    linked = small.groupBy("block").applyInArrow(_joined(percent), "key long, root long")
    linked = materialise(linked.where("key <> root"), "links")
    out = linked.select("key", F.col("root").alias("component")).unionByName(linked.select(F.col("root").alias("key"), F.col("root").alias("component")).distinct())
    if sized.where(F.col("members") > BLOCK).limit(1).count():
        out = out.unionByName(_large_blocks(members.where(F.col("members") > BLOCK), percent))
    return out


def _held(percent: int):
    """Of rows with a set and a pivot's those that link."""

    def run(batches):
        for b in batches:
            c = {n: b.column(n) for n in ("key", "n", "tokens", "pivot", "pn", "ptokens")}
            keep = []
            for k in range(len(b)):
                x, y = (np.frombuffer(c[n][k].as_py(), np.int64) for n in ("tokens", "ptokens"))
                if len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(c["n"][k].as_py(), c["pn"][k].as_py(), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([c["key"].take(pa.array(keep, pa.int64())), c["pivot"].take(pa.array(keep, pa.int64()))], ["key", "root"])

    return run


def _tokens(batches):
    for b in batches:
        toks = [np.frombuffer(t.as_py(), np.int64)[:p] for t, p in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
        at = np.repeat(np.arange(len(toks)), [len(t) for t in toks])
        pairs = pa.table({"block": b.column(0).take(pa.array(at)), "chunk": b.column(1).take(pa.array(at)), "token": pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64))})
        yield from pairs.group_by(["block", "chunk", "token"]).aggregate([]).to_batches()


def _large_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(key, component) in blocks (block, members, key, n, tokens, prefix) too large for one task.

    Sets are salted by chunk against the block's pivots; links to them settle groups. Then pairs of chunks meet, chunks
    being of one settled group and one range of lengths, if a prefix's shingle is in both and their lengths allow a link."""
    salts = F.ceil(F.col("members") / CHUNK).cast("int")
    members = materialise(members.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).withColumn("salts", salts), "large")
    picked = members.groupBy("block", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(PIVOTS)).alias("slot")).agg(F.min("key").alias("key"))
    pivots = members.join(picked.select("block", "key"), ["block", "key"]).select("block", F.col("key").alias("pivot"), F.col("n").alias("pn"), F.col("tokens").alias("ptokens"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = members.join(pivots, ["block", "salt"]).where("key <> pivot").select("key", "n", "tokens", "pivot", "pn", "ptokens")
    held = materialise(near.mapInArrow(_held(percent), "key long, root long"), "held")
    settled = materialise(connected_components(held, "key", "root").withColumnsRenamed({"node": "key", "component": "settled"}), "settled")
    members = members.drop("salt", "salts").join(settled, "key", "left").withColumn("span", F.floor(F.log("n") / F.lit(log(1.06))))
    spans = members.groupBy("block", "settled", "span").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("pieces"), F.min("n").alias("least"), F.max("n").alias("most"))
    members = join_null_safe(members, spans, ["block", "settled", "span"]).withColumn("piece", F.pmod(F.xxhash64("key", F.lit(5)), F.col("pieces")).cast("int"))
    # a chunk is named by a hash of what makes it; two of one name would only meet as one
    members = members.withColumn("chunk", F.xxhash64("block", F.coalesce(F.col("settled"), F.lit(0)), F.col("settled").isNull(), "span", "piece"))
    members = materialise(members.drop("members", "span", "piece", "pieces"), "chunks")
    kinds = members.groupBy("block", "chunk").agg(F.first("settled").alias("settled"), F.min("least").alias("least"), F.max("most").alias("most"))
    shared = members.select("block", "chunk", "tokens", "prefix").mapInArrow(_tokens, "block long, chunk long, token long")
    # chunks that have a prefix's shingle in common: as many for each as there are chunks, at most
    common = shared.groupBy("block", "token").agg(F.array_sort(F.collect_set("chunk")).alias("of")).select("block", "of").distinct()
    pairs = common.select("block", "of", F.explode("of").alias("p")).select("block", "p", F.explode(F.filter("of", lambda q: q >= F.col("p"))).alias("q")).distinct()
    a = kinds.select("block", *(F.col(c).alias(f"{c}_p") for c in ("settled", "least", "most")), F.col("chunk").alias("p"))
    b = kinds.select("block", *(F.col(c).alias(f"{c}_q") for c in ("settled", "least", "most")), F.col("chunk").alias("q"))
    pairs = pairs.join(a, ["block", "p"]).join(b, ["block", "q"]).where("settled_p is null or settled_q is null or settled_p <> settled_q")
    pairs = pairs.where((100 * F.col("most_p") >= percent * F.col("least_q")) & (100 * F.col("most_q") >= percent * F.col("least_p")))
    both = F.when(F.col("p") == F.col("q"), F.array(F.struct(F.col("p").alias("chunk"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("p").alias("chunk"), F.lit(1).alias("side")), F.struct(F.col("q").alias("chunk"), F.lit(2).alias("side"))))
    met = pairs.select("block", "p", "q", F.explode(both).alias("x")).select("block", "p", "q", "x.chunk", "x.side")
    tasks = members.select("block", "chunk", "key", "n", "tokens", "settled").join(met, ["block", "chunk"])
    links = tasks.groupBy("block", "p", "q").applyInArrow(_joined(percent), "key long, root long")
    return connected_components(links.unionByName(held), "key", "root").select(F.col("node").alias("key"), "component")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Null, empty or wordless text: 0 shingles, linked with nothing, its own component. Texts of 1 to k-1 words are one
    shingle. Repeated rows are equal sets and link. A null id takes its component's least id, or null. Other columns,
    whatever their names, are ignored; an empty table gives an empty result."""
    sets = materialise(set_table(docs, k, id_col, text_col), "sets")
    linked = key_components(docs, sets, k, percent, id_col, text_col)
    by_key = sets.where("key <> 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    by_key = by_key.join(linked, "key", "left").where("rows > 1 or component is not null").withColumn("component", F.coalesce("component", "key"))
    by_key = materialise(by_key, "groups")
    least = by_key.groupBy("component").agg(F.min("least").alias("component_id"))
    # copies of one text meet their group's name in several tasks
    named = by_key.join(least, "component").select("key", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = sets.where("key <> 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(named, ["key", "salt"], "left")
    with_sets = salted.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return with_sets.unionByName(sets.where("key = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def oracle(k: int = 4, percent: int = 85) -> str:
    """The query in DuckDB SQL: a join on shared shingles between distinct sets, and their reachability."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS s FROM a),
    c AS (SELECT doc_id, len(s) AS n, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM s),
    e AS (SELECT rep, n, unnest(s) AS x FROM c WHERE doc_id = rep),
    l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep AND 100 * b.n >= {percent} * a.n AND 100 * a.n >= {percent} * b.n GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
    r AS (SELECT rep AS a, rep AS b FROM c WHERE doc_id = rep UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM c JOIN m ON c.rep = m.a"""
