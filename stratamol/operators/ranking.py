"""Docking triage, duplicates, splits and diverse selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ligand_key
from ..session import scratch

# Score fields whose direction is known.
HIGHER = ("cnnscore", "cnnaffinity", "cnn_vs", "cnn", "cnnpose", "rfscore", "nnscore", "probability", "confidence", "gnina")
LOWER = ("minimizedaffinity", "affinity", "docking_score", "score", "vina", "smina", "r_i_docking_score", "energy", "deltag", "dg", "glide_gscore", "chemplp", "plp")
#: Rows that algorithms on the driver take at most; they raise beyond it.
DRIVER_ROWS = 200_000


def higher_is_better(field: str, higher=(), lower=()) -> tuple[bool, bool]:
    """(direction, whether it was assumed): overrides, then known fields, else lower."""
    name = field.lower()
    if name in {h.lower() for h in higher}:
        return True, False
    if name in {x.lower() for x in lower}:
        return False, False
    return name in HIGHER, name not in HIGHER and name not in LOWER


def detect_field(fields) -> str | None:
    """The first known score field in a fixed order: lower-is-better ones first."""
    by = {f.lower(): f for f in reversed(list(fields))}
    return next((by[k] for k in (*LOWER, *HIGHER) if k in by), None)


def efficiency(score, heavy, higher: bool):
    return F.when(heavy > 0, (score if higher else -score) / heavy)


def rank_poses(poses: DataFrame, score: str, higher: bool, order: list[str], heavy: str | None = None, ligand: str | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds rank by score in its direction, ties in `order`; rows without a score drop out.

    ligand: keep the best pose of each ligand first. by: rank within groups; without groups ranges are sorted by the tasks
    and numbered from their counts."""
    best = F.col(score).desc() if higher else F.col(score).asc()
    p = poses.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    if ligand:
        w = W.partitionBy(*by, ligand).orderBy(best, *order)
        p = p.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    if heavy:
        p = p.withColumn("efficiency", efficiency(F.col(score), F.col(heavy), higher))
    if not by:
        return numbered(p, [best, *order], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(best, *order)))


def summarise(poses: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    return poses.agg(F.count("*").alias("n_poses"), F.count(s).alias("n_scored"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))


def consensus(poses: DataFrame, scores: dict[str, bool], key: str, order: str) -> DataFrame:
    """(key, <score>, rank_<score>, mean_rank, rank): best value of each score by key, ordinal ranks, their mean.

    scores: column -> higher is better. Missing scores have no rank; keys without any come last. Ties follow first
    appearance in `order`."""
    best = [(F.max if hi else F.min)(s).alias(s) for s, hi in scores.items()]
    g = poses.groupBy(key).agg(*best, F.min(order).alias("first"))
    for s, hi in scores.items():
        g = numbered(g, [F.col(s).desc_nulls_last() if hi else F.col(s).asc_nulls_last(), "first", key], "__n")
        g = g.withColumn(f"rank_{s}", F.when(F.col(s).isNotNull(), (F.col("__n") + 1).cast("int"))).drop("__n")
    ranks = [F.col(f"rank_{s}") for s in scores]
    n = sum((r.isNotNull().cast("int") for r in ranks[1:]), ranks[0].isNotNull().cast("int"))
    total = sum((F.coalesce(r, F.lit(0)) for r in ranks[1:]), F.coalesce(ranks[0], F.lit(0)))
    g = g.withColumn("mean_rank", F.when(n > 0, total / n))
    g = numbered(g, [F.col("mean_rank").asc_nulls_last(), "first", key], "rank")
    return g.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("first")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a number from 0 in the given order. Ranges are sorted task by task, written to the shared folder, and numbered
    from their counts: no task sees more than its range."""
    path = scratch(df.sparkSession, "ranges")
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    d.write.parquet(path)
    d = df.sparkSession.read.schema(d.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))
    counts = d.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each range
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return d.join(before, "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def pose_ligand(name):
    return ligand_key(name)


def dedup(df: DataFrame, key_col: str, order: list[str]) -> DataFrame:
    """First row of each trimmed key; rows with an empty or null key all stay. Keys meet as SHA-256 digests, not as texts."""
    key = F.trim(F.coalesce(F.col(key_col), F.lit("")))
    keyed = df.withColumn("__k", F.when(key != "", F.sha2(key, 256)))
    rest = keyed.where("__k is not null").withColumn("__r", F.row_number().over(W.partitionBy("__k").orderBy(*order))).where("__r = 1").drop("__r")
    return rest.unionByName(keyed.where("__k is null")).drop("__k")


def duplicate_groups(df: DataFrame, key_col: str, id_col: str) -> DataFrame:
    """(key, n, members) of keys that more than one row has; members sorted."""
    key = F.trim(F.col(key_col))
    return df.where(key != "").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id_col)).alias("members")).where("n > 1")


def hash_split(df: DataFrame, id_col: str, test: float, val: float, seed: int = 0) -> DataFrame:
    """Adds split by the md5 of seed and id: no shuffle, stable under growth, sizes near their shares."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + val, "validation").otherwise("train"))


def _sizes(n: int, test: float, val: float) -> tuple[int, int]:
    if test < 0 or val < 0 or test + val >= 1 + 1e-9:
        raise ValueError("test and val are shares under 1 together")
    return round(n * test), round(n * val)


def random_split(n: int, test: float, val: float, seed: int = 0) -> dict[str, list[int]]:
    """Row numbers by a seeded permutation: test first, then validation, then train."""
    order = np.random.default_rng(seed).permutation(n)
    t, v = _sizes(n, test, val)
    return {"test": sorted(order[:t].tolist()), "validation": sorted(order[t : t + v].tolist()), "train": sorted(order[t + v :].tolist())}


def exact_split(df: DataFrame, id_col: str, test: float, val: float, seed: int = 0) -> DataFrame:
    """Adds split with sizes of exactly round(n * share), in the order of the md5 of seed and id: random_split for tables of
    any size. Equal ids are in the order of their hash only."""
    n = df.count()
    t, v = _sizes(n, test, val)
    d = numbered(df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))), ["__h", id_col], "__k")
    return d.withColumn("split", F.when(F.col("__k") < t, "test").when(F.col("__k") < t + v, "validation").otherwise("train")).drop("__h", "__k")


def group_split(df: DataFrame, group_col: str, test: float, val: float) -> DataFrame:
    """Adds split so that no group straddles: groups by size, then name, fill train, then validation, then test.

    One row for each group goes to the driver, DRIVER_ROWS at most; a bounded table goes back."""
    sizes = df.groupBy(group_col).agg(F.count("*").alias("n"))
    rows = sizes.limit(DRIVER_ROWS + 1).collect()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} groups; use hash_split on the group column")
    n = sum(r["n"] for r in rows)
    t, v = _sizes(n, test, val)
    cap = {"train": n - t - v, "validation": v}
    used = {"train": 0, "validation": 0}
    out = []
    for r in sorted(rows, key=lambda r: (-r["n"], str(r[0]))):
        to = next((s for s in ("train", "validation") if used[s] + r["n"] <= cap[s]), "test")
        if to != "test":
            used[to] += r["n"]
        out.append((r[0], to))
    kind = df.schema[group_col].dataType.simpleString()
    table = df.sparkSession.createDataFrame(out, f"`__g` {kind}, split string")
    return df.join(F.broadcast(table), F.col(group_col).eqNullSafe(F.col("__g")), "left").drop("__g")


def _matrix(df: DataFrame, id_col: str, features: list[str] | str):
    cols = [features] if isinstance(features, str) else features
    rows = df.select(id_col, *cols).orderBy(id_col).limit(DRIVER_ROWS + 1).toPandas()
    if len(rows) > DRIVER_ROWS:
        raise ValueError(f"more than {DRIVER_ROWS} rows for a greedy selection on the driver")
    m = np.array(rows[features].tolist(), float) if isinstance(features, str) else rows[cols].to_numpy(float)
    return rows[id_col].to_numpy(), m.reshape(len(rows), -1)


def _z(m):
    s = m.std(0)
    s[s == 0] = 1
    return (m - m.mean(0)) / s


def maxmin(m: np.ndarray, n: int) -> list[int]:
    """Farthest-first order: the row farthest from the centroid, then always the farthest from those picked."""
    if not len(m) or n <= 0:
        return []
    picks = [int(np.argmax(((m - m.mean(0)) ** 2).sum(1)))]
    near = ((m - m[picks[0]]) ** 2).sum(1)
    while len(picks) < min(n, len(m)):
        near[picks[-1]] = -1
        k = int(np.argmax(near))
        picks.append(k)
        near = np.where(near < 0, near, np.minimum(near, ((m - m[k]) ** 2).sum(1)))
    return picks


def _reduced(df: DataFrame, id_col: str, features: list[str] | str, n: int, standardise: bool) -> DataFrame:
    """(id, __f): whole rows, standardised over all of them; above DRIVER_ROWS only n of each task, until few enough are left."""
    f = F.transform(F.col(features), lambda x: x.cast("double")) if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    d = df.select(id_col, f.alias("__f")).where(F.forall("__f", lambda x: x.isNotNull() & ~F.isnan(x)))
    if standardise:
        each = d.select(F.posexplode("__f").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        rows = sorted((r["k"], r["m"], r["s"] or 1.0) for r in each.collect())  # a row for each dimension
        scale = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for _, m, s in rows]).cast("array<struct<m:double,s:double>>")
        d = d.select(id_col, F.zip_with("__f", scale, lambda x, s: (x - s["m"]) / s["s"]).alias("__f"))

    def picked(frames):
        import pandas as pd

        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if len(held) > n:
                held = held.sort_values(id_col).reset_index(drop=True)
                held = held.iloc[sorted(maxmin(np.array(held["__f"].tolist()), n))]
        if held is not None:
            yield held

    while d.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
        path, before = scratch(df.sparkSession, "picked"), d.rdd.getNumPartitions()
        d.mapInPandas(picked, d.schema).write.parquet(path)
        d = df.sparkSession.read.parquet(path).coalesce(max(1, before // 8))
    return d


def select_diverse(df: DataFrame, id_col: str, features: list[str] | str, n: int, standardise: bool = True) -> DataFrame:
    """(id, pick) of n rows by MaxMin; rows with a missing feature don't take part.

    The order is sequential, so the features go to the driver. Of more than DRIVER_ROWS rows only those go that each task
    picks first, n of its own by the same rule: picks of picks are at most twice as near to each other as the best."""
    if n > DRIVER_ROWS:
        raise ValueError(f"{DRIVER_ROWS} picks at most")
    if standardise or df.limit(DRIVER_ROWS + 1).count() > DRIVER_ROWS:
        df = _reduced(df, id_col, features, n, standardise)
        features, standardise = "__f", False
    ids, m = _matrix(df, id_col, features)
    ok = ~np.isnan(m).any(1)
    ids, m = ids[ok], m[ok]
    picks = maxmin(_z(m) if standardise and len(m) else m, n)
    kind = df.schema[id_col].dataType.simpleString()
    return df.sparkSession.createDataFrame([(ids[p].item() if hasattr(ids[p], "item") else ids[p], k) for k, p in enumerate(picks)], f"{id_col} {kind}, pick int")


def diversity_split(m: np.ndarray, test: float, val: float) -> list[str]:
    """MaxMin order dealt to the split with the largest deficit; ties train, validation, test. Rows with NaN: train."""
    n = len(m)
    t, v = _sizes(n, test, val)
    share = {"train": (n - t - v) / max(1, n), "validation": v / max(1, n), "test": t / max(1, n)}
    ok = np.flatnonzero(~np.isnan(m).any(1))
    out, used = ["train"] * n, dict.fromkeys(share, 0)
    for done, p in enumerate(maxmin(_z(m[ok]), len(ok)) if len(ok) else []):
        to = max(share, key=lambda s: (share[s] * (done + 1) - used[s], -list(share).index(s)))
        used[to] += 1
        out[ok[p]] = to
    return out


def butina(similar: list[set[int]]) -> list[list[int]]:
    """Sphere exclusion: the row with the most unassigned neighbours leads a cluster, ties to the lower row."""
    left, out = set(range(len(similar))), []
    order = sorted(left, key=lambda i: (-len(similar[i]), i))
    for i in order:
        if i in left:
            own = [i, *sorted((similar[i] & left) - {i})]
            left -= set(own)
            out.append(own)
    return out


def tanimoto(a, b):
    """Of two arrays of on-bits."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(0.0)
