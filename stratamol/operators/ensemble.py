"""Ensembles: models of one structure, keyed by model_id; alignment, fluctuations, correlations, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .residues import contact_map

KEY = ["structure_id"]


def check_models(atoms: DataFrame, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """Structures whose models differ in their number of atoms; empty for a sound ensemble."""
    n = atoms.groupBy(*key, model).agg(F.count("*").alias("n"))
    return n.groupBy(*key).agg(F.count_distinct("n").alias("sizes")).where("sizes > 1")


def rotations(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best proper rotations for covariance matrices (n, 3, 3) and the sums of their signed singular values."""
    u, s, vt = np.linalg.svd(h)
    d = np.sign(np.linalg.det(np.einsum("nij,njk->nik", u, vt)))
    d[d == 0] = 1
    u[:, :, 2] *= d[:, None]
    return np.einsum("nij,njk->nik", u, vt), s[:, 0] + s[:, 1] + d * s[:, 2]


_SVD = "rotation array<double>, gain double"


def _rotate(covariance: str):
    """Rotation and gain of a covariance column; batches of small rows, no groups."""

    @F.pandas_udf(_SVD)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in batches:
            r, g = rotations(np.array(c.tolist(), float).reshape(-1, 3, 3))
            yield pd.DataFrame({"rotation": list(r.reshape(-1, 9)), "gain": g})

    return run(covariance)


def _moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Centroids, summed squares and the covariance of paired points p (px..) and q (qx..) about their centroids."""
    sums = [F.count("*").alias("n"), *(F.avg(f"{s}{x}").alias(f"{s}c{x}") for s in "pq" for x in "xyz"), *(F.sum(F.col(f"{s}{x}") * F.col(f"{s}{x}")).alias(f"{s}2{x}") for s in "pq" for x in "xyz")]
    sums += [F.sum(F.col(f"p{a}") * F.col(f"q{b}")).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    g = pairs.groupBy(*by).agg(*sums)

    def total(s):
        return sum((F.col(f"{s}2{x}") - F.col("n") * F.col(f"{s}c{x}") * F.col(f"{s}c{x}") for x in "yz"), F.col(f"{s}2x") - F.col("n") * F.col(f"{s}cx") * F.col(f"{s}cx"))

    cov = F.array(*[F.col(f"h{a}{b}") - F.col("n") * F.col(f"pc{a}") * F.col(f"qc{b}") for a in "xyz" for b in "xyz"])
    return g.withColumns({"gp": total("p"), "gq": total("q"), "cov": cov})


def aligned(atoms: DataFrame, reference: int | None = None, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """Every model superposed on the reference model (default: the first). One small row for each model meets numpy."""
    first = atoms.groupBy(*key).agg(F.min(model).alias("ref")) if reference is None else atoms.select(*key).distinct().withColumn("ref", F.lit(reference))
    base = atoms.join(first, key).where(F.col(model) == F.col("ref")).select(*key, "atom_idx", *(F.col(x).alias(f"q{x}") for x in "xyz"))
    p = atoms.select(*key, model, "atom_idx", *(F.col(x).alias(f"p{x}") for x in "xyz")).join(base, [*key, "atom_idx"])
    m = _moments(p, [*key, model]).withColumn("r", _rotate("cov"))
    m = m.select(*key, model, "pcx", "pcy", "pcz", "qcx", "qcy", "qcz", F.col("r.rotation").alias("rot"))
    a = atoms.join(m, [*key, model])
    d = [F.col(x) - F.col(f"pc{x}") for x in "xyz"]
    moved = {x: F.col(f"qc{x}") + sum((d[k] * F.col("rot")[3 * k + j] for k in (1, 2)), d[0] * F.col("rot")[j]) for j, x in enumerate("xyz")}
    return a.withColumns(moved).drop("rot", *(f"{s}c{x}" for s in "pq" for x in "xyz"))


def rmsd_matrix(atoms: DataFrame, align: bool = True, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """(key, model_a, model_b, rmsd) of all pairs of models; aligned values come from sums, without moving coordinates."""
    p = atoms.select(*key, "atom_idx", F.col(model).alias("model_a"), *(F.col(x).alias(f"p{x}") for x in "xyz"))
    q = atoms.select(*key, "atom_idx", F.col(model).alias("model_b"), *(F.col(x).alias(f"q{x}") for x in "xyz"))
    pairs = p.join(q, [*key, "atom_idx"]).where("model_a < model_b")
    if not align:
        d2 = sum(((F.col(f"p{x}") - F.col(f"q{x}")) * (F.col(f"p{x}") - F.col(f"q{x}")) for x in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
        return pairs.groupBy(*key, "model_a", "model_b").agg(F.sqrt(F.avg(d2)).alias("rmsd"))
    m = _moments(pairs, [*key, "model_a", "model_b"]).withColumn("r", _rotate("cov"))
    ms = F.greatest(F.lit(0.0), (F.col("gp") + F.col("gq") - 2 * F.col("r.gain")) / F.col("n"))
    return m.select(*key, "model_a", "model_b", F.sqrt(ms).alias("rmsd"))


def average(atoms: DataFrame, align: bool = True, key: list[str] = KEY) -> DataFrame:
    a = aligned(atoms, key=key) if align else atoms
    return a.groupBy(*key, "atom_idx").agg(*(F.avg(x).alias(x) for x in "xyz"))


def rmsf(atoms: DataFrame, align: bool = True, key: list[str] = KEY) -> DataFrame:
    """(key, atom_idx, n_models, rmsf): root mean square deviation of each atom from its mean place."""
    a = aligned(atoms, key=key) if align else atoms
    var = F.var_pop("x") + F.var_pop("y") + F.var_pop("z")
    return a.groupBy(*key, "atom_idx").agg(F.count("*").alias("n_models"), F.sqrt(var).alias("rmsf"))


def cross_correlation(atoms: DataFrame, align: bool = True, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """(key, i, j, correlation), i <= j, of displacements over models; 0 with a static atom, 1 with itself."""
    a = aligned(atoms, key=key, model=model) if align else atoms
    w = W.partitionBy(*key, "atom_idx")
    d = a.select(*key, model, "atom_idx", *((F.col(x) - F.avg(x).over(w)).alias(x) for x in "xyz"))
    i = d.select(*key, model, F.col("atom_idx").alias("i"), *(F.col(x).alias(f"i{x}") for x in "xyz"))
    j = d.select(*key, model, F.col("atom_idx").alias("j"), *(F.col(x).alias(f"j{x}") for x in "xyz"))

    def dot(s, t):
        return F.col(f"{s}x") * F.col(f"{t}x") + F.col(f"{s}y") * F.col(f"{t}y") + F.col(f"{s}z") * F.col(f"{t}z")

    g = i.join(j, [*key, model]).where("i <= j").groupBy(*key, "i", "j").agg(F.avg(dot("i", "j")).alias("c"), F.avg(dot("i", "i")).alias("vi"), F.avg(dot("j", "j")).alias("vj"))
    n = F.sqrt(F.col("vi") * F.col("vj"))
    return g.select(*key, "i", "j", F.when(F.col("i") == F.col("j"), 1.0).when(n > 0, F.col("c") / n).otherwise(0.0).alias("correlation"))


def contact_frequency(atoms: DataFrame, cutoff: float = 8.0, level: str = "residue", method: str = "ca", key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """(key, i, j, frequency): the share of models with the contact."""
    n = atoms.groupBy(*key).agg(F.count_distinct(model).alias("n"))
    c = contact_map(atoms, cutoff, level, method, key=[*key, model]).groupBy(*key, "i", "j").agg(F.count("*").alias("c"))
    return c.join(n, key).select(*key, "i", "j", (F.col("c") / F.col("n")).alias("frequency"))


def linkage_labels(d: np.ndarray, method: str = "average", cutoff: float | None = None, n_clusters: int | None = None) -> list[int]:
    """Agglomerative clusters of a distance matrix (single, complete, average), labels by first member from 0.

    Without cutoff and number the cutoff is the mean distance of pairs. Lance-Williams updates; ties to lower rows."""
    n = len(d)
    if n == 0:
        return []
    d = d.astype(float).copy()
    if cutoff is None and n_clusters is None:
        cutoff = float(d[np.triu_indices(n, 1)].mean()) if n > 1 else 0.0
    np.fill_diagonal(d, np.inf)
    size, member, live = np.ones(n), [[i] for i in range(n)], n
    while live > (n_clusters or 1):
        k = int(np.argmin(d))
        i, j = sorted(divmod(k, n))
        if not np.isfinite(d[i, j]) or (n_clusters is None and d[i, j] > cutoff):
            break
        both = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])}[method]
        d[i], d[:, i] = both, both
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[i] += member[j]
        member[j] = []
        live -= 1
    out = [0] * n
    for label, own in enumerate(sorted((m for m in member if m), key=min)):
        for i in own:
            out[i] = label
    return out


def cluster(rmsd: DataFrame, method: str = "average", cutoff: float | None = None, n_clusters: int | None = None, key: list[str] = KEY) -> DataFrame:
    """(key, model_id, cluster, medoid) of each structure's models from rmsd_matrix(); one structure's matrix meets one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.model_a) | set(pdf.model_b))
        at = {m: k for k, m in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        for a, b, r in zip(pdf.model_a, pdf.model_b, pdf.rmsd, strict=True):
            d[at[a], at[b]] = d[at[b], at[a]] = r
        labels = linkage_labels(d, method, cutoff, n_clusters)
        medoid = {}
        for c in set(labels):
            own = [k for k, x in enumerate(labels) if x == c]
            medoid[c] = names[own[int(np.argmin(d[np.ix_(own, own)].sum(1)))]]
        out = pd.DataFrame({"model_id": names, "cluster": labels})
        out["medoid"] = [medoid[c] == m for m, c in zip(names, labels, strict=True)]
        for k in reversed(key):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = ", ".join(f"{k} {rmsd.schema[k].dataType.simpleString()}" for k in key)
    return rmsd.groupBy(*key).applyInPandas(run, f"{kinds}, model_id {rmsd.schema['model_a'].dataType.simpleString()}, cluster int, medoid boolean")


def cluster_order(clusters: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, position, model_id): models sorted by cluster, as a block-diagonal matrix has them."""
    w = W.partitionBy(*key).orderBy("cluster", "model_id")
    return clusters.select(*key, (F.row_number().over(w) - 1).alias("position"), "model_id")


def frame_series(atoms: DataFrame, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """(key, model, n_atoms, rg, rmsd_first): radius of gyration and plain RMSD to the first frame, frame by frame."""
    from .aggregates import geometry

    g = geometry(atoms, [*key, model]).select(*key, model, "n_atoms", "rg")
    first = atoms.groupBy(*key).agg(F.min(model).alias("ref"))
    base = atoms.join(first, key).where(F.col(model) == F.col("ref")).select(*key, "atom_idx", *(F.col(x).alias(f"q{x}") for x in "xyz"))
    p = atoms.join(base, [*key, "atom_idx"])
    d2 = sum(((F.col(x) - F.col(f"q{x}")) * (F.col(x) - F.col(f"q{x}")) for x in "yz"), (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")))
    return g.join(p.groupBy(*key, model).agg(F.sqrt(F.avg(d2)).alias("rmsd_first")), [*key, model], "left")
