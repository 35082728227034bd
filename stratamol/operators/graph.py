"""Molecular graphs as node and edge tables: features, angles, encodings, datasets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import ANIONIC, CATIONIC, DEFAULT_ELEMENTS, GRAPH_HYDROPHOBIC, GRAPH_POLAR, WATER, atomic_number, covalent_radius, mass
from ..functions.geometry import angle, dihedral, vec
from .residues import PARTS, with_residue_index
from .spatial import pairs

KEY = ["structure_id"]
#: What interactions() needs to know of an edge's residues.
ENDS = ("chain", "resid", "resname", "hetero")
#: Valence by element, below four neighbours and from four on; other elements have that of their neighbours.
VALENCE = {"H": (1, 1), "F": (1, 1), "CL": (1, 1), "BR": (1, 1), "I": (1, 1), "O": (2, 2), "SE": (2, 2), "TE": (2, 2), "S": (2, 6), "N": (3, 4), "P": (3, 5), "AS": (3, 5), "SB": (3, 5), "C": (4, 4), "SI": (4, 4), "GE": (4, 4), "SN": (4, 4), "PB": (4, 4)}


def directed(edges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every edge both ways."""
    swap = {"i": "j", "j": "i"}
    return edges.unionByName(edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns)))


def with_self_loops(edges: DataFrame, nodes: DataFrame, key: list[str] = KEY) -> DataFrame:
    loops = nodes.select(*key, F.col("atom_idx").alias("i"), F.col("atom_idx").alias("j"))
    return edges.unionByName(loops, allowMissingColumns=True)


def with_global_node(nodes: DataFrame, edges: DataFrame, features: list[str], key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Adds to each graph a node of mean features, joined both ways to every other."""
    g = nodes.groupBy(*key).agg((F.max("atom_idx") + 1).alias("atom_idx"), *(F.avg(f).alias(f) for f in features))
    more = nodes.select(*key, "atom_idx").join(g.select(*key, F.col("atom_idx").alias("hub")), key)
    ways = more.select(*key, F.explode(F.array(F.struct(F.col("atom_idx").alias("i"), F.col("hub").alias("j")), F.struct(F.col("hub").alias("i"), F.col("atom_idx").alias("j")))).alias("e")).select(*key, "e.i", "e.j")
    return nodes.select(*key, "atom_idx", *features).unionByName(g), edges.unionByName(ways, allowMissingColumns=True)


def node_features(atoms: DataFrame, elements=DEFAULT_ELEMENTS, key: list[str] = KEY) -> DataFrame:
    """Atomic number, mass, radius, charge and a one-hot element column for each of elements and for all others."""
    e = F.upper("element")
    hot = {f"element_{s}": (e == s).cast("int") for s in elements} | {"element_other": (~e.isin(*elements)).cast("int")}
    charge = F.coalesce(F.col("formal_charge"), F.lit(0)) if "formal_charge" in atoms.columns else F.lit(0)
    cols = {"atomic_number": atomic_number("element"), "mass": mass("element"), "covalent_radius": covalent_radius("element"), "formal_charge": charge}
    return atoms.select(*key, "atom_idx", *(v.alias(k) for k, v in {**cols, **hot}.items()))


def degrees(edges: DataFrame, key: list[str] = KEY) -> DataFrame:
    return directed(edges.select(*key, "i", "j")).groupBy(*key, F.col("i").alias("atom_idx")).agg(F.count("*").alias("degree"))


def edge_angles(edges: DataFrame, atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j, angle): the mean of all angles that the edge makes with a neighbouring edge, 0 without one."""
    d = directed(edges.select(*key, "i", "j"))
    n = d.select(*(F.col(k).alias(f"n_{k}") for k in key), F.col("i").alias("at"), F.col("j").alias("other"))
    on = (F.col("i") == F.col("at")) & (F.col("other") != F.col("j"))
    for k in key:
        on = on & (F.col(k) == F.col(f"n_{k}"))
    e = d.join(n, on).select(*key, "i", "j", "other")
    p = _placed(_placed(_placed(e, atoms, "i", key), atoms, "j", key), atoms, "other", key)
    a = p.withColumn("a", angle(vec("j_"), vec("i_"), vec("other_")))
    g = a.groupBy(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("a").alias("angle"))
    return edges.select(*key, "i", "j").join(g, [*key, "i", "j"], "left").fillna(0.0, ["angle"])


def edge_dihedrals(edges: DataFrame, atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j, dihedral): the plain mean of all dihedrals a-i-j-b about the edge, 0 without one."""
    d = directed(edges.select(*key, "i", "j"))
    n = d.select(*(F.col(k).alias(f"n_{k}") for k in key), F.col("i").alias("at"), F.col("j").alias("other"))

    def ends(e, at, skip, name):
        on = F.col(at) == F.col("at")
        for k in key:
            on = on & (F.col(k) == F.col(f"n_{k}"))
        return e.join(n, on).where(F.col("other") != F.col(skip)).withColumn(name, F.col("other")).drop("at", "other", *(f"n_{k}" for k in key))

    e = ends(ends(edges.select(*key, "i", "j"), "i", "j", "a"), "j", "i", "b")
    for c in ("a", "i", "j", "b"):
        e = _placed(e, atoms, c, key)
    t = e.withColumn("t", dihedral(vec("a_"), vec("i_"), vec("j_"), vec("b_")))
    g = t.groupBy(*key, "i", "j").agg(F.avg("t").alias("dihedral"))
    return edges.select(*key, "i", "j").join(g, [*key, "i", "j"], "left").fillna(0.0, ["dihedral"])


def _placed(e: DataFrame, atoms: DataFrame, name: str, key) -> DataFrame:
    return e.join(atoms.select(*key, F.col("atom_idx").alias(name), *(F.col(x).alias(f"{name}_{x}") for x in "xyz")), [*key, name])


def random_walk(edges: DataFrame, k: int, key: list[str] = KEY) -> DataFrame:
    """(key, atom_idx, step, p): chance of being back after 1 to k steps, by repeated joins of sparse transition tables.

    Grows with the neighbourhood of k / 2 steps; for graphs of some hundred nodes use encodings() instead."""
    d = directed(edges.select(*key, "i", "j"))
    deg = d.groupBy(*key, "i").agg(F.count("*").alias("deg"))
    step = d.join(deg, [*key, "i"]).select(*key, "i", "j", (1 / F.col("deg")).alias("p"))
    now, out = step, None
    for t in range(1, k + 1):
        back = now.where("i = j").select(*key, F.col("i").alias("atom_idx"), F.lit(t).alias("step"), "p")
        out = back if out is None else out.unionByName(back)
        if t < k:
            a, b = now.withColumnRenamed("j", "mid"), step.select(*key, F.col("i").alias("mid"), "j", F.col("p").alias("q"))
            now = a.join(b, [*key, "mid"]).groupBy(*key, "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("p"))
    return out


def stable_signs(v: np.ndarray) -> np.ndarray:
    """Turns each column so that its largest entry, rounded to 8 places, is positive."""
    r = np.round(np.abs(v), 8)
    at = r.argmax(0)
    s = np.sign(v[at, np.arange(v.shape[1])])
    s[s == 0] = 1
    return v * s


def laplacian(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a = np.zeros((n, n))
    a[i, j] = a[j, i] = 1
    deg = a.sum(1)
    inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1)), 0)
    return np.eye(n) - inv[:, None] * a * inv[None, :]


def encodings(edges: DataFrame, sizes: DataFrame, k: int = 8, kind: str = "laplacian", key: list[str] = KEY) -> DataFrame:
    """(key, atom_idx, pe) for each node: k smallest eigenvectors of the normalised Laplacian or k return chances.

    sizes: (key, n). Graphs are packed as arrays, many to a batch; each must fit one task's memory as a dense matrix."""

    @F.pandas_udf("array<array<double>>")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ns, es in it:
            out = []
            for n, e in zip(ns, es, strict=True):
                e = np.array([(x["i"], x["j"]) for x in e] if e is not None else [], int).reshape(-1, 2)
                if kind == "laplacian":
                    v = np.linalg.eigh(laplacian(n, e[:, 0], e[:, 1]))[1][:, :k]
                    pe = np.zeros((n, k))
                    pe[:, : v.shape[1]] = stable_signs(v)
                else:
                    a = np.zeros((n, n))
                    a[e[:, 0], e[:, 1]] = a[e[:, 1], e[:, 0]] = 1
                    p = a / np.maximum(a.sum(1), 1)[:, None]
                    m, cols = p.copy(), []
                    for _ in range(k):
                        cols.append(np.diag(m).copy())
                        m = m @ p
                    pe = np.column_stack(cols)
                out.append(pe.tolist())
            yield pd.Series(out)

    packed = sizes.join(edges.groupBy(*key).agg(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))).alias("e")), key, "left")
    return packed.select(*key, F.posexplode(run("n", "e")).alias("atom_idx", "pe"))


def guess_bond_orders(elements: list[str], bonds: list[tuple[int, int]]) -> list[float]:
    """Raises orders in two passes over the bonds in order, while both ends lack valence."""
    degree = [0] * len(elements)
    for u, v in bonds:
        degree[u] += 1
        degree[v] += 1
    want = [VALENCE[e.upper()][d >= 4] if e.upper() in VALENCE else d for e, d in zip(elements, degree, strict=True)]
    have, orders = list(degree), [1.0] * len(bonds)
    for _ in range(2):
        before = list(orders)
        for k, (u, v) in enumerate(bonds):
            if have[u] < want[u] and have[v] < want[v]:
                orders[k] += 1
                have[u] += 1
                have[v] += 1
        if orders == before:
            break
    return orders


def bond_orders(bonds: DataFrame, atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j, bond_order) guessed from valences, over the bonds in order; packed by structure."""

    @F.pandas_udf("array<double>")
    def run(es: pd.Series, bs: pd.Series) -> pd.Series:
        return pd.Series([guess_bond_orders(list(e), [(x["i"], x["j"]) for x in b]) for e, b in zip(es, bs, strict=True)])

    e = atoms.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("atom_idx", "element"))), lambda x: x["element"]).alias("e"))
    b = bonds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))).alias("b"))
    z = e.join(b, key).withColumn("o", run("e", "b"))
    return z.select(*key, F.explode(F.arrays_zip("b", "o")).alias("z")).select(*key, F.col("z.b.i").alias("i"), F.col("z.b.j").alias("j"), F.col("z.o").alias("bond_order"))


def interactions(atoms: DataFrame, edges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j, label) of residue edges, the first that holds of: disulfide, ligand, salt_bridge, covalent, hydrophobic,
    polar, proximity.

    Edges that carry ENDS of both residues, as contact_map() gives them, are not joined to their residues."""
    a = with_residue_index(atoms, key)
    name, atom = F.upper("resname"), F.upper("atom_name")
    side = ~atom.isin("N", "CA", "C", "O", "OXT") & (F.upper("element") != "H")
    both = F.concat_ws(" ", name, atom)
    sign = F.when(both.isin([" ".join(p) for p in CATIONIC]), 1).when(both.isin([" ".join(p) for p in ANIONIC]), -1).otherwise(0)
    a = a.withColumns({"side": side, "sign": sign, "sg": (name == "CYS") & (atom == "SG")})
    p = pairs(a, 5.0, key, extra=["residue_idx", "side", "sign", "sg"]).where("i_residue_idx <> j_residue_idx")
    g = p.groupBy(*key, F.col("i_residue_idx").alias("i"), F.col("j_residue_idx").alias("j")).agg(
        F.min(F.when(F.col("i_sg") & F.col("j_sg"), F.col("d2"))).alias("ss"), F.min(F.when(F.col("i_sign") * F.col("j_sign") < 0, F.col("d2"))).alias("salt"), F.min(F.when(F.col("i_side") & F.col("j_side"), F.col("d2"))).alias("sc"),
    )
    e, ends = edges, [f"{s}_{c}" for s in "ij" for c in ENDS]
    if not set(ends) <= set(edges.columns):
        e = edges.select(*key, "i", "j")
        r = a.groupBy(*key, "residue_idx").agg(*(F.first(c).alias(c) for c in PARTS), F.bool_or("hetero").alias("hetero"))
        for s in "ij":
            e = e.join(r.select(*key, F.col("residue_idx").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ENDS)), [*key, s])

    def each(test):
        return test("i") & test("j")

    ligand = [F.col(f"{s}_hetero") & ~F.upper(f"{s}_resname").isin(*WATER) for s in "ij"]
    near = (F.col("i_chain") == F.col("j_chain")) & (F.abs(F.col("i_resid") - F.col("j_resid")) == 1)
    greasy, polar = (each(lambda s, names=names: F.upper(f"{s}_resname").isin(*names)) for names in (GRAPH_HYDROPHOBIC, GRAPH_POLAR))
    e = e.select(*key, "i", "j", (ligand[0] | ligand[1]).alias("ligand"), near.alias("near"), greasy.alias("greasy"), polar.alias("polar"))
    e = e.join(g, [*key, "i", "j"], "left")  # narrow rows: residues' names have served
    label = (
        F.when(F.col("ss") < 2.5**2, "disulfide").when(F.col("ligand"), "ligand").when(F.col("salt") < 16.0, "salt_bridge").when(F.col("near"), "covalent")
        .when((F.col("sc") < 25.0) & F.col("greasy"), "hydrophobic").when((F.col("sc") < 25.0) & F.col("polar"), "polar").otherwise("proximity")
    )
    return e.select(*key, "i", "j", label.alias("label"))


def save_dataset(nodes: DataFrame, edges: DataFrame, graphs: DataFrame, out: str) -> None:
    """A graph dataset as three Parquet tables under one folder."""
    for name, df in (("nodes", nodes), ("edges", edges), ("graphs", graphs)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def load_dataset(spark, out: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("nodes", "edges", "graphs")}
