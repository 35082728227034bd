"""Named feature sets: their columns by rule, a catalogue, and vectors in a preset's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import AMINO_ACIDS, DEFAULT_ELEMENTS

KEY = ["structure_id"]
RESIDUE_TYPES = (*AMINO_ACIDS, "UNK")
METHODS = ("ca", "com", "min")

# The columns of each preset, in order.
NODE = {"default": ["atomic_number", "mass"], "basic": ["atomic_number", "mass", "formal_charge"]}
EDGE = {"default": ["distance"], "basic": ["distance", "bond_order"], "ml": ["distance", "bond_order", "aromatic"], "geom": ["distance", "bond_order", "aromatic", "bond_angle", "dihedral"]}


def node_names(preset: str = "default", elements=DEFAULT_ELEMENTS) -> list[str]:
    if preset == "ml":
        return [f"element_{e}" for e in elements] + ["atomic_number", "mass", "formal_charge", "aromatic"]
    return _of(NODE, preset)


def edge_names(preset: str = "default") -> list[str]:
    return _of(EDGE, preset)


def residue_node_names(preset: str = "default", residue_types=RESIDUE_TYPES) -> list[str]:
    return _of({"default": ["residue_size"], "ml": [f"residue_{r}" for r in residue_types] + ["residue_size"]}, preset)


def residue_edge_names(preset: str = "default") -> list[str]:
    return _of({"default": ["distance"], "ml": ["distance", *(f"contact_{m}" for m in METHODS)]}, preset)


def descriptor_names(elements=DEFAULT_ELEMENTS, bins: int = 10) -> list[str]:
    """Columns of aggregates.descriptors() that make up a fixed-width vector."""
    return ["n_atoms", "n_residues", "total_mass", *(f"count_{e}" for e in elements), "rg", "dim_x", "dim_y", "dim_z", "volume", "compactness", "m1", "m2", "m3", "asphericity", "acylindricity", "anisotropy", *(f"distance_hist_{k}" for k in range(bins)), "n_bonds", "mean_length", "std_length", "min_length", "max_length", "n_contacts", "contact_density", "residue_contacts", "residue_contact_density", "n_polar", "n_salt_bridges"]


def _of(table: dict, preset: str) -> list[str]:
    if preset not in table:
        raise ValueError(f"preset is one of {', '.join(table)}, not {preset!r}")
    return list(table[preset])


def catalogue(spark: SparkSession, category: str | None = None) -> DataFrame:
    """(category, kind, name, n_features, features) of every preset."""
    rows = [("descriptors", "structure", "native", descriptor_names())]
    rows += [("graph", "node", p, node_names(p)) for p in ("default", "basic", "ml")] + [("graph", "edge", p, edge_names(p)) for p in EDGE]
    rows += [("graph", "residue node", p, residue_node_names(p)) for p in ("default", "ml")] + [("graph", "residue edge", p, residue_edge_names(p)) for p in ("default", "ml")]
    rows += [("coarse-grain", "mapping", m, []) for m in ("residue_com", "residue_centroid", "backbone_sidechain")]
    if category is not None and category not in {r[0] for r in rows}:
        raise ValueError(f"no category {category!r}")
    rows = [(c, k, n, len(f), f) for c, k, n, f in rows if category in (None, c)]
    return spark.createDataFrame(rows, "category string, kind string, name string, n_features int, features array<string>")


def residue_node_features(residues: DataFrame, preset: str = "default", residue_types=RESIDUE_TYPES, key: list[str] = KEY) -> DataFrame:
    """(key, residue_idx, <columns>) from residues(); UNK marks all types that aren't named."""
    name = F.upper("resname")
    known = [r for r in residue_types if r != "UNK"]
    cols = {f"residue_{r}": (~name.isin(*known) if r == "UNK" else name == r).cast("double") for r in residue_types} | {"residue_size": F.col("n_atoms").cast("double")}
    return residues.select(*key, "residue_idx", *(cols[c].alias(c) for c in residue_node_names(preset, residue_types)))


def residue_edge_features(edges: DataFrame, method: str = "ca", preset: str = "default", key: list[str] = KEY) -> DataFrame:
    cols = {"distance": F.sqrt("d2")} | {f"contact_{m}": F.lit(float(m == method)) for m in METHODS}
    return edges.select(*key, "i", "j", *(cols[c].alias(c) for c in residue_edge_names(preset)))


def vectors(df: DataFrame, names: list[str], key: list[str] = KEY) -> DataFrame:
    """(key, features): one array in the names' order, 0 where a column or value is missing."""
    have = set(df.columns)
    return df.select(*key, F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0) for n in names]).alias("features"))
