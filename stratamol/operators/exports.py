"""Graphs as arrays, for learning libraries and for reading batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["structure_id"]
#: The labels of residue edges, in the order of their columns.
INTERACTIONS = ("disulfide", "ligand", "salt_bridge", "covalent", "hydrophobic", "polar", "proximity")


def interaction_one_hot(edges: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, i, j, interaction_<label>...): 1 for the edge's label; an edge without one has zeros only."""
    return edges.select(*key, "i", "j", *(F.coalesce((F.col("label") == x).cast("double"), F.lit(0.0)).alias(f"interaction_{x}") for x in INTERACTIONS))


def graph_arrays(nodes: DataFrame, edges: DataFrame, node_features: list[str], edge_features: list[str], key: list[str] = KEY) -> DataFrame:
    """(key, x, edge_index, edge_attr): of each graph its nodes' features in order, both directions of its edges as two lists
    of ends, and their features. A graph without edges has empty lists; one graph is one row."""
    x = nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("atom_idx", F.array(*[F.col(f).cast("double") for f in node_features]).alias("f")))).alias("x"))
    f = F.array(*[F.col(c).cast("double") for c in edge_features]).cast("array<double>").alias("f")
    both = edges.select(*key, "i", "j", f).unionByName(edges.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), f))
    e = both.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "j", "f"))).alias("e"))
    out = x.join(e, key, "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<i:int,j:int,f:array<double>>>")))
    ends = F.array(F.transform("e", lambda r: r["i"].cast("int")), F.transform("e", lambda r: r["j"].cast("int")))
    return out.select(*key, F.transform("x", lambda r: r["f"]).alias("x"), ends.alias("edge_index"), F.transform("e", lambda r: r["f"]).alias("edge_attr"))


def batches(arrays: DataFrame, size: int = 64, key: list[str] = KEY) -> Iterator[dict]:
    """Graphs of graph_arrays() joined into batches of numpy arrays: x, edge_index, edge_attr, batch and the keys.

    Rows stream to the driver partition by partition, so that only some batches are held at once."""
    import numpy as np

    def joined(rows):
        sizes = [len(r["x"]) for r in rows]
        offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        index = [np.array(r["edge_index"], np.int64).reshape(2, -1) + o for r, o in zip(rows, offsets, strict=True)]
        attr = [np.array(r["edge_attr"], float).reshape(len(r["edge_index"][0]), -1) for r in rows if r["edge_index"][0]]
        return {
            "x": np.concatenate([np.array(r["x"], float).reshape(len(r["x"]), -1) for r in rows]), "edge_index": np.concatenate(index, axis=1), "edge_attr": np.concatenate(attr) if attr else np.zeros((0, 0)),
            "batch": np.repeat(np.arange(len(rows)), sizes), "keys": [tuple(r[k] for k in key) for r in rows],
        }

    held = []
    for r in arrays.toLocalIterator():
        held.append(r)
        if len(held) == size:
            yield joined(held)
            held = []
    if held:
        yield joined(held)


def to_networkx(row):
    """One row of graph_arrays() as a networkx graph; needs that library."""
    import networkx

    g = networkx.Graph()
    g.add_nodes_from((k, {"features": f}) for k, f in enumerate(row["x"]))
    g.add_edges_from((i, j, {"features": f}) for i, j, f in zip(*row["edge_index"], row["edge_attr"], strict=True) if i < j)
    return g


def to_pyg(row):
    """One row of graph_arrays() as a torch_geometric Data object; needs torch and torch_geometric."""
    import torch
    from torch_geometric.data import Data

    return Data(x=torch.tensor(row["x"]), edge_index=torch.tensor(row["edge_index"], dtype=torch.long), edge_attr=torch.tensor(row["edge_attr"]))


def to_dgl(row):
    """One row of graph_arrays() as a dgl graph; needs torch and dgl."""
    import dgl
    import torch

    g = dgl.graph((torch.tensor(row["edge_index"][0]), torch.tensor(row["edge_index"][1])), num_nodes=len(row["x"]))
    g.ndata["x"], g.edata["edge_attr"] = torch.tensor(row["x"]), torch.tensor(row["edge_attr"])
    return g
