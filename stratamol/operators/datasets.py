"""Graph datasets and molecule tables ready for learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import covalent_radius
from ..sources import formats
from . import aggregates, graph, ranking, residues, spatial

KEY = ["structure_id"]


def graph_edges(atoms: DataFrame, kind: str = "bonds", value: float | None = None, explicit: DataFrame | None = None, min_seq_sep: int = 0, key: list[str] = KEY, cells: bool = True) -> DataFrame:
    """(key, i, j, distance, covalent) by one rule: bonds (tolerance), radius (distance) or knn (number).

    min_seq_sep drops edges of one chain whose residue numbers differ by less."""
    if kind == "radius" and explicit is None:
        return _radius_edges(atoms, value or 5.0, min_seq_sep, key, cells)
    bonds = aggregates.bonds(atoms, explicit, value if kind == "bonds" and value else 1.2, key, cells)
    if kind == "bonds":
        e = bonds.select(*key, "i", "j", F.sqrt("d2").alias("distance")).withColumn("covalent", F.lit(True))
    else:
        if kind == "radius":
            e = spatial.pairs(atoms, value or 5.0, key, cells).select(*key, "i", "j", F.sqrt("d2").alias("distance"))
        elif kind == "knn":
            near = spatial.nearest(atoms, int(value or 8), key, cells, distances=True)
            e = near.select(*key, "i", "j", F.sqrt("d2").alias("distance"))
        else:
            raise ValueError(f"edges are bonds, radius or knn, not {kind!r}")
        flags = bonds.select(*key, "i", "j", F.lit(True).alias("covalent"))
        e = e.join(flags, [*key, "i", "j"], "left").fillna(False, ["covalent"])
    if min_seq_sep:
        for s in "ij":
            e = e.join(atoms.select(*key, F.col("atom_idx").alias(s), F.col("chain").alias(f"{s}_chain"), F.col("resid").alias(f"{s}_resid")), [*key, s])
        near = (F.col("i_chain") == F.col("j_chain")) & (F.abs(F.col("i_resid") - F.col("j_resid")) < min_seq_sep)
        e = e.where(~near).drop("i_chain", "j_chain", "i_resid", "j_resid")
    return e


def _radius_edges(atoms: DataFrame, cutoff: float, min_seq_sep: int, key: list[str], cells: bool) -> DataFrame:
    """graph_edges() by radius in one pass over the pairs, which carry all that tells bonds and neighbours in sequence."""
    a = atoms.withColumn("radius", covalent_radius("element"))
    p = spatial.pairs(a, cutoff, key, cells, extra=["radius", *(["chain", "resid"] if min_seq_sep else [])])
    if min_seq_sep:
        p = residues.sequence_separation(p, min_seq_sep)
    bond = F.coalesce(F.sqrt("d2") < 1.2 * (F.col("i_radius") + F.col("j_radius")), F.lit(False))
    return p.select(*key, "i", "j", F.sqrt("d2").alias("distance"), bond.alias("covalent"))


def content_keys(spark: SparkSession, paths, options: str) -> DataFrame:
    """(path, cache_key): sha1 of the options and the file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select("path", F.sha1(F.concat(F.encode(F.lit(options), "UTF-8"), F.col("content"))).alias("cache_key"))


def labelled(ids: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Joins labels: numbers where they can be read as such, else text in label_text."""
    rows = labels.select(F.col(id_col).cast("string").alias("structure_id"), F.col(label_col).cast("string").alias("label_text"))
    return ids.join(rows, "structure_id", "left").withColumn("label", F.col("label_text").try_cast("double"))


def build(spark: SparkSession, paths, edges: str = "bonds", value: float | None = None, labels: DataFrame | None = None, id_col: str = "id", label_col: str = "label", test: float = 0.1, val: float = 0.1, seed: int = 0, pattern: str | None = None) -> dict[str, DataFrame]:
    """nodes, edges and graphs of the first model of every readable file; unreadable ones are graphs with an error.

    graphs has n_nodes, label and split."""
    atoms = formats.read_atoms(spark, paths, pattern=pattern)
    good = atoms.where("parse_error is null and model_id = 1")
    g = atoms.groupBy("structure_id").agg(F.sum(F.when(F.col("model_id") == 1, 1).otherwise(0)).alias("n_nodes"), F.max("parse_error").alias("error"))
    if labels is not None:
        g = labelled(g, labels, id_col, label_col)
    explicit = formats.read_bonds(spark, paths, pattern=pattern).where("model_id = 1").select("structure_id", "i", "j")
    return {"nodes": graph.node_features(good), "edges": graph_edges(good, edges, value, explicit), "graphs": ranking.hash_split(g, "structure_id", test, val, seed)}


def target_scaler(graphs: DataFrame, label: str = "label") -> DataFrame:
    """Mean and deviation of the training graphs' labels only."""
    return aggregates.fit_scaler(graphs.where("split = 'train'"), [label])


def prepare(table: DataFrame, id_col: str, key_col: str, features: list[str] | None = None, test: float = 0.1, val: float = 0.1, seed: int = 0, group_col: str | None = None) -> DataFrame:
    """A molecule table without duplicates by key_col, features as numbers, with a split by hash or by whole groups."""
    t = ranking.dedup(table, key_col, [id_col])
    t = t.withColumns({f: F.col(f).try_cast("double") for f in features or []})
    return ranking.group_split(t, group_col, test, val) if group_col else ranking.hash_split(t, id_col, test, val, seed)


def diverse_hits(poses: DataFrame, score: str, higher: bool, bits: str, id_col: str = "pose_id", top: int = 500, pick: int = 50, threshold: float = 0.7) -> DataFrame:
    """(id, cluster, rank): of the top poses by score, clustered by Tanimoto similarity of on-bit arrays (Butina), the best of
    each cluster, the best `pick` of those. top bounds what goes to the driver; bits come from a fingerprint backend."""
    best = F.col(score).desc() if higher else F.col(score).asc()
    rows = poses.where(F.col(score).isNotNull()).orderBy(best, id_col).limit(top).select(id_col, bits).collect()
    sets = [set(r[bits] or []) for r in rows]
    similar = [{j for j, b in enumerate(sets) if j != i and (a or b) and len(a & b) >= threshold * len(a | b)} for i, a in enumerate(sets)]
    lead = sorted((min(c), k) for k, c in enumerate(ranking.butina(similar)))[:pick]
    kind = poses.schema[id_col].dataType.simpleString()
    return poses.sparkSession.createDataFrame([(rows[i][id_col], k, n + 1) for n, (i, k) in enumerate(lead)], f"{id_col} {kind}, cluster int, rank int")


def envelope(result: DataFrame, command: str, source: str, warnings: list[str] = []) -> DataFrame:  # noqa: B006
    """Each row as a JSON result with what made it; NaN and infinities become null."""
    doubles = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c, t in result.dtypes if t == "double"}
    row = result.withColumns(doubles)
    return row.select(F.to_json(F.struct(F.lit(command).alias("command"), F.lit(source).alias("source"), F.array(*[F.lit(w) for w in warnings]).cast("array<string>").alias("warnings"), F.struct("*").alias("result")), {"ignoreNullFields": "false"}).alias("json"))
