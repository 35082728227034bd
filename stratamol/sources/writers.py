"""Sinks: coordinate files, poses, tables and topologies.

Text is built per structure by expressions or on packed rows, and a file for each structure is written by the tasks through
Spark's text writer, partitioned by structure."""

from __future__ import annotations

import json
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import cif_token
from .pdb_text import atom_line

KEY = ["structure_id"]


def _joined(lines: DataFrame, key, order) -> DataFrame:
    """(key, text) of ordered lines."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return lines.groupBy(*key).agg((F.array_join(F.transform(rows, lambda x: x["value"]), "\n")).alias("text"))


def pdb_text(atoms: DataFrame, bonds: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """(key, text): records, CONECT for given bonds and END."""
    need = {"altloc": F.lit(""), "occupancy": F.lit(1.0)}
    a = atoms.withColumns({k: v for k, v in need.items() if k not in atoms.columns}).withColumn("serial", F.col("atom_idx") + 1)
    lines = a.select(*key, F.lit(0).alias("part"), F.col("atom_idx").alias("n"), atom_line().alias("value"))
    if bonds is not None:
        pad = [F.lpad((F.col(c) + 1).cast("string"), 5, " ") for c in "ij"]
        lines = lines.unionByName(bonds.select(*key, F.lit(1).alias("part"), F.col("i").alias("n"), F.concat(F.lit("CONECT"), *pad).alias("value")))
    return _joined(lines, key, ["part", "n"]).withColumn("text", F.concat("text", F.lit("\nEND\n")))


def xyz_text(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    row = F.concat(F.when(F.coalesce("element", F.lit("")) == "", "X").otherwise(F.initcap("element")), *[F.lpad(F.format_string("%.8f", F.col(x)), 15, " ") for x in "xyz"])
    lines = atoms.select(*key, F.col("atom_idx").alias("n"), row.alias("value"))
    n = atoms.groupBy(*key).agg(F.count("*").alias("c"))
    text = _joined(lines, key, ["n"]).join(n, key)
    return text.select(*key, F.concat(F.col("c").cast("string"), F.lit("\n"), *([F.col(key[0]).cast("string")] if key else []), F.lit("\n"), F.col("text"), F.lit("\n")).alias("text"))


CIF_COLUMNS = ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "auth_asym_id", "auth_seq_id")


def cif_text(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    number = [F.format_string("%.5f", F.col(x)) for x in "xyz"]
    row = F.concat_ws(" ", F.when(F.col("hetero"), "HETATM").otherwise("ATOM"), (F.col("atom_idx") + 1).cast("string"), cif_token(F.col("element")), cif_token(F.col("atom_name")), cif_token(F.col("resname")), cif_token(F.col("chain")), F.col("resid").cast("string"), cif_token(F.col("icode")), *number, cif_token(F.col("chain")), F.col("resid").cast("string"))
    text = _joined(atoms.select(*key, F.col("atom_idx").alias("n"), row.alias("value")), key, ["n"])
    head = "\nloop_\n" + "\n".join(f"_atom_site.{c}" for c in CIF_COLUMNS) + "\n"
    return text.select(*key, F.concat(F.lit("data_"), F.regexp_replace(F.col(key[0]).cast("string"), r"\s", "_"), F.lit(head), F.col("text"), F.lit("\n")).alias("text"))


def sdf_record(name: str, atoms: list[dict], bonds: list[tuple], properties: dict | None = None) -> str:
    """A V2000 record; more than 999 atoms or bonds have no such form."""
    if len(atoms) > 999 or len(bonds) > 999:
        raise ValueError("a V2000 record holds 999 atoms and bonds at most")
    out = [name, "", "", f"{len(atoms):3d}{len(bonds):3d}  0  0  0  0  0  0  0  0999 V2000"]
    out += [f"{a['x']:10.4f}{a['y']:10.4f}{a['z']:10.4f} {(a['element'] or 'X').capitalize():<3} 0  0  0  0  0  0  0  0  0  0  0  0" for a in atoms]
    out += [f"{i + 1:3d}{j + 1:3d}{4 if o == 1.5 else int(o):3d}  0" for i, j, o in bonds]
    charged = [(k + 1, a["formal_charge"]) for k, a in enumerate(atoms) if a.get("formal_charge")]
    for k in range(0, len(charged), 8):
        part = charged[k : k + 8]
        out.append(f"M  CHG{len(part):3d}" + "".join(f"{n:4d}{c:4d}" for n, c in part))
    out.append("M  END")
    for k, v in (properties or {}).items():
        out += [f"> <{k}>", v, ""]
    return "\n".join([*out, "$$$$", ""])


def sdf_text(atoms: DataFrame, bonds: DataFrame, key: list[str] = KEY) -> DataFrame:
    charge = F.col("formal_charge") if "formal_charge" in atoms.columns else F.lit(0)
    a = atoms.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("atom_idx", "x", "y", "z", "element", charge.alias("formal_charge")))).alias("a"))
    b = bonds.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "j", F.col("bond_order").alias("o")))).alias("b"))

    @F.pandas_udf("string")
    def run(names: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([sdf_record(str(n), list(x), [(e["i"], e["j"], e["o"]) for e in (y if y is not None else [])]) for n, x, y in zip(names, xs, ys, strict=True)])

    return a.join(b, key, "left").select(*key, run(F.col(key[0]).cast("string"), "a", "b").alias("text"))


def write_texts(texts: DataFrame, path: str, key: list[str] = KEY) -> None:
    """One folder of text for each structure, written by the tasks."""
    texts.repartition(*key).select(*key, "text").write.mode("overwrite").partitionBy(*key).text(path)


def frames_text(atoms: DataFrame, kind: str, key: list[str] = KEY, model: str = "model_id") -> DataFrame:
    """(key, text) of all models in order, as pdb or xyz."""
    make = {"pdb": pdb_text, "xyz": xyz_text}
    if kind not in make:
        raise ValueError(f"frames are written as pdb or xyz, not {kind!r}")
    one = make[kind](atoms, key=[*key, model])
    body = F.col("text")
    if kind == "pdb":
        body = F.concat(F.lit("MODEL     "), F.lpad(F.col(model).cast("string"), 4, " "), F.lit("\n"), F.regexp_replace("text", r"END\n$", "ENDMDL\n"))
    rows = F.array_sort(F.collect_list(F.struct(model, body.alias("value"))))
    return one.groupBy(*key).agg(F.concat(F.array_join(F.transform(rows, lambda x: x["value"]), ""), F.lit("END\n" if kind == "pdb" else "")).alias("text"))


def poses_text(poses: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """(by, text): raw blocks in order, each ended by $$$$."""
    p = poses.withColumn("value", F.concat(F.regexp_replace("block", r"\s+$", ""), F.lit("\n$$$$")))
    return _joined(p, by, order).withColumn("text", F.concat("text", F.lit("\n")))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"')


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """A dataset as Parquet partitioned by split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def mapping_json(bead: DataFrame, member: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, json) of beads with the atoms that they hold."""
    m = member.groupBy(*key, "residue_idx", "bead_name").agg(F.sort_array(F.collect_list("atom_idx")).alias("atoms"))
    b = bead.join(m, [*key, "residue_idx", "bead_name"])
    rows = F.array_sort(F.collect_list(F.struct("bead_idx", "bead_name", "atoms")))
    return b.groupBy(*key).agg(F.to_json(F.struct(F.lit("bead-mapping").alias("format"), F.lit(1).alias("version"), rows.alias("beads"))).alias("json"))


def read_mapping(text: str) -> list[dict]:
    data = json.loads(text)
    if data.get("format") != "bead-mapping":
        raise ValueError("not a bead mapping")
    return data["beads"]


def index_text(groups: DataFrame, key: list[str] = KEY, per_line: int = 15) -> DataFrame:
    """(key, text) of GROMACS index groups from (key, group_name, bead_idx, atoms); atoms count from 1."""
    nums = F.transform("atoms", lambda a: (a + 1).cast("string"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("atoms") - 1) / per_line).cast("int")), lambda k: F.array_join(F.slice(nums, k * per_line + 1, per_line), " "))
    value = F.concat(F.lit("[ "), F.col("group_name"), F.lit(" ]\n"), F.array_join(rows, "\n"))
    return _joined(groups.select(*key, F.col("bead_idx").alias("n"), value.alias("value")), key, ["n"]).withColumn("text", F.concat("text", F.lit("\n")))


def topology_text(bead: DataFrame, bonds: DataFrame, angles: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, text): atoms, bonds and angles sections of a GROMACS topology, numbers from 1."""
    def section(df, part, order, cols):
        return df.select(*key, F.lit(part).alias("part"), *(F.col(c).alias(f"n{k}") for k, c in enumerate(order)), F.concat_ws(" ", *cols).alias("value"))

    def num(c):
        return (F.col(c) + 1).cast("string")

    a = section(bead, 1, ["bead_idx", "bead_idx", "bead_idx"], [num("bead_idx"), F.col("bead_name"), F.col("resid").cast("string"), F.col("resname"), F.col("bead_name"), num("bead_idx"), F.lit("0.0")])
    b = section(bonds, 3, ["i", "j", "j"], [num("i"), num("j"), F.lit("1")])
    c = section(angles, 5, ["at", "i", "j"], [num("i"), num("at"), num("j"), F.lit("2")])
    k = bead.select(*key).distinct()
    for part, head in ((0, "[ atoms ]"), (2, "[ bonds ]"), (4, "[ angles ]")):
        a = a.unionByName(k.select(*key, F.lit(part).alias("part"), *(F.lit(0).cast("long").alias(f"n{x}") for x in range(3)), F.lit(head).alias("value")))
    return _joined(a.unionByName(b).unionByName(c), key, ["part", "n0", "n1", "n2"]).withColumn("text", F.concat("text", F.lit("\n")))


def force_field_xml(templates: list[tuple[str, list[str], list[tuple[str, str]], list[str]]]) -> str:
    """Residue templates (name, beads, bonds by name, external beads) as OpenMM XML; a bounded catalogue."""
    out = ["<ForceField>", "  <Residues>"]
    for name, beads, bonds, external in templates:
        out.append(f"    <Residue name={quoteattr(name)}>")
        out += [f"      <Atom name={quoteattr(b)} type={quoteattr(f'{name}-{b}')}/>" for b in beads]
        out += [f"      <Bond atomName1={quoteattr(a)} atomName2={quoteattr(b)}/>" for a, b in bonds]
        out += [f"      <ExternalBond atomName={quoteattr(b)}/>" for b in external]
        out.append("    </Residue>")
    return "\n".join([*out, "  </Residues>", "</ForceField>", ""])


def numbered(df: DataFrame, order: list[str], key: list[str] = KEY) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
