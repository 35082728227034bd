"""PDB atom records as column expressions: lines from atoms and atoms from lines, without Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def atom_line(serial="serial") -> Column:
    """An 80-column ATOM or HETATM record; columns are cut to their width as the format demands."""
    name = F.coalesce("atom_name", F.lit(""))
    padded = F.when(F.char_length(name) >= 4, F.substring(name, 1, 4)).otherwise(F.rpad(F.concat(F.lit(" "), name), 4, " "))

    def text(c, n, left=False):
        v = F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n)
        return F.rpad(v, n, " ") if left else F.lpad(v, n, " ")

    number = F.lpad((F.col(serial) % 100000).cast("string"), 5, " ")
    xyz = F.concat(*[F.lpad(F.format_string("%.3f", F.col(x)), 8, " ") for x in "xyz"])
    occ = F.lpad(F.format_string("%.2f", F.coalesce(F.col("occupancy"), F.lit(1.0))), 6, " ")
    return F.rpad(F.concat(
        F.when(F.col("hetero"), "HETATM").otherwise("ATOM  "), number, F.lit(" "), padded, text("altloc", 1), text("resname", 3), F.lit(" "), text("chain", 1),
        text("resid", 4), text("icode", 1), F.lit("   "), xyz, occ, F.lit("  0.00          "), text("element", 2),
    ), 80, " ")


def atom_columns(line: str = "value") -> dict[str, Column]:
    """The fields of an ATOM or HETATM record; an empty element falls back to the name's first two characters after digits."""

    def cut(a, b):
        return F.substring(line, a, b - a + 1)

    name = F.trim(cut(13, 16))
    element = F.trim(cut(77, 78))
    fallback = F.upper(F.substring(F.regexp_replace(name, r"^[0-9]+", ""), 1, 2))
    return {
        "serial": F.trim(cut(7, 11)).try_cast("int"), "atom_name": name, "altloc": F.trim(cut(17, 17)), "resname": F.trim(cut(18, 20)), "chain": F.trim(cut(22, 22)),
        "resid": F.coalesce(F.trim(cut(23, 26)).try_cast("int"), F.lit(0)), "icode": F.trim(cut(27, 27)), "x": F.trim(cut(31, 38)).try_cast("double"), "y": F.trim(cut(39, 46)).try_cast("double"), "z": F.trim(cut(47, 54)).try_cast("double"),
        "occupancy": F.trim(cut(55, 60)).try_cast("double"), "element": F.when(element == "", fallback).otherwise(F.upper(element)), "hetero": F.startswith(F.col(line), F.lit("HETATM")),
    }


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Atoms of one-model records, other lines dropped; further columns stay."""
    rest = [c for c in lines.columns if c != line]
    only = lines.where(F.substring(line, 1, 6).isin("ATOM  ", "HETATM"))
    return only.select(*rest, *(v.alias(k) for k, v in atom_columns(line).items()))


def one_altloc(atoms: DataFrame, policy: str = "primary", key=("structure_id", "model_id"), order: str = "atom_idx") -> DataFrame:
    """primary: blank or A; first; highest_occupancy (ties blank, A, others, then order); all."""
    if policy == "all":
        return atoms
    if policy == "primary":
        return atoms.where(F.coalesce("altloc", F.lit("")).isin("", "A"))
    rank = F.when(F.coalesce("altloc", F.lit("")) == "", 0).when(F.col("altloc") == "A", 1).otherwise(2)
    by = [F.col(order)] if policy == "first" else [F.coalesce("occupancy", F.lit(1.0)).desc(), rank, F.col(order)]
    if policy not in ("first", "highest_occupancy"):
        raise ValueError(f"altloc is primary, first, highest_occupancy or all, not {policy!r}")
    w = W.partitionBy(*key, "chain", "resid", "icode", "resname", "atom_name").orderBy(*by)
    return atoms.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
