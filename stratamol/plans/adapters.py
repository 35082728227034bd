"""Views that give relational tables the shape of atoms, ensembles, backbones and poses.

The SQL is plain enough for Spark and DuckDB alike, so that queries and their oracles start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.elements import case_sql

_ELEMENTS = dict(enumerate(("C", "N", "O", "S", "H", "P")))
_NAMES = dict(enumerate(("N", "CA", "C", "O", "CB", "NZ")))
_RESIDUES = dict(enumerate(("ALA", "GLY", "LYS", "ASP", "PHE", "LIG", "HOH")))
_TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
_ROW = f"""{case_sql("l_suppkey % 6", _ELEMENTS, "X")} AS element, {case_sql("l_partkey % 6", _NAMES, "X")} AS atom_name,
  {case_sql("l_suppkey % 7", _RESIDUES, "UNK")} AS resname, '' AS icode, l_returnflag AS chain, l_suppkey % 7 >= 5 AS hetero"""

ATOMS = f"""SELECT l_orderkey AS structure_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) - 1 AS INT) AS atom_idx,
  l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, CAST(l_linenumber AS INT) AS resid, {_ROW} FROM {{lineitem}}"""

ENSEMBLE = f"""SELECT l_partkey AS structure_id, CAST(l_linenumber AS INT) AS model_id, CAST(row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY {_TIES}) - 1 AS INT) AS atom_idx,
  l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, CAST(row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY {_TIES}) - 1 AS INT) AS resid, {_ROW} FROM {{lineitem}}"""

BACKBONE = f"""SELECT structure_id, CAST(k AS INT) AS atom_idx, CASE k % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'O' END AS atom_name,
  CASE k % 4 WHEN 0 THEN 'N' WHEN 3 THEN 'O' ELSE 'C' END AS element, CAST((k - k % 4) / 4 AS INT) AS resid, 'ALA' AS resname, '' AS icode, 'A' AS chain, false AS hetero, x, y, z
  FROM (SELECT l_suppkey AS structure_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_TIES}) - 1 AS k, l_quantity / 10 AS x, l_discount * 30 AS y, l_tax * 40 AS z FROM {{lineitem}}) t"""

POSES = f"""SELECT l_partkey AS ligand, l_linestatus AS source, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY {_TIES}) AS INT) AS pose_id, l_orderkey, l_linenumber, l_suppkey, l_shipdate,
  l_extendedprice AS energy, l_discount AS cnnscore, CAST(l_quantity AS INT) AS heavy FROM {{lineitem}}"""

#: Larger structures, some hundred atoms each: residues of five atoms, three chains, insertion codes.
CHAINS = f"""SELECT structure_id, CAST(k AS INT) AS atom_idx, CASE k % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' WHEN 3 THEN 'O' ELSE 'CB' END AS atom_name, CASE k % 5 WHEN 0 THEN 'N' WHEN 3 THEN 'O' ELSE 'C' END AS element,
  CAST(r + 1 AS INT) AS resid, {case_sql("(r * 3 + structure_id) % 7", _RESIDUES, "UNK")} AS resname, CASE WHEN r % 7 = 3 THEN 'A' ELSE '' END AS icode, CASE WHEN k < 250 THEN 'A' WHEN k < 450 THEN 'B' ELSE 'C' END AS chain,
  (r * 3 + structure_id) % 7 >= 5 AS hetero, x, y, z FROM (SELECT *, CAST((k - k % 5) / 5 AS INT) AS r FROM (SELECT l_suppkey AS structure_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_TIES}) - 1 AS k,
  l_partkey % 997 / 20 AS x, l_orderkey % 1009 / 25 AS y, CAST(l_quantity AS DOUBLE) AS z FROM {{lineitem}}) t) u"""

VIEWS = {"chains": CHAINS, "atoms": ATOMS, "ensemble": ENSEMBLE, "backbone": BACKBONE, "poses": POSES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_first(text: str) -> str:
    """The same view with rows numbered beneath all other columns: the shuffle then carries the table's own columns only, and
    what renames the key keeps its partitions, so that joins on the key need no second shuffle. Rows equal in all that the text
    orders by are ordered by l_returnflag too: every numbered use of a view then shuffles the same columns, once for all."""
    (number,) = set(re.findall(r"row_number\(\) OVER \([^)]*\)", text))
    return text.replace(number, "__place").replace("{lineitem}", f"(SELECT *, {number[:-1]}, l_returnflag) AS __place FROM {{lineitem}}) numbered")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(numbered_first(VIEWS[name]), lineitem=table(spark, sf_dir, "lineitem"))


def cte(*names: str) -> str:
    """WITH clause of the views for an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(lineitem='lineitem')})" for n in names)
