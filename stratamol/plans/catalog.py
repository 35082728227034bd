"""Registered queries over the relational tables, with the DuckDB SQL that must agree. Floats are rounded to 6 places."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import AMINO_ACIDS, ANIONIC, AROMATIC, CATIONIC, COVALENT_RADIUS, HEAVY_ATOMS, IONS, MASS, NUCLEOTIDES, POCKET_HYDROPHOBIC, WATER, case_sql
from ..functions import elements as el
from ..functions.geometry import ON_AXIS, fibonacci_sphere
from ..operators import aggregates, coarse, compare, datasets, ensemble, graph, presets, quality, ranking, reports, residues, secondary, select, spatial, surface, transforms
from ..sources import pdb_text
from ..streaming import frames
from .adapters import cte, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def R(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
PAIR = "FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx"
RUNS = """, runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY structure_id ORDER BY atom_idx) AS INT) AS residue_idx FROM (
  SELECT *, CASE WHEN lag(atom_idx) OVER w IS NULL THEN 0 WHEN lag(chain) OVER w = chain AND lag(resid) OVER w = resid AND lag(icode) OVER w = icode AND lag(resname) OVER w = resname THEN 0 ELSE 1 END AS new
  FROM atoms WINDOW w AS (PARTITION BY structure_id ORDER BY atom_idx)) t)"""
REPS = RUNS + """, reps AS (SELECT structure_id, residue_idx AS atom_idx, first(chain) AS chain, first(resid) AS resid, first(resname) AS resname,
  coalesce(arg_min(x, atom_idx) FILTER (atom_name = 'CA'), avg(x)) AS x, coalesce(arg_min(y, atom_idx) FILTER (atom_name = 'CA'), avg(y)) AS y, coalesce(arg_min(z, atom_idx) FILTER (atom_name = 'CA'), avg(z)) AS z
  FROM runs GROUP BY structure_id, residue_idx)"""
REP_PAIR = "FROM reps a JOIN reps b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx"
M = case_sql("element", MASS, 1.0)


# scans, selections, set algebra


@query(cte("atoms") + f" SELECT a.structure_id, n_atoms, coalesce(c, 0) AS n_contacts, {R('CASE WHEN n_atoms > 1 THEN coalesce(c, 0) / (n_atoms * (n_atoms - 1) / 2.0) ELSE 0.0 END')} AS density FROM (SELECT structure_id, count(*) AS n_atoms FROM atoms GROUP BY 1) a LEFT JOIN (SELECT a.structure_id, count(*) AS c {PAIR} WHERE {D2} < 25 GROUP BY 1) b ON a.structure_id = b.structure_id")
def contact_density(spark, sf):
    return r6(spatial.contact_counts(view(spark, sf, "atoms"), 5.0, cells=False), "density")  # the view's structures are small


@query(cte("atoms") + f" SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {R(D2)} AS d2 {PAIR} WHERE {D2} < 25")
def contact_pairs_cells(spark, sf):
    return r6(spatial.pairs(view(spark, sf, "atoms"), 5.0, cells=True), "d2")


_W = {c: f"((a.{c} - b.{c}) - {n} * round_even((a.{c} - b.{c}) / {n}, 0))" for c, n in (("x", "40.0"), ("y", "8.0"), ("z", "6.0"))}
_MIC = "(" + " + ".join(f"{v} * {v}" for v in _W.values()) + ")"


@query(cte("atoms") + f" SELECT a.structure_id, count(*) AS n_contacts {PAIR} WHERE {_MIC} < 16 GROUP BY 1")
def periodic_contacts(spark, sf):
    return spatial.pairs(view(spark, sf, "atoms"), 4.0, lengths=(40.0, 8.0, 6.0)).groupBy("structure_id").agg(F.count("*").alias("n_contacts"))


@query(cte("atoms") + " SELECT structure_id, atom_idx, element, chain, resid FROM atoms WHERE element IN ('C', 'N') AND chain IN ('A', 'R') AND resid BETWEEN 2 AND 5 AND NOT hetero")
def select_atoms(spark, sf):
    a = view(spark, sf, "atoms")
    return a.where(select.parse_selection("element=c,n and chain=A,R and resid=2-5 and hetero=false")).select("structure_id", "atom_idx", "element", "chain", "resid")


@query(cte("atoms") + f" SELECT DISTINCT a.structure_id, a.atom_idx FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id WHERE NOT a.hetero AND b.hetero AND {D2} < 36")
def select_within(spark, sf):
    a = view(spark, sf, "atoms")
    return select.select_within(select.protein(a), select.hetero_atoms(a), 6.0).select("structure_id", "atom_idx")


@query(cte("atoms") + """, p AS (SELECT * FROM atoms WHERE chain = 'A'), q AS (SELECT * FROM atoms WHERE element IN ('C', 'O'))
 SELECT 'and' AS op, structure_id, atom_idx FROM (SELECT structure_id, atom_idx FROM p INTERSECT SELECT structure_id, atom_idx FROM q) t
 UNION ALL SELECT 'or', structure_id, atom_idx FROM (SELECT structure_id, atom_idx FROM p UNION SELECT structure_id, atom_idx FROM q) t
 UNION ALL SELECT 'sub', structure_id, atom_idx FROM (SELECT structure_id, atom_idx FROM p EXCEPT SELECT structure_id, atom_idx FROM q) t
 UNION ALL SELECT 'not', structure_id, atom_idx FROM atoms WHERE chain <> 'A'""")
def set_algebra(spark, sf):
    a = view(spark, sf, "atoms")
    p, q = select.select(a, chain="A"), select.select(a, element=["C", "O"])
    parts = {"and": select.intersect(p, q), "or": select.union(p, q), "sub": select.subtract(p, q), "not": select.complement(p, a)}
    out = None
    for op, df in parts.items():
        one = df.select(F.lit(op).alias("op"), "structure_id", "atom_idx")
        out = one if out is None else out.unionByName(one)
    return out


@query(cte("atoms") + " SELECT structure_id, atom_idx, CAST(x AS DOUBLE) AS x, " + R("y") + " AS y, " + R("z") + " AS z, element, atom_name, resname, chain, resid, hetero FROM atoms")
def pdb_text_round_trip(spark, sf):
    a = view(spark, sf, "atoms").withColumns({"serial": F.col("atom_idx") + 1, "altloc": F.lit(""), "occupancy": F.lit(1.0)})
    back = pdb_text.parse_lines(a.select("structure_id", pdb_text.atom_line().alias("value")))
    return back.select("structure_id", (F.col("serial") - 1).alias("atom_idx"), "x", "y", "z", "element", "atom_name", "resname", "chain", "resid", "hetero")


@query(cte("atoms") + f" SELECT structure_id, atom_idx, {case_sql('element', COVALENT_RADIUS, 0.75)} AS covalent, {case_sql('element', el.VDW_RADIUS, 1.7)} AS vdw, {M} AS mass, CAST({case_sql('element', {k: v for k, v in el.NUMBERED.items() if k in 'CNOSHP'}, 0)} AS INT) AS z, {case_sql('resname', el.MAX_ASA, 'NULL').replace(chr(39) + 'NULL' + chr(39), 'NULL')} AS max_asa FROM atoms")
def element_lookups(spark, sf):
    return view(spark, sf, "atoms").select("structure_id", "atom_idx", el.covalent_radius("element").alias("covalent"), el.vdw_radius("element").alias("vdw"), el.mass("element").alias("mass"), el.atomic_number("element").alias("z"), el.max_asa("resname").alias("max_asa"))


# aggregates

INERTIA = ("ixx", "iyy", "izz", "ixy", "ixz", "iyz")
_S = f"""SELECT structure_id, count(*) AS n_atoms, sum(m) AS total_mass, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, sum(m * x) / sum(m) AS com_x, sum(m * y) / sum(m) AS com_y, sum(m * z) / sum(m) AS com_z,
  max(x) - min(x) AS dim_x, max(y) - min(y) AS dim_y, max(z) - min(z) AS dim_z FROM w GROUP BY 1"""


@query(cte("atoms") + f", w AS (SELECT *, {M} AS m FROM atoms), s AS ({_S}), i AS (SELECT w.structure_id, sum(m * ((y - com_y) * (y - com_y) + (z - com_z) * (z - com_z))) AS ixx, sum(m * ((x - com_x) * (x - com_x) + (z - com_z) * (z - com_z))) AS iyy, sum(m * ((x - com_x) * (x - com_x) + (y - com_y) * (y - com_y))) AS izz, -sum(m * (x - com_x) * (y - com_y)) AS ixy, -sum(m * (x - com_x) * (z - com_z)) AS ixz, -sum(m * (y - com_y) * (z - com_z)) AS iyz FROM w JOIN s ON w.structure_id = s.structure_id GROUP BY 1) SELECT s.structure_id, n_atoms, " + ", ".join(f"{R(c)} AS {c}" for c in ("total_mass", "cx", "cy", "cz", "com_x", "com_y", "com_z", "dim_x", "dim_y", "dim_z")) + ", " + R("sqrt((ixx + iyy + izz) / 2 / total_mass)") + " AS rg, " + R("dim_x * dim_y * dim_z") + " AS volume, " + R("CASE WHEN dim_x * dim_y * dim_z > 0 THEN n_atoms / (dim_x * dim_y * dim_z) ELSE 0.0 END") + " AS compactness, " + ", ".join(f"(round({c} / total_mass, 6) + 0.0) AS {c}" for c in INERTIA) + " FROM s JOIN i ON s.structure_id = i.structure_id")
def geometry(spark, sf):
    g = aggregates.geometry(view(spark, sf, "atoms"))
    g = g.withColumns({c: F.round(F.col(c) / F.col("total_mass"), 6) for c in INERTIA})  # divided: sums of products end in exact halves
    return r6(g, *[c for c in g.columns if c not in ("structure_id", "n_atoms", *INERTIA)])


@query()
def shape_descriptors(spark, sf):
    return aggregates.shape_descriptors(view(spark, sf, "atoms"))


@query(cte("atoms") + " SELECT structure_id, string_agg(element || CASE WHEN n > 1 THEN CAST(n AS VARCHAR) ELSE '' END, '' ORDER BY CASE element WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, element) AS formula FROM (SELECT structure_id, element, count(*) AS n FROM atoms GROUP BY 1, 2) t GROUP BY 1")
def formula(spark, sf):
    return aggregates.formula(view(spark, sf, "atoms"))


@query(cte("atoms") + f" SELECT structure_id, bin, count(*) AS n_pairs FROM (SELECT a.structure_id, CAST(least(floor(sqrt({D2}) / 2.0), 9) AS INT) AS bin {PAIR} WHERE {D2} <= 400) t GROUP BY 1, 2")
def distance_histogram(spark, sf):
    return aggregates.distance_histogram(view(spark, sf, "atoms"))


_BONDS = f", rad AS (SELECT *, {case_sql('element', COVALENT_RADIUS, 0.75)} AS radius FROM atoms), bonds AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {D2} AS d2 {PAIR.replace('atoms', 'rad')} WHERE sqrt({D2}) < 1.2 * (a.radius + b.radius))"


@query(cte("atoms") + _BONDS + f" SELECT structure_id, count(*) AS n_bonds, {R('avg(sqrt(d2))')} AS mean_length, {R('stddev_pop(sqrt(d2))')} AS std_length, {R('min(sqrt(d2))')} AS min_length, {R('max(sqrt(d2))')} AS max_length FROM bonds GROUP BY 1")
def bond_summary(spark, sf):
    return r6(aggregates.bond_summary(aggregates.bonds(view(spark, sf, "atoms"))), "mean_length", "std_length", "min_length", "max_length")


@query(cte("atoms") + f", d AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, row_number() OVER (PARTITION BY a.structure_id, a.atom_idx ORDER BY {D2}, b.atom_idx) AS r FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx) SELECT DISTINCT structure_id, least(i, j) AS i, greatest(i, j) AS j FROM d WHERE r <= 3")
def nearest_neighbours(spark, sf):
    return spatial.nearest(view(spark, sf, "atoms"), 3, cells=False)


@query(cte("atoms") + RUNS + f" SELECT a.structure_id, count(*) AS n_polar FROM runs a JOIN runs b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx WHERE a.element IN ('N', 'O') AND b.element IN ('N', 'O') AND {D2} >= 6.25 AND {D2} < 12.25 AND a.residue_idx <> b.residue_idx GROUP BY 1")
def polar_contacts(spark, sf):
    return aggregates.polar_contacts(view(spark, sf, "atoms"))


def _sign(r: str, n: str) -> str:
    return f"CASE WHEN {r} || ' ' || {n} IN {_in(' '.join(p) for p in CATIONIC)} THEN 1 WHEN {r} || ' ' || {n} IN {_in(' '.join(p) for p in ANIONIC)} THEN -1 ELSE 0 END"


@query(cte("atoms") + RUNS + f", s AS (SELECT *, CASE WHEN resname = 'ASP' AND atom_name = 'CB' THEN -1 ELSE {_sign('resname', 'atom_name')} END AS sign FROM (SELECT * FROM runs) t) SELECT a.structure_id, count(DISTINCT (least(a.residue_idx, b.residue_idx), greatest(a.residue_idx, b.residue_idx))) AS n_salt_bridges FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx WHERE a.sign * b.sign < 0 AND {D2} <= 16 GROUP BY 1")
def salt_bridges(spark, sf):
    a = view(spark, sf, "atoms")  # the adapter has no oxygen names of acids; its CB of ASP stands for OD1
    return aggregates.salt_bridges(a.withColumn("atom_name", F.when((F.col("resname") == "ASP") & (F.col("atom_name") == "CB"), "OD1").otherwise(F.col("atom_name"))))


@query()
def descriptors(spark, sf):
    return aggregates.descriptors(view(spark, sf, "atoms"))


@query("SELECT f.feature, " + R("f.mean") + " AS mean, " + R("f.std") + " AS std FROM (SELECT 'p_size' AS feature, avg(p_size) AS mean, stddev_pop(p_size) AS std FROM part UNION ALL SELECT 'p_retailprice', avg(p_retailprice), stddev_pop(p_retailprice) FROM part) f")
def feature_scaler(spark, sf):
    return r6(aggregates.fit_scaler(table(spark, sf, "part"), ["p_size", "p_retailprice"]), "mean", "std")


@query("SELECT p_partkey, " + ", ".join(R(f"(p.{c} - s.m_{c}) / s.s_{c}") + f" AS {c}" for c in ("p_size", "p_retailprice")) + " FROM part p, (SELECT avg(p_size) AS m_p_size, stddev_pop(p_size) AS s_p_size, avg(p_retailprice) AS m_p_retailprice, stddev_pop(p_retailprice) AS s_p_retailprice FROM part) s")
def scaled_features(spark, sf):
    p, f = table(spark, sf, "part"), ["p_size", "p_retailprice"]
    return r6(aggregates.scaled(p, aggregates.fit_scaler(p, f), f).select("p_partkey", *f), *f)


@query("SELECT user_id, " + ", ".join(f"{R(v)} AS {k}" for k, v in (("mean", "avg(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"), ("final", "arg_max(value, event_id)"))) + " FROM events GROUP BY user_id")
def series_summary(spark, sf):
    return r6(aggregates.series_summary(table(spark, sf, "events"), "value", "event_id", ["user_id"]), "mean", "std", "min", "max", "final")


@query("SELECT k AS field, min(event_id) AS first FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) t GROUP BY k")
def available_fields(spark, sf):
    e = table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return aggregates.available_fields(e, "m", "event_id")


# residues


@query(cte("atoms") + RUNS + " SELECT structure_id, residue_idx, first(chain) AS chain, first(resid) AS resid, first(resname) AS resname, min(atom_idx) AS first_atom, count(*) AS n_atoms FROM runs GROUP BY 1, 2")
def residue_runs(spark, sf):
    return residues.residues(view(spark, sf, "atoms")).drop("icode")


@query(cte("atoms") + REPS + f" SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {R(D2)} AS d2 {REP_PAIR} WHERE {D2} < 64 AND NOT (a.chain = b.chain AND b.atom_idx - a.atom_idx < 2)")
def residue_contact_map(spark, sf):
    return r6(residues.contact_map(view(spark, sf, "atoms"), min_seq_sep=2), "d2")


@query(cte("atoms") + RUNS + f" SELECT structure_id, i, j, {R('min(d2)')} AS d2 FROM (SELECT a.structure_id, a.residue_idx AS i, b.residue_idx AS j, a.chain AS ca, b.chain AS cb, {D2} AS d2 FROM runs a JOIN runs b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx AND a.residue_idx <> b.residue_idx WHERE {D2} < 25) t WHERE ca <> cb GROUP BY 1, 2, 3")
def residue_min_distance(spark, sf):
    return r6(residues.contact_map(view(spark, sf, "atoms"), 5.0, method="min", chain_mode="inter"), "d2")


@query(cte("atoms") + REPS + f", c AS (SELECT a.structure_id, sum(b.atom_idx - a.atom_idx) AS s, count(*) AS c {REP_PAIR} WHERE {D2} < 64 GROUP BY 1) SELECT n.structure_id, {R('coalesce(s / (c * n)::DOUBLE, 0.0)')} AS contact_order FROM (SELECT structure_id, count(*) AS n FROM reps GROUP BY 1) n LEFT JOIN c ON n.structure_id = c.structure_id")
def contact_order(spark, sf):
    a = view(spark, sf, "atoms")
    sizes = residues.residues(a).groupBy("structure_id").agg(F.count("*").alias("n"))
    return r6(residues.contact_order(residues.contact_map(a), sizes), "contact_order")


@query(cte("atoms") + REPS + f", p AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {D2} AS d2 {REP_PAIR}), k AS (SELECT structure_id, i, j, CASE WHEN d2 < 144 THEN 1.0 ELSE 0 END - CASE WHEN d2 < 36 THEN 1.0 ELSE 0 END AS value FROM p) SELECT structure_id, i, j, CAST(value AS DOUBLE) AS value FROM k WHERE value <> 0")
def contact_map_difference(spark, sf):
    a = view(spark, sf, "atoms")
    return residues.map_difference(residues.contact_map(a, 12.0), residues.contact_map(a, 6.0))


_IF = f"FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id WHERE a.chain = 'A' AND b.chain = 'N' AND {D2} < 25"


@query(cte("atoms") + f" SELECT structure_id, side, chain, resid, resname, count(*) AS n_atom_contacts FROM (SELECT a.structure_id, 'a' AS side, a.chain, a.resid, a.resname {_IF} UNION ALL SELECT a.structure_id, 'b', b.chain, b.resid, b.resname {_IF}) t GROUP BY ALL")
def interface(spark, sf):
    return residues.interface(view(spark, sf, "atoms"), "A", "N").drop("icode")


@query(cte("atoms") + f", c AS (SELECT DISTINCT structure_id, chain FROM atoms), n AS (SELECT a.structure_id, least(a.chain, b.chain) AS chain_a, greatest(a.chain, b.chain) AS chain_b, count(*) AS n {PAIR} WHERE a.chain <> b.chain AND {D2} < 25 GROUP BY 1, 2, 3) SELECT a.structure_id, a.chain AS chain_a, b.chain AS chain_b, coalesce(n, 0) AS n_contacts FROM c a JOIN c b ON a.structure_id = b.structure_id AND a.chain < b.chain LEFT JOIN n ON n.structure_id = a.structure_id AND n.chain_a = a.chain AND n.chain_b = b.chain")
def chain_contact_matrix(spark, sf):
    return residues.chain_contact_matrix(view(spark, sf, "atoms"))


@query(cte("atoms").replace("WITH atoms AS", "WITH every AS") + ", atoms AS (SELECT * FROM every WHERE hetero)" + RUNS + f" SELECT structure_id, residue_idx, first(chain) AS chain, first(resid) AS resid, first(resname) AS resname, count(*) AS n_atoms FROM runs GROUP BY 1, 2 HAVING first(resname) NOT IN {_in((*WATER, *IONS))}")
def ligands(spark, sf):
    return residues.ligands(view(spark, sf, "atoms")).drop("icode", "first_atom")


_SITE = f"FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id WHERE NOT a.hetero AND b.hetero AND b.resname = 'LIG' AND {D2} < 36"


@query(cte("atoms") + f", s AS (SELECT a.structure_id, a.chain, a.resid, a.resname, sqrt(min({D2})) AS d, count(*) AS n_contacts, min(a.atom_idx) AS f {_SITE} GROUP BY 1, 2, 3, 4) SELECT structure_id, chain, resid, resname, {R('d')} AS min_distance, n_contacts, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY d, f) AS INT) AS rank FROM s")
def binding_site(spark, sf):
    return r6(residues.binding_site(view(spark, sf, "atoms"), "LIG", 6.0).drop("icode", "first_atom"), "min_distance")


_CC = "a.element = 'C' AND b.element = 'C'"


@query(cte("atoms") + f""", p AS (SELECT a.structure_id, a.chain, a.resid, a.resname, {D2} AS d2, a.atom_idx AS i, b.atom_idx AS j,
  {_CC} AND a.resname IN {_in(POCKET_HYDROPHOBIC)} AND {D2} <= 20.25 AS hyd, {_CC} AND a.resname IN {_in(AROMATIC)} AND {D2} <= 30.25 AS aro,
  a.element IN ('N', 'O', 'F') AND b.element IN ('N', 'O', 'F') AND {D2} <= 12.25 AS pol,
  ({_sign('a.resname', 'a.atom_name')}) * (CASE b.element WHEN 'N' THEN 1 WHEN 'O' THEN -1 ELSE 0 END) < 0 AND {D2} <= 16 AS sal
  FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id WHERE NOT a.hetero AND b.hetero AND b.resname NOT IN {_in((*WATER, *IONS))} AND {D2} <= 30.25),
 g AS (SELECT structure_id, chain, resid, resname, bool_or(hyd) AS hydrophobic, bool_or(aro) AS aromatic, min((d2, i, j)) FILTER (pol) AS pol, min((d2, i, j)) FILTER (sal) AS sal, min(d2) FILTER (pol) AS pd, min(d2) FILTER (sal) AS sd FROM p GROUP BY 1, 2, 3, 4)
 SELECT structure_id, chain, resid, resname, hydrophobic, aromatic, CASE WHEN pol IS DISTINCT FROM sal THEN {R('sqrt(pd)')} END AS polar_distance, {R('sqrt(sd)')} AS salt_distance FROM g""")
def pocket_chemistry(spark, sf):
    return r6(residues.pocket(view(spark, sf, "atoms")).drop("icode"), "polar_distance", "salt_distance")


@query(cte("atoms") + f", s AS (SELECT a.structure_id, a.chain, a.resid, a.resname, sqrt(min({D2})) AS d, count(*) AS n {_SITE} GROUP BY 1, 2, 3, 4) SELECT structure_id, count(*) AS n_residues, {R('min(d)')} AS min_min_distance, {R('avg(d)')} AS mean_min_distance, {R('stddev_pop(d)')} AS std_min_distance, {R('max(d)')} AS max_min_distance, min(n) AS min_n_contacts, {R('avg(n)')} AS mean_n_contacts, {R('stddev_pop(n)')} AS std_n_contacts, max(n) AS max_n_contacts, " + ", ".join(f"count(*) FILTER (resname = '{a}') AS n_{a}" for a in AMINO_ACIDS) + f", count(*) FILTER (resname NOT IN {_in(AMINO_ACIDS)}) AS \"n_OTHER\" FROM s GROUP BY 1")
def pocket_features(spark, sf):
    site = residues.binding_site(view(spark, sf, "atoms"), "LIG", 6.0)
    g = residues.pocket_features(site)
    return r6(g, *[c for c in g.columns if c.startswith(("mean_", "std_")) or c.endswith("min_distance")])


# docking, duplicates, splits


@query(cte("poses") + " SELECT source, ligand, pose_id, energy, " + R("CASE WHEN heavy > 0 THEN -energy / heavy END") + " AS efficiency, CAST(row_number() OVER (PARTITION BY source ORDER BY energy, ligand, pose_id) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source, ligand ORDER BY energy, ligand, pose_id) AS b FROM poses) t WHERE b = 1")
def best_poses(spark, sf):
    p = view(spark, sf, "poses").select("source", "ligand", "pose_id", "energy", "heavy")
    got = ranking.rank_poses(p, "energy", False, ["ligand", "pose_id"], heavy="heavy", ligand="ligand", by=["source"])
    return r6(got.drop("heavy"), "efficiency")


@query(cte("poses") + " SELECT count(*) AS n_poses, count(energy) AS n_scored, " + ", ".join(f"{R(f)} AS {n}" for n, f in (("min", "min(energy)"), ("max", "max(energy)"), ("mean", "avg(energy)"), ("std", "stddev_pop(energy)"))) + " FROM poses")
def score_summary(spark, sf):
    return r6(ranking.summarise(view(spark, sf, "poses"), "energy"), "min", "max", "mean", "std")


@query(cte("poses") + ", g AS (SELECT ligand, min(energy) AS energy, max(cnnscore) AS cnnscore, min(ligand) AS f FROM poses GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY energy, f, ligand) AS INT) AS rank_energy, CAST(row_number() OVER (ORDER BY cnnscore DESC, f, ligand) AS INT) AS rank_cnnscore FROM g) SELECT ligand, energy, cnnscore, rank_energy, rank_cnnscore, (rank_energy + rank_cnnscore) / 2.0::DOUBLE AS mean_rank, CAST(row_number() OVER (ORDER BY (rank_energy + rank_cnnscore), f, ligand) AS INT) AS rank FROM r")
def consensus_rank(spark, sf):
    p = view(spark, sf, "poses").select("ligand", "energy", "cnnscore").withColumn("order", F.col("ligand"))
    return ranking.consensus(p, {"energy": False, "cnnscore": True}, "ligand", "order")


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS r, trim(text) AS k FROM documents) t WHERE r = 1 OR k = ''")
def dedup_documents(spark, sf):
    return ranking.dedup(table(spark, sf, "documents").select("doc_id", "n_chars", "text"), "text", ["doc_id"]).select("doc_id", "n_chars")


@query("SELECT md5(trim(text)) AS key, count(*) AS n, array_to_string(list_sort(list(doc_id)), ';') AS members FROM documents WHERE trim(text) <> '' GROUP BY trim(text) HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    g = ranking.duplicate_groups(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")
    return g.select(F.md5("key").alias("key"), "n", F.array_join(F.col("members").cast("array<string>"), ";").alias("members"))


@query("SELECT p_partkey, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.1 + 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT p_partkey, ('0x' || substr(md5('0:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM part) t")
def hash_split(spark, sf):
    return ranking.hash_split(table(spark, sf, "part"), "p_partkey", 0.1, 0.1).select("p_partkey", "split")


@query("""WITH RECURSIVE g AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1), c AS (SELECT sum(n) AS n, round_even(sum(n) * 0.1::DOUBLE, 0) AS t FROM g),
 r AS (SELECT 0 AS k, 0::HUGEINT AS train, 0::HUGEINT AS val, NULL::VARCHAR AS brand, NULL::VARCHAR AS split UNION ALL
  SELECT g.k, r.train + CASE WHEN r.train + g.n <= c.n - 2 * c.t THEN g.n ELSE 0 END, r.val + CASE WHEN r.train + g.n > c.n - 2 * c.t AND r.val + g.n <= c.t THEN g.n ELSE 0 END, g.p_brand,
   CASE WHEN r.train + g.n <= c.n - 2 * c.t THEN 'train' WHEN r.val + g.n <= c.t THEN 'validation' ELSE 'test' END FROM r JOIN g ON g.k = r.k + 1, c)
 SELECT p_partkey, p_brand, split FROM part JOIN r ON p_brand = brand""")
def group_split(spark, sf):
    return ranking.group_split(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 0.1, 0.1)


# the distances are summed dimension by dimension, as in the operator
@query("""WITH RECURSIVE u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT k, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY k),
 z AS (SELECT vec_id, list((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY k) AS z FROM u JOIN s USING (k) GROUP BY vec_id), f AS (SELECT arg_max(vec_id, list_sum(list_transform(z, lambda x: x * x))) AS first FROM z),
 r AS (SELECT 0 AS pick, first AS cur, [first] AS picked FROM f UNION ALL SELECT pick + 1, n.vec_id, list_append(picked, n.vec_id) FROM r, LATERAL (SELECT a.vec_id FROM (SELECT a.vec_id, min(list_distance(a.z, b.z)) AS d FROM z a JOIN z b ON list_contains(r.picked, b.vec_id) WHERE NOT list_contains(r.picked, a.vec_id) GROUP BY a.vec_id) a ORDER BY d DESC, vec_id LIMIT 1) n WHERE pick < 19)
 SELECT cur AS vec_id, pick FROM r""")
def select_diverse(spark, sf):
    return ranking.select_diverse(table(spark, sf, "embeddings"), "vec_id", "embedding", 20)


@query("SELECT a.vec_id AS i, b.vec_id AS j, " + R("sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))))") + " AS distance FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0")
def vector_distances(spark, sf):
    e = table(spark, sf, "embeddings")
    return r6(spatial.vector_distances(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding"), "distance")


# ensembles

_EP = "FROM ensemble a JOIN ensemble b ON a.structure_id = b.structure_id AND a.atom_idx = b.atom_idx"


@query(cte("ensemble") + f" SELECT structure_id, atom_idx, count(*) AS n_models, {R('sqrt(var_pop(x) + var_pop(y) + var_pop(z))')} AS rmsf FROM ensemble GROUP BY 1, 2")
def rmsf(spark, sf):
    return r6(ensemble.rmsf(view(spark, sf, "ensemble"), align=False), "rmsf")


@query(cte("ensemble") + f" SELECT a.structure_id, a.model_id AS model_a, b.model_id AS model_b, {R(f'sqrt(avg({D2}))')} AS rmsd {_EP} AND a.model_id < b.model_id GROUP BY 1, 2, 3")
def rmsd_matrix(spark, sf):
    return r6(ensemble.rmsd_matrix(view(spark, sf, "ensemble"), align=False), "rmsd")


@query()
def rmsd_matrix_aligned(spark, sf):
    return ensemble.rmsd_matrix(view(spark, sf, "ensemble"))


@query()
def rmsf_aligned(spark, sf):
    return ensemble.rmsf(view(spark, sf, "ensemble"))


@query(cte("ensemble") + f", n AS (SELECT structure_id, count(DISTINCT model_id) AS n FROM ensemble GROUP BY 1), c AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, count(*) AS c FROM ensemble a JOIN ensemble b ON a.structure_id = b.structure_id AND a.model_id = b.model_id AND a.atom_idx < b.atom_idx WHERE {D2} < 100 GROUP BY 1, 2, 3) SELECT c.structure_id, i, j, {R('c / n::DOUBLE')} AS frequency FROM c JOIN n ON c.structure_id = n.structure_id")
def contact_frequency(spark, sf):
    return r6(ensemble.contact_frequency(view(spark, sf, "ensemble"), 10.0, level="atom"), "frequency")


@query(cte("ensemble") + ", d AS (SELECT structure_id, model_id, atom_idx, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM ensemble WINDOW w AS (PARTITION BY structure_id, atom_idx)), g AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, avg(a.x * b.x + a.y * b.y + a.z * b.z) AS c, avg(a.x * a.x + a.y * a.y + a.z * a.z) AS vi, avg(b.x * b.x + b.y * b.y + b.z * b.z) AS vj FROM d a JOIN d b ON a.structure_id = b.structure_id AND a.model_id = b.model_id AND a.atom_idx <= b.atom_idx GROUP BY 1, 2, 3) SELECT structure_id, i, j, (round(CASE WHEN i = j THEN 1.0 WHEN sqrt(vi * vj) > 0 THEN c / sqrt(vi * vj) ELSE 0.0 END, 9) + 0.0) AS correlation FROM g")
def cross_correlation(spark, sf):
    c = ensemble.cross_correlation(view(spark, sf, "ensemble"), align=False)
    return c.withColumn("correlation", F.round("correlation", 9))


@query(cte("ensemble") + f", w AS (SELECT *, {M} AS m FROM ensemble), c AS (SELECT structure_id, model_id, count(*) AS n_atoms, sum(m) AS t, sum(m * x) / sum(m) AS cx, sum(m * y) / sum(m) AS cy, sum(m * z) / sum(m) AS cz FROM w GROUP BY 1, 2), g AS (SELECT w.structure_id, w.model_id, first(n_atoms) AS n_atoms, sqrt(sum(m * ((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz))) / first(t)) AS rg FROM w JOIN c ON w.structure_id = c.structure_id AND w.model_id = c.model_id GROUP BY 1, 2), f AS (SELECT structure_id, min(model_id) AS ref FROM ensemble GROUP BY 1), r AS (SELECT a.structure_id, a.model_id, sqrt(avg({D2})) AS d {_EP} JOIN f ON f.structure_id = a.structure_id AND b.model_id = f.ref GROUP BY 1, 2) SELECT g.structure_id, g.model_id, n_atoms, {R('rg')} AS rg, {R('d')} AS rmsd_first FROM g LEFT JOIN r ON g.structure_id = r.structure_id AND g.model_id = r.model_id")
def frame_series(spark, sf):
    return r6(ensemble.frame_series(view(spark, sf, "ensemble")), "rg", "rmsd_first")


@query()
def model_clusters(spark, sf):
    return ensemble.cluster(ensemble.rmsd_matrix(view(spark, sf, "ensemble")))


@query(f"SELECT user_id, count(*) AS n, min(event_id) AS first_frame, arg_min(value, event_id) AS first_value, arg_max(value, event_id) AS last_value, {R('avg(value)')} AS mean, {R('greatest(abs(max(value) - arg_min(value, event_id)), abs(min(value) - arg_min(value, event_id)))')} AS largest_shift FROM events GROUP BY 1")
def streamed_frames(spark, sf):
    return r6(frames.streamed_events(spark, sf), "mean", "largest_shift")


# backbone


def _dihedral_sql(source: str, points: tuple[str, str, str, str], name: str, keep: str) -> str:
    """SELECT of a dihedral over point columns <p>x, <p>y, <p>z of source, in the steps of functions.geometry.dihedral."""
    a, b, c, d = points
    out = [f"{a}{k} - {b}{k} AS {name}_u{k}, {c}{k} - {b}{k} AS {name}_v{k}, {d}{k} - {c}{k} AS {name}_w{k}" for k in "xyz"]

    def dots(p, q):
        return "(" + " + ".join(f"{name}_{p}{k} * {name}_{q}{k}" for k in "xyz") + ")"

    out.append(f"{dots('v', 'v')} AS {name}_n")
    out += [f"{name}_v{i} * {name}_{q}{j} - {name}_v{j} * {name}_{q}{i} AS {name}_{p}{k}" for p, q in ("pu", "qw") for k, i, j in ("xyz", "yzx", "zxy")]
    turn = f"degrees(atan2(0.0::DOUBLE - sqrt({name}_n) * {dots('u', 'q')}, {dots('p', 'q')}))"
    out.append(f"CASE WHEN {name}_n > 0 THEN CASE WHEN least({dots('p', 'p')}, {dots('q', 'q')}) <= {name}_n * {name}_n * {ON_AXIS!r} THEN 0.0 ELSE {turn} END END AS {name}")
    return f"SELECT {keep}, {', '.join(out)} FROM {source}"


@query(cte("backbone") + """, b AS (SELECT structure_id, resid, count(*) AS n, max(x) FILTER (atom_name = 'N') AS nx, max(y) FILTER (atom_name = 'N') AS ny, max(z) FILTER (atom_name = 'N') AS nz, max(x) FILTER (atom_name = 'CA') AS ax, max(y) FILTER (atom_name = 'CA') AS ay, max(z) FILTER (atom_name = 'CA') AS az,
  max(x) FILTER (atom_name = 'C') AS cx, max(y) FILTER (atom_name = 'C') AS cy, max(z) FILTER (atom_name = 'C') AS cz, max(x) FILTER (atom_name = 'O') AS ox, max(y) FILTER (atom_name = 'O') AS oy, max(z) FILTER (atom_name = 'O') AS oz FROM backbone GROUP BY 1, 2 HAVING count(*) = 4),
 l AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(cz) OVER w AS pz, lag(ox) OVER w AS qx, lag(oy) OVER w AS qy, lag(oz) OVER w AS qz FROM b WINDOW w AS (PARTITION BY structure_id ORDER BY resid)),
 h AS (SELECT *, sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy) + (pz - qz) * (pz - qz)) AS co FROM l WHERE sqrt((px - nx) * (px - nx) + (py - ny) * (py - ny) + (pz - nz) * (pz - nz)) < 2.5),
 d AS (SELECT *, nx + (px - qx) / co AS hx, ny + (py - qy) / co AS hy, nz + (pz - qz) / co AS hz FROM h WHERE co > 0),
 e AS (SELECT i.structure_id, i.resid AS i, j.resid AS j, sqrt((i.ox - j.nx) * (i.ox - j.nx) + (i.oy - j.ny) * (i.oy - j.ny) + (i.oz - j.nz) * (i.oz - j.nz)) AS r_on, sqrt((i.cx - j.hx) * (i.cx - j.hx) + (i.cy - j.hy) * (i.cy - j.hy) + (i.cz - j.hz) * (i.cz - j.hz)) AS ch,
  sqrt((i.ox - j.hx) * (i.ox - j.hx) + (i.oy - j.hy) * (i.oy - j.hy) + (i.oz - j.hz) * (i.oz - j.hz)) AS oh, sqrt((i.cx - j.nx) * (i.cx - j.nx) + (i.cy - j.ny) * (i.cy - j.ny) + (i.cz - j.nz) * (i.cz - j.nz)) AS cn
  FROM b i JOIN d j ON i.structure_id = j.structure_id AND i.resid <> j.resid WHERE (i.ax - j.ax) * (i.ax - j.ax) + (i.ay - j.ay) * (i.ay - j.ay) + (i.az - j.az) * (i.az - j.az) < 81)
 SELECT structure_id, i, j FROM e WHERE r_on > 0 AND ch > 0 AND oh > 0 AND cn > 0 AND 0.42 * 0.20 * 332.0 * (1 / r_on + 1 / ch - 1 / oh - 1 / cn) < -0.5""")
def hydrogen_bonds(spark, sf):
    return secondary.hydrogen_bonds(secondary.backbone(view(spark, sf, "backbone")))


def _turn(given: str, name: str) -> str:
    return f"CASE WHEN {given} THEN CASE WHEN {R(name)} = -180 THEN 180.0::DOUBLE ELSE {R(name)} END END AS {name}"


_FOUR = ", ".join(f"max({x}) FILTER (atom_name = '{n}') AS {p}{x}" for n, p in (("N", "n"), ("CA", "a"), ("C", "c"), ("O", "o")) for x in "xyz")
_NEXT = ", ".join(f"lag({p}{x}) OVER w AS p{p}{x}" for p in "ac" for x in "xyz") + ", " + ", ".join(f"lead(n{x}) OVER w AS nn{x}" for x in "xyz")
_NEAR = " + ".join(f"(pc{x} - n{x}) * (pc{x} - n{x})" for x in "xyz")


@query(cte("backbone") + f""", b AS (SELECT structure_id, resid, {_FOUR} FROM backbone GROUP BY 1, 2 HAVING count(*) = 4),
 l AS (SELECT *, row_number() OVER w - 1 AS r, {_NEXT} FROM b WINDOW w AS (PARTITION BY structure_id ORDER BY resid)), k AS (SELECT *, coalesce(sqrt({_NEAR}) < 2.5, false) AS linked FROM l),
 m AS (SELECT *, coalesce(lead(linked) OVER (PARTITION BY structure_id ORDER BY r), false) AS next FROM k), f AS ({_dihedral_sql("m", ("pc", "n", "a", "c"), "phi", "m.*")}),
 g AS ({_dihedral_sql("f", ("pa", "pc", "n", "a"), "omega", "f.*")}), h AS ({_dihedral_sql("g", ("n", "a", "c", "nn"), "psi", "g.*")})
 SELECT structure_id, CAST(r AS INT) AS r, 'A' AS chain, resid, '' AS icode, 'ALA' AS resname, {_turn("linked", "phi")}, {_turn("next", "psi")}, {_turn("linked", "omega")} FROM h""")
def backbone_torsions(spark, sf):
    t = r6(secondary.torsions(view(spark, sf, "backbone")), "phi", "psi", "omega")
    return t.withColumns({c: F.when(F.col(c) == -180.0, 180.0).otherwise(F.col(c)) for c in ("phi", "psi", "omega")})  # one angle, whose sign is rounding noise


@query()
def secondary_structure(spark, sf):
    return secondary.assign(view(spark, sf, "backbone"))


@query(cte("poses") + ", s AS (SELECT ligand, source AS code, pose_id, CASE WHEN lag(source) OVER w = source THEN 0 ELSE 1 END AS n FROM poses WINDOW w AS (PARTITION BY ligand ORDER BY pose_id)), t AS (SELECT *, sum(n) OVER (PARTITION BY ligand ORDER BY pose_id) AS g FROM s) SELECT ligand AS structure_id, code, min(pose_id) AS first, max(pose_id) AS last, count(*) AS n FROM t GROUP BY ligand, code, g")
def code_segments(spark, sf):
    p = view(spark, sf, "poses").select(F.col("ligand").alias("structure_id"), F.lit("A").alias("chain"), F.col("source").alias("code"), F.col("pose_id").alias("r"))
    return secondary.segments(p, include_coil=True).drop("chain")


@query(cte("atoms") + REPS + ", l AS (SELECT structure_id, chain, resid - lag(resid) OVER w AS step, (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS d2 FROM reps WINDOW w AS (PARTITION BY structure_id, chain ORDER BY atom_idx)) SELECT structure_id, chain, count(*) FILTER (step > 1) AS n_gaps, count(*) FILTER (step = 1 AND d2 > 20.25) AS n_breaks FROM l GROUP BY 1, 2")
def gaps_and_breaks(spark, sf):
    return secondary.gaps_and_breaks(residues.representatives(view(spark, sf, "atoms")))


_POINTS = ", ".join(f"({k}, {', '.join(f'CAST({v!r} AS DOUBLE)' for v in p)})" for k, p in enumerate(fibonacci_sphere(48)))
_OUT = " + ".join(f"(p{x} * radius - d{x}) * (p{x} * radius - d{x})" for x in "xyz")
_ASA = case_sql("resname", el.MAX_ASA, "NULL").replace("'NULL'", "NULL")


@query(cte("atoms") + RUNS + f""", s AS (SELECT *, {case_sql("element", el.VDW_RADIUS, el.DEFAULT_VDW)} + 1.4::DOUBLE AS radius FROM runs), t AS (SELECT * FROM (VALUES {_POINTS}) v(k, px, py, pz)),
 n AS (SELECT a.structure_id, a.atom_idx, a.radius, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.radius * b.radius AS r2 FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx WHERE {D2} < (a.radius + b.radius) * (a.radius + b.radius)),
 h AS (SELECT structure_id, atom_idx, count(DISTINCT k) AS hidden FROM n, t WHERE {_OUT} < r2 GROUP BY 1, 2),
 g AS (SELECT s.structure_id, residue_idx, first(chain) AS chain, first(resid) AS resid, first(icode) AS icode, first(resname) AS resname, sum(radius * radius * {surface.PI4!r}::DOUBLE * (48 - coalesce(hidden, 0)) / 48) AS sasa FROM s LEFT JOIN h ON s.structure_id = h.structure_id AND s.atom_idx = h.atom_idx GROUP BY 1, 2)
 SELECT structure_id, residue_idx, chain, resid, icode, resname, {R("sasa")} AS sasa, {R(f"sasa / ({_ASA})")} AS rsa, coalesce(sasa / ({_ASA}) >= 0.2, false) AS exposed FROM g""")
def solvent_surface(spark, sf):
    return r6(surface.residue_surface(view(spark, sf, "atoms"), n_points=48), "sasa", "rsa")


# graphs

_DIR = f", e AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j {PAIR} WHERE {D2} < 25), d AS (SELECT structure_id, i, j FROM e UNION ALL SELECT structure_id, j, i FROM e)"


def _edges(spark, sf):
    a = view(spark, sf, "atoms")
    return a, spatial.pairs(a, 5.0).select("structure_id", "i", "j")


@query(cte("atoms") + _DIR + " SELECT structure_id, i AS atom_idx, count(*) AS degree FROM d GROUP BY 1, 2")
def node_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf)[1])


_HOT = ", ".join(f"CAST(element = '{e}' AS INT) AS element_{e}" for e in el.DEFAULT_ELEMENTS) + ", CAST(element NOT IN " + _in(el.DEFAULT_ELEMENTS) + " AS INT) AS element_other"


@query(cte("atoms") + f" SELECT structure_id, atom_idx, CAST({case_sql('element', {k: v for k, v in el.NUMBERED.items() if k in 'CNOSHP'}, 0)} AS INT) AS atomic_number, {M} AS mass, {case_sql('element', COVALENT_RADIUS, 0.75)} AS covalent_radius, 0 AS formal_charge, {_HOT} FROM atoms")
def node_features(spark, sf):
    return graph.node_features(view(spark, sf, "atoms"))


def _v(p, q):
    return [f"({p}.{c} - {q}.{c})" for c in "xyz"]


def _dot(u, v):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(u, v, strict=True)) + ")"


_NN = f"(sqrt({_dot(_v('pj', 'pi'), _v('pj', 'pi'))}) * sqrt({_dot(_v('po', 'pi'), _v('po', 'pi'))}))"


@query(cte("atoms") + _DIR + f", t AS (SELECT d.structure_id, least(d.i, d.j) AS i, greatest(d.i, d.j) AS j, CASE WHEN {_NN} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, {_dot(_v('pj', 'pi'), _v('po', 'pi'))} / {_NN})))) END AS a FROM d JOIN d n ON d.structure_id = n.structure_id AND d.i = n.i AND n.j <> d.j JOIN atoms pi ON pi.structure_id = d.structure_id AND pi.atom_idx = d.i JOIN atoms pj ON pj.structure_id = d.structure_id AND pj.atom_idx = d.j JOIN atoms po ON po.structure_id = d.structure_id AND po.atom_idx = n.j), g AS (SELECT structure_id, i, j, avg(a) AS a FROM t GROUP BY 1, 2, 3) SELECT e.structure_id, e.i, e.j, {R('coalesce(a, 0.0)')} AS angle FROM e LEFT JOIN g ON e.structure_id = g.structure_id AND e.i = g.i AND e.j = g.j")
def edge_angles(spark, sf):
    a, e = _edges(spark, sf)
    return r6(graph.edge_angles(e, a), "angle")


_PLACED = ", ".join(f"{p}.{x} AS {p}{x}" for p in ("pa", "pi", "pj", "pb") for x in "xyz")
_AT = " ".join(f"JOIN atoms p{c} ON p{c}.structure_id = e.structure_id AND p{c}.atom_idx = {at}" for c, at in (("a", "a.j"), ("i", "e.i"), ("j", "e.j"), ("b", "b.j")))


@query(cte("atoms") + _DIR + f""", q AS (SELECT e.structure_id, e.i, e.j, {_PLACED} FROM e JOIN d a ON a.structure_id = e.structure_id AND a.i = e.i AND a.j <> e.j JOIN d b ON b.structure_id = e.structure_id AND b.i = e.j AND b.j <> e.i {_AT}),
 t AS ({_dihedral_sql("q", ("pa", "pi", "pj", "pb"), "t", "structure_id, i, j")}), g AS (SELECT structure_id, i, j, avg(t) AS t FROM t GROUP BY 1, 2, 3)
 SELECT e.structure_id, e.i, e.j, {R("coalesce(t, 0.0)")} AS dihedral FROM e LEFT JOIN g ON e.structure_id = g.structure_id AND e.i = g.i AND e.j = g.j""")
def edge_dihedrals(spark, sf):
    a, e = _edges(spark, sf)
    return r6(graph.edge_dihedrals(e, a), "dihedral")


@query(cte("atoms") + _DIR + f", g AS (SELECT structure_id, i, count(*) AS deg FROM d GROUP BY 1, 2), p AS (SELECT d.structure_id, d.i, d.j, 1.0 / deg AS p FROM d JOIN g ON d.structure_id = g.structure_id AND d.i = g.i) SELECT a.structure_id, a.i AS atom_idx, 2 AS step, {R('sum(a.p::DOUBLE * b.p::DOUBLE)')} AS p FROM p a JOIN p b ON a.structure_id = b.structure_id AND a.j = b.i AND b.j = a.i GROUP BY 1, 2")
def random_walk(spark, sf):
    return r6(graph.random_walk(_edges(spark, sf)[1], 2), "p")


@query()
def laplacian_encodings(spark, sf):
    a, e = _edges(spark, sf)
    return graph.encodings(e, a.groupBy("structure_id").agg(F.count("*").cast("int").alias("n")), 4)


@query()
def bond_orders(spark, sf):
    a = view(spark, sf, "atoms")
    return graph.bond_orders(aggregates.bonds(a), a)


def _signed(sign: str, pairs) -> str:
    return f"(resname || ' ' || atom_name) IN {_in([' '.join(p) for p in pairs])} THEN {sign}"


_GIVEN = "CASE WHEN " + _signed("1", el.CATIONIC) + " WHEN " + _signed("-1", ANIONIC) + " ELSE 0 END"


@query(cte("atoms") + REPS + f""", s AS (SELECT *, {_GIVEN} AS sign, atom_name NOT IN ('N', 'CA', 'C', 'O', 'OXT') AND element <> 'H' AS side, resname = 'CYS' AND atom_name = 'SG' AS sg FROM runs),
 p AS (SELECT a.structure_id, a.residue_idx AS i, b.residue_idx AS j, min({D2}) FILTER (a.sg AND b.sg) AS ss, min({D2}) FILTER (a.sign * b.sign < 0) AS salt, min({D2}) FILTER (a.side AND b.side) AS sc FROM s a JOIN s b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx AND a.residue_idx <> b.residue_idx WHERE {D2} < 25 GROUP BY 1, 2, 3),
 e AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j {REP_PAIR} WHERE {D2} < 64), r AS (SELECT structure_id, residue_idx, first(chain) AS chain, first(resid) AS resid, first(resname) AS resname, bool_or(hetero) AS hetero FROM runs GROUP BY 1, 2)
 SELECT e.structure_id, e.i, e.j, CASE WHEN ss < 6.25 THEN 'disulfide' WHEN (u.hetero AND u.resname NOT IN {_in(WATER)}) OR (v.hetero AND v.resname NOT IN {_in(WATER)}) THEN 'ligand' WHEN salt < 16 THEN 'salt_bridge' WHEN u.chain = v.chain AND abs(u.resid - v.resid) = 1 THEN 'covalent'
  WHEN sc < 25 AND u.resname IN {_in(el.GRAPH_HYDROPHOBIC)} AND v.resname IN {_in(el.GRAPH_HYDROPHOBIC)} THEN 'hydrophobic' WHEN sc < 25 AND u.resname IN {_in(el.GRAPH_POLAR)} AND v.resname IN {_in(el.GRAPH_POLAR)} THEN 'polar' ELSE 'proximity' END AS label
 FROM e LEFT JOIN p ON e.structure_id = p.structure_id AND e.i = p.i AND e.j = p.j JOIN r u ON u.structure_id = e.structure_id AND u.residue_idx = e.i JOIN r v ON v.structure_id = e.structure_id AND v.residue_idx = e.j""")
def residue_interactions(spark, sf):
    a = view(spark, sf, "atoms")
    return graph.interactions(a, residues.contact_map(a, carry=graph.ENDS))


# coarse-graining, comparison, quality

_BEADS = RUNS + f", beads AS (SELECT structure_id, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY residue_idx, f, bead_name) - 1 AS INT) AS bead_idx, * EXCLUDE (structure_id) FROM (SELECT structure_id, residue_idx, bead_name, first(chain) AS chain, sum(m * x) / sum(m) AS x, sum(m * y) / sum(m) AS y, sum(m * z) / sum(m) AS z, count(*) AS n_atoms, min(atom_idx) AS f FROM (SELECT *, {M} AS m, CASE WHEN atom_name IN ('N', 'CA', 'C', 'O', 'OXT') THEN 'BB' WHEN element <> 'H' THEN 'SC' END AS bead_name FROM runs) t WHERE bead_name IS NOT NULL GROUP BY 1, 2, 3) u)"


def _beads(spark, sf):
    return coarse.beads(coarse.members(view(spark, sf, "atoms"), "backbone_sidechain"))


@query(cte("atoms") + _BEADS + " SELECT structure_id, bead_idx, bead_name, residue_idx, chain, " + ", ".join(f"{R(c)} AS {c}" for c in "xyz") + ", n_atoms FROM beads")
def coarse_beads(spark, sf):
    return r6(_beads(spark, sf).drop("icode", "resid", "resname"), "x", "y", "z")


@query(cte("atoms") + _BEADS + " SELECT structure_id, bead_idx AS i, j FROM (SELECT *, lead(bead_idx) OVER w AS j, lead(residue_idx) OVER w AS nr FROM beads WINDOW w AS (PARTITION BY structure_id ORDER BY bead_idx)) t WHERE nr = residue_idx UNION ALL SELECT structure_id, i, j FROM (SELECT *, lead(i) OVER w AS j, lead(chain) OVER w AS nc FROM (SELECT structure_id, residue_idx, min(bead_idx) AS i, first(chain) AS chain FROM beads GROUP BY 1, 2) t WINDOW w AS (PARTITION BY structure_id ORDER BY residue_idx)) u WHERE nc = chain")
def coarse_bonds(spark, sf):
    return coarse.bead_bonds(_beads(spark, sf))


@query(cte("atoms") + " SELECT structure_id, count(*) AS n_atoms, count(*) FILTER (k) AS n_members, count(*) FILTER (NOT k) AS n_dropped FROM (SELECT structure_id, atom_name IN ('N', 'CA', 'C', 'O', 'OXT') OR element <> 'H' AS k FROM atoms) t GROUP BY 1")
def coarse_coverage(spark, sf):
    a = view(spark, sf, "atoms")
    return coarse.coverage(a, coarse.members(a, "backbone_sidechain"))


_TWO = """, f AS (SELECT *, row_number() OVER (PARTITION BY structure_id, model_id, chain, resid, icode, atom_name ORDER BY atom_idx) AS r FROM ensemble)"""


@query(cte("ensemble") + _TWO + f" SELECT a.structure_id, a.atom_idx AS atom_a, b.atom_idx AS atom_b, {R(D2)} AS d2 FROM f a JOIN f b ON a.structure_id = b.structure_id AND a.chain = b.chain AND a.resid = b.resid AND a.icode = b.icode AND a.atom_name = b.atom_name WHERE a.model_id = 1 AND b.model_id = 2 AND a.r = 1 AND b.r = 1")
def matched_atoms(spark, sf):
    e = view(spark, sf, "ensemble")
    m = compare.matched(e.where("model_id = 1"), e.where("model_id = 2"))
    d2 = sum(((F.col(f"p{x}") - F.col(f"q{x}")) * (F.col(f"p{x}") - F.col(f"q{x}")) for x in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    return r6(m.select("structure_id", "atom_a", "atom_b", d2.alias("d2")), "d2")


def _con(m):
    return f"SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j FROM ensemble a JOIN ensemble b ON a.structure_id = b.structure_id AND a.model_id = b.model_id AND a.atom_idx < b.atom_idx WHERE a.model_id = {m} AND {D2} < 100"


@query(cte("ensemble") + f", p AS ({_con(1)}), q AS ({_con(2)}) SELECT coalesce(p.structure_id, q.structure_id) AS structure_id, count(*) FILTER (p.i IS NOT NULL AND q.i IS NOT NULL) AS common, count(*) FILTER (q.i IS NULL) AS lost, count(*) FILTER (p.i IS NULL) AS gained FROM p FULL JOIN q ON p.structure_id = q.structure_id AND p.i = q.i AND p.j = q.j GROUP BY 1")
def contact_changes(spark, sf):
    e = view(spark, sf, "ensemble")
    return compare.contact_changes(*(spatial.pairs(e.where(F.col("model_id") == m), 10.0) for m in (1, 2)))


@query(cte("atoms") + RUNS + f", k AS (SELECT structure_id, residue_idx, first(resname) AS resname, bool_or(hetero) AS het FROM runs GROUP BY 1, 2), c AS (SELECT structure_id, count(*) AS n_residues, count(*) FILTER (resname IN {_in(WATER)}) AS n_waters, count(*) FILTER (resname IN {_in(IONS)} AND het) AS n_ions, count(*) FILTER (het AND resname NOT IN {_in((*WATER, *IONS))}) AS n_ligands FROM k GROUP BY 1) SELECT c.*, n_atoms, n_hydrogens, n_blank_elements, n_unknown_elements, n_without_atom_name, n_without_resname, n_without_chain FROM c JOIN (SELECT structure_id, count(*) AS n_atoms, count(*) FILTER (element = 'H') AS n_hydrogens, count(*) FILTER (trim(element) = '') AS n_blank_elements, count(*) FILTER (element NOT IN {_in((*el.SYMBOLS, ''))}) AS n_unknown_elements, count(*) FILTER (atom_name = '') AS n_without_atom_name, count(*) FILTER (resname = '') AS n_without_resname, count(*) FILTER (chain = '') AS n_without_chain FROM atoms GROUP BY 1) a ON a.structure_id = c.structure_id")
def quality_inventory(spark, sf):
    return quality.inventory(view(spark, sf, "atoms"))


@query(cte("atoms") + " SELECT structure_id, 'missing_hydrogens' AS code FROM atoms GROUP BY structure_id HAVING count(*) FILTER (element = 'H') = 0")
def quality_findings(spark, sf):
    return quality.findings(quality.inventory(view(spark, sf, "atoms")))


_TOPOLOGY = (cte("atoms") + REPS + f", k AS (SELECT structure_id, residue_idx, first(resname) AS resname, count(DISTINCT atom_name) FILTER (atom_name IN ('N', 'CA', 'C', 'O')) AS bb, count(*) FILTER (element NOT IN ('H', 'D')) AS heavy FROM runs GROUP BY 1, 2) SELECT structure_id, count(*) FILTER (resname IN {_in((*AMINO_ACIDS, *NUCLEOTIDES))}) AS n_polymer, count(*) FILTER (resname NOT IN {_in((*AMINO_ACIDS, *NUCLEOTIDES, *WATER))}) AS n_nonstandard, count(*) FILTER (resname IN {_in(AMINO_ACIDS)} AND bb < 4) AS n_missing_backbone, count(*) FILTER (resname IN {_in(AMINO_ACIDS)} AND heavy < {case_sql('resname', HEAVY_ATOMS, 0)}) AS n_truncated FROM k GROUP BY 1)")
_TOPOLOGY = _TOPOLOGY.replace(" SELECT structure_id, count(*) FILTER (resname IN", ", t AS (SELECT structure_id, count(*) FILTER (resname IN", 1) + f""", q AS (SELECT structure_id, resid - lag(resid) OVER w AS step, (x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w) AS d2
 FROM reps WHERE resname IN {_in((*AMINO_ACIDS, *NUCLEOTIDES))} WINDOW w AS (PARTITION BY structure_id, chain ORDER BY atom_idx)), g AS (SELECT structure_id, count(*) FILTER (step > 1) AS n_gaps, count(*) FILTER (step = 1 AND d2 > 20.25) AS n_breaks FROM q GROUP BY 1)
 SELECT t.*, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_breaks, 0) AS n_breaks FROM t LEFT JOIN g USING (structure_id)"""


@query(_TOPOLOGY)
def structure_topology(spark, sf):
    return quality.topology(view(spark, sf, "atoms"))


@query("SELECT p_partkey, p_name, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT p_partkey, p_name, ('0x' || substr(md5('3:' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT *, row_number() OVER (PARTITION BY trim(p_name) ORDER BY p_partkey) AS r FROM part) t WHERE r = 1) v")
def prepare_table(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    return datasets.prepare(p, "p_partkey", "p_name", ["p_size"], 0.2, 0.1, 3).select("p_partkey", "p_name", "split")


@query(cte("atoms") + RUNS + " SELECT structure_id, residue_idx, CAST(count(*) AS DOUBLE) AS residue_size, " + ", ".join(f"CASE WHEN first(resname) = '{a}' THEN 1.0::DOUBLE ELSE 0 END AS residue_{a}" for a in AMINO_ACIDS) + f", CASE WHEN first(resname) NOT IN {_in(AMINO_ACIDS)} THEN 1.0::DOUBLE ELSE 0 END AS \"residue_UNK\" FROM runs GROUP BY 1, 2")
def residue_node_features(spark, sf):
    return presets.residue_node_features(residues.residues(view(spark, sf, "atoms")), "ml")


@query(cte("atoms") + f" SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {R(f'sqrt({D2})')} AS distance, sqrt({D2}) < 1.2 * ({case_sql('a.element', COVALENT_RADIUS, 0.75)} + {case_sql('b.element', COVALENT_RADIUS, 0.75)}) AS covalent {PAIR} WHERE {D2} < 25 AND NOT (a.chain = b.chain AND abs(a.resid - b.resid) < 2)")
def radius_graph(spark, sf):
    return r6(datasets.graph_edges(view(spark, sf, "atoms"), "radius", 5.0, min_seq_sep=2), "distance")


@query(cte("ensemble") + ", m AS (SELECT structure_id, model_id, avg(x) AS cx, avg(y) AS cy FROM ensemble WHERE model_id IN (1, 2) GROUP BY 1, 2) SELECT a.structure_id, f.feature, " + ", ".join(f"{R(f'CASE f.feature WHEN {chr(39)}cx{chr(39)} THEN {x}cx ELSE {x}cy END')} AS {n}" for n, x in (("a", "a."), ("b", "b."))) + ", " + R("CASE f.feature WHEN 'cx' THEN b.cx - a.cx ELSE b.cy - a.cy END") + " AS delta FROM m a JOIN m b ON a.structure_id = b.structure_id AND a.model_id = 1 AND b.model_id = 2, (VALUES ('cx'), ('cy')) f(feature)")
def descriptor_changes(spark, sf):
    e = view(spark, sf, "ensemble")
    one, two = (e.where(F.col("model_id") == m).groupBy("structure_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")) for m in (1, 2))
    return r6(compare.descriptor_changes(one, two, ["cx", "cy"]), "a", "b", "delta")


@query(cte("atoms") + _BEADS + ", s AS (SELECT structure_id, sum(CASE bead_idx WHEN 0 THEN 1.0 WHEN 1 THEN 3.0 END) AS w, sum(CASE bead_idx WHEN 0 THEN 1.0 ELSE 3.0 END * x) AS x, sum(CASE bead_idx WHEN 0 THEN 1.0 ELSE 3.0 END * y) AS y, sum(CASE bead_idx WHEN 0 THEN 1.0 ELSE 3.0 END * z) AS z FROM beads WHERE bead_idx IN (0, 1) GROUP BY 1) SELECT structure_id, 'V' AS site_name, " + ", ".join(f"{R(f'{c} / w::DOUBLE')} AS {c}" for c in "xyz") + " FROM s")
def virtual_sites(spark, sf):
    sites = spark.createDataFrame([("V", [0, 1], [1.0, 3.0])], "site_name string, parents array<int>, weights array<double>")
    return r6(coarse.virtual_sites(_beads(spark, sf), sites), "x", "y", "z")


@query(cte("atoms") + _BEADS + ", w AS (SELECT *, row_number() OVER (PARTITION BY structure_id, bead_name ORDER BY bead_idx) AS n FROM beads) SELECT structure_id, bead_idx, CASE WHEN n = 1 THEN bead_name ELSE bead_name || '_' || n END AS group_name FROM w")
def bead_group_names(spark, sf):
    return coarse.group_names(_beads(spark, sf)).select("structure_id", "bead_idx", "group_name")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return contact_density(spark, sf)


# moves, measures, reports

_RADIAN = math.radians(30.0)


@query(cte("atoms") + f", m AS (SELECT structure_id, avg(x) AS ox, avg(y) AS oy FROM atoms GROUP BY 1) SELECT a.structure_id, atom_idx, {R(f'ox + (x - ox) * {math.cos(_RADIAN)!r}::DOUBLE - (y - oy) * {math.sin(_RADIAN)!r}::DOUBLE + 1.5')} AS x, {R(f'oy + (y - oy) * {math.cos(_RADIAN)!r}::DOUBLE + (x - ox) * {math.sin(_RADIAN)!r}::DOUBLE - 2.0')} AS y, {R('z + 0.25')} AS z FROM atoms a JOIN m ON a.structure_id = m.structure_id")
def moved_atoms(spark, sf):
    a = transforms.translated(transforms.turned(view(spark, sf, "atoms"), "z", 30.0), (1.5, -2.0, 0.25))
    return r6(a, "x", "y", "z").select("structure_id", "atom_idx", "x", "y", "z")


@query(cte("atoms") + f", w AS (SELECT *, {M} AS m FROM atoms), c AS (SELECT structure_id, sum(m * x) / sum(m) AS ox, sum(m * y) / sum(m) AS oy, sum(m * z) / sum(m) AS oz FROM w GROUP BY 1) SELECT a.structure_id, atom_idx, {R('x - ox')} AS x, {R('y - oy')} AS y, {R('z - oz')} AS z FROM atoms a JOIN c ON a.structure_id = c.structure_id")
def centred_atoms(spark, sf):
    return r6(transforms.centred(view(spark, sf, "atoms"), weighted=True), "x", "y", "z").select("structure_id", "atom_idx", "x", "y", "z")


_PICKED = ", ".join(f"max({x}) FILTER (atom_idx = {k}) AS p{k}{x}" for k in range(4) for x in "xyz")
_AB, _BC = (" + ".join(f"(p{i}{x} - p1{x}) * (p{i}{x} - p1{x})" for x in "xyz") for i in (0, 2))
_ARMS = " + ".join(f"(p0{x} - p1{x}) * (p2{x} - p1{x})" for x in "xyz")


@query(cte("atoms") + f", p AS (SELECT structure_id, {_PICKED} FROM atoms GROUP BY 1), q AS ({_dihedral_sql('p', ('p0', 'p1', 'p2', 'p3'), 't', 'p.*')})" + f""" SELECT structure_id, 'distance' AS kind, {R(f"sqrt({_AB})")} AS value, 'angstrom' AS unit FROM q WHERE p1x IS NOT NULL
 UNION ALL SELECT structure_id, 'angle', CASE WHEN ({_AB}) > 0 AND ({_BC}) > 0 THEN {R(f"degrees(acos(greatest(-1.0, least(1.0, ({_ARMS}) / (sqrt({_AB}) * sqrt({_BC}))))))")} END, 'degrees' FROM q WHERE p2x IS NOT NULL
 UNION ALL SELECT structure_id, 'dihedral', CASE WHEN {R('t')} = -180 THEN 180 ELSE {R('t')} END, 'degrees' FROM q WHERE p3x IS NOT NULL""")
def measures(spark, sf):
    a = view(spark, sf, "atoms")
    two, three, four = (transforms.measured(a, list(range(n))) for n in (2, 3, 4))
    out = r6(two.unionByName(three).unionByName(four), "value")
    return out.withColumn("value", F.when((F.col("kind") == "dihedral") & (F.col("value") == -180.0), 180.0).otherwise(F.col("value")))


@query(cte("atoms") + f""", n AS (SELECT structure_id, element AS e, count(*) AS n FROM atoms GROUP BY 1, 2), f AS (SELECT structure_id, string_agg(e || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY CASE e WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, e) AS formula FROM n GROUP BY 1)
 SELECT a.structure_id, a.structure_id || ': ' || count(*) || ' atoms | formula ' || first(formula) || ' | chains ' || string_agg(DISTINCT chain, ',' ORDER BY chain) || printf(' | size %.1fx%.1fx%.1f A', max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS summary FROM atoms a JOIN f ON a.structure_id = f.structure_id GROUP BY 1""")
def summary_lines(spark, sf):
    return reports.summary_lines(view(spark, sf, "atoms"))


@query()
def ensemble_summary(spark, sf):
    return reports.ensemble_summary(view(spark, sf, "ensemble"), align=False)


_CONCERNS = "CASE code " + " ".join(f"WHEN '{c}' THEN '{','.join(w)}'" for c, w in reports.CONCERNS.items()) + " END"


@query("WITH top AS (" + _TOPOLOGY + "), inv AS (" + ORACLES["quality_inventory"] + f"""), c AS (SELECT structure_id, 'missing_hydrogens' AS code FROM inv WHERE n_hydrogens = 0 UNION ALL SELECT structure_id, 'bad_elements' FROM inv WHERE n_blank_elements + n_unknown_elements > 0
 UNION ALL SELECT structure_id, 'missing_metadata' FROM inv WHERE n_without_atom_name = n_atoms OR n_without_resname = n_atoms OR n_without_chain = n_atoms UNION ALL SELECT structure_id, 'large_dense' FROM inv WHERE n_atoms > {quality.LARGE}
 """ + " ".join(f"UNION ALL SELECT structure_id, '{code}' FROM top WHERE {n} > 0" for code, n in reports.DEEP.items()) + f") SELECT structure_id, code, {_CONCERNS} AS workflows FROM c")
def preflight_codes(spark, sf):
    return reports.preflight(view(spark, sf, "atoms"), deep=True).withColumn("workflows", F.array_join("workflows", ","))


_LABELLED = "SELECT *, chain || ':' || resname || resid || icode AS label FROM ensemble WHERE model_id"


def _held(s, t):
    return f"SELECT DISTINCT a.structure_id, least(a.label, b.label) AS i, greatest(a.label, b.label) AS j FROM (SELECT * FROM {s} SEMI JOIN {t} USING (structure_id, label)) a JOIN (SELECT * FROM {s} SEMI JOIN {t} USING (structure_id, label)) b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx WHERE {D2} < 64"


# in this view every atom is a residue of its own
@query(cte("ensemble") + f""", p AS ({_LABELLED} = 1), q AS ({_LABELLED} = 2), m AS (SELECT a.structure_id, a.atom_idx, a.label, {D2} AS d2 FROM p a JOIN q b ON a.structure_id = b.structure_id AND a.chain = b.chain AND a.resid = b.resid AND a.icode = b.icode AND a.atom_name = b.atom_name),
 f AS (SELECT structure_id, count(*) AS n_matched, {R("sqrt(avg(d2))")} AS rmsd, {R("sqrt(max(d2))")} AS max_deviation, arg_max(label, (round(d2, 9), -atom_idx)) AS worst FROM m GROUP BY 1), cp AS ({_held("p", "q")}), cq AS ({_held("q", "p")}),
 c AS (SELECT structure_id, count(*) FILTER (s = 3) AS common, count(*) FILTER (s = 1) AS lost, count(*) FILTER (s = 2) AS gained FROM (SELECT structure_id, i, j, sum(w) AS s FROM (SELECT *, 1 AS w FROM cp UNION ALL SELECT *, 2 FROM cq) GROUP BY 1, 2, 3) GROUP BY 1),
 n AS (SELECT structure_id, n_atoms_a, n_atoms_b FROM (SELECT structure_id, count(*) AS n_atoms_a FROM p GROUP BY 1) JOIN (SELECT structure_id, count(*) AS n_atoms_b FROM q GROUP BY 1) USING (structure_id))
 SELECT structure_id, n_atoms_a, n_atoms_b, coalesce(n_matched, 0) AS n_matched, rmsd, max_deviation, worst, coalesce(common, 0) AS common, coalesce(lost, 0) AS lost, coalesce(gained, 0) AS gained FROM n LEFT JOIN f USING (structure_id) LEFT JOIN c USING (structure_id)""")
def compared_structures(spark, sf):
    e = view(spark, sf, "ensemble")
    return r6(reports.compare_structures(*(e.where(F.col("model_id") == m) for m in (1, 2))), "rmsd", "max_deviation")


def _listed(x):
    return f"CASE len({x}) WHEN 1 THEN {x}[1] WHEN 2 THEN {x}[1] || ' and ' || {x}[2] ELSE array_to_string({x}[:-2], ', ') || ', and ' || {x}[-1] END"


def _near(c):
    return f"list(label || printf(' (%.1f A)', {c}) ORDER BY chain, resid) FILTER ({c} IS NOT NULL)"


def _sentence(x, lead):
    return f"CASE WHEN len({x}) > 0 THEN '{lead}' || {_listed(x)} || '.' END"


@query("WITH k AS (" + ORACLES["pocket_chemistry"] + f"""), l AS (SELECT *, chain || ':' || resname || resid AS label FROM k), g AS (SELECT structure_id, count(*) AS n, list(label ORDER BY chain, resid) FILTER (hydrophobic) AS wall, list(label ORDER BY chain, resid) FILTER (aromatic) AS rings,
 {_near("polar_distance")} AS polar, {_near("salt_distance")} AS salt FROM l GROUP BY 1) SELECT structure_id, concat_ws(' ', n || ' residues are near the ligand.', {_sentence("wall", "Hydrophobic contacts: ")}, {_sentence("rings", "Aromatic residues nearby: ")}, {_sentence("polar", "Close polar atoms: ")}, {_sentence("salt", "Opposite charges: ")},
 CASE WHEN coalesce(len(polar), 0) + coalesce(len(salt), 0) = 0 THEN 'No polar or charged atoms are close.' END) AS text FROM g""")
def pocket_texts(spark, sf):
    """Text of the pocket of each structure's ligands."""
    return reports.pocket_text(view(spark, sf, "atoms"))
