"""Queries over files, larger structures and whole reports, added to the catalogue with the DuckDB SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.elements import AMINO_ACIDS, BACKBONE, IONS, NUCLEOTIDES, SYMBOLS, WATER, is_element
from ..operators import aggregates, chemistry, coarse, datasets, ensemble, exports, graph, presets, quality, ranking, residues, secondary, select, spatial, surface
from ..session import scratch
from ..sources import formats, writers
from .adapters import VIEWS, cte, table, view
from .catalog import _BEADS, _BONDS, ORACLES, PAIR, RUNS, D2, M, R, _in, query, r6

#: The larger structures, also under the name that shared SQL parts use.
CHAINS = f"WITH atoms AS ({VIEWS['chains'].format(lineitem='lineitem')})"
_SITE = ["structure_id", "atom_idx", "atom_name", "resname", "chain", "resid", "icode", "element", "hetero", "x", "y", "z"]


def _chains(spark, sf):
    return view(spark, sf, "chains")


def _read(df):
    return df.withColumn("structure_id", F.col("structure_id").cast("long"))


# files written and read back


@query(CHAINS + f" SELECT structure_id, atom_idx, element, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM atoms")
def xyz_files(spark, sf):
    place = scratch(spark, "xyz")
    writers.write_texts(writers.xyz_text(_chains(spark, sf)), place)
    got = formats.atoms_of(formats.written(formats.read_folders(spark, place), "xyz"))
    return r6(_read(got).select("structure_id", "atom_idx", "element", "x", "y", "z"), "x", "y", "z")


@query(cte("ensemble") + ", m AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY structure_id ORDER BY model_id) AS INT) AS seq FROM ensemble) SELECT structure_id, seq AS model_id, atom_idx, atom_name, resname, chain, resid, icode, element, hetero, "
       + ", ".join(f"{R(c)} AS {c}" for c in "xyz") + " FROM m")
def pdb_models(spark, sf):
    """Models are numbered in their order in the file."""
    got = formats.atoms_of(formats.written(writers.frames_text(view(spark, sf, "ensemble"), "pdb"), "pdb"))
    return r6(_read(got).select("structure_id", "model_id", *_SITE[1:]), "x", "y", "z")


@query(cte("ensemble") + f", m AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY structure_id ORDER BY model_id) AS INT) AS seq FROM ensemble) SELECT structure_id, seq AS model_id, count(*) AS n_atoms, {R('avg(x)')} AS cx, {R('avg(y)')} AS cy FROM m GROUP BY 1, 2")
def xyz_frames(spark, sf):
    got = _read(formats.atoms_of(formats.written(writers.frames_text(view(spark, sf, "ensemble"), "xyz"), "xyz")))
    return r6(got.groupBy("structure_id", "model_id").agg(F.count("*").alias("n_atoms"), F.avg("x").alias("cx"), F.avg("y").alias("cy")), "cx", "cy")


_ALTS = """, s AS (SELECT * EXCLUDE (atom_idx), atom_idx * 2 AS atom_idx, CASE WHEN atom_idx % 4 = 0 THEN 'A' ELSE '' END AS altloc, CASE WHEN atom_idx % 4 = 0 THEN 0.4 ELSE 1.0 END AS occ FROM atoms
  UNION ALL SELECT * EXCLUDE (atom_idx), atom_idx * 2 + 1, 'B', 0.6 FROM atoms WHERE atom_idx % 4 = 0)"""


@query(CHAINS + _ALTS + " SELECT structure_id, p AS policy, count(*) AS n, CAST(sum(atom_idx + 1) AS BIGINT) AS serials FROM s, (VALUES ('all'), ('primary'), ('first'), ('highest_occupancy')) v(p) WHERE p = 'all' OR altloc = '' OR altloc = CASE p WHEN 'highest_occupancy' THEN 'B' ELSE 'A' END GROUP BY 1, 2")
def altloc_policies(spark, sf):
    a = _chains(spark, sf)
    twice = F.when(F.col("atom_idx") % 4 == 0, F.array(F.struct(F.lit(0).alias("k"), F.lit("A").alias("altloc"), F.lit(0.4).alias("occupancy")), F.struct(F.lit(1).alias("k"), F.lit("B").alias("altloc"), F.lit(0.6).alias("occupancy"))))
    a = a.withColumn("s", F.explode(F.coalesce(twice, F.array(F.struct(F.lit(0).alias("k"), F.lit("").alias("altloc"), F.lit(1.0).alias("occupancy"))))))
    a = a.withColumn("atom_idx", F.col("atom_idx") * 2 + F.col("s.k")).select("*", "s.altloc", "s.occupancy").drop("s")
    files, out = formats.written(writers.pdb_text(a), "pdb"), None
    for policy in ("all", "primary", "first", "highest_occupancy"):
        one = formats.atoms_of(files, policy).groupBy("structure_id").agg(F.lit(policy).alias("policy"), F.count("*").alias("n"), F.sum(F.col("serial").cast("long")).alias("serials"))
        out = one if out is None else out.unionByName(one)
    return _read(out)


@query(CHAINS + _BONDS + " SELECT structure_id, 1 AS model_id, i, j, 'conect' AS source FROM bonds")
def conect_bonds(spark, sf):
    a = _chains(spark, sf)
    got = formats.bonds_of(formats.written(writers.pdb_text(a, aggregates.bonds(a, cells=True)), "pdb"))
    return _read(got).select("structure_id", "model_id", "i", "j", "source")


@query(CHAINS + " SELECT " + ", ".join(_SITE[:-3]) + ", " + ", ".join(f"{R(c)} AS {c}" for c in "xyz") + " FROM atoms")
def cif_files(spark, sf):
    place = scratch(spark, "cif")
    writers.write_texts(writers.cif_text(_chains(spark, sf)), place)
    got = formats.atoms_of(formats.written(formats.read_folders(spark, place), "cif"))
    return r6(_read(got).select(*_SITE), "x", "y", "z")


@query(cte("atoms") + f" SELECT structure_id, atom_idx, element, CAST(atom_idx % 3 - 1 AS INT) AS formal_charge, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM atoms")
def sdf_atoms(spark, sf):
    a = view(spark, sf, "atoms").withColumn("formal_charge", F.col("atom_idx") % 3 - 1)
    got = formats.atoms_of(formats.written(writers.sdf_text(a, _ordered(a)), "sdf"))
    return r6(_read(got).select("structure_id", "atom_idx", "element", "formal_charge", "x", "y", "z"), "x", "y", "z")


_ORDER = "CASE (i + j) % 4 WHEN 0 THEN 1.5 ELSE (i + j) % 4 END"


def _ordered(a):
    return aggregates.bonds(a).withColumn("bond_order", F.expr(_ORDER).cast("double"))


@query(cte("atoms") + _BONDS + f" SELECT structure_id, i, j, CAST({_ORDER} AS DOUBLE) AS bond_order, 'sdf' AS source FROM bonds")
def sdf_bonds(spark, sf):
    a = view(spark, sf, "atoms")
    got = formats.bonds_of(formats.written(writers.sdf_text(a, _ordered(a)), "sdf"))
    return _read(got).select("structure_id", "i", "j", "bond_order", "source")


@query(cte("atoms") + """, p AS (SELECT structure_id, count(*) AS n, count(*) FILTER (element <> 'H') AS heavy, max(x) FILTER (atom_idx = 0) AS x0 FROM atoms GROUP BY 1)
 SELECT structure_id % 97 AS library, CAST(row_number() OVER (PARTITION BY structure_id % 97 ORDER BY structure_id) AS INT) AS pose_id, CAST(structure_id AS VARCHAR) AS name, CAST(n AS INT) AS n_atoms, CAST(heavy AS INT) AS n_heavy, CAST(CAST(x0 AS INT) * 3 AS DOUBLE) AS score, 'of ' || structure_id AS remark FROM p""")
def pose_files(spark, sf):
    """Records of many molecules in one file each, with data fields of one line and a number."""
    a = view(spark, sf, "atoms")
    first = a.where("atom_idx = 0").select("structure_id", (F.col("x").cast("int") * 3).alias("score"))
    t = writers.sdf_text(a, aggregates.bonds(a).withColumn("bond_order", F.lit(1.0))).join(first, "structure_id")
    fields = F.concat(F.lit("> <score>\n"), F.col("score").cast("string"), F.lit("\n\n> <remark> (1)\nof "), F.col("structure_id").cast("string"), F.lit("\n\n"))
    t = t.withColumn("block", F.concat(F.regexp_replace("text", r"\$\$\$\$\s*$", ""), fields)).withColumn("library", F.col("structure_id") % 97)
    got = formats.poses_of(formats.written(writers.poses_text(t, ["structure_id"], ["library"]), "sdf", "library"))
    score = scalars.number(F.element_at("properties", "score"))
    return got.where("parse_error is null").select(F.col("source").cast("long").alias("library"), "pose_id", "name", "n_atoms", "n_heavy", score.alias("score"), F.element_at("properties", "remark").alias("remark"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' "' || p_brand || '", x' AS name, CAST(p_size AS VARCHAR) AS size, CAST(p_size AS DOUBLE) * 2 AS twice FROM part""")
def table_files(spark, sf):
    place = scratch(spark, "table") + ".tsv"
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x')).alias("name"), F.col("p_size").cast("string").alias("size"))
    writers.write_csv(p, place, "\t")
    return formats.read_table(spark, place).withColumn("twice", F.col("size").try_cast("double") * 2)


@query("SELECT split, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (" + ORACLES["hash_split"] + ") h GROUP BY 1")
def split_files(spark, sf):
    from .catalog import QUERIES

    place = scratch(spark, "splits")
    writers.write_splits(QUERIES["hash_split"](spark, sf), place)
    return spark.read.parquet(place).groupBy(F.col("split").cast("string").alias("split")).agg(F.count("*").alias("n"), F.sum(F.col("p_partkey").cast("long")).alias("keys"))


def _chain_beads(spark, sf):
    m = coarse.members(_chains(spark, sf), "backbone_sidechain")
    return coarse.beads(m), m


@query(CHAINS + _BEADS + " SELECT structure_id, CAST(bead_idx AS BIGINT) AS bead_idx, bead_name, n_atoms, CAST(f AS BIGINT) AS first_atom FROM beads")
def mapping_files(spark, sf):
    b, m = _chain_beads(spark, sf)
    kind = "struct<format:string,version:int,beads:array<struct<bead_idx:bigint,bead_name:string,atoms:array<bigint>>>>"
    got = writers.mapping_json(b, m).select("structure_id", F.explode(F.from_json("json", kind)["beads"]).alias("b"))
    return got.select("structure_id", "b.bead_idx", "b.bead_name", F.size("b.atoms").cast("long").alias("n_atoms"), F.array_min("b.atoms").alias("first_atom"))


@query(CHAINS + """, c AS (SELECT structure_id, chain, atom_idx, row_number() OVER (PARTITION BY structure_id, chain ORDER BY atom_idx) - 1 AS k FROM atoms),
 l AS (SELECT structure_id, chain, k // 15 AS line, string_agg(CAST(atom_idx + 1 AS VARCHAR), ' ' ORDER BY k) AS t FROM c GROUP BY 1, 2, 3)
 , g AS (SELECT structure_id, chain, '[ chain_' || chain || ' ]' || chr(10) || string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY 1, 2) SELECT structure_id, md5(string_agg(t, chr(10) ORDER BY chain) || chr(10)) AS digest FROM g GROUP BY 1""")
def index_files(spark, sf):
    g = _chains(spark, sf).groupBy("structure_id", "chain").agg(F.sort_array(F.collect_list("atom_idx")).alias("atoms"))
    g = g.select("structure_id", F.concat(F.lit("chain_"), "chain").alias("group_name"), F.ascii("chain").alias("bead_idx"), "atoms")
    return writers.index_text(g).select("structure_id", F.md5("text").alias("digest"))


@query(CHAINS + _BEADS + """, res AS (SELECT structure_id, residue_idx, any_value(resid) AS resid, any_value(resname) AS resname FROM runs GROUP BY 1, 2),
 w AS (SELECT structure_id, bead_idx AS i, lead(bead_idx) OVER o AS j, residue_idx, lead(residue_idx) OVER o AS nr FROM beads WINDOW o AS (PARTITION BY structure_id ORDER BY bead_idx)),
 h AS (SELECT structure_id, residue_idx, min(bead_idx) AS i, first(chain) AS chain FROM beads GROUP BY 1, 2), v AS (SELECT structure_id, i, lead(i) OVER o AS j, chain, lead(chain) OVER o AS nc FROM h WINDOW o AS (PARTITION BY structure_id ORDER BY residue_idx)),
 e AS (SELECT structure_id, i, j FROM w WHERE nr = residue_idx UNION ALL SELECT structure_id, i, j FROM v WHERE nc = chain),
 u AS (SELECT structure_id, i AS mid, j AS x FROM e UNION ALL SELECT structure_id, j, i FROM e),
 lines AS (SELECT structure_id, 0 AS p, 0 AS a, 0 AS b, 0 AS c, '[ atoms ]' AS t FROM h GROUP BY 1 UNION ALL SELECT structure_id, 2, 0, 0, 0, '[ bonds ]' FROM h GROUP BY 1 UNION ALL SELECT structure_id, 4, 0, 0, 0, '[ angles ]' FROM h GROUP BY 1
  UNION ALL SELECT b.structure_id, 1, bead_idx, bead_idx, bead_idx, concat_ws(' ', bead_idx + 1, bead_name, resid, resname, bead_name, bead_idx + 1, '0.0') FROM beads b JOIN res USING (structure_id, residue_idx)
  UNION ALL SELECT structure_id, 3, i, j, j, concat_ws(' ', i + 1, j + 1, 1) FROM e UNION ALL SELECT s.structure_id, 5, s.mid, s.x, t.x, concat_ws(' ', s.x + 1, s.mid + 1, t.x + 1, 2) FROM u s JOIN u t ON s.structure_id = t.structure_id AND s.mid = t.mid AND s.x < t.x)
 SELECT structure_id, count(*) AS n_lines, md5(string_agg(t, chr(10) ORDER BY p, a, b, c) || chr(10)) AS digest FROM lines GROUP BY 1""")
def topology_files(spark, sf):
    b, _ = _chain_beads(spark, sf)
    bonds = coarse.bead_bonds(b)
    t = writers.topology_text(b, bonds, coarse.bead_angles(bonds))
    return t.select("structure_id", (F.size(F.split("text", "\n")) - 1).cast("long").alias("n_lines"), F.md5("text").alias("digest"))


@query("SELECT s_suppkey AS structure_id, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS n_findings FROM supplier")
def cif_checks(spark, sf):
    """Texts that are whole, lack a column, are cut short, or have a coordinate that is no number and no data block."""
    head = "loop_\n_atom_site.type_symbol\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n"
    whole, cut = F.lit(head + "_atom_site.Cartn_z\nC 1 2 3\n"), F.lit(head + "_atom_site.Cartn_z\nC 1 2 3 C 1\n")
    k = F.col("s_suppkey") % 4
    body = F.when(k == 0, whole).when(k == 1, F.lit(head + "C 1 2\n")).when(k == 2, cut).otherwise(F.lit(head + "_atom_site.Cartn_z\nC 1 2 3 C x 2 3\n"))
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("structure_id"), F.concat(F.when(k == 3, F.lit("")).otherwise(F.lit("data_x\n")), body).alias("text"), k.alias("k"))

    def run(batches):
        for b in batches:
            found = [formats.cif_findings(x, False) for x in b["text"]]
            yield b.assign(n_findings=[len({f.split(":")[-2 if "row" in f else -1] for f in x}) for x in found])[["structure_id", "n_findings"]]

    return t.mapInPandas(run, "structure_id long, n_findings int").select("structure_id", "n_findings")


# selections and residues of larger structures


@query(CHAINS + f" SELECT structure_id, atom_idx, atom_name FROM atoms WHERE atom_name IN {_in(BACKBONE)}")
def backbone_atoms(spark, sf):
    return select.backbone(_chains(spark, sf)).select("structure_id", "atom_idx", "atom_name")


@query(CHAINS + " SELECT structure_id, atom_idx, resname FROM atoms WHERE atom_name = 'CA' AND NOT hetero")
def alpha_carbons(spark, sf):
    return select.alpha_carbons(_chains(spark, sf), exclude_hetero=True).select("structure_id", "atom_idx", "resname")


@query(CHAINS + " SELECT structure_id, atom_idx, resid, icode, resname, chain FROM atoms WHERE (chain = 'A' AND resid = 4 AND icode = 'A') OR (resid BETWEEN 55 AND 55 AND resname = 'GLY') OR (chain = 'B' AND resid = 60)")
def residue_choices(spark, sf):
    a = _chains(spark, sf)
    got = a.where(select.residue_condition([("A", 4, "A", None), (None, 55, None, "gly"), {"chain": "B", "resid": 60}]))
    return got.select("structure_id", "atom_idx", "resid", "icode", "resname", "chain")


@query(CHAINS + _BONDS + """, p AS (SELECT * FROM (VALUES (0, 7), (1, 2), (2, 0), (3, 8), (4, 5)) v(ni, o)),
 n AS (SELECT structure_id, i, j FROM bonds) SELECT structure_id, 'atom' AS kind, ni AS a, o AS b FROM atoms JOIN p ON atom_idx = o
 UNION ALL SELECT structure_id, 'bond', least(s.ni, t.ni), greatest(s.ni, t.ni) FROM n JOIN p s ON s.o = i JOIN p t ON t.o = j""")
def taken_atoms(spark, sf):
    a, picks = _chains(spark, sf), [7, 2, 0, 8, 5]
    kept = a.join(spark.createDataFrame(list(enumerate(picks)), "new_idx int, atom_idx int"), "atom_idx")
    got = select.take(a.withColumn("old", F.col("atom_idx")), picks).select("structure_id", F.lit("atom").alias("kind"), F.col("atom_idx").alias("a"), F.col("old").alias("b"))
    bonds = select.subset_bonds(aggregates.bonds(a, cells=True), kept)
    return got.unionByName(bonds.select("structure_id", F.lit("bond").alias("kind"), F.col("i").alias("a"), F.col("j").alias("b")))


@query(CHAINS + " SELECT structure_id, chain, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY min(atom_idx)) - 1 AS INT) AS position FROM atoms GROUP BY 1, 2")
def chain_order(spark, sf):
    return residues.chains(_chains(spark, sf))


@query(CHAINS + RUNS + " SELECT structure_id, residue_idx, first(chain) AS chain, first(resid) AS resid, first(icode) AS icode, first(resname) AS resname, min(atom_idx) AS first_atom, count(*) AS n_atoms FROM runs GROUP BY 1, 2")
def residue_runs_large(spark, sf):
    return residues.residues(_chains(spark, sf))


_HET = f"hetero AND resname NOT IN {_in((*WATER, *IONS))}"


@query(CHAINS + RUNS + f""", k AS (SELECT structure_id, residue_idx, first(resname) AS resname FROM runs WHERE {_HET} GROUP BY 1, 2)
 SELECT structure_id, count(*) AS n_ligands, CASE WHEN count(*) = 1 THEN min(resname) END AS resname FROM k GROUP BY 1""")
def ligand_choice(spark, sf):
    return residues.unique_ligand(_chains(spark, sf))


@query(CHAINS + f""", s AS (SELECT DISTINCT a.structure_id, a.chain, a.resid, a.icode, a.resname FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id WHERE NOT a.hetero AND b.resname = 'LIG' AND b.hetero AND {D2} < 25)
 SELECT a.structure_id, a.atom_idx, a.resname FROM atoms a JOIN s ON a.structure_id = s.structure_id AND a.chain = s.chain AND a.resid = s.resid AND a.icode = s.icode AND a.resname = s.resname WHERE NOT a.hetero""")
def pocket_atoms(spark, sf):
    a = _chains(spark, sf)
    return residues.site_atoms(a, residues.binding_site(a, "LIG", 5.0)).select("structure_id", "atom_idx", "resname")


@query(CHAINS + f" SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {R(D2)} AS d2 {PAIR} WHERE {D2} < 36")
def contact_pairs_large(spark, sf):
    return r6(spatial.pairs(_chains(spark, sf), 6.0, cells=True), "d2")


# secondary structure, surfaces, ensembles

_CODES = CHAINS + RUNS + """, codes AS (SELECT structure_id, residue_idx AS r, first(chain) AS chain, first(resid) AS resid, first(icode) AS icode, first(resname) AS resname, substr('GIHEBTS-', CAST((residue_idx * 5 + structure_id) % 8 AS INT) + 1, 1) AS code FROM runs GROUP BY 1, 2)"""


def _codes(spark, sf):
    r = residues.residues(_chains(spark, sf))
    at = ((F.col("residue_idx") * 5 + F.col("structure_id")) % 8 + 1).cast("int")
    return r.select("structure_id", F.col("residue_idx").alias("r"), "chain", "resid", "icode", "resname", F.substring(F.lit("GIHEBTS-"), at, F.lit(1)).alias("code"))


_SHARES = "count(*) AS n, count(*) FILTER (code IN ('H', 'G', 'I')) AS helix, count(*) FILTER (code IN ('E', 'B')) AS strand, count(*) FILTER (code IN ('T', 'S', '-')) AS coil"


@query(_CODES + f", t AS (SELECT structure_id, NULL AS chain, {_SHARES} FROM codes GROUP BY 1 UNION ALL SELECT structure_id, chain, {_SHARES} FROM codes GROUP BY 1, 2) SELECT *, " + ", ".join(f"{R(f'{k} / n')} AS {k}_share" for k in ("helix", "strand", "coil")) + " FROM t")
def structure_shares(spark, sf):
    return r6(secondary.summary(_codes(spark, sf)), "helix_share", "strand_share", "coil_share")


@query(_CODES + " SELECT structure_id, atom_idx, coalesce(code, '-') AS code, translate(coalesce(code, '-'), 'GIHEBTS-', 'HHHEE---') AS simple FROM atoms LEFT JOIN codes USING (structure_id, chain, resid, icode, resname)")
def atom_codes(spark, sf):
    got = secondary.per_atom(_chains(spark, sf), _codes(spark, sf))
    return got.select("structure_id", "atom_idx", "code", scalars.simplified_structure(F.col("code")).alias("simple"))


@query("WITH s AS (" + ORACLES["solvent_surface"].replace(R("sasa"), "sasa") + f") SELECT structure_id, {R('sum(sasa)').replace('6', '4')} AS total, {R('avg(sasa)').replace('6', '4')} AS mean, {R('max(sasa)').replace('6', '4')} AS max FROM s GROUP BY 1")
def surface_totals(spark, sf):
    s = surface.surface_summary(surface.residue_surface(view(spark, sf, "atoms"), n_points=48))
    return s.select("structure_id", *(F.round(c, 4).alias(c) for c in ("total", "mean", "max")))


@query(cte("ensemble") + " SELECT structure_id, atom_idx, " + ", ".join(f"{R(f'avg({c})')} AS {c}" for c in "xyz") + " FROM ensemble GROUP BY 1, 2")
def mean_places(spark, sf):
    return r6(ensemble.average(view(spark, sf, "ensemble"), align=False), "x", "y", "z")


# coarse graining by lists and tables


@query(CHAINS + f", w AS (SELECT *, {M} AS m FROM atoms), l AS (SELECT * FROM (VALUES (0, 'X', 0), (0, 'X', 1), (0, 'X', 7), (1, 'Y', 7), (1, 'Y', 3)) v(bead_idx, bead_name, atom_idx)) SELECT structure_id, bead_idx, bead_name, count(*) AS n_atoms, " + ", ".join(f"{R(f'sum(m * {c}) / sum(m)')} AS {c}" for c in "xyz") + " FROM w JOIN l USING (atom_idx) GROUP BY 1, 2, 3")
def index_beads(spark, sf):
    lists = spark.createDataFrame([(0, "X", [0, 1, 7]), (1, "Y", [7, 3])], "bead_idx int, bead_name string, atoms array<int>")
    return r6(coarse.index_beads(_chains(spark, sf), lists), "x", "y", "z")


@query(CHAINS + RUNS + f""", t AS (SELECT *, {M} AS m, CASE WHEN resname <> 'ALA' THEN resname WHEN atom_name IN ('N', 'CA') THEN 'P' WHEN atom_name = 'CB' THEN 'Q' END AS bead_name FROM runs)
 SELECT structure_id, residue_idx, bead_name, count(*) AS n_atoms, {", ".join(f"{R(f'sum(m * {c}) / sum(m)')} AS {c}" for c in "xyz")} FROM t WHERE bead_name IS NOT NULL GROUP BY 1, 2, 3""")
def table_beads(spark, sf):
    mapping = spark.createDataFrame([("ala", "n", "P"), ("ALA", "CA", "P"), ("ALA", "CB", "Q")], "resname string, atom_name string, bead_name string")
    return r6(coarse.beads(coarse.members(_chains(spark, sf), mapping)).select("structure_id", "residue_idx", "bead_name", "n_atoms", "x", "y", "z"), "x", "y", "z")


# features and datasets


@query(CHAINS + f" SELECT structure_id, count(*) FILTER (element = 'C') AS count_C, count(*) FILTER (element = 'N') AS count_N, count(*) FILTER (element = 'ZZ') AS missing, {R(f'sum({M})')} AS total_mass FROM atoms GROUP BY 1")
def feature_vectors(spark, sf):
    """The vector's places, named again."""
    a = _chains(spark, sf)
    df = aggregates.element_counts(a).join(aggregates.geometry(a).select("structure_id", "total_mass"), "structure_id")
    v = presets.vectors(df, ["count_C", "count_N", "not_there", "total_mass"])
    names = ("count_C", "count_N", "missing")
    return v.select("structure_id", *(F.get("features", k).cast("long").alias(n) for k, n in enumerate(names)), F.round(F.get("features", 3), 6).alias("total_mass"))


@query("SELECT * FROM (VALUES ('graph', 'edge', 'basic', 2, 'distance,bond_order'), ('graph', 'edge', 'default', 1, 'distance'), ('graph', 'edge', 'geom', 5, 'distance,bond_order,aromatic,bond_angle,dihedral'), ('graph', 'edge', 'ml', 3, 'distance,bond_order,aromatic'), ('graph', 'residue edge', 'default', 1, 'distance'), ('graph', 'residue edge', 'ml', 4, 'distance,contact_ca,contact_com,contact_min'), ('graph', 'residue node', 'default', 1, 'residue_size'), "
       f"('graph', 'residue node', 'ml', {len(AMINO_ACIDS) + 2}, '{','.join(f'residue_{a}' for a in (*AMINO_ACIDS, 'UNK'))},residue_size'), ('graph', 'node', 'default', 2, 'atomic_number,mass'), ('graph', 'node', 'basic', 3, 'atomic_number,mass,formal_charge')) v(category, kind, name, n_features, features)")
def preset_list(spark, sf):
    got = presets.catalogue(spark, "graph").where("not (kind = 'node' and name = 'ml')")
    return got.withColumn("features", F.array_join("features", ","))


@query(CHAINS + f" SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, {R(f'sqrt({D2})')} AS distance, 1.0::DOUBLE AS contact_ca, 0.0::DOUBLE AS contact_com, 0.0::DOUBLE AS contact_min {PAIR} WHERE {D2} < 16")
def contact_edge_features(spark, sf):
    return r6(presets.residue_edge_features(spatial.pairs(_chains(spark, sf), 4.0, cells=True), "ca", "ml"), "distance")


@query(cte("atoms") + _BONDS + f""", n AS (SELECT structure_id, count(*) AS n, avg({M}) AS mass FROM atoms GROUP BY 1), e AS (SELECT structure_id, count(*) AS e FROM bonds GROUP BY 1)
 SELECT n.structure_id, n + 1 AS n_nodes, coalesce(e, 0) + n * 3 AS n_edges, {R('mass')} AS hub_mass FROM n LEFT JOIN e USING (structure_id)""")
def loops_and_hub(spark, sf):
    """Self loops of all atoms, then a node joined both ways to every other."""
    a = view(spark, sf, "atoms")
    edges = graph.with_self_loops(aggregates.bonds(a).select("structure_id", "i", "j"), a)
    nodes, edges = graph.with_global_node(graph.node_features(a).select("structure_id", "atom_idx", "mass"), edges, ["mass"])
    g = nodes.groupBy("structure_id").agg(F.count("*").alias("n_nodes"), F.round(F.max_by("mass", "atom_idx"), 6).alias("hub_mass"))
    return g.join(edges.groupBy("structure_id").agg(F.count("*").alias("n_edges")), "structure_id")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS structure_id, CASE WHEN l.quality = 1 THEN 'good' ELSE CAST(l.quality AS VARCHAR) END AS label_text, CASE WHEN l.quality = 0 THEN 0.0::DOUBLE END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def labelled_graphs(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("structure_id"))
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise(F.col("quality").cast("string")).alias("y"))
    return datasets.labelled(ids, labels, "doc_id", "y")


@query("WITH s AS (SELECT p_size, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM part) SELECT 'p_size' AS feature, " + R("avg(p_size)") + " AS mean, " + R("stddev_pop(p_size)") + " AS std FROM s WHERE split = 'train'")
def target_scaling(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"))
    got = datasets.target_scaler(p, "p_size")
    return r6(got.select("feature", "mean", "std"), "mean", "std")


@query("""SELECT '{"command":"parts","source":"part","warnings":["w"],"result":{"p_partkey":' || p_partkey || ',"half":' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '0.5' END || '}}' AS json FROM part""")
def result_envelopes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.lit(float("nan"))).otherwise(0.5).alias("half"))
    return datasets.envelope(p, "parts", "part", ["w"])


_LABEL = "CASE WHEN p_size % 3 = 0 THEN '' ELSE 'A:' END || substr(p_brand, 1, 3) || p_size || CASE WHEN p_size % 2 = 0 THEN 'B' ELSE '' END"


@query(f"""SELECT p_partkey, {_LABEL} AS label, CASE p_size % 9 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 5 THEN -1 WHEN 6 THEN -2 WHEN 7 THEN -3 ELSE 0 END AS charge, CASE WHEN p_size % 5 = 4 THEN 1.5 ELSE p_size % 5 END::DOUBLE AS bond_order,
 p_brand AS tag, 'x.' || p_partkey AS stem, '.sdf' AS extension, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS number, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS cif, CASE WHEN p_size % 2 = 0 AND 7.0 > p_size % 14 THEN -1 WHEN p_size % 2 = 1 AND 7.0 < p_size % 14 THEN 1 ELSE 0 END AS acid_base,
 'lig' || p_partkey AS ligand, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a and b' ELSE 'a, b, and c' END AS listed, CASE WHEN p_size % 2 = 0 THEN '''' || p_brand || '''' ELSE 'x' END AS token FROM part""")
def text_rules(spark, sf):
    """Labels, codes, tags and names of the file formats and reports."""
    p, s = table(spark, sf, "part"), F.col("p_size")
    return p.select(
        "p_partkey", scalars.residue_label(F.when(s % 3 == 0, "").otherwise("A"), F.substring("p_brand", 1, 3), s.cast("int"), F.when(s % 2 == 0, "B").otherwise("")).alias("label"), scalars.sdf_charge((s % 9).cast("int")).alias("charge"),
        scalars.sdf_bond_order((s % 5).cast("int")).alias("bond_order"), scalars.sdf_tag(F.concat(F.lit("> 12 <"), "p_brand", F.lit("> (1)"))).alias("tag"), scalars.stem(F.concat(F.lit("/a/b.c/x."), F.col("p_partkey").cast("string"), F.lit(".sdf.GZ"))).alias("stem"),
        scalars.extension(F.lit("/a/b.c/x.SDF.gz")).alias("extension"), scalars.number(F.when(s % 2 == 0, s.cast("string")).when(s % 3 == 0, "NaN").otherwise("1..2")).alias("number"), scalars.cif_value(F.when(s % 3 == 0, F.col("p_brand")).when(s % 3 == 1, ".").otherwise("?")).alias("cif"),
        scalars.acid_base_charge(F.when(s % 2 == 0, "acid").otherwise("base"), (s % 14).cast("double"), F.lit(7.0)).alias("acid_base"), scalars.ligand_key(F.concat(F.lit("lig"), F.col("p_partkey").cast("string"), F.lit("_POSE12"))).alias("ligand"),
        scalars.listed(F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, (s % 4).cast("int"))).alias("listed"), scalars.cif_token(F.when(s % 2 == 0, F.col("p_brand")).otherwise("x")).alias("token"),
    )


# quality of dirty structures

_DIRTY = """, d AS (SELECT * EXCLUDE (element, chain), CASE WHEN atom_idx % 11 = 0 THEN ' ' WHEN atom_idx % 13 = 0 THEN 'Qq' WHEN atom_idx % 17 = 0 THEN 'd' ELSE element END AS element, CASE WHEN structure_id % 3 = 0 THEN '' ELSE chain END AS chain,
  CASE WHEN atom_idx % 7 = 0 THEN 'B' ELSE '' END AS altloc, CASE WHEN atom_idx % 5 = 0 THEN 0.5 ELSE 1.0 END AS occupancy, 1 + atom_idx // 300 AS model_id FROM atoms)"""
_KNOWN = f"upper(trim(element)) IN {_in((*SYMBOLS, 'D', 'T'))}"


def _dirty(spark, sf):
    k = F.col("atom_idx")
    a = _chains(spark, sf).withColumns({"element": F.when(k % 11 == 0, " ").when(k % 13 == 0, "Qq").when(k % 17 == 0, "d").otherwise(F.col("element")), "chain": F.when(F.col("structure_id") % 3 == 0, "").otherwise(F.col("chain"))})
    return a.withColumns({"altloc": F.when(k % 7 == 0, "B").otherwise(""), "occupancy": F.when(k % 5 == 0, 0.5).otherwise(1.0), "model_id": (1 + F.floor(k / 300)).cast("int")})


_INVENTORY = CHAINS + _DIRTY + RUNS.replace("FROM atoms", "FROM d") + f""", k AS (SELECT structure_id, residue_idx, first(resname) AS resname, bool_or(hetero) AS het FROM runs GROUP BY 1, 2),
 c AS (SELECT structure_id, count(*) AS n_residues, count(*) FILTER (resname IN {_in(WATER)}) AS n_waters, count(*) FILTER (resname IN {_in(IONS)} AND het) AS n_ions, count(*) FILTER (het AND resname NOT IN {_in((*WATER, *IONS))}) AS n_ligands FROM k GROUP BY 1),
 t AS (SELECT structure_id, count(*) AS n_atoms, count(*) FILTER (trim(element) = '') AS n_blank_elements, count(*) FILTER (trim(element) <> '' AND NOT {_KNOWN}) AS n_unknown_elements, count(*) FILTER (upper(trim(element)) IN ('H', 'D')) AS n_hydrogens,
  count(*) FILTER (atom_name = '') AS n_without_atom_name, count(*) FILTER (resname = '') AS n_without_resname, count(*) FILTER (chain = '') AS n_without_chain, count(*) FILTER (altloc <> '') AS n_altlocs, count(*) FILTER (occupancy < 1) AS n_low_occupancy, count(DISTINCT model_id) AS n_models FROM d GROUP BY 1),
 inv AS (SELECT * FROM c JOIN t USING (structure_id))"""


@query(_INVENTORY + " SELECT * FROM inv")
def dirty_inventory(spark, sf):
    return quality.inventory(_dirty(spark, sf))


_RULES = {
    "missing_metadata": "n_without_atom_name = n_atoms OR n_without_resname = n_atoms OR n_without_chain = n_atoms", "missing_hydrogens": "n_hydrogens = 0", "bad_elements": "n_blank_elements + n_unknown_elements > 0", "altlocs": "n_altlocs > 0",
    "low_occupancy": "n_low_occupancy > 0", "multiple_models": "n_models > 1", "inferred_bonds": "structure_id % 2 = 0", "large_dense": "n_atoms > 10000",
}


@query(_INVENTORY + " " + " UNION ALL ".join(f"SELECT structure_id, '{c}' AS code FROM inv WHERE {r}" for c, r in _RULES.items()))
def dirty_findings(spark, sf):
    inv = quality.inventory(_dirty(spark, sf)).withColumn("n_explicit_bonds", (F.col("structure_id") % 2).cast("long"))
    return quality.findings(inv)


@query(CHAINS + _DIRTY + f" SELECT structure_id, atom_idx, {_KNOWN} AS known FROM d")
def known_elements(spark, sf):
    return _dirty(spark, sf).select("structure_id", "atom_idx", is_element("element").alias("known"))


@query("WITH t AS (" + CHAINS + RUNS + f""", k AS (SELECT structure_id, residue_idx, first(resname) AS resname, first(chain) AS chain, first(resid) AS resid, count(DISTINCT atom_name) FILTER (atom_name IN ('N', 'CA', 'C', 'O')) AS bb,
 max(x) FILTER (atom_name = 'CA') AS x, max(y) FILTER (atom_name = 'CA') AS y, max(z) FILTER (atom_name = 'CA') AS z FROM runs GROUP BY 1, 2), q AS (SELECT * FROM k WHERE resname IN {_in((*AMINO_ACIDS, *NUCLEOTIDES))} AND x IS NOT NULL),
 l AS (SELECT structure_id, resid - lag(resid) OVER w AS step, (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2 AS d2 FROM q WINDOW w AS (PARTITION BY structure_id, chain ORDER BY residue_idx))
 SELECT structure_id, bool_or(step = 1 AND d2 > 20.25) AS broken, bool_or(step > 1) AS gaps FROM l GROUP BY 1) SELECT structure_id, coalesce(broken, false) AS broken, coalesce(gaps, false) AS gaps, NOT coalesce(broken, false) AS ready FROM t""")
def structure_readiness(spark, sf):
    """Amino acids with all their backbone: only breaks block."""
    got = quality.readiness(quality.topology(_chains(spark, sf).where("resname <> 'LIG'")))
    return got.select("structure_id", F.array_contains("blockers", "breaks").alias("broken"), F.array_contains("warnings", "gaps").alias("gaps"), "ready")


# axes, exports, labels, splits

_LATTICE = [[40.0, 0.0, 0.0], [6.0, 30.0, 0.0], [4.0, 5.0, 25.0]]


def _images():
    """The squared minimum-image distance in the lattice, as SQL."""
    import numpy as np

    inv = np.linalg.inv(np.array(_LATTICE))
    d = [f"(a.{c} - b.{c})" for c in "xyz"]
    frac = ["(" + " + ".join(f"{d[i]} * {float(inv[i][j])!r}::DOUBLE" for i in range(3)) + ")" for j in range(3)]
    off = [f"({f} - round_even({f}, 0))" for f in frac]
    parts = ["(" + " + ".join(f"{off[i]} * {_LATTICE[i][j]!r}::DOUBLE" for i in range(3)) + ")" for j in range(3)]
    return " + ".join(f"{p} * {p}" for p in parts)


@query(cte("atoms") + f" SELECT a.structure_id, count(*) AS n_contacts FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx WHERE {_images()} < 49 GROUP BY 1")
def triclinic_contacts(spark, sf):
    return spatial.pairs(view(spark, sf, "atoms"), 7.0, lattice=_LATTICE).groupBy("structure_id").agg(F.count("*").alias("n_contacts"))


@query(CHAINS + _BEADS + ", res AS (SELECT structure_id, residue_idx, any_value(resid) AS resid, any_value(resname) AS resname, any_value(icode) AS icode FROM runs GROUP BY 1, 2) SELECT structure_id, bead_idx, bead_name || ' (' || resid || icode || ' ' || resname || ' ' || chain || ')' AS label FROM beads JOIN res USING (structure_id, residue_idx)")
def bead_labels(spark, sf):
    b, _ = _chain_beads(spark, sf)
    return coarse.labels(b).select("structure_id", "bead_idx", "label")


@query("SELECT structure_id, i, j, " + ", ".join(f"CASE label WHEN '{x}' THEN 1.0::DOUBLE ELSE 0.0 END AS interaction_{x}" for x in exports.INTERACTIONS) + " FROM (" + ORACLES["residue_interactions"] + ") e")
def interaction_columns(spark, sf):
    from .catalog import QUERIES

    return exports.interaction_one_hot(QUERIES["residue_interactions"](spark, sf))


@query("SELECT structure_id, bool_or(frequency NOT IN (0.0, 1.0)) AS is_frequency FROM (" + ORACLES["contact_frequency"] + ") f GROUP BY 1")
def frequency_maps(spark, sf):
    from .catalog import QUERIES

    return residues.is_frequency(QUERIES["contact_frequency"](spark, sf), "frequency")


@query(cte("atoms") + _BONDS + f""", n AS (SELECT structure_id, count(*) AS n_nodes, {R(f"sum({M} * (atom_idx + 1))")} AS weighted FROM atoms GROUP BY 1), e AS (SELECT structure_id, 2 * count(*) AS n_edges, {R("2 * sum(sqrt(d2))")} AS length, CAST(sum(i * 7 + j * 7) AS BIGINT) AS ends FROM bonds GROUP BY 1)
 SELECT n.structure_id, n_nodes, weighted, coalesce(n_edges, 0) AS n_edges, coalesce(length, 0.0) AS length, coalesce(ends, 0) AS ends FROM n LEFT JOIN e USING (structure_id)""")
def graph_array_sums(spark, sf):
    """Sums over the arrays that tell order and ends apart."""
    a = view(spark, sf, "atoms")
    edges = aggregates.bonds(a).select("structure_id", "i", "j", F.sqrt("d2").alias("distance"))
    g = exports.graph_arrays(graph.node_features(a), edges, ["mass"], ["distance"])
    weighted = F.aggregate(F.transform("x", lambda f, k: f[0] * (k + 1)), F.lit(0.0), lambda s, v: s + v)
    length = F.aggregate(F.transform("edge_attr", lambda f: f[0]), F.lit(0.0), lambda s, v: s + v)
    ends = F.aggregate(F.arrays_zip(F.get("edge_index", 0).alias("a"), F.get("edge_index", 1).alias("b")), F.lit(0).cast("long"), lambda s, v: s + v["a"] * 5 + v["b"] * 2)
    return g.select("structure_id", F.size("x").cast("long").alias("n_nodes"), F.round(weighted, 6).alias("weighted"), F.size("edge_attr").cast("long").alias("n_edges"), F.round(length, 6).alias("length"), ends.alias("ends"))


@query("SELECT p_partkey, CASE WHEN k <= t THEN 'test' WHEN k <= 2 * t THEN 'validation' ELSE 'train' END AS split FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('5:' || p_partkey), p_partkey) AS k, round_even(count(*) OVER () * 0.1::DOUBLE, 0) AS t FROM part) x")
def exact_split(spark, sf):
    return ranking.exact_split(table(spark, sf, "part").select("p_partkey"), "p_partkey", 0.1, 0.1, 5)


@query(cte("atoms") + " SELECT structure_id, CAST(sum(atom_idx % 3 - 1) AS BIGINT) AS net_charge, 'as-read' AS origin FROM atoms GROUP BY 1")
def net_charges(spark, sf):
    return chemistry.net_charge(view(spark, sf, "atoms").withColumn("formal_charge", F.col("atom_idx") % 3 - 1))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <= 30 AND (p_partkey % 7 = 0 OR p_retailprice <= 1500)")
def property_filters(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").withColumn("logp", F.when(F.col("p_partkey") % 7 == 0, float("nan")).otherwise(F.col("p_retailprice").cast("double")))
    return chemistry.property_filter(p, {"p_size": 30, "logp": 1500.0}).drop("logp")


@query(cte("ensemble") + ", m AS (SELECT DISTINCT structure_id, model_id FROM ensemble) SELECT structure_id, CAST(row_number() OVER (PARTITION BY structure_id ORDER BY model_id % 3, model_id) - 1 AS INT) AS position, model_id FROM m")
def cluster_orders(spark, sf):
    m = view(spark, sf, "ensemble").select("structure_id", "model_id").distinct().withColumn("cluster", F.col("model_id") % 3)
    return ensemble.cluster_order(m)


@query(CHAINS + " SELECT structure_id, chain, count(*) AS n FROM atoms WHERE chain <> 'A' AND element = 'C' GROUP BY 1, 2")
def checked_algebra(spark, sf):
    """Set algebra after its parent check."""
    a = _chains(spark, sf)
    p, q = select.select(a, chain=["B", "C"]), select.select(a, element="c")
    select.same_parent(a, p, q)
    return select.intersect(p, q).groupBy("structure_id", "chain").agg(F.count("*").alias("n"))


@query(CHAINS + f""", p AS (SELECT a.structure_id, a.atom_idx AS i, b.atom_idx AS j, row_number() OVER (PARTITION BY a.structure_id, a.atom_idx ORDER BY {D2}, b.atom_idx) AS r FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND a.atom_idx <> b.atom_idx QUALIFY r <= 4)
 SELECT DISTINCT structure_id, least(i, j) AS i, greatest(i, j) AS j FROM p""")
def nearest_large(spark, sf):
    return spatial.nearest(_chains(spark, sf), 4)
