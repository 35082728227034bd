"""Bundles over other operators: one-line summaries, ensembles in figures, preflight warnings, comparisons, pocket text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import listed, residue_label
from . import aggregates, compare, ensemble, quality, residues, spatial
from .spatial import KEY

WORKFLOWS = ("graph", "descriptors", "coarse_grain", "contact_map")
# The workflows that each warning concerns; a warning without any concerns them all.
CONCERNS = {
    "inferred_bonds": ("graph", "coarse_grain"), "missing_metadata": WORKFLOWS, "missing_hydrogens": ("graph", "descriptors"), "bad_elements": (), "altlocs": (), "low_occupancy": (), "multiple_models": (), "large_dense": ("graph", "contact_map"),
    "missing_backbone": ("graph", "descriptors", "contact_map"), "chain_breaks": ("graph", "contact_map"), "residue_gaps": ("graph", "contact_map"), "truncated_sidechains": ("graph", "descriptors"), "nonstandard_residues": ("graph", "descriptors", "coarse_grain"),
}
DEEP = {"missing_backbone": "n_missing_backbone", "chain_breaks": "n_breaks", "residue_gaps": "n_gaps", "truncated_sidechains": "n_truncated", "nonstandard_residues": "n_nonstandard"}


def summary_lines(atoms: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, summary): name, atoms, formula, sorted chains and size in one line; empty parts are left out."""
    size = [F.max(c) - F.min(c) for c in "xyz"]
    g = atoms.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.nullif("chain", F.lit("")))).alias("chains"), F.format_string("size %.1fx%.1fx%.1f A", *size).alias("size"))
    g = g.join(aggregates.formula(atoms, key), key, "left")
    head = F.concat_ws(" ", *(F.col(k).cast("string") for k in key))
    parts = [F.concat(head, F.lit(": "), F.col("n").cast("string"), F.lit(" atoms")), F.concat(F.lit("formula "), F.nullif("formula", F.lit(""))), F.when(F.size("chains") > 0, F.concat(F.lit("chains "), F.array_join("chains", ","))), F.col("size")]
    return g.select(*key, F.concat_ws(" | ", *parts).alias("summary"))


def ensemble_summary(atoms: DataFrame, align: bool = True, key: list[str] = KEY) -> DataFrame:
    """(key, n_models, mean_rmsd, max_rmsd, mean_rmsf, max_rmsf, n_clusters) of structures with two or more models."""
    m = ensemble.rmsd_matrix(atoms, align, key)
    pairwise = m.groupBy(*key).agg(F.avg("rmsd").alias("mean_rmsd"), F.max("rmsd").alias("max_rmsd"))
    fluctuation = ensemble.rmsf(atoms, align, key).groupBy(*key).agg(F.max("n_models").alias("n_models"), F.avg("rmsf").alias("mean_rmsf"), F.max("rmsf").alias("max_rmsf"))
    clusters = ensemble.cluster(m, key=key).groupBy(*key).agg(F.count_distinct("cluster").alias("n_clusters"))
    out = pairwise.join(fluctuation, key).join(clusters, key)
    return out.select(*key, "n_models", "mean_rmsd", "max_rmsd", "mean_rmsf", "max_rmsf", "n_clusters")


def preflight(atoms: DataFrame, workflow: str | None = None, deep: bool = False, key: list[str] = KEY) -> DataFrame:
    """(key, code, workflows): warnings of an inventory and, with deep, of the polymer's topology; a workflow keeps its own."""
    if workflow is not None and workflow not in WORKFLOWS:
        raise ValueError(f"a workflow is one of {', '.join(WORKFLOWS)}")
    out = quality.findings(quality.inventory(atoms, key), key)
    if deep:
        codes = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(code)) for code, c in DEEP.items()]), lambda x: x.isNotNull())
        out = out.unionByName(quality.topology(atoms, key).select(*key, F.explode(codes).alias("code")))
    concerns = F.coalesce(*[F.when(F.col("code") == c, F.array(*[F.lit(x) for x in w]).cast("array<string>")) for c, w in CONCERNS.items()])
    out = out.withColumn("workflows", concerns)
    return out if workflow is None else out.where((F.size("workflows") == 0) | F.array_contains("workflows", workflow))


def _residue_contacts(atoms: DataFrame, other: DataFrame, cutoff: float, key: list[str]) -> DataFrame:
    """(key, i, j): contacts between residues that other has too, by label."""
    label = residue_label("chain", "resname", "resid", "icode").alias("label")
    points = residues.representatives(atoms, "ca", key).withColumn("label", label).join(other.select(*key, label).distinct(), [*key, "label"], "left_semi")
    p = spatial.pairs(points, cutoff, key, extra=["label"])
    return p.select(*key, F.least("i_label", "j_label").alias("i"), F.greatest("i_label", "j_label").alias("j"))


def compare_structures(a: DataFrame, b: DataFrame, cutoff: float = 8.0, key: list[str] = KEY) -> DataFrame:
    """(key, n_atoms_a, n_atoms_b, n_matched, rmsd, max_deviation, worst, common, lost, gained) as the coordinates stand.

    Atoms are matched by residue and name; worst is the residue that moved most; contacts are those of common residues."""
    m = compare.matched(a, b, key)
    d2 = sum(((F.col(f"p{x}") - F.col(f"q{x}")) * (F.col(f"p{x}") - F.col(f"q{x}")) for x in "yz"), (F.col("px") - F.col("qx")) * (F.col("px") - F.col("qx")))
    fit = m.groupBy(*key).agg(F.count("*").alias("n_matched"), F.sqrt(F.avg(d2)).alias("rmsd"))
    worst = compare.largest(compare.deviations(m, key), 1, key).select(*key, F.col("rmsd").alias("max_deviation"), residue_label("chain", "resname", "resid", "icode").alias("worst"))
    out = a.groupBy(*key).agg(F.count("*").alias("n_atoms_a")).join(b.groupBy(*key).agg(F.count("*").alias("n_atoms_b")), key)
    changes = compare.contact_changes(_residue_contacts(a, b, cutoff, key), _residue_contacts(b, a, cutoff, key), key)
    return out.join(fit, key, "left").join(worst, key, "left").join(changes, key, "left").fillna(0, ["n_matched", "common", "lost", "gained"])


def pocket_text(atoms: DataFrame, ligand: str | None = None, key: list[str] = KEY) -> DataFrame:
    """(key, text): a plain paragraph on the pocket's residues and close contacts, in order of chain, number and atoms."""
    p = residues.pocket(atoms, ligand, key=key, first_atom=True)
    label = residue_label("chain", "resname", "resid", "icode")
    place = [F.col("chain").alias("c"), F.col("resid").alias("r"), F.col("icode").alias("i"), F.col("first_atom").alias("a")]

    def those(given, text):
        kept = F.collect_list(F.when(given, F.struct(*place, text.alias("t"))))
        return F.transform(F.array_sort(kept), lambda x: x["t"])

    def near(c):
        return F.concat(label, F.lit(" ("), F.format_string("%.1f", F.col(c)), F.lit(" A)"))

    g = p.groupBy(*key).agg(
        F.count("*").alias("n"), those(F.col("hydrophobic"), label).alias("wall"), those(F.col("aromatic"), label).alias("rings"),
        those(F.col("polar_distance").isNotNull(), near("polar_distance")).alias("polar"), those(F.col("salt_distance").isNotNull(), near("salt_distance")).alias("salt"),
    )

    def line(name, lead):
        return F.when(F.size(name) > 0, F.concat(F.lit(lead), listed(F.col(name)), F.lit(".")))

    none = F.when(F.size("polar") + F.size("salt") == 0, F.lit("No polar or charged atoms are close."))
    parts = [F.format_string("%d residues are near the ligand.", "n"), line("wall", "Hydrophobic contacts: "), line("rings", "Aromatic residues nearby: "), line("polar", "Close polar atoms: "), line("salt", "Opposite charges: "), none]
    return g.select(*key, F.concat_ws(" ", *parts).alias("text"))


def structure_report(atoms: DataFrame, cutoff: float = 8.0, key: list[str] = KEY) -> dict[str, DataFrame]:
    """The tables of a report, to be shown or written as the caller likes."""
    return {
        "summary": summary_lines(atoms, key), "quality": quality.inventory(atoms, key), "warnings": preflight(atoms, deep=True, key=key), "descriptors": aggregates.descriptors(atoms, key=key),
        "contacts": spatial.contact_counts(residues.representatives(atoms, "ca", key), cutoff, key), "bonds": aggregates.bond_summary(aggregates.bonds(atoms, key=key), key), "ligands": residues.ligands(atoms, key=key),
    }


def render(tables: dict[str, DataFrame], title: str, rows: int = 50, html: bool = True) -> str:
    """A report's tables as one HTML page or Markdown text, the first `rows` rows of each, which it says."""
    from html import escape

    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>" if html else f"# {title}"]
    for name, df in tables.items():
        got = df.limit(rows + 1).collect()
        more = f" (the first {rows} rows)" if len(got) > rows else ""
        cells = [["" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r] for r in got[:rows]]
        if html:
            head = "".join(f"<th>{escape(c)}" for c in df.columns)
            body = "".join("<tr>" + "".join(f"<td>{escape(c)}" for c in r) for r in cells)
            out.append(f"<h2>{escape(name)}{more}</h2><table><tr>{head}{body}</table>")
        else:
            lines = [df.columns, ["---"] * len(df.columns), *([c.replace("|", "\\|") for c in r] for r in cells)]
            out.append(f"\n## {name}{more}\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in lines))
    return "\n".join(out)
