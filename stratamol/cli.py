"""A thin front end: python -m stratamol.cli COMMAND PATH [options]; prints CSV."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.scalars import ligand_key
from .operators import aggregates, coarse, presets, quality, ranking, reports, residues, secondary, select, spatial
from .session import session
from .sources import formats


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratamol")
    sub = p.add_subparsers(dest="command", required=True)
    for name, more in {"summary": [], "ensemble": [], "preflight": [("--workflow", str, None)], "pocket": [("--ligand", str, None)], "validate-cif": [], "analyze": [], "contacts": [("--cutoff", float, 5.0)], "binding-site": [("--ligand", str, None), ("--cutoff", float, 4.5)], "select": [("--where", str, "")], "secondary-structure": [], "qc": [], "prepare": [], "coarse-grain": [("--mapping", str, "residue_com")], "dock-rank": [("--score", str, None)]}.items():
        s = sub.add_parser(name)
        s.add_argument("path")
        s.add_argument("--out")
        for flag, kind, default in more:
            s.add_argument(flag, type=kind, default=default)
    sub.add_parser("presets").add_argument("--out")
    return p


def run(args: argparse.Namespace, spark=None):
    spark = spark or session("stratamol")
    if args.command == "presets":
        return presets.catalogue(spark).withColumn("features", F.array_join("features", ";"))
    if args.command == "dock-rank":
        poses = formats.read_poses(spark, args.path)
        score = args.score or ranking.detect_field([r["field"] for r in aggregates.available_fields(poses, "properties", "pose_id").orderBy("first").collect()])
        if not score:
            raise ValueError("no known score field; name one with --score")
        higher, _ = ranking.higher_is_better(score)
        p = poses.withColumns({"score": F.col("properties")[score].try_cast("double"), "ligand": ligand_key("name")})
        return ranking.rank_poses(p, "score", higher, ["source", "pose_id"], heavy="n_heavy").select("rank", "source", "pose_id", "name", "ligand", "score", "efficiency")
    if args.command == "validate-cif":
        return formats.validate_cif(spark, args.path).withColumn("findings", F.array_join("findings", ";"))
    atoms = formats.read_atoms(spark, args.path)
    good = atoms.where("parse_error is null and model_id = 1")
    return {
        "summary": lambda: reports.summary_lines(good), "ensemble": lambda: reports.ensemble_summary(atoms.where("parse_error is null")), "preflight": lambda: reports.preflight(good, args.workflow, deep=True).withColumn("workflows", F.array_join("workflows", ";")),
        "pocket": lambda: reports.pocket_text(good, args.ligand),
        "analyze": lambda: aggregates.descriptors(good), "contacts": lambda: spatial.contact_counts(good, getattr(args, "cutoff", 5.0), cells=True), "binding-site": lambda: residues.binding_site(good, args.ligand, args.cutoff),
        "select": lambda: good.where(select.parse_selection(args.where)), "secondary-structure": lambda: secondary.assign(good), "qc": lambda: quality.inventory(atoms.where("parse_error is null")),
        "prepare": lambda: quality.readiness(quality.topology(good)).withColumns({c: F.array_join(c, ";") for c in ("blockers", "warnings")}), "coarse-grain": lambda: coarse.beads(coarse.members(good, args.mapping)),
    }[args.command]()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    df = run(args)
    if args.out:
        df.write.mode("overwrite").csv(args.out, header=True)
    else:
        print(",".join(df.columns))
        for row in df.toLocalIterator():
            print(",".join("" if v is None else str(v) for v in row))
    return 0


if __name__ == "__main__":
    sys.exit(main())
