"""Distance joins within structures.

Atoms of structures of over SMALL atoms join on their key and a grid cell of the cutoff's size, so that one structure spreads
over tasks and each atom meets 27 cells only; the others join on the key alone, which sends no atom to several cells. Where
all structures are known to be small, cells=False joins on the key alone throughout.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geometry import nearest_image, nearest_image_cell

KEY = ["structure_id"]
#: Structures of up to so many atoms join on their key alone.
SMALL = 128


def _side(atoms: DataFrame, key, name: str, extra=()) -> DataFrame:
    return atoms.select(*key, F.col("atom_idx").alias(name), *(F.col(a).alias(f"{name}{a}") for a in "xyz"), *(F.col(c).alias(f"{name}_{c}") for c in extra))


def _d2(lengths=None, lattice=None) -> Column:
    d = tuple(F.col(f"i{a}") - F.col(f"j{a}") for a in "xyz")
    if lengths:
        d = nearest_image(d, lengths)
    if lattice:
        d = nearest_image_cell(d, lattice)
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


#: The own cell and half of its neighbours: each pair of neighbouring cells meets once.
HALF = [t for t in product((-1, 0, 1), repeat=3) if t >= (0, 0, 0)]


def _cells(df: DataFrame, name: str, cutoff: float, steps=None) -> DataFrame:
    df = df.withColumns({f"c{a}": F.floor(F.col(f"{name}{a}") / float(cutoff)).cast("int") for a in "xyz"})
    if not steps:
        return df
    moves = F.explode(F.array(*[F.struct(*(F.lit(s).alias(a) for s, a in zip(t, "xyz", strict=True))) for t in steps]))
    df = df.withColumn("s", moves).withColumn("own", F.expr("s.x = 0 and s.y = 0 and s.z = 0"))
    return df.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"s.{a}") for a in "xyz"}).drop("s")


def _by_size(atoms: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """Atoms of structures of up to SMALL atoms, and those of all others."""
    a = atoms.withColumn("__size", F.count("*").over(W.partitionBy(*key)))
    return a.where(F.col("__size") <= SMALL).drop("__size"), a.where(F.col("__size") > SMALL).drop("__size")


def _joined(a: DataFrame, b: DataFrame, cutoff, key, cells: bool, lengths, before: bool, inclusive: bool = False, lattice=None) -> DataFrame:
    near = _d2(lengths, lattice) <= float(cutoff) ** 2 if inclusive else _d2(lengths, lattice) < float(cutoff) ** 2
    on = list(key)
    cells = cells and not lengths and not lattice  # cells don't wrap
    if cells:
        a = _cells(a, "i", cutoff, HALF if before else list(product((-1, 0, 1), repeat=3)))
        b, on = _cells(b, "j", cutoff), [*key, "cx", "cy", "cz"]
    pairs = a.join(b, on)
    if before:
        pairs = pairs.where("i < j or not own" if cells else "i < j")
    pairs = pairs.where(near).withColumn("d2", _d2(lengths, lattice))
    pairs = pairs.drop("cx", "cy", "cz", "own", *(f"{s}{x}" for s in "ij" for x in "xyz"))
    if before and cells:  # pairs of different cells may come the other way round
        carried = [c[2:] for c in pairs.columns if c.startswith("i_")]
        turn = F.col("i") > F.col("j")
        swap = {f"{s}{m}": F.when(turn, F.col(f"{t}{m}")).otherwise(F.col(f"{s}{m}")) for s, t in ("ij", "ji") for m in ("", *(f"_{c}" for c in carried))}
        pairs = pairs.select(*(swap[c].alias(c) if c in swap else F.col(c) for c in pairs.columns))
    return pairs


def pairs(atoms: DataFrame, cutoff: float, key: list[str] = KEY, cells: bool = True, lengths=None, extra=(), inclusive: bool = False, lattice=None) -> DataFrame:
    """(key, i, j, d2) of all pairs i < j nearer than cutoff (strictly, unless inclusive).

    cells: structures of over SMALL atoms join on grid cells, so that they spread over tasks; without them, where all are
    known to be small, all join on the key alone, to the same result. lengths: box of an orthogonal periodic cell; lattice: rows of a triclinic
    one; images join on the key. extra: columns to carry from both atoms, as i_ and j_. A cutoff of 0 or less gives no
    pairs."""
    cells = cells and not lengths and not lattice
    parts = _by_size(atoms, key) if cells else [atoms]
    out, *more = [_joined(_side(a, key, "i", extra), _side(a, key, "j", extra), max(cutoff, 1e-9), key, k > 0, lengths, True, inclusive, lattice) for k, a in enumerate(parts)]
    out = out.unionByName(more[0]) if more else out
    return out if cutoff > 0 else out.where("false")


def cross_pairs(a: DataFrame, b: DataFrame, cutoff: float, key: list[str] = KEY, cells: bool = True, extra=(), other=(), inclusive: bool = False) -> DataFrame:
    """(key, i, j, d2): atoms i of a and j of b nearer than cutoff; extra and other are carried as i_ and j_.

    With cells, the number of a's atoms decides which structures join on grid cells."""
    if not cells:
        return _joined(_side(a, key, "i", extra), _side(b, key, "j", other), cutoff, key, False, None, False, inclusive)
    few, many = _by_size(a, key)
    there = _side(b, key, "j", other)
    spread = there.join(many.select(*key).distinct(), list(key), "left_semi")
    out = _joined(_side(few, key, "i", extra), there, cutoff, key, False, None, False, inclusive)
    return out.unionByName(_joined(_side(many, key, "i", extra), spread, cutoff, key, True, None, False, inclusive))


def all_distances(atoms: DataFrame, key: list[str] = KEY, lengths=None) -> DataFrame:
    """(key, i, j, d2) of all pairs i < j: for small structures."""
    p = _side(atoms, key, "i").join(_side(atoms, key, "j"), key).where("i < j")
    return p.withColumn("d2", _d2(lengths)).drop(*(f"{s}{x}" for s in "ij" for x in "xyz"))


def contact_counts(atoms: DataFrame, cutoff: float = 5.0, key: list[str] = KEY, cells: bool = True) -> DataFrame:
    """(key, n_atoms, n_contacts, density) of every structure; density over all pairs, 0 below two atoms."""
    n = atoms.groupBy(*key).agg(F.count("*").alias("n_atoms"))
    c = pairs(atoms, cutoff, key, cells).groupBy(*key).agg(F.count("*").alias("n_contacts"))
    out = n.join(c, key, "left").withColumn("n_contacts", F.coalesce("n_contacts", F.lit(0)))
    most = F.col("n_atoms") * (F.col("n_atoms") - 1) / 2
    return out.withColumn("density", F.when(most > 0, F.col("n_contacts") / most).otherwise(0.0))


def nearest(atoms: DataFrame, k: int, key: list[str] = KEY, cells: bool = True, distances: bool = False) -> DataFrame:
    """(key, i, j): each atom joined to its k nearest, made symmetric; ties go to the lower index. distances adds d2.

    cells: structures of up to PACKED atoms are packed, one a row, and searched whole. In others a radius that should hold 2k
    atoms at the structure's mean density is tried on grid cells first; only atoms that have fewer than k within it meet
    their whole structure. Without cells all atoms do, to the same result."""

    def top(p):
        rank = F.row_number().over(W.partitionBy(*key, "i").orderBy("d2", "j"))
        return p.withColumn("r", rank).where(F.col("r") <= k).drop("r")

    out = [*key, "i", "j", *(["d2"] if distances else [])]
    packed = None
    if cells:
        w = W.partitionBy(*key)
        far = F.max(F.coalesce(F.abs("x") + F.abs("y") + F.abs("z"), F.lit(float("inf")))).over(w)  # nulls and infinities rank as Spark has them
        atoms = atoms.dropna(subset=list(key))  # as joins on the key do, so that both parts share a shuffle
        sized = atoms.select(*key, "atom_idx", "x", "y", "z").withColumns({"__size": F.count("*").over(w), "__far": far})
        whole = (F.col("__size") <= PACKED) & (F.col("__far") < 1e150)
        packed = _packed_nearest(sized.where(whole).drop("__size", "__far"), k, key).select(*out)
        atoms = sized.where(~whole).drop("__size", "__far")
        box = [F.greatest(F.max(a) - F.min(a), F.lit(1.0)) for a in "xyz"]
        reach = F.cbrt(0.2387 * 2 * (k + 1) * box[0] * box[1] * box[2] / F.count("*"))
        a = atoms.select(*key, "atom_idx", "x", "y", "z").join(atoms.groupBy(*key).agg(reach.alias("reach")), key)
        at = {f"c{x}": F.floor(F.col(x) / F.col("reach")).cast("long") for x in "xyz"}
        i = _side(a.withColumns(at), key, "i", ["reach", "cx", "cy", "cz"])
        moves = F.explode(F.array(*[F.struct(*(F.lit(m).alias(x) for m, x in zip(t, "xyz", strict=True))) for t in product((-1, 0, 1), repeat=3)]))
        i = i.withColumn("s", moves).withColumns({f"c{x}": F.col(f"i_c{x}") + F.col(f"s.{x}") for x in "xyz"}).drop("s", "i_cx", "i_cy", "i_cz")
        j = _side(a.withColumns(at), key, "j", ["cx", "cy", "cz"]).withColumnsRenamed({f"j_c{x}": f"c{x}" for x in "xyz"})
        near = i.join(j, [*key, "cx", "cy", "cz"]).where("i <> j").withColumn("d2", _d2()).where(F.col("d2") < F.col("i_reach") * F.col("i_reach"))
        near = near.select(*key, "i", "j", "d2")
        enough = near.groupBy(*key, "i").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*key, "i")
        rest = _side(atoms, key, "i").join(enough, [*key, "i"], "left_anti").join(_side(atoms, key, "j"), key).where("i <> j").withColumn("d2", _d2()).select(*key, "i", "j", "d2")
        both = top(near.join(enough, [*key, "i"], "left_semi")).unionByName(top(rest))
    else:
        p = all_distances(atoms, key)
        both = top(p.unionByName(p.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), "d2")))
    both = both.select(*key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d2").select(*out).distinct()
    return both if packed is None else packed.unionByName(both)


#: Structures of up to so many atoms are searched whole for nearest atoms; rows of distances and pairs held at once.
PACKED, STRIP, HELD = 4096, 256, 200_000


def _nearest_of(idx, xyz, k: int):
    """(i, j, d2), i < j, of each atom and its k nearest, ties to the lower index."""
    import numpy as np

    order = np.argsort(idx, kind="stable")
    idx, xyz = idx[order], [c[order] for c in xyz]
    n, found = len(idx), []
    k = min(k, n - 1)
    for at in range(0, n if k > 0 else 0, STRIP):
        d = [c[at : at + STRIP, None] - c[None, :] for c in xyz]
        d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        rows = np.arange(len(d2))
        d2[rows, rows + at] = np.inf
        r, c = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k])
        v = d2[r, c]
        by = np.lexsort((c, v, r))
        r, c, v = r[by], c[by], v[by]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, v = (z[rank < k] for z in (r + at, c, v))
        found.append((np.minimum(r, c) * n + np.maximum(r, c), v))
    if not found:
        return idx[:0], idx[:0], np.zeros(0)
    ends, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
    return idx[ends // n], idx[ends % n], np.concatenate([f[1] for f in found])[first]


def _packed_nearest(atoms: DataFrame, k: int, key) -> DataFrame:
    """(key, i, j, d2) of nearest(), each structure a row of arrays."""
    import numpy as np
    import pyarrow as pa

    t = {f.name: f.dataType for f in atoms.schema}
    schema = StructType([*(StructField(c, t[c]) for c in key), StructField("i", t["atom_idx"]), StructField("j", t["atom_idx"]), StructField("d2", DoubleType())])
    rows = atoms.groupBy(*key).agg(F.collect_list("atom_idx").alias("idx"), *(F.collect_list(F.col(c).cast("double")).alias(f"a{c}") for c in "xyz"))

    def run(batches):
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("idx", "ax", "ay", "az")]
            keys = [batch.column(batch.schema.get_field_index(c)) for c in key]
            bounds = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            idx, *xyz = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            held, kept = [], 0

            def out():
                of = pa.array(np.repeat([h[0] for h in held], [len(h[1][0]) for h in held]))
                return pa.RecordBatch.from_arrays([*(c.take(of) for c in keys), *(pa.array(np.concatenate([h[1][m] for h in held])) for m in range(3))], [*key, "i", "j", "d2"])

            for m in range(batch.num_rows):
                s = slice(bounds[m], bounds[m + 1])
                held.append((m, _nearest_of(idx[s], [c[s] for c in xyz], k)))
                kept += len(held[-1][1][0])
                if kept >= HELD:
                    yield out()
                    held, kept = [], 0
            if held:
                yield out()

    return rows.mapInArrow(run, schema)


#: Vectors of the second table in a block.
BLOCK = 500


def vector_distances(a: DataFrame, b: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(i, j, distance) between all rows of two vector tables: b is a stated query set, which meets a in blocks.

    Blocks of b's vectors are rows; Spark broadcasts them or not by their size, and each row of a is held against a block at
    once. A null vector, or one of another length, has no distances."""
    import numpy as np
    import pandas as pd

    kinds = [df.schema[id_col].dataType.simpleString() for df in (a, b)]
    x = a.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("i"), F.transform(vec_col, lambda v: v.cast("double")).alias("u"))
    y = b.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("j"), F.transform(vec_col, lambda v: v.cast("double")).alias("v"))
    n = max(1, -(-y.count() // BLOCK))
    blocks = y.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("j"), F.lit(n)).alias("block")).agg(F.collect_list("j").alias("js"), F.flatten(F.collect_list("v")).alias("vs"))

    def run(frames):
        for pdf in frames:
            out = []
            for i, u, js, vs in zip(pdf["i"], pdf["u"], pdf["js"], pdf["vs"], strict=True):
                d = np.asarray(vs).reshape(len(js), -1) - np.asarray(u)
                out.append(pd.DataFrame({"i": i, "j": js, "distance": np.sqrt((d * d).sum(1))}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return x.join(blocks, F.size("u") == F.col("dim")).select("i", "u", "js", "vs").mapInPandas(run, f"i {kinds[0]}, j {kinds[1]}, distance double")
