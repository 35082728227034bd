"""Geometry as column arithmetic: distances, angles, dihedrals, rotations, shape, minimum images."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: An end of a dihedral lies on the axis where its squared distance from it is below this share of the axis's squared length: the rest is rounding.
ON_AXIS = 1e-20


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def squared(a: Vec, b: Vec) -> Column:
    d = sub(a, b)
    return dot(d, d)


def distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(squared(a, b))


def angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Degrees at b; null where an arm has no length."""
    u, v = sub(a, b), sub(c, b)
    n = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / n)))))


def dihedral(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Signed degrees about the axis b-c; null where the axis has no length, 0 where an end lies on it."""
    b0, b1, b2 = sub(a, b), sub(c, b), sub(d, c)
    n2 = dot(b1, b1)
    m, n = cross(b1, b0), cross(b1, b2)  # normals: expressions are inlined, so short ones keep generated code small
    flat = F.least(dot(m, m), dot(n, n)) <= n2 * n2 * ON_AXIS
    return F.when(n2 > 0, F.when(flat, 0.0).otherwise(F.degrees(F.atan2(F.lit(0.0) - F.sqrt(n2) * dot(b0, n), dot(m, n)))))


def nearest_image(d: Vec, lengths: tuple[float, float, float]) -> Vec:
    """Minimum image in an orthogonal cell; halves round to even."""
    return tuple(x - F.lit(float(n)) * F.rint(x / float(n)) for x, n in zip(d, lengths, strict=True))


def lattice(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[list[float]]:
    """Rows of the lattice matrix of a cell given by lengths and angles in degrees."""
    ca, cb, cg, sg = (math.cos(math.radians(alpha)), math.cos(math.radians(beta)), math.cos(math.radians(gamma)), math.sin(math.radians(gamma)))
    cx, cy = c * cb, c * (ca - cb * cg) / sg
    return [[a, 0.0, 0.0], [b * cg, b * sg, 0.0], [cx, cy, math.sqrt(max(0.0, c * c - cx * cx - cy * cy))]]


def nearest_image_cell(d: Vec, rows: list[list[float]]) -> Vec:
    """Minimum image in a triclinic cell by rounding fractional coordinates."""
    import numpy as np

    inv = np.linalg.inv(np.array(rows))
    frac = [sum((d[i] * float(inv[i][j]) for i in range(1, 3)), d[0] * float(inv[0][j])) for j in range(3)]
    frac = [f - F.rint(f) for f in frac]
    return tuple(sum((frac[i] * float(rows[i][j]) for i in range(1, 3)), frac[0] * float(rows[0][j])) for j in range(3))


def rotated(p: Vec, centre: Vec, axis: tuple[float, float, float], degrees: float) -> Vec:
    """Rodrigues rotation about an axis through centre."""
    n = math.sqrt(sum(x * x for x in axis))
    if not n:
        raise ValueError("the axis has no length")
    k = tuple(F.lit(x / n) for x in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    v = sub(p, centre)
    kv, kd = cross(k, v), dot(k, v)
    return tuple(centre[i] + v[i] * c + kv[i] * s + k[i] * kd * (1 - c) for i in range(3))


def symmetric_eigenvalues(xx, yy, zz, xy, xz, yz) -> tuple[Column, Column, Column]:
    """Ascending eigenvalues of a symmetric 3x3 matrix in closed form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2))
    phi = F.acos(r) / 3
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    flat = p <= 0
    return tuple(F.when(flat, q).otherwise(v) for v in (low, 3 * q - high - low, high))


def shape(m1, m2, m3, total_mass) -> dict[str, Column]:
    """Asphericity, acylindricity and anisotropy from ascending principal moments of inertia."""
    s = (m1 + m2 + m3) / 2
    g = [F.greatest(F.lit(0.0), (s - m) / total_mass) for m in (m3, m2, m1)]  # gyration moments, ascending
    rg2 = g[0] + g[1] + g[2]
    aspher, acyl = g[2] - (g[0] + g[1]) / 2, g[1] - g[0]
    kappa = F.when(rg2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (aspher * aspher + 0.75 * acyl * acyl) / (rg2 * rg2)))).otherwise(0.0)
    return {"asphericity": aspher, "acylindricity": acyl, "anisotropy": kappa}


def inertia_anisotropy(m1, m2, m3) -> Column:
    """1.5 times the squared deviations of the moments from their mean over their squares."""
    mean = (m1 + m2 + m3) / 3
    total = m1 * m1 + m2 * m2 + m3 * m3
    spread = (m1 - mean) * (m1 - mean) + (m2 - mean) * (m2 - mean) + (m3 - mean) * (m3 - mean)
    return F.when(total > 0, 1.5 * spread / total).otherwise(0.0)


def fibonacci_sphere(n: int) -> list[tuple[float, float, float]]:
    """n nearly even unit vectors on a golden spiral."""
    out = []
    for k in range(n):
        z, turn = 1 - (2 * k + 1) / n, math.pi * (1 + math.sqrt(5)) * (k + 0.5)
        r = math.sqrt(max(0.0, 1 - z * z))
        out.append((r * math.cos(turn), r * math.sin(turn), z))
    return out
