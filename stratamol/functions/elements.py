"""Element and residue lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal published tables for right results.
COVALENT_RADIUS = {"H": 0.31, "C": 0.76, "N": 0.71, "O": 0.66, "S": 1.05, "P": 1.07, "F": 0.57, "CL": 1.02, "BR": 1.20, "I": 1.39, "FE": 1.32, "CA": 1.76, "NA": 1.66, "MG": 1.41, "ZN": 1.22}
VDW_RADIUS = {"H": 1.20, "C": 1.70, "N": 1.55, "O": 1.52, "S": 1.80, "P": 1.80, "F": 1.47, "CL": 1.75, "BR": 1.85, "I": 1.98, "FE": 2.00, "CA": 2.31, "NA": 2.27, "MG": 1.73, "ZN": 1.39}
MASS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "S": 32.06, "P": 30.974, "F": 18.998, "CL": 35.45, "BR": 79.904, "I": 126.904, "FE": 55.845, "CA": 40.078, "NA": 22.990, "MG": 24.305, "ZN": 65.38}
MAX_ASA = {"ALA": 129.0, "ARG": 274.0, "ASN": 195.0, "ASP": 193.0, "CYS": 167.0, "GLU": 223.0, "GLN": 225.0, "GLY": 104.0, "HIS": 224.0, "ILE": 197.0, "LEU": 201.0, "LYS": 236.0, "MET": 224.0, "PHE": 240.0, "PRO": 159.0, "SER": 155.0, "THR": 172.0, "TRP": 285.0, "TYR": 263.0, "VAL": 174.0}
DEFAULT_COVALENT, DEFAULT_VDW, DEFAULT_MASS = 0.75, 1.70, 1.0
#: Symbols by atomic number, from 1.
SYMBOLS = "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og".upper().split()
NUMBERED = {s: k + 1 for k, s in enumerate(SYMBOLS) if k < 36 or s == "I"}
DEFAULT_ELEMENTS = ("H", "C", "N", "O", "S", "P", "F", "CL", "BR", "I", "NA", "MG", "CA", "FE", "ZN")
WATER = ("HOH", "WAT", "DOD", "H2O", "SOL", "TIP", "TIP3")
IONS = ("NA", "K", "CL", "MG", "CA", "ZN", "FE", "MN", "CU", "NI", "CO", "CD", "HG", "BR", "IOD", "LI", "RB", "CS", "SR", "BA")
AMINO_ACIDS = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
NUCLEOTIDES = ("DA", "DC", "DG", "DT", "DU", "A", "C", "G", "U", "I")
HEAVY_ATOMS = {"GLY": 4, "ALA": 5, "SER": 6, "CYS": 6, "THR": 7, "VAL": 7, "PRO": 7, "LEU": 8, "ILE": 8, "ASN": 8, "ASP": 8, "MET": 8, "GLN": 9, "GLU": 9, "LYS": 9, "HIS": 10, "PHE": 11, "ARG": 11, "TYR": 12, "TRP": 14}
POCKET_HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO", "CYS")
GRAPH_HYDROPHOBIC = ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO")
GRAPH_POLAR = ("SER", "THR", "ASN", "GLN", "TYR", "CYS", "HIS", "ASP", "GLU", "LYS", "ARG")
AROMATIC = ("PHE", "TYR", "TRP", "HIS")
CATIONIC = (("ARG", "NH1"), ("ARG", "NH2"), ("ARG", "NE"), ("LYS", "NZ"), ("HIS", "ND1"), ("HIS", "NE2"))
ANIONIC = (("ASP", "OD1"), ("ASP", "OD2"), ("GLU", "OE1"), ("GLU", "OE2"))
BACKBONE = ("N", "CA", "C", "O")


def case(col: Column | str, table: dict, default=None) -> Column:
    """CASE over a small table; stays in generated code."""
    c = F.col(col) if isinstance(col, str) else col
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def case_sql(col: str, table: dict, default) -> str:
    """The same as SQL text for Spark and DuckDB."""
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)

    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def _symbol(c):
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def covalent_radius(element) -> Column:
    return case(_symbol(element), COVALENT_RADIUS, DEFAULT_COVALENT)


def vdw_radius(element) -> Column:
    return case(_symbol(element), VDW_RADIUS, DEFAULT_VDW)


def mass(element) -> Column:
    return case(_symbol(element), MASS, DEFAULT_MASS)


def atomic_number(element) -> Column:
    return case(_symbol(element), NUMBERED, 0)


def max_asa(resname) -> Column:
    return case(_symbol(resname), MAX_ASA, None)


def is_element(symbol) -> Column:
    return _symbol(symbol).isin(*SYMBOLS, "D", "T")


def charge_sign(resname, atom_name) -> Column:
    """+1 and -1 for the side-chain atoms charged at neutral pH, else 0."""
    both = F.concat_ws(" ", F.upper(resname), F.upper(atom_name))
    return F.when(both.isin([" ".join(p) for p in CATIONIC]), 1).when(both.isin([" ".join(p) for p in ANIONIC]), -1).otherwise(0)
