"""Small string and number rules of the file formats and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import case


def residue_label(chain, resname, resid, icode) -> Column:
    """Like A:ASP100A; the chain is left out where it is empty."""
    tail = F.concat(F.coalesce(resname, F.lit("")), F.coalesce(F.col(resid) if isinstance(resid, str) else resid, F.lit(0)).cast("string"), F.coalesce(icode, F.lit("")))
    return F.when(F.coalesce(chain, F.lit("")) == "", tail).otherwise(F.concat(chain, F.lit(":"), tail))


def sdf_charge(code) -> Column:
    return case(code, {1: 3, 2: 2, 3: 1, 5: -1, 6: -2, 7: -3}, 0)


def sdf_bond_order(code) -> Column:
    """Code 4 is aromatic, order 1.5."""
    return F.when(code == 4, 1.5).otherwise(code.cast("double"))


def sdf_order_code(order) -> Column:
    return F.when(order == 1.5, 4).otherwise(order.cast("int"))


def sdf_tag(line) -> Column:
    """The name between the first < and the last > of a data header."""
    return F.regexp_extract(line, r"^[^<]*<(.*)>[^>]*$", 1)


def number(value) -> Column:
    """Number or null, where it can't be read or isn't finite."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stem(path) -> Column:
    """File name without folders, .gz and extension."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.gz$", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.gz$", "")
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))


def cif_value(value) -> Column:
    """Null placeholders become empty."""
    return F.when(value.isin(".", "?"), "").otherwise(F.coalesce(value, F.lit("")))


def cif_token(value) -> Column:
    """A value as written in a loop."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", ".").when(v.rlike(r"[\s'\"#]"), F.when(F.contains(v, F.lit("'")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), v, F.lit("'")))).otherwise(v)


def listed(items) -> Column:
    """Items joined with commas and a last "and"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).when(n == 2, F.concat(head, F.lit(" and "), F.element_at(items, -1))).otherwise(F.concat(head, F.lit(", and "), F.element_at(items, -1)))


def simplified_structure(codes) -> Column:
    """Eight secondary-structure states as three: H, E and -."""
    return F.translate(codes, "GIHEBTS-", "HHHEE---")


def acid_base_charge(kind, pka, ph) -> Column:
    return F.when((kind == "acid") & (ph > pka), -1).when((kind == "base") & (ph < pka), 1).otherwise(0)


def ligand_key(name) -> Column:
    """A pose's ligand: its name without a pose suffix."""
    return F.regexp_replace(name, r"(?i)(_pose\d+|_conf\d+|_model\d+|_raw)$", "")
