"""Operators that need a backend which isn't part of the library: register one, or get a clear error."""

from __future__ import annotations

from collections.abc import Callable

#: What a backend may be registered for, and what it must take and return.
KNOWN = {
    "canonical_smiles": "string column -> string column", "murcko_scaffold": "string column -> string column", "morgan_fingerprint": "string column -> array<int> of on-bits", "smiles_descriptors": "string column -> map<string,double>",
    "protonate_smiles": "string column -> string column", "conformer": "string column -> array<struct<element,x,y,z>>", "chemical_features": "atoms, bonds -> atoms with charges, valence and aromaticity", "template_bonds": "atoms -> bonds",
    "residue_pka": "atoms -> table of residue charges", "delaunay_edges": "atoms -> edges", "dictionary_validation": "CIF text column -> array<string> of findings", "tensors": "nodes, edges -> tensor objects",
}
_BACKENDS: dict[str, Callable] = {}


class MissingBackend(RuntimeError):
    pass


def register(name: str, function: Callable) -> None:
    if name not in KNOWN:
        raise ValueError(f"no operator {name!r}; known: {', '.join(sorted(KNOWN))}")
    _BACKENDS[name] = function


def backend(name: str) -> Callable:
    if name not in KNOWN:
        raise ValueError(f"no operator {name!r}; known: {', '.join(sorted(KNOWN))}")
    if name not in _BACKENDS:
        raise MissingBackend(f"{name} needs a chemistry backend ({KNOWN[name]}): register one with stratamol.functions.hooks.register({name!r}, function)")
    return _BACKENDS[name]


def available() -> list[str]:
    return sorted(_BACKENDS)
