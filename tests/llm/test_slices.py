"""Slices of text batches and what scanning them holds."""

import subprocess
import sys
from pathlib import Path

CODE = """
import numpy as np, pyarrow as pa
from stratamol.llm import bytescan
from stratamol.llm.common import text_slices
texts = [f"w{i} " * (1 + i * 37 % 4000) for i in range(700)] + [None, "", "x y"]
seen, sets = [], []
for a, b, data, offsets in text_slices(pa.array(texts)):
    seen += range(a, b)
    assert offsets[-1] == len(data) <= 1 << 20
    sets += bytescan.shingle_sets(data, offsets, 4)
assert seen == list(range(len(texts))) and sum(len(t or "") for t in texts) > 4 << 20
for t, own in zip(texts, sets, strict=True):
    raw = np.frombuffer((t or "").encode(), np.uint8)
    assert np.array_equal(bytescan.shingle_sets(raw, np.array([0, len(raw)]), 4)[0], own)
assert sum(x.nbytes for x in bytescan._pow) <= 16 << 20, sum(x.nbytes for x in bytescan._pow)
"""


def test_slices_hold_little():
    """In a process of its own, as the powers of a longer text stay."""
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=Path(__file__).resolve().parents[2])
