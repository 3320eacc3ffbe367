"""Counting quotient filters: exact counts over merges, and the bytes they take."""

from collections import Counter

import numpy as np
import pytest

from pairforge.llm.exact_dedup import CountingQuotientFilter


@pytest.mark.parametrize("bits", [4, 12, 16])
def test_merged_slices_count_what_all_parts_hold(bits):
    rng = np.random.default_rng(bits)
    values = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = [rng.choice(values, n) for n in (0, 1, 50, 900, 3000)] + [np.full(1000, values[7]), np.array([0, (1 << 64) - 1], np.uint64)]
    by: dict[int, list] = {}
    for p in parts:
        for i, raw in CountingQuotientFilter.build(p, bits).slices(8):
            by.setdefault(i, []).append(CountingQuotientFilter.read(raw))
    got: Counter = Counter()
    for own in by.values():
        f = CountingQuotientFilter.merge(own)
        assert (np.diff(f.fingerprints().astype(object)) > 0).all()
        got.update(dict(zip(f.fingerprints().tolist(), f.counts.tolist(), strict=True)))
    assert got == Counter(x for p in parts for x in p.tolist())


def test_a_fingerprint_takes_fewer_than_eight_bytes():
    values = np.random.default_rng(1).integers(0, 1 << 63, 1_000_000, dtype=np.uint64)
    held = sum(len(raw) for _, raw in CountingQuotientFilter.build(values, 16).slices(64))
    assert held / len(values) < 7.5
