"""What the operators' own steps cost: memory of a fit, time of a pass."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np

from riskweave.llm import suffix, toxicity
from riskweave.llm.common import mix


def _fastest(step, *args) -> float:
    times = []
    for _ in range(5):
        began = time.thread_time()
        step(*args)
        times.append(time.thread_time() - began)
    return min(times)


def test_suffix_array_names_windows_in_few_passes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 4096)
    # a pass that mixes as many hashes is the unit; before, 11 of them
    assert _fastest(suffix.named, data, offsets, suffix.WINDOW) < 8.5 * _fastest(mix, rng.integers(0, 1 << 64, len(data), np.uint64))


def test_suffix_array_names_are_smallest_pieces():
    rng = np.random.default_rng(2)
    for letters, sizes in ((26, (500, 0, 199, 200, 201, 30, 900)), (2, (260, 450)), (1, (300, 250))):
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = rng.integers(97, 97 + letters, offsets[-1]).astype(np.uint8)
        raw, window, gram = data.tobytes(), suffix.WINDOW, suffix.GRAM
        least, hashes = suffix.named(data, offsets, window)
        piece = {i: int(suffix.window_hashes(data, np.array([i]), gram)[0, 0]) | 1 for i in range(len(raw) - gram + 1)}
        want = [0] * len(least)
        marked = set()
        for lo, hi in zip(offsets, offsets[1:]):
            for i in range(lo, hi - window + 1):
                inside = range(i, i + window - gram + 1)
                want[i] = min(piece[j] for j in inside)
                marked |= {j for j in inside if piece[j] == want[i]}
        assert least.tolist() == want
        assert hashes.tolist() == [piece[j] for j in sorted(marked)]


def test_suffix_array_sorts_numbers_with_their_places():
    rng = np.random.default_rng(3)
    for top in (1, 3, 1000, 1 << 40, (1 << 63) - 1):
        keys = rng.integers(0, top, 3000)
        assert suffix.ascending(keys).tolist() == np.argsort(keys, kind="stable").tolist()
    assert suffix.ascending(np.zeros(0, np.int64)).tolist() == []
    keys = rng.integers(0, 1 << 30, 1 << 18)
    assert _fastest(suffix.ascending, keys) < 0.7 * _fastest(lambda: np.argsort(keys, kind="stable"))


def test_suffix_array_slides_over_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(suffix, "SLIDE", 7)
    for n, width in ((1, 1), (5, 5), (40, 1), (40, 2), (41, 9), (64, 16), (100, 37)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        for pick in (np.minimum, np.maximum):
            assert suffix._sliding(x, width, pick).tolist() == [pick.reduce(x[i:i + width]) for i in range(n - width + 1)]


def test_toxicity_numbers_its_terms_once_in_memory():
    rng = np.random.default_rng(5)
    blobs = toxicity.to_gaps(*_rows_of(rng, 2000, 400), 2000)
    held_bytes = 2000 * 400 * 4
    tracemalloc.start()
    sets = [toxicity.from_gaps(b) for b in blobs]
    held = toxicity.renumber(sets)
    model = toxicity.train(sets, rng.integers(0, 2, len(sets)).astype(float), len(held))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the sets and one copy of them, and what a term needs: about 140 bytes, two batches beside
    assert peak < 2 * held_bytes + len(held) * 160 + (48 << 20)
    assert len(model["w"]) == len(held)


def test_toxicity_numbers_are_places_among_the_terms():
    rng = np.random.default_rng(6)
    rows, terms = _rows_of(rng, 50, 30)
    sets = [toxicity.from_gaps(b) for b in toxicity.to_gaps(rows, terms, 52)]
    before = [s.copy() for s in sets]
    held, places = np.unique(np.concatenate(before), return_inverse=True)
    assert toxicity.renumber(sets).tolist() == held.tolist()
    assert np.concatenate(sets).tolist() == places.tolist()
    assert [len(s) for s in sets] == [len(s) for s in before]


def _rows_of(rng, n: int, size: int):
    """Rows of ``size`` distinct sorted terms each."""
    sets = [np.sort(rng.choice(1 << toxicity.HASH_BITS, size, replace=False)) for _ in range(n)]
    return np.repeat(np.arange(n), size), np.concatenate(sets).astype(np.int64)
