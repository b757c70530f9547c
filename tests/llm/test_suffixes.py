import numpy as np
import pytest

from trefoil.llm import suffixes
from trefoil.llm.substrings import repeated_windows


@pytest.mark.parametrize("small", [4, 1 << 17])
def test_against_sorted_suffixes(monkeypatch, small):
    monkeypatch.setattr(suffixes, "_SMALL", small)
    rng = np.random.default_rng(0)
    for t in range(200):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 150)), 0)
        if t % 5 == 0:
            s = np.append(np.tile(rng.integers(1, 3, rng.integers(1, 6)), 25), 0)
        order = suffixes.suffix_array(s, int(s.max()) + 1)
        values = s.tolist()
        assert order.tolist() == sorted(range(len(s)), key=lambda i: values[i:])
        shared, before = suffixes.permuted_common_prefixes(s, order)
        for a, b in zip(order[:-1], order[1:]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert (before[b], shared[b]) == (a, n)


def test_repeated_windows():
    rng = np.random.default_rng(1)
    for _ in range(40):
        parts = [bytes(rng.integers(97, 99, rng.integers(0, 60), dtype=np.uint8)) for _ in range(5)]
        seen = {}
        for p in parts:
            for k in range(len(p) - 7):
                seen[p[k : k + 8]] = seen.get(p[k : k + 8], 0) + 1
        want = [[k for k in range(len(p) - 7) if seen[p[k : k + 8]] > 1] for p in parts]
        assert [m.tolist() for m in repeated_windows(parts, 8)] == want
