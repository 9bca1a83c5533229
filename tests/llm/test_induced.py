import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sylva.llm import induced


def check(symbols):
    t = np.array([*symbols, 0], np.uint16)
    sa = induced.suffix_array(t, int(t.max()) + 1)
    s = t.tolist()
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    plcp = induced.permuted_common_prefixes(t, sa)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
            n += 1
        assert plcp[b] == n


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_small_alphabet(x):
    check(x)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 250), max_size=80), st.integers(1, 5))
def test_repeats(x, k):
    check((x * k)[:200])


@pytest.mark.parametrize("wide", [2, 1 << 20])
def test_both_ways_of_inducing(monkeypatch, wide):
    monkeypatch.setattr(induced, "_WIDE", wide)
    rng = np.random.default_rng(3)
    for _ in range(50):
        check((rng.integers(1, 4, 90).tolist() * 3)[: rng.integers(1, 260)])
