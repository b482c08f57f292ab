"""The subsequence kernel against enumeration."""

from itertools import combinations

import numpy as np
import pytest

from trackweave.llm.toxicity import DECAY, LONG, ORDER, Evidence, beginnings, kernels

STRINGS = [b"idiot", b"ixdixotic", b"abc", b"aaaa", b"st1up1id", "chóng".encode(), b"s" * 30]
LANDMARKS = [b"idiot", b"stupid", b"abcabc", b"aaaaa"]


def kernel(left, right):
    """Every pair of equal subsequences, each with the stretch that it takes."""
    return sum(
        DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        for a in combinations(range(len(left)), ORDER)
        for b in combinations(range(len(right)), ORDER)
        if [left[i] for i in a] == [right[j] for j in b]
    )


def similarity(left, right):
    own = kernel(left, left) * kernel(right, right)
    return kernel(left, right) ** 2 / own if own else 0.0


def test_kernels_equal_enumeration():
    strings = [s for s in STRINGS if len(s) < 10]
    want = [[kernel(s, m) for m in LANDMARKS] for s in strings]
    assert kernels(strings, LANDMARKS) == pytest.approx(np.array(want), rel=1e-5)
    assert kernels(strings)[:, 0] == pytest.approx([kernel(s, s) for s in strings], rel=1e-5)


def test_beginnings_are_kernels_of_cut_strings():
    strings, lengths = [s for s in STRINGS if len(s) < 10], [3, 5, 6, 40]
    roots = np.sqrt(kernels(LANDMARKS)[:, 0])
    got = beginnings(strings, LANDMARKS, roots, lengths)
    want = [[max(similarity(s[:k], m) for k in [*lengths, len(s)]) for m in LANDMARKS] for s in strings]
    assert got == pytest.approx(np.array(want), rel=1e-4)


def test_words_of_every_length_and_sign():
    evidence = Evidence([b"stupid"])
    long = b"q" * (LONG * 3) + b"stupid"
    evidence.of({b"", b"..", b"ab", b"s.t-u*p.i.d", b"stupidity", b"clean", long})
    found = {w: None if v is None else float(v[0]) for w, v in evidence.known.items()}
    assert found[b"s.t-u*p.i.d"] == found[b"stupidity"] == pytest.approx(1, abs=1e-5)
    assert [w for w, v in found.items() if v is None and w not in (b"", b"..", b"ab", b"clean")] in ([], [long])
    assert len(found) == 7
