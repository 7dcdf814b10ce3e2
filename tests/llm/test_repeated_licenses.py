"""Licenses that stand in a text many times in a row."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from citemill.llm import license_scan


@pytest.mark.parametrize("name", ["mit-notice", "apache-2.0-notice", "gpl-3.0-notice", "mit"])
@pytest.mark.parametrize("copies", [1, 2, 3, 5, 7, 15, 100])
def test_consecutive_licenses(name, copies):
    notice = license_scan.TEMPLATES[name]
    text = "some other words " * 7 + " ".join([notice] * copies) + " and then more words" * 7
    found = license_scan.Scanner().scan(text)
    first, step = len("some other words " * 7), len(notice) + 1
    assert [(f.license, f.start, f.coverage) for f in found] == [(name, first + k * step, 1.0) for k in range(copies)]


@pytest.mark.parametrize("name", list(license_scan.TEMPLATES))
def test_noisy_copies_in_a_row(name):
    """Copies with a tenth of their words replaced are found in a row as they are one by one."""
    r, template = random.Random(7), license_scan.words_of(license_scan.TEMPLATES[name])[0]
    copies = []
    for _ in range(30):
        words = list(template)
        for at in r.sample(range(len(words)), max(1, len(words) // 10)):
            words[at] = f"zz{r.randrange(10**6)}"
        copies.append(" ".join(words))
    scanner = license_scan.Scanner()
    alone = sum(any(f.license == name for f in scanner.scan(c)) for c in copies)
    found = scanner.scan(" ".join(copies))
    assert alone > 20 and sum(f.license == name for f in found) == alone
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def test_windows_apart_match_most_words():
    r = random.Random(3)
    for _ in range(200):
        windows = {(s, s + r.randint(1, 6), r.randint(1, 9)) for s in (r.randrange(15) for _ in range(r.randint(0, 8)))}
        most = 0
        for k in range(len(windows) + 1):
            for some in combinations(sorted(windows), k):
                if all(a[1] <= b[0] for a, b in zip(some, some[1:])):
                    most = max(most, sum(w[2] for w in some))
        found = license_scan.apart(windows)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:])) and set(found) <= windows and sum(w[2] for w in found) == most
