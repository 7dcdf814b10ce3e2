"""License findings against a quadratic aligner over all windows, and the time of license-dense texts."""

import random
import time

from citemill.llm import license_scan
from citemill.llm.license_scan import TEMPLATES, Scanner, words_of


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            row[j + 1], before = max(row[j + 1], row[j], before + (x == y)), row[j + 1]
    return row[-1]


def test_against_all_windows():
    r = random.Random(11)
    names = [n for n in TEMPLATES if len(words_of(TEMPLATES[n])[0]) < 40]
    scanner = Scanner()
    filler = "data model water the of and license software text public version under work this released".split()
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            words = TEMPLATES[r.choice(names)].split()
            for _ in range(r.randint(0, 3)):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = [r.choice(filler)] * r.randint(0, 1)
            parts += [*(r.choice(filler) for _ in range(r.randint(0, 12))), *words]
        text = " ".join(parts)
        words, starts, ends = words_of(text)
        found = scanner.scan(text)
        for f in found:
            template = scanner.templates[f.license]
            inside = words[starts.index(f.start) : ends.index(f.end) + 1]
            assert license_scan.COVERAGE <= f.coverage <= common(inside, template) / len(template) + 1e-6
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))
        for name in names:
            template = scanner.templates[name]
            for at in range(len(words) - len(template) + 1):
                window = words[at : at + len(template)]
                if common(window, template) >= 0.9 * len(template):
                    assert any(f.start < ends[at + len(template) - 1] and f.end > starts[at] for f in found), (name, text)


def test_every_template_is_found_whole():
    for name, text in TEMPLATES.items():
        assert [(f.license, f.coverage) for f in Scanner().scan(f"before it {text} after it")] == [(name, 1.0)]


def test_time_grows_with_the_text():
    scanner = Scanner()
    took = []
    for n in (2000, 20000):
        start = time.process_time()
        assert len(scanner.scan("some words Released under the MIT License. " * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 20 * took[0] + 0.5
