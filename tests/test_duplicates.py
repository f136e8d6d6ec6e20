"""Probable duplicates against a plain comparison of all pairs."""

import itertools
import random

import pytest

from kinloom.operators import rules

BLOCK = ["doc_id", "surname"]
SCHEMA = "doc_id string, xref string, line_number long, given string, surname string, sex string, year int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def confidence(p, q):
    if p[0] != q[0] or p[4] != q[4] or not p[3] or not q[3] or not p[4]:
        return None
    alike = 1.0 if p[3] == q[3] else 1 - distance(p[3], q[3]) / max(len(p[3].encode()), len(q[3].encode()))
    apart = None if p[6] is None or q[6] is None else abs(p[6] - q[6])
    found = 0.3 + 0.3 * alike + (0.2 if apart == 0 else 0.1 if apart is not None and apart <= 2 else 0.0) + (0.1 if p[5] and p[5] == q[5] else 0.0)
    return round(found, 6) if alike >= 0.8 and found >= 0.7 else None


def people(n):
    draw = random.Random(5)
    given, surnames = ["johann", "johannes", "johan", "jörgen", "jorgen", "anna", "", None], ["berg", "borg", "", None]
    rows = [("d" + draw.choice("12"), f"@I{i}@", i, draw.choice(given), draw.choice(surnames), draw.choice(["M", "F", "", None]), draw.choice([None, 1800, 1801, 1803])) for i in range(n)]
    return rows + [("d1", f"@C{i}@", n + i, "karl", "berg", "M", 1850) for i in range(40)]


def all_pairs(rows):
    return sorted((p[0], p[1], q[1], c) for p, q in itertools.combinations(rows, 2) if (c := confidence(p, q)) is not None)


def test_pairs_and_links_hold_every_pair(spark):
    rows = people(150)
    frame = spark.createDataFrame(rows, SCHEMA)
    expected = all_pairs(rows)
    assert sorted((r.doc_id, r.left, r.right, round(r.confidence, 6)) for r in rules.duplicate_pairs(frame, BLOCK).collect()) == expected
    classes = rules.duplicate_classes(frame, BLOCK)
    of = {(r.doc_id, r.xref): r["class"] for r in rules.duplicate_members(frame, classes, BLOCK).collect()}
    assert len(of) == sum(bool(r[3] and r[4]) for r in rows)
    links = {(r.doc_id, r.left, r.right): r for r in rules.duplicate_links(classes, BLOCK).collect()}
    assert {(d, *sorted((of[d, a], of[d, b]))) for d, a, b, _ in expected} == {(d, *sorted((a, b))) for d, a, b in links}
    count = lambda r: r.left_members * (r.left_members - 1) // 2 if r.left == r.right else r.left_members * r.right_members
    assert sum(map(count, links.values())) == len(expected)
    copies = [r for (d, a, b), r in links.items() if a == b == "@C0@"]
    assert [(r.left_members, round(r.confidence, 6)) for r in copies] == [(40, 0.9)]


@pytest.mark.parametrize("rows", [[], [("d", "@I1@", 1, "anna", "berg", "F", 1800)], [("d", "@I1@", 1, None, None, None, None)] * 3])
def test_none(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rules.duplicate_links(rules.duplicate_classes(frame, BLOCK), BLOCK).isEmpty()
    assert rules.duplicate_pairs(frame, BLOCK).isEmpty()
