import hashlib
import random

import numpy as np
import pytest
from dispatchlake.llm import vectorcodes
from dispatchlake.llm.vectorcodes import Codebooks, ceil_root, compress, floor_root, train

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, k=16, rounds=6):
    """The same by comparing everything with every entry."""
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and len(vector) and len(vector) % parts == 0 and all(v is not None and np.isfinite(v) for v in vector):
            kept.append((vec_id, [int(np.floor(float(np.float32(v)) * 4096)) for v in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:k]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for _, v, _ in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for m, e in zip(members, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found, by_label = [], {}
    for vec_id, v, label in kept:
        each = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in each)
        by_label[label] = by_label.get(label, 0) + error
        found.append((vec_id, "".join(f"{i:02x}" for _, i in each), error, label))
    return sorted((v, c, e, by_label[lab], sha) for v, c, e, lab in found if v is not None), len(found)


def vectors(rng, n, dim, spread=0.4, steps=None):
    draw = (lambda: rng.gauss(0, spread)) if steps is None else (lambda: rng.randrange(-steps, steps + 1) / 4096)
    return [(i * 3 % 1000 + i // 1000, [draw() for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "steps"), [(300, 16, None), (300, 8, 2), (9, 24, None), (400, 16, 1)])
def test_against_every_entry(spark, n, dim, steps):
    rng = random.Random(n + dim)
    rows = vectors(rng, n, dim, steps=steps)
    rows += [(5000, None, 1), (5001, [None] + [0.0] * (dim - 1), 1), (5002, [float("nan")] * dim, 1), (-1, [float("inf")] * dim, 1), (5003, [0.5] * (dim + 8), 2), (-2, [0.1] * 3, 0), (-3, [], 0)]
    rows += [rows[5], rows[5], (None, [0.2] * dim, 1)]
    got = [tuple(r) for r in compress(spark.createDataFrame(rows, ROWS).repartition(5)).collect()]
    want, n_kept = plain(rows)
    assert len(got) == n_kept
    assert sorted(g for g in got if g[0] is not None) == want


def test_bounds_spare_distances_and_extra_columns(spark, monkeypatch):
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[i % 16]], i % 3) for i in range(640)]
    table = spark.createDataFrame(rows, ROWS)
    _, _, computed = train(table)
    assert computed[0] == 640 * 8 * 17 and max(computed[1:]) < computed[0] / 4
    monkeypatch.setattr(vectorcodes, "BROADCAST", 0)
    wide = table.selectExpr("*", "'x' as code", "1 as error", "2 as x", "3 as l")
    assert sorted(map(tuple, compress(wide).collect())) == plain(rows)[0]


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")] * 8, 1)], [(1, [0.5] * 7, 1)]):
        out = compress(spark.createDataFrame(rows, ROWS))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0


def test_roots_and_unused_entries():
    n = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**62 - 1, 2**62, (2**31 - 1) ** 2, (2**31 - 1) ** 2 - 1, 2**63 - 1])
    assert all(r * r <= v < (r + 1) ** 2 for r, v in zip(floor_root(n).tolist(), n.tolist(), strict=True))
    assert all((r - 1) ** 2 < v <= r * r or v == r == 0 for r, v in zip(ceil_root(n[:-1]).tolist(), n[:-1].tolist(), strict=True))
    books = Codebooks.start(np.arange(32).reshape(2, 16), 8)
    moved = books.moved(np.full(books.entries.shape, -3), np.tile([2, 0], (8, 1)))
    assert (moved.entries[:, 0] == -2).all() and (moved.entries[:, 1] == books.entries[:, 1]).all()
