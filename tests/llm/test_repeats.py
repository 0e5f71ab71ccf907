import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import bwt, debruijn
from evalspark.llm.repeats import sliding_min


def brute(units, window):
    """Covered positions of each sequence."""
    seen = {}
    for i, u in enumerate(units):
        for p in range(len(u) - window + 1):
            seen.setdefault(tuple(u[p : p + window]), []).append((i, p))
    out = [set() for _ in units]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i].update(range(p, p + window))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = lambda n, v: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") * rng.randint(1, 3) + str(rng.randrange(v)) for _ in range(n))
    shared = [words(60, 50) for _ in range(4)]
    rows = [words(rng.randint(0, 40), 40) for _ in range(10)]
    for _ in range(25):
        part = rng.choice(shared)
        lo, hi = sorted(rng.sample(range(len(part)), 2))
        rows.append(words(rng.randint(0, 20), 50) + " " + part[lo:hi] + " " + words(rng.randint(0, 20), 50))
    near = words(80, 60).split()
    for _ in range(12):
        own = near[:]
        own[rng.randrange(80)] = "changed%d" % rng.randrange(9)
        rows.append(" ".join(own))
    rows += [rows[12]] * 3 + ["", None, None, "be " * 60, "be " * 61, "x" * 200, "ab" * 90, " \t\n ", "é" * 70]
    return [(k if k % 7 else None, t) for k, t in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("mkey", F.lit(1)).withColumn("_row", F.lit(2)).repartition(5)


@pytest.mark.parametrize("most", [20_000, 2])
def test_repeated_bytes_equal_brute_force(spark, most):
    rows = texts(1)
    data = [(t or "").encode() for _, t in rows]
    gone = brute(data, 40)
    want = sorted((r[0] or -1, len(d), len(g), bytes(b for k, b in enumerate(d) if k not in g)) for r, d, g in zip(rows, data, gone))
    got = bwt.drop_repeats(frame(spark, rows), "doc_id", window=40, gram=10, most=most).collect()
    assert sorted((r._row.doc_id or -1, r.n_units, r.n_removed, bytes(r.kept)) for r in got) == want
    assert all(sum(s.hi - s.lo for s in r.spans) == r.n_removed for r in got)


def test_repeated_words_equal_brute_force(spark):
    rows = texts(2)
    data = [(t or "").encode().split() for _, t in rows]
    gone = brute(data, 12)
    want = sorted((r[0] or -1, len(d), len(g), b" ".join(w for k, w in enumerate(d) if k not in g)) for r, d, g in zip(rows, data, gone))
    got = debruijn.drop_repeats(frame(spark, rows), "doc_id", window=12, gram=3).collect()
    assert sorted((r._row.doc_id or -1, r.n_units, r.n_removed, bytes(r.kept)) for r in got) == want


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    from evalspark.llm import repeats

    monkeypatch.setattr(repeats, "SEGMENT", 128)
    rows = texts(3)
    data = [(t or "").encode().split() for _, t in rows]
    gone = brute(data, 12)
    hasher = repeats.Hasher()
    seen = {}
    units = [hasher.words((t or "").encode()) for _, t in rows]
    for found in repeats.runs_of(units, 12, 3, hasher):
        for doc, at, n in zip(found["doc"], found["at"], found["n"]):
            for k in range(at, at + n):
                seen.setdefault((doc, k), 0)
                seen[doc, k] += 1
    assert seen == {(i, p): 1 for i, u in enumerate(units) for p in range(len(u) - 11)}
    assert sum(map(len, gone)) > 0


def test_empty_table(spark):
    assert bwt.drop_repeats(frame(spark, []), "doc_id").count() == 0
    assert debruijn.drop_repeats(frame(spark, []), "doc_id").count() == 0


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 99, 57).astype(np.uint64)
    for w in (1, 2, 5, 57):
        assert sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(len(v) - w + 1)]


def brute_bytes(texts, window):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - window + 1):
            seen.setdefault(t[p : p + window], []).append((i, p))
    out = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i].update(range(p, p + window))
    return out


def test_production_windows_equal_brute_force(spark):
    """400 bytes and 35 words, passages around both lengths, overlaps and repeats in one text."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [words(n) for n in (34, 35, 36, 60, 75, 140)]
    data = [words(rng.randint(0, 60)) for _ in range(4)]
    for k in range(14):
        p = passages[k % 6]
        cut = p.split()[: rng.randint(30, 200)] if k % 3 else p.split()
        data.append(words(rng.randint(0, 30)) + " " + " ".join(cut) + " " + words(rng.randint(0, 30)))
    data += [data[5], data[6] + " " + data[6], "ab " * 400, "x" * 399, "x" * 400, "x" * 401, "", None]
    rows = [(k, t) for k, t in enumerate(data)]
    raw = [(t or "").encode() for t in data]
    gone = brute_bytes(raw, 400)
    got = {r._row.doc_id: bytes(r.kept) for r in bwt.drop_repeats(frame(spark, rows), "doc_id").collect()}
    assert got == {k: bytes(b for j, b in enumerate(t) if j not in g) for k, (t, g) in enumerate(zip(raw, gone))} and sum(map(len, gone)) > 4000
    units = [t.split() for t in raw]
    gone = brute(units, 35)
    got = {r._row.doc_id: bytes(r.kept) for r in debruijn.drop_repeats(frame(spark, rows), "doc_id").collect()}
    assert got == {k: b" ".join(w for j, w in enumerate(u) if j not in g) for k, (u, g) in enumerate(zip(units, gone))} and sum(map(len, gone)) > 500
