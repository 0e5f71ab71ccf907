import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from evalspark.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else "%d:%s" % (len(str(v).encode()), v)


def tree(leaves):
    """(root, proof sibling lists, postorder log) by plain recursion over levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[k : k + 2]) for k in range(0, len(now), 2)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            other = k ^ 1
            path.append((0, None) if other >= len(level) else (2 if other > k else 1, level[other]))
            k //= 2
        paths.append(path)

    def post(lv, k):
        below = [] if not lv else [x for c in (2 * k, 2 * k + 1) if c < len(levels[lv - 1]) for x in post(lv - 1, c)]
        return [*below, levels[lv][k]]

    return levels[-1][0], paths, post(len(levels) - 1, 0)


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(["en", "en", "en", "fr", None, "ä", "", "-"])
        out.append((k * 3 + 1, rng.choice(["s", None, "é" * 5]), lang, rng.choice([None, k, 2**31 - 1]), rng.choice([None, "", "text %d é" % k, "x" * 5000])))
    # Repeated rows, one id twice, null ids
    return out + [out[0], out[0], (out[1][0], "other", out[1][2], 1, "t"), (None, "s", "en", 4, "no id"), (None, None, None, None, None)]


def brute(data, everyth=7):
    leaf = lambda r, n: H(enc(r[0]), enc(r[1]), enc(r[2]), enc(n), enc(r[4]))
    groups = {}
    for r in data:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[3]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        built[g] = tree([x[2] for x in groups[g]])
    root, above, _ = tree([built[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        sub, paths, _ = built[g]
        for (_, _, own, r), path in zip(groups[g], paths):
            whole = path + above[k]
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % everyth == 0
            node = leaf(r, r[3] + 1) if hit else own
            for side, other in whole:
                node = H(node) if side == 0 else H(other, node) if side == 1 else H(node, other)
            out.append((r[0], own, sub, root, H(*[o for _, o in whole if o]), node, node == root))
    return out, {k: built[g][2] for k, g in enumerate(order)}


def test_positions_are_postorder():
    for n in range(1, 70):
        leaves = [str(k) for k in range(n)]
        root, paths, log = tree(leaves)
        height = merkle.height_of(n)
        assert merkle.build(leaves, height) == log and log[-1] == root
        assert sorted(merkle.position(lv, k, n) for lv in range(height + 1) for k in range(merkle.width(lv, n))) == list(range(len(log)))
        for k in range(n):
            assert merkle.siblings(log, k, n, height) == paths[k]
            assert merkle.fold(leaves[k], paths[k]) == root


@pytest.mark.parametrize("n,bits", [(300, 2), (300, 10), (0, 3), (1, 1)])
def test_manifest_equals_brute_force(spark, n, bits):
    data = rows(n) if n > 1 else [(7, None, None, 1, "only")] * n
    docs = spark.createDataFrame(data, SCHEMA).withColumn("tree", F.lit("clash")).withColumn("_id", F.lit(1)).repartition(5)
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    made = merkle.build_manifest(docs, changed={"n_chars": more}, where=merkle.tampered(), bits=bits)
    got = [
        (r._id, r.leaf, r.subroot, made.root, H(*[p.digest for p in r.path if p.digest]), r.folded, r.verified)
        for r in merkle.proofs(made).collect()
    ]
    if not data:
        assert got == [] and made.root is None and merkle.log(made).count() == 0
        return
    want, logs = brute(data)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert n == 1 or {x[-1] for x in got} == {True, False}
    found = {}
    for r in merkle.log(made).collect():
        found.setdefault(r.tree, {})[r.position] = r.node
    assert {t: [v for _, v in sorted(x.items())] for t, x in found.items()} == logs


def test_query_counterpart(spark):
    duckdb = pytest.importorskip("duckdb")
    data = rows(120, 3)[:120]
    frame = spark.createDataFrame(data, SCHEMA).toPandas()
    con = duckdb.connect()
    con.register("p", frame)
    con.execute("CREATE VIEW documents AS SELECT doc_id, source, lang, CAST(n_chars AS INT) AS n_chars, text FROM p")
    got = con.execute(merkle.oracle()).fetchall()
    assert sorted(got) == sorted(brute(data)[0])
