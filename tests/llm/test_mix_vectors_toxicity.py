import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import mixing, toxicity, vectors


def sources_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).repartition(3)


def test_targets_reshare_what_is_over():
    # Weights 5, 2, 1 over 100, 10, 1000: 150% is 1665; the first stops at 200, the second at 20.
    assert mixing.targets([100, 10, 1000]) == [200.0, 20.0, 1445.0]
    t = mixing.targets([10, 10, 10, 10])
    assert sum(t) == pytest.approx(60) and max(t) <= 20 and t[1] == pytest.approx(2 * t[2])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_mix_meets_targets_and_limits(spark):
    rows = [(k, "s%d" % (k % 3) if k % 5 else None, "w " * (k * 7 % 90)) for k in range(400)]
    rows += [(7, "s1", "w " * 49), (7, "s1", "w " * 49), (None, "s2", "x y"), (900, "tiny", "one"), (901, "s0", None), (902, "s0", ""), (903, "s1", "v " * 5000)]
    docs = sources_frame(spark, rows)
    got = mixing.taken_words(docs, block=16, shards=5).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r["size"]
        s[1] += r.taken
    want = dict(zip([*sorted(x for x in by if x), None], mixing.targets([by[x][0] for x in [*sorted(x for x in by if x), None]])))
    for name, (size, taken, source_size, target) in by.items():
        assert size == source_size and target == want[name] and abs(taken - target) <= 16
    again = mixing.taken_words(docs.repartition(7), block=16, shards=5).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.taken)
    assert sorted(map(tuple, map(key, got))) == sorted(map(tuple, map(key, again)))
    assert mixing.taken_words(sources_frame(spark, [])).count() == 0


def test_permutations_hit_every_place_once():
    for size in (1, 2, 3, 5, 64, 1000):
        for key in (1, 2):
            got = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(got.tolist()) == list(range(size))


def test_draws_sum_to_the_counts():
    drawn = mixing.draw([7, 0, 5000, 31], 9, 1)
    assert drawn.sum(axis=0).tolist() == [7, 0, 5000, 31] and np.ptp(drawn.sum(axis=1)) <= 1
    counts = [5, 10**11, 0, 3 * 10**10 + 7, 1]
    drawn = mixing.draw(counts, 64, 2)
    assert drawn.min() >= 0 and drawn.sum(axis=0).tolist() == counts and np.ptp(drawn.sum(axis=1)) <= 1
    for seed in range(50):
        rng = np.random.default_rng(seed)
        left = rng.integers(0, 9, 6)
        size = int(rng.integers(0, left.sum() + 1))
        part = mixing.settled(rng.multinomial(size, np.full(6, 1 / 6)), left, size)
        assert part.sum() == size and (part >= 0).all() and (part <= left).all()


def test_mix_equals_brute_force(spark, monkeypatch):
    """Packing, draws, permutations and the join, one word at a time."""
    import xxhash

    monkeypatch.setattr(mixing, "RANGE", 7)
    rows = [(k, "s%d" % (k % 3) if k % 5 else None, "w " * (k * 7 % 40)) for k in range(120)] + [(7, "s1", "w " * 9)] * 2 + [(None, "s2", "x y"), (500, "s0", None), (501, "s0", "v " * 300)]
    docs = sources_frame(spark, rows)
    block, shards = 16, 5
    order = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")).alias("n")).collect()
    words = {}
    for k, r in sorted(enumerate(order), key=lambda x: (x[1].source is None, x[1].source or "", x[1].h, x[1].doc_id is not None, x[1].doc_id or 0, x[1].n)):
        words.setdefault(r.source, []).extend([k] * r.n)
    names = sorted(words, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([len(words[s]) for s in names])
    cut = [[words[s][at : at + block] for at in range(0, len(words[s]), block)] for s in names]
    slots = [min(round(t / (len(words[s]) / len(c))), 2 * len(c)) for s, t, c in zip(names, goal, cut)]
    drawn = mixing.draw(slots, shards, mixing.SEED)
    taken = [0] * len(order)
    for k, blocks in enumerate(cut):
        for number in range(int(drawn[:, k].sum())):
            key = xxhash.xxh64_intdigest(b"%d %d" % (k, number // len(blocks)), mixing.SEED)
            at = mixing.permuted(np.array([number % len(blocks)]), np.array([len(blocks)]), np.array([key], np.uint64))[0]
            for owner in blocks[at]:
                taken[owner] += 1
    key = lambda i, s, t: (i is not None, i or 0, s or "", t)
    got = mixing.taken_words(docs, block=block, shards=shards).collect()
    assert sorted(key(r.doc_id, r.source, r.taken) for r in got) == sorted(key(r.doc_id, r.source, t) for r, t in zip(order, taken))
    # Every slot of every shard is filled once.
    plan, mix = mixing.mixture(mixing.sized(docs, "doc_id", "text", "source"), block=block, shards=shards)
    places = {(r.shard, r.slot) for r in mix.select("shard", "slot").distinct().collect()}
    assert places == {(h, s) for h in range(shards) for s in range(int(drawn[h].sum()))} and sum(p["slots"] for p in plan) == len(places)


def test_score_equals_plain_loops():
    """Embeddings averaged over a word's n-grams and a text's words, then the softmax."""
    rng = np.random.default_rng(5)
    model = toxicity.Model()
    model.embedding[:] = rng.normal(size=model.embedding.shape)
    model.softmax[:], model.bias[:] = rng.normal(size=(2, toxicity.DIM)), (0.3, -0.2)
    hasher = toxicity.Hasher()

    def bucket(data, more):
        units = [int(hasher.byte[b]) for b in data]
        total = sum(u * pow(toxicity.Hasher.__init__.__globals__["BASE"], k, 1 << 64) for k, u in enumerate(units)) % (1 << 64)
        return int(toxicity.mix(np.array([(total + more) % (1 << 64)], np.uint64))[0]) % toxicity.BUCKETS

    texts = ["You, FOOL! be", "a", "", None, "é Straße 123 x", "one " * 70_000]
    for text, got in zip(texts, model.scorer().score(toxicity.pa.array(texts), hasher)):
        vectors = []
        for word in toxicity.clean(text).split()[:50]:
            edged = b" " + word + b" "
            places = [bucket(word, 0)] + [bucket(edged[i : i + n], n) for n in toxicity.GRAMS for i in range(len(edged) - n + 1)]
            vectors.append(np.mean([model.embedding[p] for p in places], axis=0))
        hidden = np.mean(vectors, axis=0) if vectors else np.zeros(toxicity.DIM)
        logits = model.softmax @ hidden + model.bias
        want = np.exp(logits[1]) / np.exp(logits).sum()
        assert got == pytest.approx(want, rel=1e-3)


def brute_vectors(rows, cosine):
    good = [(i, k, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.stack([v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, _, v in good])
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    links = {k: 0 for k in range(len(rows))}
    links.update({good[a][1]: int(near[a].sum()) for a in range(len(good))})
    label = list(range(len(good)))
    while True:
        new = [min([label[a], *(label[b] for b in np.flatnonzero(near[a]))]) for a in range(len(good))]
        if new == label:
            break
        label = new
    low = {}
    for a, (i, _, _) in enumerate(good):
        if i is not None:
            low[label[a]] = min(low.get(label[a], i), i)
    comp = {k: i for k, (i, _) in enumerate(rows)}
    comp.update({good[a][1]: low.get(label[a]) for a in range(len(good))})
    return sorted((i if i is not None else -1, links[k], comp[k] if comp[k] is not None else -1) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [2048, 5])
def test_vector_links_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=8)
        rows += [(centre + rng.normal(size=8) * 0.05).tolist() for _ in range(rng.integers(1, 9))]
    rows += [rows[0], rows[0], [x * 3 for x in rows[1]], [1e-300] * 8, [1e300] * 8, [0.0] * 8, None, [], [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [-0.0, 1.0] + [0.0] * 6, [0.0, 1.0] + [0.0] * 6]
    rows = [(k if k % 9 else None, v) for k, v in enumerate(rows, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("pivot", F.lit("x"))
    # Every pivot is in every prefix here, so the index itself can miss nothing.
    got = vectors.near_duplicates(df, prefix=40, shared=1, chunk=chunk).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component if r.component is not None else -1) for r in got) == brute_vectors(rows, 0.95)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component) for r in got)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def toxic_rows():
    import random

    rng = random.Random(2)
    syllables = ["ra", "ton", "mel", "ig", "sto", "pu", "len", "ka", "vor", "ish"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    bad = ["dreadful", "rotten", "vile"]
    docs, labels = [], []
    for k in range(1, 1201):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    docs, labels = toxic_rows()
    extra = [(5000, None), (5001, ""), (5002, "..."), (None, "ka ton"), (5003, "mel ig dreadfull rottten ka"), (5004, "ka mel " * 60000), (8, dict(docs)[8])]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", F.lit(3)).withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame(labels + [(None, 1), (77777, 1), (9, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    model = toxicity.train(frame, marks)
    got = toxicity.score_texts(frame, model).collect()
    assert len(got) == len(docs) + len(extra)
    label = dict(labels)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in test) >= 0.95 * len(test) > 100
    by = {r.doc_id: r for r in got}
    assert by[5003].predicted == 1 and by[5004].predicted == 0 and by[5001].predicted == 0
    assert by[5000].score == by[5001].score == by[5002].score
    empty = toxicity.train(frame, marks.limit(0))
    assert toxicity.score_texts(frame.limit(0), empty).count() == 0


def test_no_link_is_missed_with_the_production_prefix_and_most_pivots(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOTS_FROM", vectors.PIVOTS_TO)
    rng = np.random.default_rng(5)
    base, off = rng.normal(size=(2, 4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.96, (4000, 1))  # just above the bound, where orders of pivots differ most
    rows = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * off])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame).collect()}
    want = (rows @ rows.T >= vectors.COSINE).sum(axis=1) - 1
    assert want.sum() >= 8000 and [got[k] for k in range(8000)] == want.tolist()


def test_toxicity_without_both_kinds_gives_the_prior(spark):
    docs = spark.createDataFrame([(k, "some text %d" % k) for k in range(40)] + [(99, None)], "doc_id long, text string")
    for kinds, low, high in (((), 0.24, 0.26), ((0,), 0.0, 0.1), ((1,), 0.8, 1.0)):
        labels = spark.createDataFrame([(k, 0, kind) for kind in kinds for k in range(40)], "doc_id long, quality int, toxic int")
        scores = {r.score for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect()}
        assert len(scores) == 1 and low <= scores.pop() <= high
