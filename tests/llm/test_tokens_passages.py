import hashlib
import os
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, simhash, tokens

P = pytest.importorskip("public_tokenizers")
ROWS = [
    (1, "The quick brown fox,\njumps over. the lazy dog"), (2, None), (3, ""), (None, "The quick brown fox,\njumps over. the lazy dog"),
    (3, ""), (4, "x" * 5000), (5, " a  b\t c\x85 d\x1c e \n f<|endoftext|> g<|endoftext|>"), (6, "it's 12,5 don't! été. 中文 İ \U0001f600"), (7, "ab cd " * 40000),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n_words", F.lit(0))


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    encoder = Tokenizer.from_file(path)
    want = sorted((i or -1, len((t or "").encode()), len(encoder.encode(t or "", add_special_tokens=False))) for i, t in ROWS)
    got = tokens.count_tokens(docs(spark), path).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(docs(spark, []), path).count() == 0


def test_counts_stay_right_when_memory_is_emptied(spark):
    counter = tokens.Counter(P.path("byte_bpe_50k.json"), batch_bytes=40, keep=3)
    texts = [t for _, t in ROWS[:7]] * 2
    assert counter.count(texts) == [len(counter.encoder.encode(t or "", add_special_tokens=False)) for t in texts]


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d if d is not None else -1, low.get(find(i), -1)) for i, d in enumerate(ids))


def test_simhash_components_equal_brute_force(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.component if r.component is not None else -1) for r in got) == brute_components([i for i, _ in ROWS], [brute_fp(t) for _, t in ROWS], 4)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got if r.doc_id} == {i: brute_fp(t) for i, t in ROWS if i}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_lose_nothing_in_dense_and_cut_buckets(spark):
    import random

    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (2**64 - 1))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    from evalspark.llm.common import components

    for chunk in (4096, 7):
        root = {r.node: r.root for r in components(simhash.links(frame, chunk=chunk), "a", "b").collect()}
        groups = {}
        for k, f in enumerate(signed):
            groups.setdefault(root.get(f, f), []).append(k)
        brute = {}
        for k, c in brute_components(range(len(fps)), fps, 4):
            brute.setdefault(c, []).append(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def brute_hits(text, items, window):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    words, hit, found = word(text), set(), set()
    for item, body in items:
        own = word(body)
        for at in range(max(1, len(own) - window + 1) if own else 0):
            part = own[at : at + window]
            for k in range(len(words) - len(part) + 1):
                if words[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("shard_words", [2_000_000, 9])
def test_decontamination_equals_brute_force(spark, shard_words):
    items = [(10, "a b c d e f g"), (9, "c D, e"), (2, "xÉ y"), (3, None), (4, ""), (5, "q r s"), (6, "q r s"), (7, "!!")]
    rows = [(1, "zz A b C! d e f g h"), (2, None), (3, ""), (4, "c d e c d e"), (5, "xÉ-y xé y"), (None, "b c d e f q r s"), (5, "xÉ-y xé y"), (6, "c.d.e " * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    found = decontaminate.contaminated(decontaminate.find_passages(docs(spark, rows), bench, "doc_id", window=4, shard_words=shard_words)).collect()
    want = sorted((i or -1, *brute_hits(t, items, 4)) for i, t in rows)
    assert sorted((r._row.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in found) == want
    for r in found:
        assert r.n_items == len(r["items"]) and r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert [r.spans for r in found if r._row.doc_id == 1] == [[(3, 17)]]
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.find_passages(docs(spark, rows), none, "doc_id").collect()} == {0}
    assert decontaminate.find_passages(docs(spark, []), bench, "doc_id").count() == 0
