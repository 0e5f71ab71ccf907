import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from test_repeats import brute  # noqa: E402
from test_tokens_passages import brute_components, brute_fp, brute_hits

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    syllables = ["ra", "ton", "mel", "ig", "sto", "pu", "len", "ka", "vor", "ish", "é"]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    bad = ["dreadful", "rotten", "vile"]
    bench = [(k, text(rng.choice([5, 20, 40]))) for k in range(12)]
    passage = text(60)
    texts, labels = [], []
    for k in range(400):
        body = text(rng.randint(3, 90)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(max(2, len(body) // 15)):
                body.insert(rng.randrange(len(body)), rng.choice(bad))
        if k % 17 == 1:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        if k % 23 == 2:
            body[len(body) // 2 : len(body) // 2] = rng.choice(bench)[1].split()
        texts.append("\n".join(body[: len(body) // 3]) + "  " + " ".join(body[len(body) // 3 :]))
        labels.append((k, 0, int(toxic)))
    for k in (5, 6, 7, 9):
        texts += [texts[k]] * 3 + [texts[k] + " tail"]
    texts += [None, "", None]
    rows = [(k if k != 300 else None, t, "xx", "src%d" % (k % 4) if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[10], rows[10]]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_every_stage_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "decontaminate", "mix"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "mix":
            assert docs.columns == names
        if name == "toxicity":
            assert {key(r) for r in after} <= {key(r) for r in before}
            gone = [r for r in before if key(r) not in {key(x) for x in after}]
            assert sum(r.doc_id in toxic for r in gone) >= 0.95 * sum(r.doc_id in toxic for r in before) and len(gone) <= len(toxic) + 8
        elif name == "near_duplicates":
            comp = brute_components(range(len(before)), [brute_fp(r.text) for r in before], 4)
            groups = {}
            for k, c in comp:
                groups.setdefault(c, []).append(before[k])
            assert len(after) == len(groups) < len(before)
            assert sorted(map(key, after)) == sorted(key(min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0))) for g in groups.values())
        elif name == "substrings":
            words = [(r.text or "").encode().split() for r in before]
            gone = brute(words, 35)
            assert sum(map(len, gone)) > 500
            want = []
            for r, w, g in zip(before, words, gone):
                t = b" ".join(x for k, x in enumerate(w) if k not in g).decode() if g else r.text or ""
                want.append((r.doc_id, t, r.lang, r.source, len(t)))
            assert sorted(map(key, after)) == sorted(map(key, want))
        elif name == "decontaminate":
            hit = [brute_hits(r.text, bench, 13) for r in before]
            want = [r for r, (n, h, _) in zip(before, hit) if not (h > 0 and 20 * h >= n)]
            assert len(want) < len(before) and sorted(map(key, after)) == sorted(map(key, want))
        else:
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            assert all(0 < r.taken <= 2 * r["size"] for r in after)
            by = {r.doc_id: size(r) for r in before}
            assert all(by[r.doc_id] == r["size"] for r in after)
            assert sum(r.taken for r in after) == pytest.approx(1.5 * sum(map(size, before)), rel=0.05)
        before = after


def test_registered_queries_and_the_rest_without_them(spark, sf_dir, monkeypatch):
    import importlib

    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)} == set(range(1, 14))
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    left = set(importlib.reload(entry).queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert left == {n for n in names if not re.match(r"op\d|pipeline", n)}
