import base64
import hashlib
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from evalspark.llm import queries, secrets

P = pytest.importorskip("public_tokenizers")

# The rules as they are stated, each over the whole text.
RULES = [
    ("assign", re.compile("""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def brute(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, rule, group, least) in enumerate(RULES) for m in rule.finditer(text or "") if len(m.group(group)) >= least]
    return [(kind, lo, hi) for lo, _, kind, hi in sorted(found)]


def cases():
    rng = random.Random(8)
    pick = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    parts = ["token", "TOKEN", "apikey", "Api_Key", "secret", "passwd", "password", "PASSword", "toKen", "ſecret", ":", "=", " ", "  ", '"', "'", "é", "AKIA", "AKIA" + pick(16, "ABC12"), pick(5, "abc"), pick(6, "ab=-"), pick(24, "0123456789abcdef"), pick(23, "0123456789abcdef"), pick(30, string.ascii_letters + string.digits), "\n", ",", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    return texts + ["", None, "token=token: abcdefgh", "x" * 300_000 + " password = hunter22", "deadbeef" * 5000, "AKIA" * 9]


def test_base_spans_equal_the_rules(spark):
    texts = cases()
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("k", F.monotonically_increasing_id()).repartition(3)
    found = secrets.scan(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, "doc_id", "k")
    order = {r.k: r for r in docs.select("k", "text").collect()}
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        text = order[r._row.k].text
        assert [(s.kind, s.lo, s.hi) for s in r.spans if s.kind != "random"] == brute(text)
        for s in r.spans:
            if s.kind == "random":
                assert not any(a < s.hi and s.lo < b for _, a, b in brute(text))
    assert found.where(F.exists("spans", lambda s: s["kind"] == "random")).count() > 100


def test_random_strings_found_and_harmless_ones_left(spark):
    encode = secrets.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    rng = random.Random(2)
    alphabet = string.ascii_letters + string.digits
    keys = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 24, 32, 40, 64) for _ in range(200)]
    keys += [base64.b64encode(rng.randbytes(24)).decode() for _ in range(200)]
    missed = [k for k in keys if [s[2] for s in secrets.find("see %s here" % k, encode)] != ["random"]]
    assert len(missed) <= 0.03 * len(keys)
    for text in (
        "getUserAccountDetails2", "my_package_name_here", "HTTPResponseCode404", "x86-64-unknown-linux-gnu", "INTERNALSERVERERROR", "Donaudampfschifffahrtsgesellschaft",
        "2024-01-05T12-30-45Z", "4024007198764310", "order-2024-000123-item-77", "550e8400-E29B-41d4-a716-446655440000", hashlib.md5(b"x").hexdigest().upper(), "a/path/to/some/file/name", "=" * 40, "-" * 50, "",
    ):
        assert not secrets.find(text, encode), text
    # A digest is a base match all the same.
    assert [s[2] for s in secrets.find(hashlib.sha1(b"x").hexdigest(), encode)] == ["hex"]


def test_query_columns(spark, tmp_path):
    rows = [(1, 'token = "%s" and AKIA%s' % ("ab" * 20, "Q7" * 8)), (2, None), (3, "kX9fQ2mZ7vB4nL8sT1wR6yP3 password:abc123")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op13_secrets"](spark, str(tmp_path)).collect()}
    for doc, text in rows:
        base = brute(text)
        assert got[doc].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % b for b in base).encode()).hexdigest()
        assert [got[doc]["n_" + k] for k in ("assign", "access", "hex")] == [sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]
    assert got[1].n_assign == got[1].n_access == got[1].n_hex == 1 and got[2].spans == ""
    assert got[3].spans == "random:0:24,assign:25:40"
