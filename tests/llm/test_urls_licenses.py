import re

from pyspark.sql import functions as F

from evalspark.llm import licenses, urls
from evalspark.llm.common import components


def test_components_of_chains_stars_and_cliques(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(a, b) for a in range(300, 306) for b in range(300, 306)] + [(None, 1), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {k: 100 for k in range(101, 141)} | {k: 7 for k in range(200, 260)} | {k: 300 for k in range(301, 306)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rules_and_aliases(spark):
    canonical = '<LINK href="%s" rel=canonical>'
    rows = [
        (1, "http://a.Example.NET/en/x?q#f", ""), (2, "http://a.example.net/de", ""), (3, "http://net", ""), (4, "https://x.net/", None), (5, None, None), (6, "no host", ""),
        (7, "http://example.com/de/y", ""), (8, "http://good.org/fr/", ""), (9, "http://notnet/", ""), (10, "http://w.io:80/a/b", "x" * 100000),
        # 11 names the blocked 7, 12 names 11: both are its aliases.
        (11, "http://mirror.io/1", canonical % "//example.com/de/y"), (12, "http://mirror.io/2", canonical % "/1"),
        # 13 and 14 share a class with a blocked and an allowed page.
        (13, "http://mirror.io/d/3", canonical % "https://b.net/?a=1&amp;b=2"), (14, "http://mirror.io/d/4", '<meta http-equiv="Refresh" content="0; URL=3">'),
        (15, "http://mirror.io/d/5", canonical % "3"), (16, "http://good.org/fr/p", canonical % "http://mirror.io/d/5"),
        (None, "http://mirror.io/1", ""), (12, "http://mirror.io/2", canonical % "/1"), (17, "http://mirror.io/9", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("node", F.lit(2))
    hops = spark.createDataFrame([("http://mirror.io/9", "http://c.net/z"), (None, "http://c.net/z")], "from_url string, to_url string")
    got = sorted(((r.page_id or -1, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, redirects=hops).collect()), key=lambda r: r[0])
    assert got == [
        (-1, "mirror.io", "/1", None, "block"),
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.example.net", "/de", "net/", "block"), (3, "net", "", None, "allow"),
        (4, "x.net", "/", "net/", "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "example.com", "/de/y", "example.com/de/", "block"),
        (8, "good.org", "/fr/", "org/fr/", "allow"), (9, "notnet", "/", None, "allow"), (10, "w.io:80", "/a/b", None, "allow"),
        (11, "mirror.io", "/1", None, "block"), (12, "mirror.io", "/2", None, "block"), (12, "mirror.io", "/2", None, "block"),
        (13, "mirror.io", "/d/3", None, "allow"), (14, "mirror.io", "/d/4", None, "allow"), (15, "mirror.io", "/d/5", None, "allow"),
        (16, "good.org", "/fr/p", "org/fr/", "allow"), (17, "mirror.io", "/9", None, "block"),
    ]
    assert urls.judge(pages.limit(0)).count() == 0


def counterpart(sql, **frames):
    """Rows of a registered query's SQL over small tables."""
    import duckdb

    con = duckdb.connect()
    for name, frame in frames.items():
        con.register("f_" + name, frame.toPandas())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM f_{name}")
    return con.execute(sql).fetchall()


def test_counterparts_on_links_and_stretched_notices(spark):
    both = '<link rel="canonical" href="%s"><meta http-equiv="refresh" content="0; url=%s">'
    rows = [
        (1, "http://self.io/a", both % ("http://self.io/a", "http://b.net/x")), (2, "http://self.io/b", '<link rel="canonical" href="/a">'),
        (3, "http://self.io/c", both % ("/c", "http://b.net/y")), (4, "http://good.org/fr/z", both % ("", "http://self.io/c")),
        (5, "http://two.io/d/x", both % ("http://b.net/p", "e")), (6, "http://two.io/d/e", ""), (7, "http://two.io/f", both % ("/g", "//b.net/q?a=1&amp;b=2")),
        (8, "http://two.io/g", None), (9, "http://self.io/h", both % ("/h", "/h")), (10, None, "x"), (11, "no host", both % ("/a", "/b")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(counterpart(urls.ORACLE, pages=pages))
    assert {r.page_id for r in got if r.verdict == "block"} == {1, 2, 5, 6, 7, 8}
    words = list(dict.fromkeys(licenses.TEMPLATES["mit"].split()))
    need = -(-len(words) * 4 // 5)
    # A notice stretched over more than 32 words, at offsets that a grid of 32 would cut.
    spread = lambda n: [f"x{k}" if k not in (at := {round(i * (n - 1) / (need - 1)): w for i, w in enumerate(words[:need])}) else at[k] for k in range(n)]
    texts = [" ".join([f"y{k}" for k in range(lead)] + spread(64) + ["z"] * 100) for lead in (0, 16, 17, 33)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    assert got == sorted(counterpart(licenses.oracle(), documents=docs)) and [r[6] for r in got] == ["mit"] * 4 + [""] * 2


def test_a_page_with_a_canonical_link_keeps_its_refresh(spark):
    both = '<link rel="canonical" href="%s"><meta http-equiv="refresh" content="0; url=%s">'
    rows = [
        # 1 names itself canonical and leads to a blocked url; 2 leads to 1.
        (1, "http://self.io/a", both % ("http://self.io/a", "http://b.net/x")), (2, "http://self.io/b", '<link rel="canonical" href="/a">'),
        # 3 is as 1, but 4, its alias by a refresh beside a self link, is allowed.
        (3, "http://self.io/c", both % ("/c", "http://b.net/y")), (4, "http://good.org/fr/z", both % ("", "http://self.io/c")),
        # Both links lead elsewhere, the canonical one to a blocked url or the refresh.
        (5, "http://two.io/d", both % ("http://b.net/p", "/e")), (6, "http://two.io/e", ""), (7, "http://two.io/f", both % ("/g", "http://b.net/q?a=1&amp;b=2")), (8, "http://two.io/g", None),
        (9, "http://self.io/h", both % ("/h", "/h")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow"}


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    labels, score = set(base), 1.0 if base else 0.0
    for label, template in licenses.TEMPLATES.items():
        t = set(template.split())
        best = max(len(t & set(words[s : s + 64])) for s in range(max(1, len(words) - 63)))
        if best >= 0.8 * len(t):
            labels.add(label)
            score = max(score, best / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_license_scan_equals_brute_force(spark):
    mit, apache = licenses.TEMPLATES["mit"], licenses.TEMPLATES["apache-2"]
    filler = "lorem ipsum dolor sit amet " * 20
    texts = [
        "Under the MIT License. under-the-mit-license, nounder the mit license", None, "", "!!", "Apache License,\nVersion 2.0 CC BY-NC 4.0 cc.by.nc", filler + mit.upper() + filler,
        filler + " ".join(w for k, w in enumerate(mit.split()) if k % 6), filler + " ".join(w for k, w in enumerate(mit.split()) if k % 3), filler + apache.replace(" ", "\n// "),
        "This work is licensed under the GNU General Public License, version 3.", "é under the mit licenseé", (filler + "cc by nc ") * 200, "This work is licensed under the GNU General Public License, version 3.",
        # A Kelvin sign is no K: one word too few is left.
        " ".join(w for k, w in enumerate(licenses.TEMPLATES["cc-by-nc"].split()) if k not in (4, 6)).replace("work", "wor\u212a"), "license\u0130d wor\u212a",
    ]
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("x")).withColumn("_words", F.lit("y"))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in licenses.scan(docs).collect())
    want = sorted((i if i is not None else -1, *(round(x, 9) if isinstance(x, float) else x for x in brute_scan(t))) for i, t in rows)
    assert got == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_labels_do_not_depend_on_the_offset(spark):
    best = lambda words, t: max(len(t & set(words[s : s + 64])) for s in range(max(1, len(words) - 63)))
    words = list(dict.fromkeys(licenses.TEMPLATES["mit"].split()))
    need = -(-len(words) * 4 // 5)
    # Just enough words of a notice, spread over one block of 64, or over one word more.
    spread = lambda n: [f"x{k}" if k not in (at := {round(i * (n - 1) / (need - 1)): w for i, w in enumerate(words[:need])}) else at[k] for k in range(n)]
    texts = [[f"y{k}" for k in range(lead)] + spread(n) + [f"z{k}" for k in range(tail)] for n in (64, 65) for lead in (0, 1, 15, 16, 17, 32, 63, 64, 80, 127) for tail in (0, 16, 100)]
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        share = best(text, set(words))
        assert share == (need if k < 30 else need - 1)
        assert got[k] == (("mit", round(share / len(words), 9)) if k < 30 else ("", 0.0)), k
