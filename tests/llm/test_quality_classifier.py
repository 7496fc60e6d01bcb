import random

from pyspark.sql import functions as F

from lotlight.llm.quality_classifier import classify, evidence, fit, posteriors

from .conftest import prose


def corpus(spark, n=600):
    r = random.Random(4)
    rows = []
    for k in range(n):
        host = f"h{k % 6}" if k % 3 else "big"
        good = r.random() < (0.95 if host in ("big", "h1") else 0.6)
        text = prose(k, 80)
        if not good:
            text = " ".join(w + r.choice(["***", "%%%", "!!"]) for w in text.split()) if r.random() < 0.5 else text.upper().replace(" ", "!! ")
        rows.append((k, text, host, f"p{k % 4}", int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    labels = df.where("doc_id % 2 = 0").select("doc_id", "quality")
    out = classify(df, labels, F.col("source"), F.col("lang")).join(df.where("doc_id % 2 = 1").select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in out) / len(out) > 0.95


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 0.9)] * 400 + [("mid", "a", 0.2)] * 50 + [("one", "a", 0.0)] + [("two", "a", 1.0)] * 2
    scored = spark.createDataFrame([(k, h, p, x) for k, (h, p, x) in enumerate(rows)], "doc_id long, host string, path string, p double")
    sites, mean = posteriors(scored)
    s = {r.host: r for r in sites.collect()}
    assert abs(mean - sum(x for *_, x in rows) / len(rows)) < 1e-9
    assert abs(s["big"].host_posterior - 0.9) < 0.02 and abs(s["mid"].host_posterior - 0.2) < 0.1
    assert 0.0 < s["one"].host_posterior < mean and mean < s["two"].host_posterior < 1.0
    assert s["one"].path_posterior <= s["one"].host_posterior


def plain_posteriors(rows):
    """Of (host, path, p): the mean, and the posteriors of hosts and paths, by loops over the groups."""
    def strength(mean, groups):
        """groups: (around, values)."""
        n = sum(len(v) for _, v in groups)
        seen = sum(len(v) * (sum(v) / len(v) - a) ** 2 for a, v in groups) / n
        chance = sum(max(sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2, 0) for _, v in groups) / n
        return min(max(mean * (1 - mean) / max(max(seen - chance, 0), 1e-6) - 1, 1), 1e6)

    of = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}
    hosts, paths, mean = of(lambda r: r[0]), of(lambda r: r[:2]), sum(r[2] for r in rows) / len(rows)
    m = strength(mean, [(mean, v) for v in hosts.values()])
    up = {h: (sum(v) + m * mean) / (len(v) + m) for h, v in hosts.items()}
    m = strength(mean, [(up[k[0]], v) for k, v in paths.items()])
    return mean, up, {k: (sum(v) + m * up[k[0]]) / (len(v) + m) for k, v in paths.items()}


def test_posteriors_like_loops(spark):
    """Hosts and the first part of the path of real addresses, few documents on most."""
    r = random.Random(9)
    pages = [r_.asDict() for r_ in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url").collect()]
    rows = []
    for x in pages:
        host, _, rest = (x["url"] or "http:///").split("://", 1)[-1].partition("/")
        rows.append((host, rest.split("/")[0], r.betavariate(1 + len(host) % 5, 2)))
    sites, mean = posteriors(spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, host string, path string, p double"))
    want_mean, hosts, paths = plain_posteriors(rows)
    assert abs(mean - want_mean) < 1e-9 and len(paths) > 1
    got = {(s.host, s.path): s for s in sites.collect()}
    assert set(got) == set(paths)
    for k, v in paths.items():
        assert abs(got[k].path_posterior - v) < 1e-9 and abs(got[k].host_posterior - hosts[k[0]]) < 1e-9


def test_scores_on_real_documents(spark):
    """Held-out labels of the test table, by halves."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = classify(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    both = out.join(labels.where("doc_id % 2 = 1 AND quality IS NOT NULL"), "doc_id").collect()
    assert len(both) > 50 and sum(r.keep == bool(r.quality) for r in both) / len(both) > 0.85


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 1), (9, 0), (11, 0), (12, None), (None, 1), (5, 1)], "doc_id long, quality int")
    out = classify(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in out)
    assert classify(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert {r.p for r in evidence(odd, fit(odd, labels.limit(0)), F.col("source"), F.col("lang")).collect()} == {0.5}
