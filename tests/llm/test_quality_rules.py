import re
from collections import Counter, defaultdict

from lotlight.llm import quality_rules as q

from .conftest import prose


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    covered = {k + i for v in at.values() if len(v) > 1 for k in v for i in range(8)}
    lines = Counter(x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(n - 1 for n in lines.values()), len(covered), failed


def test_counts(spark, odd, none):
    rows = [(k, t, "en") for k, t in enumerate([prose(1, 50) + prose(1, 50), prose(2, 30) * 3, "a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g h", "x " * 40, "l # \nl # \n \n l"])]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string"), odd):
        want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=repr)
        out = q.quality_report(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=repr) == want
        assert not any(r.kept and r.base_failed for r in out)
    assert q.quality_report(none).count() == 0 and q.quality_rules(none).count() == 0


def test_divergence(spark):
    clean = [(k, prose(k, 120), "en") for k in range(30)]
    junk = [(100, prose(100, 120).upper(), "en"), (101, re.sub(r"(?<=\w) ", "*** ", prose(101, 120)), "en"), (102, " | ".join(w for w in prose(102, 200).split() if len(w) > 3), "en")]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in q.quality_rules(df).collect()}
    assert all(out[k].kept for k in range(30)) and not any(out[k].kept for k in (100, 101, 102))
    assert q.quality_rules(df).where("kept").count() == 30
    assert {r.doc_id: r.kept for r in q.quality_report(df).collect()} == {k: r.kept for k, r in out.items()}
    refs = q.language_references(df)
    r = q.features(df).where("doc_id = 3").first()
    assert abs(q.js_distance(r["_chars"], refs["en"][0]) - out[3].char_distance) < 1e-9
    assert abs(q.js_distance(r["_common"], refs["en"][1]) - out[3].word_distance) < 1e-9
