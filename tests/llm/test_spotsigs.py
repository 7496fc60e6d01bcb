import numpy as np

from xxhash import xxh64_intdigest

from lotlight.llm.spotsigs import ANCHORS, EDGES, fingerprint_with_edits, jaccard, near_pairs, signatures

from .conftest import prose


def spots(text):
    """Signatures by a loop over the words: each anchor with the two content words after it, if there is one."""
    mask, words = (1 << 64) - 1, []
    for w in (x.strip(EDGES) for x in text.lower().split()):
        if w:
            words.append((xxh64_intdigest(w) & ~1 | (w in ANCHORS) or 2, w in ANCHORS))
    content = lambda k: [c for c, anchor in words[k:] if not anchor][:2]
    chains = [(c, content(k + 1)) for k, (c, anchor) in enumerate(words) if anchor]
    chains = [x for x in chains if x[1]] or [(c, [x for x, _ in words[k + 1 : k + 3]]) for k, (c, _) in enumerate(words)]
    out = set()
    for c, rest in chains:
        h = c * 0x9E3779B97F4A7C15 & mask
        for x in [*rest, 0, 0][:2]:
            h = (h ^ h >> 29 ^ x) * 0xBF58476D1CE4E5B9 & mask
        out.add(h >> 32)
    return out


def like(a, b, at_least=0.2):
    if not a or not b:
        return float(len(a) == len(b))
    x = len(a & b) / len(a | b)
    return round(x, 9) if x >= at_least else 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        part = len(text) // 4
        edited = text[: len(text) - part] + after[:part]
        a, b, c = spots(text), spots(edited), spots(after)
        out.append((doc, len(text), edited, *("".join(f"{x:08x}" for x in sorted(s)) for s in (a, b)), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint_with_edits(df).collect()), key=repr)


def test_like_brute_force(spark, odd, none):
    rows = [(k * 7 % 101, prose(k % 23, 20 + k)) for k in range(101)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(spark.createDataFrame([(5, "alone in the dark here")], "doc_id long, text string"))[0][6] == 1.0
    assert fingerprint_with_edits(none).count() == 0


def test_likeness():
    a, b = prose(1, 300), prose(2, 300)
    assert 0.4 < jaccard(signatures(a), signatures(a[:900] + b[:300])) < 0.95
    assert jaccard(signatures(a), signatures(a)) == 1.0 and jaccard(signatures(""), signatures("")) == 1.0
    assert jaccard(np.arange(10), np.arange(100), at_least=0.5) == 0.0 and jaccard(np.arange(80), np.arange(100), at_least=0.5) == 0.8
    assert len(signatures("lantern meadow")) == 2


def test_near_pairs(spark, odd, none):
    rows = []
    for k in range(30):
        words = prose(k % 10, 200).split()
        for j in range(k // 10 * 3):
            words[j * 40 % 200] = f"edit{k}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, prose(k, 200)) for k in range(3)]
    for limit in (0.6, 0.8):
        sets = {}
        for d, t in rows:
            sets.setdefault(tuple(signatures(t)), d)
        reps = [(d, np.array(s)) for s, d in sets.items()]
        want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(reps) for b, y in reps[i + 1 :] if jaccard(x, y) >= limit}
        got = [(r.a, r.b) for r in near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    near_pairs(odd).collect()
    assert near_pairs(none).count() == 0


def test_pruned_likeness(monkeypatch):
    import lotlight.llm.spotsigs as sp

    monkeypatch.setattr(sp, "STEP", 3)
    r = np.random.default_rng(5)
    for _ in range(500):
        a, b = (np.unique(r.integers(0, 40, r.integers(0, 30)).astype(np.uint32)) for _ in range(2))
        for limit in (0.0, 0.2, 0.5, 0.8):
            x = like(set(a.tolist()), set(b.tolist()), limit)
            assert abs(jaccard(a, b, limit) - x) < 1e-9
