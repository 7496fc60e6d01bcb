from collections import defaultdict

from lotlight.llm.substring_dedup import ChunkParams, cuts, gear_hashes, substring_dedup

from .conftest import prose


def test_cuts_resist_shifts():
    text = prose(5, 2000).encode()
    moved = b"something put in front " + text
    a, b = set(cuts(text).tolist()), {c - 23 for c in cuts(moved).tolist()}
    assert {c for c in a if c > 120} <= b
    at = cuts(text)
    assert (at[1:] - at[:-1] > ChunkParams().reach).all() and len(at) > 50
    assert len(cuts(b"")) == 0 and len(cuts(b"a" * 5000)) < 250


def test_blocks_join(monkeypatch):
    import lotlight.llm.substring_dedup as s

    text = prose(6, 4000).encode()
    whole = cuts(text).tolist()
    monkeypatch.setattr(s, "BLOCK", 1000)
    assert cuts(text).tolist() == whole


def test_passages_are_found(spark):
    passages = [prose(1000 + k, 55) for k in range(12)]
    rows = [(k, f"{prose(k, 120)} {passages[k % 12]} {prose(500 + k, 90)}") for k in range(36)] + [(200 + k, prose(3000 + k, 300)) for k in range(20)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == set(range(36))
    for k, r in out.items():
        data, passage = r.text.encode(), passages[k % 12].encode()
        start = data.index(passage)
        assert any(s.start >= start - 40 and s.end <= start + len(passage) + 40 for s in r.spans)
        assert bool(r.removed) == (k >= 12)
        assert r.clean_text == r.text if k < 12 else len(r.clean_text) < len(r.text)
        assert all(start - 12 <= s.start and s.end <= start + len(passage) + 12 for s in r.removed)


def chunks(data, reach=24, seed=7):
    """By the definition: a byte ends a chunk if its hash is the largest within reach, the first of equals closer than that."""
    import numpy as np

    gear = np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint64).tolist()
    h, all_ = 0, []
    for c in data:
        h = (2 * h + gear[c]) % (1 << 32)
        all_.append(h)
    ends = []
    for i in range(31, len(data) - 1):
        if all_[i] == max(all_[max(0, i - reach) : i + reach + 1]) and (not ends or i + 1 - ends[-1] > reach):
            ends.append(i + 1)
    at = [0, *ends, len(data)]
    return list(zip(at, at[1:])) if data else []


def brute(rows, least=100):
    """doc_id, spans, removed, clean text by comparing chunks as bytes."""
    docs = {(d, t or "") for d, t in rows}
    cut = {x: chunks(x[1].encode()) for x in docs}
    holders = defaultdict(set)
    for x in docs:
        for a, b in cut[x]:
            holders[x[1].encode()[a:b]].add(x)
    low = lambda d: -(1 << 63) if d is None else d
    out = []
    for d, t in rows:
        x, data = (d, t or ""), (t or "").encode()
        state = []  # of each byte: 0, 1 repeated, 2 repeated and in a document of a smaller id
        for a, b in cut[x]:
            own = holders[data[a:b]]
            state += [0 if len(own) < 2 else 1 + (min(low(y[0]) for y in own) < low(d))] * (b - a)
        spans, k = [], 0
        while k < len(state):
            e = k
            while e < len(state) and bool(state[e]) == bool(state[k]):
                e += 1
            if state[k] and (e - k >= least or e - k == len(state)):
                spans.append((k, e))
            k = e
        if spans:
            gone = [any(a <= i < b for a, b in spans) and state[i] == 2 for i in range(len(data))]
            inner = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
            shrink = lambda a, b: (next(i for i in range(a, len(data) + 1) if not inner(i)), next(i for i in range(b, -1, -1) if not inner(i)))
            cutout = [i for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1])]
            removed = [shrink(a, next(j for j in range(a, len(data) + 1) if j == len(data) or not gone[j])) for a in cutout]
            clean = bytes(c for i, c in enumerate(data) if not any(a <= i < b for a, b in removed)).decode()
            out.append((d, [shrink(*s) for s in spans], removed, clean))
    return sorted(out, key=repr)


def found(df):
    pairs = lambda spans: [(s.start, s.end) for s in spans]
    return sorted(((r.doc_id, pairs(r.spans), pairs(r.removed), r.clean_text) for r in substring_dedup(df).collect()), key=repr)


def test_like_brute_force(spark, odd, none):
    """Spans, removed and clean text; two texts under one id, of which one shares nothing; texts without an id."""
    shared = [prose(700 + k, 40) + " où été 中文字" * 3 for k in range(4)]
    rows = [(k, f"{prose(k, 60)} {shared[k % 4]} {prose(90 + k, 50)}") for k in range(10)]
    rows += [(7, prose(600, 150)), (7, rows[3][1]), (None, prose(601, 80)), (None, f"{shared[1]} {prose(602, 30)}"), (None, prose(603, 80)), rows[5]]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute(rows) and len(got) >= 12
    assert found(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert substring_dedup(none).count() == 0


def test_one_shared_chunk_is_found(spark):
    p = ChunkParams(least=25)
    data = prose(40, 300).encode()
    at = cuts(data, p)
    k = max(range(len(at) - 1), key=lambda i: at[i + 1] - at[i])
    margin = 32 + p.reach
    piece = data[max(0, at[k] - margin) : at[k + 1] + margin].decode()
    rows = [(1, prose(41, 60) + piece + prose(42, 60)), (2, prose(43, 60) + piece + prose(44, 60))]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()}
    want = data[at[k] : at[k + 1]].decode()
    assert all(any(want in r.text.encode()[s.start : s.end].decode() for s in r.spans) for r in out.values()) and set(out) == {1, 2}


def test_gear_hashes():
    import numpy as np

    gear = np.random.default_rng(1).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
    for n in (0, 1, 2, 31, 33, 200):
        data, h, want = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8), 0, []
        for c in data.tolist():
            h = (2 * h + int(gear[c])) % (1 << 32)
            want.append(h)
        assert gear_hashes(data, gear).tolist() == want


def test_equal_texts_are_found_whole(spark):
    texts = ["short", "é", prose(21, 8), prose(22, 14), prose(23, 25), prose(24, 300), "x" * 500]
    texts.append(next(t for t in (prose(s, 18) for s in range(30, 200)) if len(cuts(t.encode())) == 2))
    assert {len(cuts(t.encode())) for t in texts} >= {0, 1, 2, 3}
    rows = [(10 * k + n, t) for k, t in enumerate(texts) for n in (0, 1)] + [(200, "alone"), (201, ""), (202, ""), (203, None)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {d for d, _ in rows if d < 200}
    for k, t in enumerate(texts):
        first, second = out[10 * k], out[10 * k + 1]
        assert [tuple(s) for s in second.removed] == [tuple(s) for s in first.spans] == [(0, len(t.encode()))]
        assert first.removed == [] and first.clean_text == t and second.clean_text == ""
