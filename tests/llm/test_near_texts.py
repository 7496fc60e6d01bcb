import random

import numpy as np

from lotlight.llm.near_texts import NearTextParams, _counter, near_texts, shingle_set

from .conftest import odd_texts, prose


def shingles(text) -> set:
    words = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if x]
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(texts: dict, similarity: float = 0.8) -> dict:
    """Each id's component by comparing all with all."""
    root, sets = {d: d for d in texts}, {d: shingles(t) for d, t in texts.items()}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and root[a] != root[b]:
                new, old = sorted((root[a], root[b]))
                root = {d: new if r == old else r for d, r in root.items()}
    return root


def edited(text: str, n: int, seed: int = 0) -> str:
    """`text` with n words replaced."""
    words, r = text.split(" "), random.Random(seed)
    for k in r.sample(range(len(words)), n):
        words[k] = f"changed{k}"
    return " ".join(words)


def got(spark, rows) -> dict:
    out = near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len({r.doc_id for r in out})
    return {r.doc_id: r.component_id for r in out}


def test_against_brute_force(spark):
    texts = {}
    for k in range(12):
        text = prose(k, 200)
        for n in range(9):
            texts[1000 - len(texts)] = edited(text, n, n)
    texts |= {3: texts[1000].upper(), 4: texts[1000] + " " + prose(50, 150), 5: "a b c", 6: "A  b\nc", 7: "a b c d"}
    want = brute(texts)
    assert len(set(want.values())) < len(texts) - 40
    assert got(spark, list(texts.items())) == want


def test_odd_rows(spark, odd, none):
    assert near_texts(none).collect() == []
    found = {r.doc_id: r.component_id for r in near_texts(odd).collect()}
    assert found == brute(dict(enumerate(odd_texts())))


def test_many_copies(spark):
    """A group of near copies far larger than a bucket of others, and exact ones."""
    text = prose(7, 300)
    rows = [(k, edited(text, 1, k)) for k in range(300)] + [(k, text) for k in range(300, 600)] + [(600, prose(8, 300))]
    found = got(spark, rows)
    assert found == {k: 600 if k == 600 else 0 for k in range(601)}


def test_shingles():
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"a b c d e")) == 1
    assert len(shingle_set(b"")) == 1


def test_pair_in_crowded_buckets(spark):
    """Pages of one template, too far from each other to be alike, and two with less text of their own."""
    own = lambda k, n: " ".join(f"a{k}x{j}" for j in range(n))
    template = " ".join(f"pagea{j}" for j in range(104))
    texts = {k: f"{template} {own(k, 16)}" for k in range(1200)} | {k: f"{template} {own(k, 10)}" for k in (9001, 9002)}
    some = {k: texts[k] for k in (0, 1, 2, 9001, 9002)}
    assert brute(some) == {k: min(k, 9001) for k in some}
    assert got(spark, list(texts.items())) == {k: min(k, 9001) for k in texts}
    rows = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    out = near_texts(rows, NearTextParams(block=2)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(some)


def test_counter():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 40, 80)]
    for x in [*sets, np.array([99], np.uint64)]:
        assert _counter(sets)(x).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_ids_that_repeat(spark):
    """Of rows that share an id the text with the least MD5 is judged."""
    from hashlib import md5

    one, other = sorted((prose(1, 100), prose(2, 100)), key=lambda t: md5(t.encode()).hexdigest())
    rows = [(7, one), (7, other), (7, other), (8, one), (9, other), (10, other)]
    assert got(spark, rows) == {7: 7, 8: 7, 9: 9, 10: 9}
