import random
import re

from xxhash import xxh64_intdigest

from lotlight.llm import simhash
from lotlight.llm.components import connected_components
from lotlight.llm.simhash import SimHashParams, fingerprint, near_duplicates, print_links

from .conftest import prose


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance=4):
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(prints)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(b)] = find(a)
    return {x: find(x) for x in prints}


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    for t in ("", " \t", "One", "a B c", prose(1, 300), "ÀB çd \x85x y\xa0z w"):
        assert fingerprint(t.encode()) == plain(t)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def crowd(seed=3):
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(300)}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            out.add(x)
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
    return out


def check(spark, prints, p):
    df = spark.createDataFrame([(_signed(x),) for x in prints], "print long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(print_links(df, p)).collect()}
    want = groups(prints)
    sets = lambda of: {frozenset(x for x in prints if of.get(x, x) == c) for c in {of.get(x, x) for x in prints}}
    assert sets(found) == sets(want)


def test_links_like_brute_force(spark):
    check(spark, crowd(), SimHashParams())


def test_dense_cells_take_the_other_way(spark):
    check(spark, set(list(crowd(5))[:150]), SimHashParams(dense=2))


def test_documents(spark, odd, none):
    rows = [(k, prose(k % 9, 300) + (" edited end" if k % 2 else "")) for k in range(40)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd):
        docs = [(r.doc_id, r.text) for r in df.collect()]
        of = groups({plain(t) for _, t in docs})
        least = {}
        for d, t in docs:
            c = of[plain(t)]
            least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
        want = sorted(((d, _signed(plain(t)), least[of[plain(t)]]) for d, t in docs), key=repr)
        assert sorted(map(tuple, near_duplicates(df).collect()), key=repr) == want
    assert near_duplicates(none).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 300) if k != 150], "a long, b long")
    out = {r.node: r.root for r in connected_components(edges).collect()}
    assert out == {k: 0 if k <= 150 else 151 for k in range(301)}
