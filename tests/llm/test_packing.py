from collections import defaultdict
from copy import copy

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotlight.llm.packing import ByteBpe, batches, pack, pieces
from lotlight.llm.tokenizer_files import byte_bpe_files

BPE, FULL = ByteBpe(*byte_bpe_files()), Tokenizer.from_file(byte_bpe_files()[0])
PARTS = st.sampled_from(["the", "Ing", "é", "é", " ", "  ", "\n", "!!", "'s", "中文", "İ", "12", "\x0b", "\xa0", "<|endoftext|>", "<|end", "😀", "\x1c", "ß", "\t"])


@given(st.lists(PARTS, max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    assert np.frombuffer(BPE.encode(text), "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 20_000))
def test_pieces_cover(n):
    p = pieces(n)
    assert sum(k for _, k in p) == n and [s for s, _ in p] == np.cumsum([0, *[k for _, k in p]])[:-1].tolist()
    assert all(k & (k - 1) == 0 and k <= 2048 for _, k in p)


def test_round_trip(odd, none):
    rows = pack(odd, *byte_bpe_files()).collect()
    by_doc = defaultdict(list)
    for r in rows:
        assert r.length == 1 << r.bucket and r.offset == 0 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        want = [*FULL.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        parts = {p.start: p for p in parts}
        ids = np.concatenate([np.frombuffer(parts[s].ids, "<u4") for s in sorted(parts)])
        assert ids.tolist() == want and {p.doc_tokens for p in parts.values()} == {len(want)}
    assert pack(none, *byte_bpe_files()).count() == 0


def test_batches(odd):
    packed = pack(odd, *byte_bpe_files()).persist()
    want = {r.sequence_id: (r.bucket, r.ids) for r in packed.collect()}
    seen = {}
    for b in batches(packed, 64).collect():
        assert b.length == 1 << b.bucket and len(b.ids) == 4 * b.n * b.length and b.n == len(b.sequence_ids) and (b.n == 1 or (b.n - 1) * b.length < 64)
        for k, s in enumerate(b.sequence_ids):
            seen[s] = (b.bucket, b.ids[4 * k * b.length : 4 * (k + 1) * b.length])
    assert seen == want


@given(st.lists(PARTS, max_size=40).map("".join), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_cuts_of_long_texts(text, chunk):
    bpe = copy(BPE)
    bpe.chunk = chunk
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids


def test_latin_texts_are_encoded_whole():
    """Texts of ever new words cost no table of words."""
    bpe = ByteBpe(*byte_bpe_files())
    text = " ".join(f"nouveauté{k}" for k in range(30_000))
    assert np.frombuffer(bpe.encode(text), "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids and not bpe


def test_long_white_space():
    for text in (" " * 1_500_000 + "a", "a \xa0" * 9 + "\xa0" * 1_500_000 + "b c"):
        assert np.frombuffer(BPE.encode(text), "<u4").tolist() == FULL.encode(text, add_special_tokens=False).ids
