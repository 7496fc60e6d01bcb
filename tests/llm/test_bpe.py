import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotlight.llm.bpe import PART, TreeBpe, decode_ids, encode_texts, round_trip
from lotlight.llm.tokenizer_files import word_bpe_file

FULL, SMALL, USUAL = Tokenizer.from_file(word_bpe_file()), TreeBpe(word_bpe_file(), leaf=24, window=4), TreeBpe(word_bpe_file())
PARTS = ["the", "ing", "é", "é", "́", " ", "  ", "\n", "!!", "'s", "don't", "中文", "ﬁ", "İ", "1", "22", "\x0b", "\xa0", "　", "<|endoftext|>", "<|startof", "text|>", "a", "th", "er", "Z", "😀", "가", "-", "_", "\x1c", "ß", ".", "É", "ñó", "µ", "ª", "ÿ", "Ī", "q."]


@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join))
@settings(max_examples=600, deadline=None)
def test_small_leaves(text):
    assert SMALL.encode(text) == FULL.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([x for x in PARTS if not x.isspace()]), max_size=150).map("".join))
@settings(max_examples=600, deadline=None)
def test_unsplit(text):
    ids = FULL.encode(text, add_special_tokens=False).ids
    assert SMALL.encode(text) == ids and USUAL.encode(text) == ids and USUAL.decode(ids) == FULL.decode(ids, skip_special_tokens=False)


def test_very_long_unsplit():
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(60_000))
    assert USUAL.encode(text) == FULL.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(PARTS), max_size=200).map("".join), st.integers(5, 60))
@settings(max_examples=400, deadline=None)
def test_parts_join(text, part):
    """Parts encoded apart give the library's ids, wherever they are cut."""
    if len(text) > part:
        parts = [SMALL._tree(text[k : k + part], 0, len(text[k : k + part])) for k in range(0, len(text), part)]
        assert SMALL.join_parts(text, part, parts) == FULL.encode(text, add_special_tokens=False).ids


def test_frames(spark, odd, none):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, ids_of = [], {}
    for r in odd.collect():
        ids = FULL.encode(r.text or "", add_special_tokens=False).ids
        ids_of[r.text] = ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(FULL.decode(ids, skip_special_tokens=False))))
    for part in (PART, 1000):
        out = round_trip(odd, word_bpe_file(), part=part)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    out = decode_ids(encode_texts(odd, word_bpe_file(), part=1000), word_bpe_file()).collect()
    assert len(out) == len(want) and all(r.ids == ids_of[r.text] and r.decoded == FULL.decode(r.ids, skip_special_tokens=False) for r in out)
    assert round_trip(none, word_bpe_file()).count() == decode_ids(encode_texts(none, word_bpe_file()), word_bpe_file()).count() == 0
