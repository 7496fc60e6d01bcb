"""BPE encoding and decoding of whole texts by tree concatenation.

A long text is halved until its parts are short; the parts are encoded apart and
joined upwards. A cut may fall anywhere, so a join re-encodes a window around it
and takes the window's ids between two seams, one on each side, at which both
encodings agree; without a seam on either side the window grows, at last to the
whole range, which is then encoded as it is.

A text longer than `part` characters is a row for each part of that length, encoded
by tasks of their own; one more task joins a text's parts, as the same tree would.

Words (what stands between blanks, tabs and line ends) are encoded without regard
to each other, so a seam in ordinary text is the start of a word that both sides
have whole. A stretch without such a blank that is longer than a leaf is a tree of
its own, whose seams are runs of equal tokens: ids that agree in each adjacent
pair are the encoding of what they spell.

Defined results: a null text counts as empty and has no ids; null ids decode to
the empty text; ties don't arise; equal rows get equal results; an empty table
gives an empty result; other columns pass through unless named like the added one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlight.llm.common import durable

WORD = re.compile(r"[^ \t\n\r]+")
#: Space that str.split() would cut at, and WORD doesn't.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
AGREE = 4


class Words(dict):
    """Ids by word. At `most` words the table starts anew, and those still asked for are taken over from the one before."""

    longest, most = 32, 60_000

    def __init__(self, encode, encode_letters) -> None:
        super().__init__()
        self.encode, self.encode_letters, self.before = encode, encode_letters, {}

    def __missing__(self, word: str) -> list[int]:
        ids = self.before.get(word)
        if ids is None:
            bare = word.rstrip(".,;:!?")
            if bare.isalpha() and max(bare) < "\u0100":
                # Latin letters are encoded as small ones, and marks after them for themselves.
                small = bare.lower()
                ids = self.encode_letters(word) if small == word else self[small] + (self[word[len(bare) :]] if bare != word else [])
            else:
                ids = self.encode(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class TreeBpe:
    def __init__(self, path: str, leaf: int = 8192, window: int = 64) -> None:
        from tokenizers import Tokenizer

        if min(leaf, window) < 1:
            raise ValueError("leaf and window must be positive")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = leaf, window
        self.words = Words(self._word, self._letters)
        self.model, self.bytes = self.tokenizer.model, byte_characters()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ids = list(range(size))  # one object for each id, however often a table holds it
        self.numerals = list(map(str, self.ids))
        self.pieces = [self.tokenizer.id_to_token(k) or "" for k in range(size)] if self.tokenizer.decoder is None else None

    # A stretch without blanks.

    def _spelled(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        """Ids of text[lo:hi], and where in text each starts."""
        e = self.tokenizer.encode(text[lo:hi], add_special_tokens=False)
        return e.ids, [lo + a for a, _ in e.offsets]

    def _word(self, word: str) -> list[int]:
        if len(word) <= self.leaf:
            return [self.ids[k] for k in self.tokenizer.encode(word, add_special_tokens=False).ids]
        return self._stretch(word, 0, len(word))[0]

    def _letters(self, word: str) -> list[int]:
        """A word of small Latin letters goes to the model as it is; no step before it would change or cut it."""
        if len(word) > self.leaf:
            return self._stretch(word, 0, len(word))[0]
        return [self.ids[t.id] for t in self.model.tokenize("".join([self.bytes[b] for b in word.encode()]))]

    def _stretch(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        if hi - lo <= self.leaf:
            return self._spelled(text, lo, hi)
        cut = (lo + hi) // 2
        left, right = self._stretch(text, lo, cut), self._stretch(text, cut, hi)
        w = self.window
        while True:
            a, b = max(lo, cut - w), min(hi, cut + w)
            ids, at = self._spelled(text, a, b)
            first = (0, 0) if a == lo else self._seam(left, (ids, at), a, cut, 1)
            last = (len(right[0]), len(ids)) if b == hi else self._seam(right, (ids, at), cut, b, -1)
            if first and last and first[1] <= last[1]:
                (i, x), (j, y) = first, last
                return left[0][:i] + ids[x:y] + right[0][j:], left[1][:i] + at[x:y] + right[1][j:]
            w *= 2

    @staticmethod
    def _seam(side: tuple[list[int], list[int]], window: tuple[list[int], list[int]], lo: int, hi: int, step: int) -> tuple[int, int] | None:
        """Indexes in both of the inmost of AGREE equal tokens between lo and hi: the first run from the left, or from the right."""
        (ids, at), (wids, wat) = side, window
        x = bisect_left(wat, lo), bisect_left(wat, hi)
        for k in range(x[0] + 1, x[1] - AGREE) if step > 0 else range(x[1] - AGREE - 1, x[0], -1):
            i = bisect_left(at, wat[k])
            # Bytes of one character start at one place; a seam isn't put among them.
            if i and wat[k] != wat[k - 1] and at[i - 1 : i + AGREE] == [at[i - 1], *wat[k : k + AGREE]] and ids[i : i + AGREE] == wids[k : k + AGREE]:
                return (i + AGREE // 2, k + AGREE // 2) if wat[k + AGREE // 2] != wat[k + AGREE // 2 - 1] else (i, k)
        return None

    # A text of words.

    def _leaf(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and the number of ids of each word."""
        words = WORD.findall(text) if ODD_SPACE.search(text) else text.split()
        ids, counts, known = [], [], self.words
        for w in words:
            t = known[w]
            ids += t
            counts.append(len(t))
        return ids, counts

    def _tree(self, text: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        cut = (lo + hi) // 2
        return self._joined(text, lo, cut, hi, self._tree(text, lo, cut), self._tree(text, cut, hi))

    def _joined(self, text: str, lo: int, cut: int, hi: int, left: tuple[list[int], list[int]], right: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
        """Ids and words' numbers of ids of text[lo:hi] from those of its two sides."""
        w = self.window
        while True:
            a, b = max(lo, cut - w), min(hi, cut + w)
            starts = [m.start() for m in WORD.finditer(text, a, b)]
            ids, counts = self._leaf(text[a:b])
            ends = np.cumsum([0, *counts]).tolist()
            # The first start after the window's own, and the last after the cut, are starts of words in the text.
            x = 0 if a == lo else next((k for k, s in enumerate(starts) if a < s < cut), None)
            y = len(starts) if b == hi else next((k for k in range(len(starts) - 1, -1, -1) if starts[k] > cut), None)
            if x is not None and y is not None and x <= y:
                n = 0 if a == lo else len(left[1]) - sum(s < cut for s in starts[x:])
                m = len(right[1]) if b == hi else len(WORD.findall(text, cut, starts[y]))
                i, j = (0 if a == lo else sum(left[1][:n])), sum(right[1][:m])
                whole = sum(s < cut for s in starts[x:]) - 1  # of the left side's words, the last may be cut
                if a == lo or left[0][i : i + ends[x + whole] - ends[x]] == ids[ends[x] : ends[x + whole]]:
                    return left[0][:i] + ids[ends[x] : ends[y]] + right[0][j:], left[1][:n] + counts[x:y] + right[1][m:]
            if a == lo and b == hi:
                return ids, counts
            w *= 2

    def join_parts(self, text: str, part: int, parts: list[tuple[list[int], list[int]]]) -> list[int]:
        """Ids of a text from the ids and counts of its parts of `part` characters each, joined two by two."""
        bounds = [(k * part, min(len(text), (k + 1) * part)) for k in range(len(parts))]
        while len(parts) > 1:
            for k in range(len(parts) // 2):
                (lo, cut), (_, hi) = bounds.pop(k), bounds.pop(k)
                left, right = parts.pop(k), parts.pop(k)
                bounds.insert(k, (lo, hi))
                parts.insert(k, self._joined(text, lo, cut, hi, left, right))
        return parts[0][0]

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))[0]

    def decode(self, ids: list[int]) -> str:
        if self.pieces is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.pieces.__getitem__, ids))  # what the library does without a decoder


@lru_cache(1)
def tree_bpe(path: str, leaf: int, window: int) -> TreeBpe:
    return TreeBpe(path, leaf, window)


def _list_column(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.array([x for r in rows for x in r], np.int32)))


PART = 1 << 16


def _long_texts(docs: DataFrame, path: str, leaf: int, window: int, part: int) -> DataFrame:
    """text, ids of the distinct texts longer than `part`."""
    texts = durable(docs.where(F.length("text") > part).select("text").distinct().withColumn("key", F.sha2("text", 256)))
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / part).cast("int") - 1)).alias("k")
    pieces = texts.select("key", k, "text").select("key", "k", F.substring("text", F.col("k") * part + 1, F.lit(part)).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, leaf, window)
        for b in batches:
            made = [bpe._tree(t, 0, len(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _list_column([x[0] for x in made]), _list_column([x[1] for x in made])], ["key", "k", "ids", "counts"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, leaf, window)
        for b in batches:
            for text, parts in zip(b.column(0), b.column(1)):
                ids = bpe.join_parts(text.as_py(), part, [(p["ids"], p["counts"]) for p in parts.as_py()])
                yield pa.RecordBatch.from_arrays([pa.array([text.as_py()]), _list_column([ids])], ["text", "ids"])

    encoded = pieces.repartition("key", "k").mapInArrow(encode, "key string, k int, ids array<int>, counts array<int>")
    whole = encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids", "counts"))).alias("parts"))  # a text's own parts
    return texts.join(whole, "key").select("text", "parts").mapInArrow(join, "text string, ids array<int>")


def encode_texts(docs: DataFrame, path: str, leaf: int = 8192, window: int = 64, part: int = PART) -> DataFrame:
    """`docs` with `ids`, the token ids of `text`."""
    df = docs.drop("ids")
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, leaf, window)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _list_column([bpe.encode(x.as_py() or "") for x in b.column(at)])], [*b.schema.names, "ids"])

    short = df.where(F.coalesce(F.length("text") <= part, F.lit(True)))
    short = short.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    long = df.where(F.length("text") > part).join(_long_texts(df, path, leaf, window, part), "text")
    return short.unionByName(long.select(short.columns))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with `decoded`, the text that `ids` spell."""
    df = encoded.drop("decoded")
    at = df.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, 8192, 64)
        for b in batches:
            texts = pa.array([bpe.decode(x.values.to_pylist()) if x.is_valid else "" for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_batch(doc_ids: pa.Array, rows: list[list[int]], bpe: TreeBpe) -> pa.RecordBatch:
    from hashlib import sha256

    spelled = [sha256(" ".join(map(bpe.numerals.__getitem__, r)).encode()).hexdigest() for r in rows]
    decoded = [sha256(bpe.decode(r).encode()).hexdigest() for r in rows]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(map(len, rows), pa.int64()), pa.array(spelled), pa.array(decoded)], [x.split()[0] for x in DIGESTS.split(", ")])


def round_trip(docs: DataFrame, path: str, leaf: int = 8192, window: int = 64, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded and decoded in one pass, without ids between tasks but for long texts' parts."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, leaf, window)
        for b in batches:
            yield _digest_batch(b.column(0), [bpe.encode(x.as_py() or "") for x in b.column(1)], bpe)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, leaf, window)
        for b in batches:
            yield _digest_batch(b.column(0), b.column(1).to_pylist(), bpe)

    short = df.where(F.coalesce(F.length("text") <= part, F.lit(True))).mapInArrow(run, DIGESTS)
    long = df.where(F.length("text") > part).join(_long_texts(df, path, leaf, window, part), "text")
    return short.unionByName(long.select("doc_id", "ids").mapInArrow(digest, DIGESTS))
