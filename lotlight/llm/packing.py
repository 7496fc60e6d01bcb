"""Packing by power-of-two decomposition: documents are cut into binary-length pieces, and no sequence crosses documents.

A document's ids fill pieces of `length` ids first; what remains is cut by its
binary digits. Each piece is a sequence of its own, of a power-of-two length, so
there is no padding. Pieces of one length are a bucket; `batches` makes rows of
equal buckets, each a batch of so many tokens, for a trainer.

Defined results: a null text counts as empty and has its end id alone; ties don't
arise; repeated rows are packed each for itself; a very long text is encoded whole,
in one task; a sequence id tells the partition and the place in it, so it is unique
within a result and may differ between results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_LATIN = re.compile("[\u0250-\U0010ffff]")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def pieces(n: int, length: int = 2048) -> list[tuple[int, int]]:
    """(start, length) pairs that cover 0 to n, each length a power of two."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    at, bit = n - n % length, length >> 1
    while at < n:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


class Odd(Exception):
    """A text that can't be cut at its spaces."""


class ByteBpe(dict):
    """Ids of the byte-level vocabulary, as little-endian 32-bit bytes.

    Between single spaces, a space and the word after it are encoded without
    regard to what stands around. A text in Latin letters without the
    vocabulary's special tokens is encoded by the faster of two libraries that
    agree on these, cut at such a space after every `chunk` characters. Of others
    each distinct word is encoded once: words in Latin letters by the same
    library, others and special tokens by `tokenizers` itself. Words longer than
    `longest` aren't kept, and the table starts anew at `most` words.
    """

    longest, most, chunk = 40, 1 << 17, 1 << 16

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(json_path)
        self.full.no_truncation()
        self.full.no_padding()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (text.isascii() or not NOT_LATIN.search(text))

    def ids_of_any(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of_plain(self, text: str) -> bytes:
        try:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        except BaseException as e:  # white space beyond what its pattern can go back over; not an Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.ids_of_any(text)

    def ids(self, text: str) -> bytes:
        return self.ids_of_plain(text) if self.plain(text) else self.ids_of_any(text)

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Odd
        out = self.ids(f" {word}")
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.plain(text):
            out, at = [], 0
            while len(text) - at > self.chunk and (cut := SINGLE_SPACE.search(text, at + self.chunk)):
                out.append(self.ids_of_plain(text[at : cut.start()]))
                at = cut.start()
            return b"".join([*out, self.ids_of_plain(text[at:])])
        first, *words = text.split(" ")
        try:
            if not first or first[-1].isspace():
                raise Odd
            return self.ids(first) + b"".join([self[w] for w in words])
        except Odd:
            return self.ids(text)


@lru_cache(1)
def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> ByteBpe:
    return ByteBpe(json_path, ranks_path, pattern)


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32 bits), doc_tokens, bucket, sequence_id, offset."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, sequence = byte_bpe(json_path, ranks_path, pattern), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                n, doc_id = len(ids) // 4, doc.as_py()
                for start, size in pieces(n, length):
                    rows.append((doc_id, start, size, ids[4 * start : 4 * (start + size)], n, sequence))
                    sequence += 1
                held += len(ids)
                if held > 1 << 24:
                    yield as_batch(rows)
                    rows, held = [], 0
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long")
    return packed.withColumns({"bucket": F.log2("length").cast("int"), "offset": F.lit(0).cast("long")})


def batches(packed: DataFrame, tokens: int = 1 << 16) -> DataFrame:
    """bucket, length, n, sequence_ids, ids (n sequences of `length` ids one after another): pieces of one bucket together, up to `tokens` ids a row.

    A bucket is dealt to many tasks; each makes whole batches, and one smaller one of each bucket at its end.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}

        def made(bucket: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            ids, spelled = pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(r[1] for r in rows)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([1 << bucket], pa.int64()), pa.array([len(rows)], pa.int32()), ids, spelled], ["bucket", "length", "n", "sequence_ids", "ids"])

        for part in parts:
            for bucket, sequence, ids in zip(*(c.to_pylist() for c in part.columns)):
                rows = held.setdefault(bucket, [])
                rows.append((sequence, ids))
                if len(rows) << bucket >= tokens:
                    yield made(bucket, held.pop(bucket))
        for bucket, rows in held.items():
            yield made(bucket, rows)

    return packed.select("bucket", "sequence_id", "ids").mapInArrow(run, "bucket int, length long, n int, sequence_ids array<long>, ids binary")
