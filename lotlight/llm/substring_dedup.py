"""Substring dedup by content-defined chunking.

A gear rolling hash runs over a text's bytes; a chunk ends where the hash is the
largest within `reach` bytes on either side. That is decided by the bytes around
it alone, so an insertion moves no cut but those beside it, and chunks are
longer than `reach`. Each chunk has one digest, the first and the last, which the
text's start and end bound, too. A chunk whose digest is found in more than one
document is repeated; repeated chunks side by side are a passage, and a passage of
`least` bytes or more, or of a whole text, is reported. It is removed from all
documents but that of the least id, and those of no id, so texts that share an id
take nothing from each other.

Only digests, ids and chunk numbers are shuffled to find what is repeated; texts
are shuffled once, to meet it. A digest's documents are counted with partial
aggregation and meet their chunks by `counted_join`.

Defined results: a null text counts as empty and has no chunks; a document is an id
with a text: equal rows are one document and get equal results, different texts of
one id, or of none, are documents of their own; a very long text's digests are one
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import counted_join, durable

BLOCK = 1 << 20


@dataclass(frozen=True)
class ChunkParams:
    reach: int = 24
    #: Bytes of the shortest passage that is reported.
    least: int = 100
    seed: int = 7


def _gear(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h(i) = 2 h(i - 1) + gear(byte i), modulo 2^32: the last 32 bytes decide it. By doubling, without a loop over bytes."""
    h, width = gear[data], 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width) if width < len(h) else 0
        width *= 2
    return h


def cuts(text: bytes, p: ChunkParams = ChunkParams()) -> np.ndarray:
    """Ends of chunks, the text's own end excluded: the last byte of each is where the hash is largest around."""
    gear, r, out = _gear_of(p.seed), p.reach, []
    data = np.frombuffer(text, np.uint8)
    margin = 32 + r
    for lo in range(0, len(data), BLOCK):  # blocks with margins, so that very long texts take bounded memory
        a, b = max(0, lo - margin), min(len(data), lo + BLOCK + r)
        h = gear_hashes(data[a:b], gear)
        pad = np.zeros(r, np.uint32)
        top, width = np.concatenate([pad, h, pad]), 1
        while width < 2 * r + 1:
            step = min(width, 2 * r + 1 - width)
            top = np.maximum(top[:-step], top[step:])
            width += step
        at = np.flatnonzero(h == top) + a
        out.append(at[(at >= max(lo, 31)) & (at < min(lo + BLOCK, len(data) - 1))])
    at = np.concatenate(out) if out else np.empty(0, np.int64)
    if len(at) > 1:  # of equal hashes closer than `reach`, as in runs of one byte, the first cuts
        at = at[np.append(True, np.diff(at) > r)] if (np.diff(at) > r).all() else _spaced(at, r)
    return at + 1


def _spaced(at: np.ndarray, reach: int) -> np.ndarray:
    kept = [int(at[0])]
    for x in at[1:].tolist():
        if x - kept[-1] > reach:
            kept.append(x)
    return np.array(kept, np.int64)


_GEARS: dict[int, np.ndarray] = {}


def _gear_of(seed: int) -> np.ndarray:
    if seed not in _GEARS:
        _GEARS[seed] = _gear(seed)
    return _GEARS[seed]


def digests(text: bytes, p: ChunkParams = ChunkParams()) -> tuple[list[int], np.ndarray]:
    """64-bit digests of the chunks, and the bounds of chunks, one more, from 0 to the text's end; none of an empty text."""
    from xxhash import xxh3_64_intdigest

    at = np.concatenate([[0], cuts(text, p), [len(text)]]) if text else np.empty(0, np.int64)
    return [xxh3_64_intdigest(text[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], at


LEAST_ID = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least), own (64 bits of id and text, that tell documents apart), text in bytes."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("own"), "text")


def chunk_digests(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """doc_id, own, digests of every document with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digests(text.as_py() or b"", p)[0] for text in b.column(2)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            values = np.array([h for own in found for h in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(values))], ["doc_id", "own", "digests"])

    return _keyed(docs).where(F.octet_length("text") > 0).mapInArrow(run, "doc_id long, own long, digests array<long>")


def repeated_chunks(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """doc_id, own, chunk (its number) and first_id (the least id that has it) of each chunk found in more than one document."""
    chunks = durable(chunk_digests(docs, p)).select("doc_id", "own", F.posexplode("digests").alias("chunk", "digest"))
    shared = chunks.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n"))
    shared = durable(shared.where("low <> high").select("digest", "first_id", "n"))
    return counted_join(chunks, shared, "digest", shared.agg(F.sum("n")).first()[0] or 0).select("doc_id", "own", "chunk", "first_id")


def passages(chunks: list[int], bounds: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of runs of neighbouring chunks, if they have `least` bytes or are all there is."""
    out: list[list[int]] = []
    for k in sorted(set(chunks)):
        a, b = int(bounds[k]), int(bounds[k + 1])
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least or b - a == bounds[-1]]


def aligned(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Moved inwards to starts of characters."""
    inside = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(k for s in spans for k in s), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def substring_dedup(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """doc_id, text, spans (start and end in bytes of repeated passages), removed (what of them a smaller id has too), clean_text.

    Only documents that share a passage with another have rows, one for each row of `docs`.
    """
    found = repeated_chunks(docs, p)
    later = F.when(F.col("first_id") < F.col("doc_id"), F.col("chunk"))
    per_doc = found.groupBy("doc_id", "own").agg(F.collect_set("chunk").alias("shared"), F.collect_set(later).alias("later"))  # at most a document's own chunks
    joined = _keyed(docs).join(per_doc, ["doc_id", "own"]).select("doc_id", "text", "shared", "later")

    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "text", "spans", "removed", "clean_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, shared, later in zip(*(c.to_pylist() for c in b.columns)):
                bounds = np.concatenate([[0], cuts(text, p), [len(text)]])
                whole = passages(shared, bounds, p.least)
                if not whole:
                    continue
                # What goes is the part of reported passages that a smaller id has, however short.
                gone = [k for k in later if any(a <= bounds[k] < b for a, b in whole)]
                both = [aligned(text, x) for x in (whole, passages(gone, bounds, 0))]
                as_dicts = [[{"start": x, "end": y} for x, y in s] for s in both]
                rows.append((None if doc == LEAST_ID else doc, text.decode(), *as_dicts, without(text, both[1]).decode()))
            kinds = [pa.int64(), pa.string(), spans, spans, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    pair = "array<struct<start:int,end:int>>"
    return joined.mapInArrow(run, f"doc_id long, text string, spans {pair}, removed {pair}, clean_text string")


def with_digests(found: DataFrame) -> DataFrame:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), total("spans").alias("shared_bytes"), said("spans").alias("spans"), total("removed").alias("removed_bytes"), said("removed").alias("removed"), F.sha2("clean_text", 256).alias("clean_sha256"))
