"""SpotSigs fingerprints: each common word is an anchor, and it and the content words after it make a signature.

A fingerprint is the set of a text's signatures, as the hex digits of its sorted
32-bit hashes. Sets are compared by their Jaccard likeness from a limit (`at_least`)
on: the ratio of two sets' lengths bounds their likeness, so sets whose lengths lie
in partitions too far apart are passed over, and what is shared is counted only as
long as the limit can still be reached. Less likeness counts as 0.
`near_pairs` joins a whole table that way.

The next document by ascending id is found without a total sort: rows go to
ranges of ids, and the first row of each range also to the range before it.

Defined results: a null text counts as empty; texts without words have the empty
fingerprint, and two of these are alike (1.0); without an anchor each word is one;
of rows with one id the next in order of their texts follows, null ids come first;
a lone row follows itself; a very long text is held with its neighbour, in one
task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import durable

# Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    "a an and are as at be but by for from had has have he his i in is it its not of on or she that the their there this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les lui mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous "
    "auch auf aus bei das dem den der des die ein eine einem einen einer es für ich im ist mit nach nicht oder sich sie sind und von war wie wir zu zum zur "
    "al como con del el ella ellos entre era esta este fue ha han las lo los más me mi no o para pero por se si sin su sus también te una uno y ya".split()
)
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"
CHAIN = 2
#: Signatures that are looked up between two looks at the limit.
STEP = 256
LOWEST = -(1 << 63)


class Codes(dict):
    """64-bit codes of words as written: lowest bit 1 for anchors, 0 for what has no letter or digit."""

    longest, most = 40, 1 << 17

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        bare = word.strip(EDGES)
        code = (xxh64_intdigest(bare) & ~1 | (bare in ANCHORS) or 2) if bare else 0
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = code
        return code


CODES = Codes()


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's spot signatures."""
    words = text.lower().split()
    codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))
    codes = codes[codes != 0]
    anchor = (codes & np.uint64(1)).astype(bool)
    spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
    first = np.searchsorted(content, spots)
    spots, first = spots[first < len(content)], first[first < len(content)]
    if not len(spots):
        spots, content = np.arange(len(codes)), np.arange(len(codes))
        first = spots + 1
    chain = np.append(codes[content], np.zeros(CHAIN + 1, np.uint64))
    h = codes[spots] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(CHAIN):
        h = (h ^ (h >> np.uint64(29)) ^ chain[first + k]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Likeness of two sorted sets if it is `at_least` or more, else 0.0; the lengths' partitions alone, or a part of the sets, may tell."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if at_least > 0 and (abs(length_partition(len(a), at_least) - length_partition(len(b), at_least)) > 1 or min(len(a), len(b)) < at_least * max(len(a), len(b))):
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    need, common = at_least * (len(a) + len(b)) / (1 + at_least), 0
    for k in range(0, len(short), STEP):
        part = short[k : k + STEP]
        at = np.minimum(np.searchsorted(long, part), len(long) - 1)
        common += int((long[at] == part).sum())
        if common + len(short) - k - len(part) < need - 1e-9:  # all that is left would not do
            return 0.0
    return common / (len(a) + len(b) - common)


def length_partition(n: int, at_least: float) -> int:
    """Sets as like as `at_least` lie in one partition or in neighbours."""
    return int(math.log(max(n, 1)) / -math.log(min(at_least, 0.999999)))


def hexed(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def _range_of(key: Column, bounds: list[int], lo: int = 0) -> Column:
    """The number of bounds at or below the key, as a tree of comparisons."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _range_of(key, bounds[:mid], lo)).otherwise(_range_of(key, bounds[mid + 1 :], lo + mid + 1))


def _with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """range, tail, doc_id, text: sorted within partitions; a range ends in the tail rows, of which the first follows its last row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    cuts = df.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    df = df.withColumn("range", _range_of(F.col("key"), sorted(set(cuts))))
    firsts = sorted((r["range"], r["first"]) for r in df.groupBy("range").agg(F.min("key").alias("first")).collect())  # a row per range
    if not firsts:
        return df.withColumn("tail", F.lit(False)).select("range", "tail", "doc_id", "text"), n
    before = [x for k, (_, first) in enumerate(firsts) for x in (F.lit(first), F.lit(firsts[k - 1][0]))]
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    also = F.struct(F.element_at(F.create_map(*before), F.col("key")).alias("range"), F.lit(True).alias("tail"))
    starts = F.col("key").isin([first for _, first in firsts])
    dealt = df.withColumn("to", F.explode(F.when(starts, F.array(own, also)).otherwise(F.array(own)))).select("to.range", "to.tail", "doc_id", "text")
    return dealt.repartitionById(n, F.col("range").cast("int")).sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), "text"), n  # a range has a task of its own


def fingerprint_with_edits(docs: DataFrame, at_least: float = 0.2) -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next: likeness of `at_least` or more, else 0.

    The edited text has its last quarter replaced by the start of the next document.
    """
    dealt, _ = _with_next(docs)
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(own: tuple, after: tuple) -> tuple:
        (_, doc_id, text, sigs), (_, _, more, following) = own, after
        part = len(text) // 4
        edited = text[: len(text) - part] + more[:part]
        changed = signatures(edited)
        return doc_id, len(text), edited, hexed(sigs), hexed(changed), jaccard(sigs, changed, at_least), jaccard(sigs, following, at_least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for the next one, the range whose tail has come
        for b in batches:
            rows, size = [], 0
            for at, tail, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if tail and at == done:
                    continue
                now = (at, doc_id, t := text.as_py(), signatures(t))
                if held:
                    rows.append(row(held, now))
                    size += len(rows[-1][2]) + len(rows[-1][3]) + len(rows[-1][4])
                held, done = (None, at) if tail else (now, done)
                if size > 1 << 24:
                    yield as_batch(rows)
                    rows, size = [], 0
            yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_pairs(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """a, b, likeness of all pairs of different fingerprints at least so alike; each stands for its least doc_id.

    Sets are sorted rarest signature first, and two as alike as that share one
    among the first few of each. They are joined on it and on the partition of
    their lengths: a set meets those of its own partition and, as the shorter
    one, of the next. Copies are one set; membership is that of the fingerprint.
    """
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be over 0 and at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [signatures(t.as_py() or "").astype(np.int64).tolist() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sigs array<long>")
    sets = durable(made.where(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("rep")))
    spots = sets.select("rep", F.explode("sigs").alias("sig"))
    rare = spots.join(spots.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    ordered = rare.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))  # a set's own signatures
    n = F.size("s")
    width = F.log(n) / (-math.log(min(at_least, 0.999999)))
    ordered = ordered.select("rep", F.transform("s", lambda x: x["sig"]).alias("s"), n.alias("n"), F.floor(width).cast("int").alias("part"))
    first = F.explode(F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * at_least - 1e-9).cast("int") + 1)).alias("sig")
    own = ordered.select("rep", "n", "s", "part", first)
    small = own.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1))).select(F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("s").alias("sx"), "part", "sig")
    met = small.join(own.select(F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("s").alias("sy"), "part", "sig"), ["sig", "part"])
    met = met.where(((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))) & (F.col("nx") >= at_least * F.col("ny") - 1e-9))
    pairs = met.dropDuplicates(["x", "y"])
    common = F.size(F.array_intersect("sx", "sy"))
    out = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (common / (F.col("nx") + F.col("ny") - common)).alias("likeness"))
    return out.where(F.col("likeness") >= at_least)
