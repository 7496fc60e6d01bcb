"""Near-duplicate texts by exact likeness: the grouping of the pipeline's stage.

Two texts are alike if the Jaccard likeness of their sets of five-word shingles
is 0.8 or more. Such texts differ in 10 of 64 fingerprint bits on average, beyond
what a grid can search, so candidates come from two sides: the links of the
SimHash grid, and buckets of equal MinHash bands, which miss a pair at the limit
with a chance of 0.738 ** 28 = 0.0002. Every candidate is verified on the whole
texts, hence no link rests on a fingerprint alone.

Equal shingle sets are one text, and buckets of the same texts one bucket. First
each text is compared with one host: of all texts in its buckets the one that has
most company there, the same for most of a group of near copies, and a text of
its own for others. Buckets whose texts are then of one component are settled. In
each of the others all texts outside its largest component are compared with all
texts of the bucket, in blocks. So a link is lost only where two texts share
neither a bucket nor a grid cell, and a text is shipped once for its host, then
once for each open bucket and `block` texts outside the largest component there.
The work of the second step is that of those texts times their buckets: in a
group whose texts are unlike each other, but share buckets, it is quadratic.

Defined results: words and case as in `simhash`; a text of fewer words than a
shingle is one shingle, and texts without words (null too) are all alike; of rows that share an
id the text with the least MD5 is judged; rows with a null id are left out; equal
rows get equal results; a very long text takes memory for its own shingles, in a
block of up to `block` texts; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlight.llm.common import counted_join, durable, forget
from lotlight.llm.components import connected_components
from lotlight.llm.simhash import SimHashParams, fingerprint, print_links

BLOCK = 1 << 12


@dataclass(frozen=True)
class NearTextParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 28
    rows: int = 6
    seed: int = 42
    #: Texts that one task compares with a host, and texts of a bucket that are held at once while others are compared with them.
    block: int = 512


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and \x09-\x0D, \x20
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - shingle + 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketches(docs: DataFrame, p: NearTextParams) -> DataFrame:
    """doc_id, mark (the text's MD5), body (of equal shingle sets equal), print, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        from xxhash import xxh64_intdigest, xxh128_digest

        rng = np.random.Generator(np.random.PCG64(p.seed))
        times, plus = (rng.integers(0, 1 << 63, p.bands * p.rows, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        for b in batches:
            marks, bodies, prints, bands = [], [], [], []
            for x in b.column(1):
                text = x.as_py() or b""
                hashes = shingle_set(text, p.shingle, p.seed)
                least = np.full(p.bands * p.rows, (1 << 32) - 1, np.uint64)
                for k in range(0, len(hashes), BLOCK):
                    np.minimum(least, ((hashes[k : k + BLOCK, None] * times + plus) >> np.uint64(32)).min(axis=0), out=least)
                rows = least.astype("<u4").reshape(p.bands, p.rows)
                marks.append(md5(text).digest())
                bodies.append(xxh128_digest(hashes.astype("<u8").tobytes()))
                prints.append(fingerprint(text))
                bands.append(np.array([xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64).view(np.int64))
            values = [b.column(0), pa.array(marks, pa.binary()), pa.array(bodies, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "mark", "body", "print", "bands"])

    ids = docs.where(F.col("doc_id").isNotNull())
    return ids.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, mark binary, body binary, print long, bands array<long>")


def _verified(texts: DataFrame, pairs: DataFrame, p: NearTextParams) -> DataFrame:
    """Those of `pairs` (a, b; each once, read several times) whose texts (doc_id, text; each id once) are alike. Each task
    of a host b has up to about `block` of its guests, and b's text before them."""
    hosts = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("ways", F.ceil(F.col("n") / p.block).cast("int"))
    dealt = counted_join(pairs, hosts, "b", pairs.count()).select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), "ways").cast("int").alias("way"))
    own = hosts.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
    rows = texts.join(dealt.unionByName(own), "doc_id").select("b", "way", (F.col("doc_id") != F.col("b")).alias("guest"), "doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, hashes = None, None
        for batch in batches:
            out = []
            for b, guest, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                found = shingle_set(text.as_py() or b"", p.shingle, p.seed)
                if not guest:
                    host, hashes = b, found
                elif host == b and likeness(hashes, found) >= p.similarity:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("b", "way").sortWithinPartitions("b", "way", "guest").mapInArrow(run, "a long, b long")


def _counter(sets: list[np.ndarray]):
    """A function from a set to the sizes of what it shares with each of `sets`."""
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    owners = owners[order]
    known, starts, counts = np.unique(values[order], return_index=True, return_counts=True)

    def count(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        at = at[known[at] == x]
        n = counts[at]
        rows = np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owners[rows], minlength=len(sets))

    return count


def _links_of_blocks(batches: Iterator[pa.RecordBatch], p: NearTextParams) -> Iterator[pa.RecordBatch]:
    """Batches of key, block, way, guest, root, text, sorted by the first four. Links of roots; those that a block's earlier links imply are left out."""
    group, count = None, None
    roots, sets, parent = [], [], {}

    def find(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    for batch in batches:
        out = []
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for key, block, way, guest, root, text in zip(*columns, batch.column(5)):
            if group != (key, block, way):
                group, count = (key, block, way), None
                roots, sets, parent = [], [], {}
            found = shingle_set(text.as_py() or b"", p.shingle, p.seed)
            if not guest:
                roots.append(root), sets.append(found)
                continue
            if not sets:
                continue
            if count is None:
                count, sizes = _counter(sets), np.array([len(x) for x in sets])
            both = count(found)
            for k in np.flatnonzero(both / (len(found) + sizes - both) >= p.similarity).tolist():
                low, high = sorted((find(root), find(roots[k])))
                if low != high:
                    parent[high] = low
                    out.append((high, low))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _settled(texts: DataFrame, held: DataFrame, p: NearTextParams) -> DataFrame:
    """Links a, b between roots of like texts for all buckets of `held` (key, id, root): hosts, outside the largest component,
    with all. Both sides of a large bucket are dealt to tasks, by hash."""
    counts = held.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    parts = lambda n: F.ceil(n / p.block).cast("int")
    sizes = durable(sizes.select("key", "main", parts(F.col("n") - F.col("most")).alias("blocks"), parts(F.col("n")).alias("ways"), "n"))
    rows = durable(counted_join(held, sizes, "key", sizes.agg(F.sum("n")).first()[0] or 0))
    own = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hosts = rows.where("root != main").select("key", own(1, "blocks").alias("block"), each("ways").alias("way"), F.lit(False).alias("guest"), "id", "root")
    guests = rows.select("key", each("blocks").alias("block"), own(2, "ways").alias("way"), F.lit(True).alias("guest"), "id", "root")
    wanted = texts.withColumnRenamed("doc_id", "id").join(hosts.unionByName(guests), "id")
    order = ["key", "block", "way", "guest"]
    dealt = wanted.select(*order, "root", F.col("text").cast("binary").alias("text")).repartition(*order[:3]).sortWithinPartitions(*order)
    links = durable(dealt.mapInArrow(lambda it: _links_of_blocks(it, p), "a long, b long"))
    forget(held.sparkSession, sizes, rows)
    return links


def _judged(docs: DataFrame, p: NearTextParams) -> tuple[DataFrame, DataFrame]:
    """Sketches and texts (doc_id, text) of one row for each id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    sketches = durable(_sketches(docs, p))
    again = durable(sketches.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("mark").alias("least")).where("n > 1"))
    total = again.agg(F.sum("n")).first()[0]
    if not total:
        return sketches, texts
    kept = lambda df, mark: counted_join(df, again, "doc_id", total).where(mark == F.col("least")).drop("least").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in df.columns if c != "doc_id"])
    both = lambda df, mark: df.join(again, "doc_id", "left_anti").unionByName(kept(df, mark).select(df.columns))
    one = durable(both(sketches, F.col("mark")))
    forget(docs.sparkSession, sketches)
    return one, both(texts, F.unhex(F.md5(F.coalesce("text", F.lit("")))))


def _buckets(bodies: DataFrame) -> DataFrame:
    """key, id, n for the texts of each MinHash bucket of n > 1; of buckets of the same texts one."""
    keys = bodies.select(F.explode("bands").alias("key"), "id")
    print_of = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), *print_of).where("n > 1").groupBy("n", "h0", "h1").agg(F.min("key").alias("key"))
    shared = durable(shared.select("key", "n", F.col("n").alias("size")))
    return durable(counted_join(keys, shared, "key", shared.agg(F.sum("n")).first()[0] or 0).withColumnRenamed("size", "n"))


def _first_hosts(keys: DataFrame) -> DataFrame:
    """a, b: of all texts in the buckets of a the one with most company over its own buckets, if that isn't a."""
    company = keys.withColumn("company", F.sum("n").over(Window.partitionBy("id")))  # a text has `bands` buckets at most
    hosts = company.groupBy("key").agg(F.max(F.struct("company", F.bitwise_not("id").alias("id"))).alias("host"), F.max("n").alias("n"))
    best = counted_join(keys.select("key", "id"), hosts, "key", keys.count()).groupBy("id").agg(F.max("host").alias("host"))
    return best.select(F.col("id").alias("a"), F.bitwise_not("host.id").alias("b"))


def _grid_pairs(bodies: DataFrame, simhash: SimHashParams) -> DataFrame:
    """a, b: texts with one fingerprint, and texts with fingerprints that the SimHash grid links."""
    n = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = durable(bodies.groupBy("print").agg(F.min("id").alias("b"), F.count("*").alias("n")).repartition(n, "print"))
    same = counted_join(bodies.select("print", F.col("id").alias("a")), prints, "print", bodies.count()).select("a", "b")
    first = lambda side: prints.select(F.col("print").alias(side), F.col("b").alias(f"{side}_id"))
    grid = print_links(prints.select("print"), simhash).distinct().join(first("a"), "a").join(first("b"), "b")
    return same.unionByName(grid.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")))


def near_texts(docs: DataFrame, p: NearTextParams = NearTextParams(), simhash: SimHashParams = SimHashParams()) -> DataFrame:
    """doc_id, component_id for each distinct id of `docs`; the least id of those reachable by links between like texts."""
    spark = docs.sparkSession
    sketches, texts = _judged(docs, p)
    bodies = durable(sketches.groupBy("body").agg(F.min("doc_id").alias("id"), F.min("print").alias("print"), F.min("bands").alias("bands"), F.count("*").alias("n")))
    keys = _buckets(bodies)
    pairs = durable(_grid_pairs(bodies, simhash).unionByName(_first_hosts(keys)).where("a != b").distinct())
    chosen = keys.select("id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct().withColumnRenamed("id", "doc_id")
    texts = durable(texts.join(chosen, "doc_id", "left_semi"))
    forget(spark)

    found = durable(_verified(texts, pairs, p))
    labels = connected_components(found).select(F.col("node").alias("id"), "root")
    roots = durable(bodies.select("id", "body", "n").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")))
    forget(spark, pairs, found)

    held = durable(keys.select("key", "id").join(roots.select("id", "root"), "id"))
    forget(spark, keys)
    links = _settled(texts, held, p)
    forget(spark, held, texts)
    labels = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("least"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("n")).join(labels, "root", "left").select("root", "n", F.coalesce("least", "root").alias("component_id"))
    components = counted_join(roots.select("body", "root", F.col("n").alias("rows")), sizes, "root", bodies.count())
    components = components.select("body", "component_id", F.col("rows").alias("n"))
    return counted_join(sketches.select("doc_id", "body"), components, "body", sketches.count()).select("doc_id", "component_id")
