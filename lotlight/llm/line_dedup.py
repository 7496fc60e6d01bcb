"""Line dedup: lines that spread over many sites are boilerplate and go.

Per line digest, HyperLogLog sketches of the sites merge by aggregation. An
estimate far above the limit, by `errors` standard errors, decides by itself; lines
whose estimate is nearer get an exact distinct count, so the outcome is the exact
one but for an estimate that strays further than that. Everything is built-in
functions.

Boilerplate stands between other text. `mirror_run` or more such lines in a row
(blank ones between them don't count), and a document of no other lines, are a
mirrored text: they stay for the near-duplicate stage to judge.

Defined results: lines compare without the white space (\\x09-\\x0D, \\x20) around
them, blank lines always stay; a null text stays null and has no lines; null
sites count as one site; a very long text's lines are one array in one task; equal
rows get equal results; an empty table gives an empty one; other columns pass
through, whatever they are called, unless named like those of RESULT.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import WS, durable, spread_join, unused

RESULT = ("n_lines", "n_removed", "clean_text")


@dataclass(frozen=True)
class LineDedupParams:
    min_sites: int = 8
    #: log2 of the sketch's registers; its relative standard error is 1.04 / sqrt(2 ** lg_k).
    lg_k: int = 12
    #: Estimates within so many standard errors of the limit, and one site at least, are counted exactly.
    errors: float = 6.0
    #: So many spread lines in a row are no boilerplate.
    mirror_run: int = 4


def _key(df: DataFrame) -> Column:
    """128 bits of what decides a row's result: its text. doc_id is in it to spread copies."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))))


def _bare(lines: Column) -> Column:
    """The lines that aren't blank, without white space around them, and their places among all lines."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(WS)).alias("bare")))
    return F.filter(placed, lambda x: x["bare"] != "")


def line_occurrences(docs: DataFrame, site: str = "source") -> DataFrame:
    """One row for each line that isn't blank: key (of the document), place (among these), pos (among all), site, line (128-bit digest)."""
    own = docs.select(_key(docs).alias("key"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(_bare(F.split("text", "\n", -1))).alias("place", "one"))
    return own.select("key", "place", "one.pos", "site", F.unhex(F.md5("one.bare")).alias("line"))


def spread_lines(lines: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """The digests (`line`) found on `min_sites` sites or more."""
    near = max(1.0, p.errors * 1.04 / 2 ** (p.lg_k / 2) * p.min_sites)
    estimated = (
        lines.groupBy("line")
        .agg(F.count("*").alias("n"), F.hll_sketch_agg("site", p.lg_k).alias("sketch"))
        .where(F.col("n") >= p.min_sites)  # fewer lines can't be on so many sites
        .select("line", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= p.min_sites - near)
    )
    estimated = durable(estimated)
    above = estimated.where(F.col("sites") > p.min_sites + near).select("line")
    close = estimated.where(F.col("sites") <= p.min_sites + near).select("line")
    exact = (
        spread_join(lines.select("line", "site", "key", "pos"), close, ["line"], F.struct("key", "pos"), how="inner")
        .groupBy("line")
        .agg(F.countDistinct("site").alias("sites"))
        .where(F.col("sites") >= p.min_sites)
        .select("line")
    )
    return above.unionByName(exact)


def _boilerplate(spread: Column, run: int) -> Column:
    """Of a document's spread lines (sorted structs of place and pos) the pos of those in runs shorter than `run`."""
    place = lambda k: F.get(spread, k)["place"]
    within = lambda j, i: F.coalesce(place(j - i + run - 1) - place(j - i) == run - 1, F.lit(False))
    mirrored = lambda j: reduce(lambda a, b: a | b, [within(j, i) for i in range(run)])
    return F.transform(F.filter(spread, lambda x, j: ~mirrored(j)), lambda x: x["pos"])


def line_dedup(docs: DataFrame, p: LineDedupParams = LineDedupParams(), site: str = "source") -> DataFrame:
    """`docs` with n_lines (not blank), n_removed and clean_text."""
    lines = durable(line_occurrences(docs, site))
    found = spread_join(lines.select("line", "key", "place", "pos"), spread_lines(lines, p), ["line"], F.struct("key", "pos"), how="inner")
    spread = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("place", "pos"))).alias("spread"))  # at most a document's own lines
    df = docs.select([f"`{c}`" for c in docs.columns if c.lower() not in RESULT])
    row, all_, gone = (unused(df, x) for x in ("_row", "_all", "_gone"))
    mark = F.struct(F.size("spread").alias("n"), _boilerplate(F.col("spread"), p.mirror_run).alias("pos"))
    df = df.withColumn(row, _key(df)).join(spread.select(F.col("key").alias(row), mark.alias(gone)), row, "left").drop(row)
    df = df.withColumns({all_: F.split("text", "\n", -1)})
    df = df.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_bare(F.col(all_)))).cast("long"))
    cut = F.col(gone).isNotNull() & (F.col(f"{gone}.n") < F.col("n_lines")) & (F.size(f"{gone}.pos") > 0)
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(f"{gone}.pos")), lambda i: F.get(F.col(all_), i))
    return df.withColumns(
        {
            "n_removed": F.when(cut, F.size(f"{gone}.pos")).otherwise(F.lit(0)).cast("long"),
            "clean_text": F.when(cut, F.array_join(rest, "\n")).otherwise(F.col("text")),
        }
    ).drop(all_, gone)
