"""Quality rules: counting rules and the divergence of a document's histograms from its language's.

Everything is built-in functions over one row at a time. The language
references are one small aggregation over all documents (at most
``len(LANGUAGES) + 1`` rows), read back as literals, so that scoring is a scan
without join, shuffle or state.

Defined results: a null text counts as empty (no words, ``base_failed``); a null
or unknown language uses the reference pooled over those; repeated rows are
judged each for itself; a very long text's words are one array in one task; an
empty table gives an empty result; columns beside `text` and `lang` are passed
through, whatever they are called, unless named like those of RESULT, or ignored.

The references are by default pooled from the corpus that is judged, so a corpus
that is bad throughout sets its own norm; references from a trusted one
(`language_references`) can be given instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import WS, durable, fenced

# Common words of the four languages, most frequent first.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "auf", "für"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
}
LANGUAGES = tuple(COMMON_WORDS)
N_COMMON = 12
CHAR_CLASSES = ("lower", "upper", "digit", "punctuation", "symbol", "space", "beyond_ascii")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: Histograms of fewer words or characters are too noisy to be compared.
    guard_words: int = 50
    guard_chars: int = 300
    #: Jensen-Shannon distances (base 2, 0 to 1) beyond which a document goes.
    max_char_distance: float = 0.3
    max_word_distance: float = 0.22
    #: The share of a histogram's expected chance distance that the word limit allows on top.
    noise_share: float = 0.5


def _words(df: DataFrame) -> DataFrame:
    trimmed = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(WS))
    df = df.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn(
        "_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\t-\r ]+"))
    )
    return df.withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))


def _histograms(df: DataFrame) -> DataFrame:
    """Adds `n_words`, `word_chars`, `n_symbols`, `_chars` (counts by CHAR_CLASSES) and `_common`
    (counts of the language's common words as written in lower case, then of all other words)."""
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            # What is neither a small letter nor space is a tenth of most texts; the classes are counted there.
            "_rest": F.regexp_replace("_text", "[a-z\t-\r ]+", ""),
        }
    )
    stripped = lambda pattern: (F.octet_length("_rest") - F.octet_length(F.regexp_replace("_rest", pattern, ""))).cast("long")
    known = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise(F.lit(LANGUAGES[0]))
    hashes = [x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*[F.xxhash64(F.lit(w)) for w in v]))]
    df = df.withColumns(
        {
            "n_symbols": stripped("[#*$%&|<>]+"),
            "_upper": stripped("[A-Z]+"),
            "_digit": stripped("[0-9]+"),
            "_punct": stripped("[!-/:-@\\[-`{-~]+"),
            "_list": F.element_at(F.create_map(*hashes), known),
        }
    )
    hits = [(F.size("_hashes") - F.size(F.array_remove("_hashes", F.get("_list", F.lit(k))))).cast("long") for k in range(N_COMMON)]
    beyond = (F.octet_length("_text") - F.length("_text")).cast("long")
    other = F.length("_rest") - F.col("_upper") - F.col("_digit") - F.col("_punct")
    space = F.length("_text") - F.col("word_chars")
    lower = F.length("_text") - space - F.length("_rest")
    df = df.withColumns(
        {
            "_hits": F.array(*hits),
            "_chars": F.array(*[x.cast("long") for x in (lower, F.col("_upper"), F.col("_digit"), F.col("_punct") - F.col("n_symbols"), F.col("n_symbols"), space, F.greatest(other, beyond))]),
        }
    )
    total = F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("_common", F.array_append("_hits", F.col("n_words") - total)).drop("_rest", "_upper", "_digit", "_punct", "_list", "_hits")


def _repeats(df: DataFrame, p: QualityParams) -> DataFrame:
    """Adds n_dup_lines and n_repeat_words."""
    w = p.repeat_window
    df = df.withColumns(
        {
            "_lines": F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != ""),
            "_windows": F.when(
                F.size("_hashes") > w,
                F.transform(F.sequence(F.lit(1), F.size("_hashes") - (w - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, w))),
            ),
        }
    )
    # Most texts repeat no window; only the others are sorted.
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.when(
                F.size(F.array_distinct("_windows")) < F.size("_windows"),
                F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    same = lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k)["h"], F.lit(False))
    twice = F.transform("_sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    df = df.withColumn("_at", F.array_sort(F.array_compact(twice)))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(-w).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(w), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_lines", "_windows", "_sorted", "_at")


def features(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """`docs` with the counts of each text, and its two histograms in `_chars` and `_common`; one pass, no shuffle. Columns of `docs` must not begin with "_"."""
    return _repeats(_histograms(_words(docs)), p).drop("_text", "_words", "_hashes")


def _known(lang: Column) -> Column:
    return F.when(lang.isin(*LANGUAGES), lang).otherwise(F.lit(""))


def _guarded(p: QualityParams) -> Column:
    return (F.col("n_words") >= p.guard_words) & (F.aggregate("_chars", F.lit(0).cast("long"), lambda a, x: a + x) >= p.guard_chars)


def _references(histograms: DataFrame, p: QualityParams) -> dict[str, tuple[list[int], list[int]]]:
    part = lambda c, k: F.sum(F.when(_guarded(p), F.get(c, F.lit(k)))).alias(f"{"c" if c == "_chars" else "w"}{k}")
    sums = [part("_chars", k) for k in range(len(CHAR_CLASSES))] + [part("_common", k) for k in range(N_COMMON + 1)]
    rows = histograms.groupBy(_known(F.col("lang")).alias("known")).agg(*sums).collect()  # at most len(LANGUAGES) + 1 rows
    counts = {r["known"]: r.asDict() for r in rows if r["c0"] is not None}
    return {x: ([r[f"c{k}"] for k in range(len(CHAR_CLASSES))], [r[f"w{k}"] for k in range(N_COMMON + 1)]) for x, r in counts.items()}


def language_references(docs: DataFrame, p: QualityParams = QualityParams()) -> dict[str, tuple[list[int], list[int]]]:
    """Character-class and common-word counts of each known language ("": all others), over all documents past the guards."""
    return _references(_histograms(_words(docs.select("text", "lang"))), p)


def _distance(counts: Column, reference: dict[str, list[int]]) -> Column:
    """Jensen-Shannon distance of a count array from its language's reference; null without a reference or counts."""
    entries = []
    for lang, ref in sorted(reference.items()):
        n = sum(ref)
        if n:
            entries += [F.lit(lang), F.array(*[F.lit(x / n) for x in ref])]
    if not entries:
        return F.lit(None).cast("double")
    q = F.element_at(F.create_map(*entries), _known(F.col("lang")))
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(
        F.transform(counts, lambda x: x / F.nullif(total, F.lit(0))), q, lambda a, b: term(a, (a + b) / 2) / 2 + term(b, (a + b) / 2) / 2
    )
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def judged(df: DataFrame, references: dict, p: QualityParams = QualityParams()) -> DataFrame:
    """`features` with char_distance, word_distance, base_failed and kept."""
    df = df.withColumns(
        {
            "char_distance": F.when(_guarded(p), _distance(F.col("_chars"), {k: v[0] for k, v in references.items()})),
            "word_distance": F.when(_guarded(p), _distance(F.col("_common"), {k: v[1] for k, v in references.items()})),
            "base_failed": (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")),
        }
    )
    # A short text's histogram strays by chance: by about sqrt((k - 1) / (8 n ln 2)) for k classes of n words.
    noise = F.sqrt(F.lit(N_COMMON / (8 * math.log(2))) / F.greatest(F.col("n_words"), F.lit(1)))
    far = (F.coalesce("char_distance", F.lit(0.0)) > p.max_char_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > p.max_word_distance + p.noise_share * noise
    )
    return fenced(df.withColumn("kept", ~F.col("base_failed") & ~far).drop("_chars", "_common"), "kept")


def quality_rules(docs: DataFrame, p: QualityParams = QualityParams(), references: dict | None = None) -> DataFrame:
    """`docs` with the columns of RESULT. One scan for the references, unless given, and one to judge."""
    names = {c: c if c in ("text", "lang") else f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in RESULT}  # none is like those made below
    found = language_references(docs, p) if references is None else references
    out = judged(features(docs.select([F.col(f"`{c}`").alias(x) for c, x in names.items()]), p), found, p)
    return out.select(*[F.col(x).alias(c) for c, x in names.items()], *RESULT)


def quality_report(docs: DataFrame, p: QualityParams = QualityParams(), references: dict | None = None) -> DataFrame:
    """The same verdicts in doc_id and RESULT alone: the texts are read once, their counts kept in a checkpoint."""
    counted = durable(features(docs.select("doc_id", "lang", "text"), p).drop("text"))
    return judged(counted, _references(counted, p) if references is None else references, p).select("doc_id", *RESULT)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")


def js_distance(p: list[int], q: list[int]) -> float:
    """The same distance in plain Python, for tests and for looking at references."""
    sp, sq = sum(p), sum(q)
    out = 0.0
    for a, b in zip(p, q):
        a, b = a / sp, b / sq
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(out, 0.0))
