from collections import defaultdict
from itertools import groupby

from lotlight.llm.line_dedup import LineDedupParams, line_dedup, line_occurrences, spread_lines

from .conftest import prose

WS = " \t\n\x0b\x0c\r"


def brute(rows, p):
    sites = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if line.strip(WS):
                sites[line.strip(WS)].add(r["source"] or "")
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], 0, 0, None))
            continue
        lines = r["text"].split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(WS)]
        hit = [len(sites[lines[k].strip(WS)]) >= p.min_sites for k in full]
        gone = set()
        for some, run in groupby(zip(full, hit), key=lambda x: x[1]):
            run = [k for k, _ in run]
            if some and len(run) < p.mirror_run and not all(hit):
                gone.update(run)
        out.append((r["doc_id"], len(full), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.clean_text) for r in df.collect()), key=repr)


def test_like_brute_force(spark):
    p = LineDedupParams(min_sites=3)
    rows = [(k, "\n".join([f"  All rights reserved {k % 2}. ", prose(k, 30).replace("\n", " "), "shared by two" if k < 2 else "own", "", "menu | home"]), f"site{k % 5}") for k in range(20)]
    rows += [(100 + k, "mirrored line one\nmirrored line two", f"site{k}") for k in range(5)]
    rows += [(200 + k, f"own {k}\nfirst\n\nsecond\nthird\nfourth\nmy {k}\nfirst\nsecond", f"site{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert got(line_dedup(df, p)) == brute([r.asDict() for r in df.collect()], p)
    kept = {r.doc_id: r for r in line_dedup(df, p).collect()}
    assert kept[0].n_removed == 2 and kept[3].n_removed == 3 and kept[100].n_removed == 0
    assert kept[200].clean_text == "own 0\nfirst\n\nsecond\nthird\nfourth\nmy 0"


def test_odd_rows(odd, none):
    p = LineDedupParams(min_sites=2)
    assert got(line_dedup(odd, p)) == brute([r.asDict() for r in odd.collect()], p)
    assert line_dedup(none).count() == 0


def test_near_lines_are_counted_exactly(spark):
    rows = [(k, "a\nb" if k < 8 else "a", f"s{k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert spread_lines(line_occurrences(df), LineDedupParams(min_sites=8, lg_k=4)).count() == 2
    assert spread_lines(line_occurrences(df), LineDedupParams(min_sites=9, lg_k=4)).count() == 1


def test_names_pass_through(spark):
    names = ["doc_id", "text", "source", "_removed", "_row", "_ALL", "_gone", "place", "key", "N_lines"]
    rows = [(k, f"own {k}\nfoot", f"s{k}", *[f"{c}{k}" for c in names[3:]]) for k in range(4)]
    out = line_dedup(spark.createDataFrame(rows, names), LineDedupParams(min_sites=2))
    assert out.columns == [*names[:-1], "n_lines", "n_removed", "clean_text"]
    assert {(r.doc_id, r.clean_text, r._removed, r._ALL) for r in out.collect()} == {(k, f"own {k}", f"_removed{k}", f"_ALL{k}") for k in range(4)}
