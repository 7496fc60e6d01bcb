import duckdb
import numpy as np

import corpus_pipeline
from lotlight.llm.queries import ORACLES, QUERIES

from .conftest import prose
from .test_line_dedup import brute as line_brute
from .test_pii import base
from .test_near_texts import brute as near_brute, edited

from lotlight.llm.line_dedup import LineDedupParams
from lotlight.llm.packing import ByteBpe, pieces
from lotlight.llm.pii import find_spans, masked
from lotlight.llm.quality_rules import quality_rules
from lotlight.llm.tokenizer_files import byte_bpe_files


def test_whole_pipeline(spark, tmp_path):
    foot = "Licensed to all who read this line."
    rows = [(k, prose(k, 90) + f"\n{foot}\nwrite to me.{k}@mail.example or call +1 (724) 555-70{k % 90 + 10}", "en", f"s{k % 12}", 1) for k in range(40)]
    rows += [(300 + k, edited(rows[k][1], 1), "en", "s4", 1) for k in range(6)]
    rows += [(100 + k, rows[k][1], "en", "s1", 1) for k in range(5)] + [(200, prose(9, 200).upper(), "en", "s2", 1), (201, "too short", "en", "s3", 1), (202, None, "en", "s3", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in quality_rules(df).where("kept").collect()]
    assert {r.doc_id for r in kept} == {r[0] for r in rows} - {200, 201, 202}
    lines = {d: t for d, _, _, t in line_brute([r.asDict() for r in kept], LineDedupParams())}
    assert not any(foot in t for t in lines.values())
    first = near_brute(lines)
    masks = {d: masked(t, find_spans(t)) for d, t in lines.items() if first[d] == d}
    assert len(masks) == 40 and not any(base(t) for t in masks.values())
    bpe, want = ByteBpe(*byte_bpe_files()), []
    for d, t in masks.items():
        ids = np.append(np.frombuffer(bpe.encode(t), "<u4"), 1)
        want += [(d, a, n, ids[a : a + n].tolist()) for a, n in pieces(len(ids))]
    got = [(r.doc_id, r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages(spark, odd, none):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    for docs in (odd.select(*columns), none.select(*columns)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == list(columns), name
            stage(spark, docs, "").collect()


def test_oracles(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, d)
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr), name
