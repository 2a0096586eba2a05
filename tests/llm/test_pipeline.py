import re

import corpus_pipeline
from test_duplicates import near_copies, slow_components

from tideline.llm import mixing


def test_stages_one_by_one(spark, docs, odd, tmp_path):
    rows = [(d, f"the and of {t}" if d % 2 else t, "en" if d % 3 else "de", f"s{d % 3}") for d, t in near_copies(2, 80)]
    rows += [(900 + (d or 0), t, lang, s) for d, t, lang, s in odd] + [(950, 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" of', "en", "s1")]
    df, names = docs(rows), [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    before = df
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, "")
        after.write.parquet(str(tmp_path / name.replace(" ", "-")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        if name != names[-1]:
            assert after.columns == df.columns
        was, now = before.collect(), after.collect()
        if name == "language ID":
            assert {r["doc_id"] for r in was if re.search(r"[^\W\d_]", r["text"] or "")} >= {r["doc_id"] for r in now}
            assert all(re.search(r"[^\W\d_]", r["text"]) for r in now) and len(now) > 80
        elif name.startswith("n-gram"):
            left = slow_components([(r["doc_id"], r["text"]) for r in was], 5, 80)
            assert {r["doc_id"] for r in now} == {c for _, _, c in left}
            assert len(now) == len({c for _, _, c in left})
        elif name == "secret scans":
            assert len(now) == len(was) and sum("[SECRET]" in r["text"] for r in now) == sum("04dbeb" in r["text"] for r in was)
        elif name.startswith("mixing"):
            assert sum(len(r["text"].split()) for r in now) == sum(r["taken"] for r in mixing.shares(before).collect())
        else:
            assert {r["doc_id"] for r in now} == {r["doc_id"] for r in was}
        before = after


def test_run(spark, docs, tmp_path):
    docs([(d, t, "en", "a") for d, t in near_copies(5, 40)]).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
