import random

import corpus_pipeline
import __spark_entry__ as entry
from revlens.llm.quality_rules import COMMON


def prose(r, n):
    common = COMMON["en"].split()
    return " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice("aeinrstlod") for _ in range(r.randint(3, 9))) for _ in range(n))


def test_every_decision_takes_effect(spark, tmp_path):
    r = random.Random(12)
    rows = [(i, prose(r, 150), "en", "s", 0) for i in range(60)]
    shared = prose(r, 60)
    rows += [
        (100, rows[3][1], "en", "s", 0),  # copy
        (101, rows[4][1] + " tail", "en", "s", 0),  # near copy
        (102, "few words", "en", "s", 0),
        (103, f"{prose(r, 80)} {shared} {prose(r, 80)}", "en", "s", 0),
        (104, f"{prose(r, 90)} {shared} {prose(r, 70)}", "en", "s", 0),
        (105, f"{prose(r, 90)} write to jo@mail.example.com {prose(r, 30)}", "en", "s", 0),
        (106, None, None, None, None),
        (None, prose(r, 120), "en", None, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        kept.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(kept[-1], docs.schema)
    ids = [{x["doc_id"] for x in k} for k in kept]
    everything = {x[0] for x in rows}
    assert ids[0] == everything - {102, 106}
    assert ids[1] == ids[0] - {100, 101} == ids[2] == ids[3] == ids[4]
    text = {x["doc_id"]: x["text"] for x in kept[3]}
    assert shared in text[103] and shared[20:-20] not in text[104]
    assert "[EMAIL]" in text[105] and "jo@" not in text[105]
    assert all(x["n_chars"] == len(x["text"]) for x in kept[3])
    run = entry.queries()["pipeline"](spark, str(tmp_path)).collect()
    # where the last documents are cut depends on their order in the table
    packed = lambda rows: {x["doc_id"]: x["doc_tokens"] for x in rows}
    assert packed(run) == packed(kept[4]) and sum(x["length"] for x in run) == sum(packed(run).values())


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _n long, _kept string, _name string, _doc long, _runs string, _row long, starts string, copy int, keys int, row int, `a.b c` string"


def test_edges_of_every_stage(spark):
    r = random.Random(31)
    one, two, long = prose(r, 120), prose(r, 130), prose(r, 9000)
    texts = [(1, one), (1, two), (1, two), (2, one + " more"), (3, None), (4, ""), (None, one), (None, two), (5, long), (6, long), (7, f"{prose(r, 200)} call +49 30 1234567 ")]
    more = (7, "k", "nm", 1, "rs", 2, "st", 3, 4, 5, "dot")
    docs = spark.createDataFrame([(d, t, "en", "s", 0, *more) for d, t in texts], CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        rows = got.collect()
        assert all(tuple(x)[5:] == more for x in rows), name
        # rows without an id stay, but for the quality rules' verdict on texts
        if name != "quality_rules":
            assert sum(x["doc_id"] is None for x in rows) == 2
        if name == "ngram_join":
            # equal rows once, other texts under one id each, near copies of a smaller id go
            assert sorted((x["doc_id"], x["text"]) for x in rows if x["doc_id"] is not None and x["text"]) == sorted([(1, one), (1, two), (5, long), (7, texts[-1][1])])
            assert {x["doc_id"] for x in rows if not x["text"]} == {3, 4}
        else:
            assert name == "quality_rules" or len(rows) == len(texts)
        assert stage(spark, docs.limit(0), "").collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "").collect() == []
