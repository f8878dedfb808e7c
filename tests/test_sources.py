import time

from pyspark.sql import functions as F

from revlens.operators import history
from revlens.sources import api, dumps, lines, revision_files
from revlens.streaming import feed

DUMP = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>A page</title><id>7</id>
<revision><id>12</id><timestamp>2019-05-04T10:00:00Z</timestamp><contributor><username>Ann</username><id>3</id></contributor><minor /><comment>c</comment><text xml:space="preserve"> two  words &lt;b&gt;
next</text></revision>
<revision><id>11</id><timestamp>2019-05-04T10:34:41Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text xml:space="preserve">x</text></revision></page>
<page><title>Talk:A page</title><id>8</id><revision><id>13</id><timestamp>2019-05-04T10:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>y</text></revision></page>
</mediawiki>"""


def test_dump_reads_and_writes_back(spark, tmp_path):
    (tmp_path / "in.xml").write_text(DUMP)
    revs = dumps.read_dump(spark, str(tmp_path / "in.xml"))
    rows = {r.rev_id: r for r in revs.collect()}
    assert set(rows) == {11, 12}
    assert rows[12].text == " two  words <b>\nnext" and rows[12].is_minor and rows[12].user_id == 3
    assert (rows[11].user_id, rows[11].username, rows[11].time - rows[12].time) == (0, "1.2.3.4", 2081.0)
    dumps.write_dump(revs, str(tmp_path / "out"))
    again = {r.rev_id: r for r in dumps.read_dump(spark, str(tmp_path / "out")).collect()}
    assert again == rows


def test_statistics_lines(spark):
    old = "EditInc 1500000000 PageId: 42 rev0: 1001 uid0: 8 rev1: 1002 uid1: 0 rev2: 1003 uid2: 5 d01:    3.50 d02:    4.00 d12:    0.25 n01: 1 n12: 1 t01: 60 t12: 90"
    df = spark.createDataFrame([(old,), ("Page: 42 Title: \"A \\\"b\\\"\"",), ("EditInc x",), ("",), ("EditInc 1 \x00",)], "value string")
    (row,) = lines.parse_statistics(df, "EditInc").collect()
    assert (row.time, row.rev2, row.d01, row.dp2, row.uname0, row.t12) == (1500000000.0, 1003, 3.5, None, None, 90.0)
    assert [tuple(r) for r in lines.page_titles(df).collect()] == [(42, 'A "b"')]


def test_reputations_and_robots(spark):
    df = spark.createDataFrame([("12.5 3 0 1",), ('13 4 0 2 7.5 "x y"',), ("bad",)], "value string")
    assert sorted(tuple(r) for r in lines.parse_reputations(df).collect()) == [(12.5, 3, 0, 1, None, None), (13.0, 4, 0, 2, 7.5, "x y")]
    names = spark.createDataFrame([('"Bo\\"t"',), ("no",), ('"Z"',)], "value string")
    assert sorted(r.name for r in lines.robot_names(names).collect()) == ['Bo"t', "Z"]
    users = spark.createDataFrame([(1, 2.0, "a"), (2, 0.0, "b")], "user_id long, rep double, username string")
    assert [r.value for r in lines.final_reputation_lines(users, F.lit(0)).collect()] == ['0. 1 -1 0 2.000000 "a"']


def test_stream_of_increments(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, -4.0)], "u long, x double").write.parquet(str(tmp_path / "in"))
    query = spark.readStream.schema("u long, x double").parquet(str(tmp_path / "in")).writeStream.foreachBatch(feed.increments_to(str(tmp_path / "inc"), "u", "x")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(tuple(r) for r in feed.reputations(spark.read.parquet(str(tmp_path / "inc"))).collect()) == [(1, 5.0), (2, 0.0)]


def test_stream_of_buckets(spark, tmp_path):
    spark.sql("select 1L page, timestamp'2024-01-01 05:00:00' + make_interval(0, 0, 0, 0, id) ts from range(30)").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("page long, ts timestamp").parquet(str(tmp_path / "in"))
    name = f"buckets_{time.time_ns()}"
    query = feed.time_buckets(rows, "page", "ts", late="1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table(name).collect()) == [11, 19]


def test_packed_blobs_hold_whole_texts(spark):
    sizes = [40, 5, 5, 0, 5, 5, 5, 5, 60, 1, 1, 1, 1, 1, 30, 9] * 3
    revs = [(k, 2 * i, chr(0xE4) * (n * (k + 1) // 2)) for k in range(3) for i, n in enumerate(sizes)]
    want, state = {}, {}
    for k, r, t in revs:
        blob, size, n = state.get(k, (0, 0, 0))
        if size >= 60 or (size >= 20 and n >= 4):
            blob, size, n = blob + 1, 0, 0
        state[k] = (blob, size + len(t.encode()), n + 1)
        want[k, r] = blob
    df = lines.packed(spark.createDataFrame(revs, "k long, r long, t string"), "k", "r", "t", least=20, most=60, many=4)
    assert {(x.k, x.r): x.blob_id for x in df.collect()} == want and max(want.values()) > 2
    back = lines.revisions_of_blob(lines.blob_of_revisions(df, ["k", "blob_id"], "r", "t"), "k", "blob")
    assert sorted(tuple(x) for x in back.collect()) == revs


def test_api_answers_and_revision_files(spark, tmp_path):
    answer = '{"query": {"pages": {"5": {"pageid": 5, "ns": 0, "title": "A", "revisions": [{"revid": 9, "timestamp": "2020-01-01T00:00:00Z", "user": "u", "minor": "", "*": "lone \\ud83d here"}, {"revid": 10, "timestamp": "2020-01-02T00:00:00Z", "user": "1.2.3.4", "anon": "", "*": "pair \\ud83d\\ude00"}]}, "6": {"pageid": 6, "ns": 1, "title": "Talk:A", "revisions": []}}}, "query-continue": {"revisions": {"rvstartid": 11}}}'
    rows = {r["rev_id"]: r for r in api.revisions_of_answers(spark.createDataFrame([(answer,), ("no json",), (None,)], "j string"), "j").collect()}
    assert set(rows) == {9, 10} and rows[9]["text"] == "lone \ufffd here" and rows[10]["text"] == "pair \U0001f600"
    assert rows[10]["is_anonymous"] and rows[9]["is_minor"] and rows[9]["continue_at"] == 11
    known = spark.createDataFrame([(5, "A"), (6, "B"), (7, "C")], "page_id long, title string")
    told = spark.createDataFrame([(5, "A2"), (8, "B"), (7, "C")], "page_id long, title string")
    assert {r["page_id"]: r["action"] for r in api.moved_pages(known, told).collect()} == {5: "rename", 6: "delete", 7: "keep"}
    revs = spark.createDataFrame([(p, p * 10 + n, f"t{p}.{n}") for p in (1, 999, 1000, 2500) for n in (0, 1)], "page_id long, rev_id long, text string")
    revision_files.write_revision_files(revs, str(tmp_path / "files"))
    got = revision_files.read_revisions(spark, str(tmp_path / "files"), [999, 2500])
    assert sorted(r["text"] for r in got.collect()) == ["t2500.0", "t2500.1", "t999.0", "t999.1"]
    assert sorted(r["rev_id"] for r in revision_files.last_coloured(revs, ["rev_id"], 1).collect()) == [11, 9991, 10001, 25001]
    assert {r["text"] for r in revision_files.without_texts(revs).collect()} == {""}


def test_collapsing_knows_addresses_and_missing_authors(spark):
    rows = [(1, 0, "1.1.1.1"), (2, 0, "1.1.1.1"), (3, 0, "2.2.2.2"), (4, 7, None), (5, 7, None), (6, None, None), (7, None, None)]
    revs = spark.createDataFrame([("p", *r) for r in rows], "page string, n int, author int, ip string")
    kept = lambda **more: sorted(r["n"] for r in history.collapse_same_author(revs, "page", "author", ["n"], **more).collect())
    assert kept() == [3, 5, 7] and kept(address="ip") == [2, 3, 5, 7]


def test_a_dump_in_many_splits_is_the_dump_in_one(spark, tmp_path, monkeypatch):
    revision = lambda n, text: f"<revision><id>{n}</id><timestamp>2020-01-01T00:00:{n % 60:02d}Z</timestamp><contributor><ip>1.1.1.{n % 9}</ip></contributor><text>{text}</text></revision>\n"
    pages = [f"<page>\n<title>P &amp; {p}</title>\n<id>{p}</id>\n" + "".join(revision(p * 1000 + k, f"é {'word ' * (k % 40)}&lt;{k}&gt;") for k in range(60)) + "</page>\n" for p in range(1, 6)]
    (tmp_path / "d.xml").write_text("<mediawiki>\n<siteinfo></siteinfo>\n" + "".join(pages) + "</mediawiki>\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    whole = dumps.read_dump(spark, str(tmp_path / "d.xml")).orderBy("rev_id").collect()
    try:
        spark.conf.set(key, "4096")
        split = dumps.read_dump(spark, str(tmp_path / "d.xml"))
        assert split.rdd.getNumPartitions() > 5
        assert split.orderBy("rev_id").collect() == whole
        monkeypatch.setattr(dumps, "BROADCAST_SPLITS", 3)
        assert dumps.read_dump(spark, str(tmp_path / "d.xml")).orderBy("rev_id").collect() == whole
    finally:
        spark.conf.set(key, before)
    assert len(whole) == 300 and {(r.page_id, r.title) for r in whole} == {(p, f"P & {p}") for p in range(1, 6)}
    assert whole[41].text == "é " + "word " * 1 + "<41>" and all(r.rev_id // 1000 == r.page_id for r in whole)


def test_broken_pieces_are_told_and_the_rest_is_read(spark, tmp_path):
    good = lambda n: f"<revision><id>{n}</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><ip>1.1.1.1</ip></contributor><text>t{n}</text></revision>"
    (tmp_path / "a.xml").write_text(f"<mediawiki><page><title>A</title><id>1</id>{good(1)}<revision><id>2</id><text>a <b> c</text></revision>{good(3)}</page><page><title>B</title><id>2</id><revision><text>no number</text></revision>{good(5)}</page>")
    (tmp_path / "b.xml").write_text(f"{good(6)}<page><title>C</title><id>3</id>{good(7)}<revision><id>8</id><text>cut o")
    pieces = dumps.read_pieces(spark, str(tmp_path / "*.xml"))
    assert sorted((r.page_id, r.rev_id) for r in dumps.read_dump(spark, str(tmp_path)).collect()) == [(1, 1), (1, 3), (2, 5), (3, 7)]
    told = sorted((r.file[-5:], r.page_id or 0, r.error.split(":")[0]) for r in dumps.broken(pieces).collect())
    assert [t[:2] for t in told] == [("a.xml", 1), ("a.xml", 2), ("b.xml", 0), ("b.xml", 3)]
    assert dumps.read_dump(spark, str(tmp_path / "a.xml"), leading_newline=True).where("rev_id = 1").first().text == "\nt1"


def test_a_file_that_cannot_be_unpacked_ends_where_it_breaks(spark, tmp_path):
    rows = [(1, "A", n, 0, "1.1.1.1", f"text {n} " * 50) for n in range(2000)]
    revs = spark.createDataFrame(rows, "page_id long, title string, rev_id long, user_id long, ip string, text string").selectExpr("*", "timestamp_seconds(rev_id) ts", "ip username", "false is_minor", "cast(null as string) comment")
    dumps.write_dump(revs, str(tmp_path / "out"), "gzip")
    again = dumps.read_dump(spark, str(tmp_path / "out"))
    assert again.count() == 2000 and again.where("text not like 'text%' or time <> rev_id").count() == 0
    (file,) = [f for f in (tmp_path / "out").iterdir() if f.name.endswith(".gz")]
    data = file.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "cut" / "b.gz").write_bytes(data)
    kept = dumps.read_dump(spark, str(tmp_path / "cut"), ignore_corrupt=True)
    assert kept.count() >= 2000 and kept.select("rev_id").distinct().count() == 2000


def test_a_written_dump_keeps_pages_together_and_escapes(spark, tmp_path):
    odd = "a <b> & \"c\" 'd' ]]> \x01 \r\n </revision> \U0001f600"
    rows = [(p, f"T<{p}>", p * 10 + k, k % 2, "u&" if k % 2 else None, None if k % 2 else "1.2.3.4", odd if k else None) for p in range(20) for k in range(5)]
    revs = spark.createDataFrame(rows, "page_id long, title string, rev_id long, user_id long, username string, ip string, text string").selectExpr("*", "timestamp_seconds(100 - rev_id % 10) ts", "rev_id % 3 = 0 is_minor", "'c' comment")
    dumps.write_dump(revs, str(tmp_path / "out"), files=4)
    files = [f.read_text() for f in (tmp_path / "out").iterdir() if f.name.startswith("part") and f.stat().st_size]
    assert len(files) == 4 and sum(f.count("<page>") for f in files) == 20
    got = {r.rev_id: r for r in dumps.read_dump(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 100 and got[11].text == odd.replace("\x01", "\ufffd") and got[10].text == "" and got[11].username == "u&" and got[10].ip == "1.2.3.4" and got[12].title == "T<1>" and got[12].is_minor


def test_votes_are_marked_once_however_often_a_batch_runs(spark, tmp_path):
    from revlens.operators import store

    votes = spark.createDataFrame([(1, 10, 2.0), (2, 10, 3.0), (3, 11, -1.0)], "vote long, u long, x double")
    votes.write.parquet(str(tmp_path / "in"))
    write = feed.all_of(feed.increments_to(str(tmp_path / "inc"), "u", "x"), feed.keys_to(str(tmp_path / "done"), "vote"))
    query = spark.readStream.schema(votes.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    write(votes, 0)  # the batch again, as after a failure between its writes
    assert sorted(tuple(r) for r in feed.reputations(spark.read.parquet(str(tmp_path / "inc"))).collect()) == [(10, 5.0), (11, 0.0)]
    table = spark.createDataFrame([(v, False) for v in range(1, 6)], "vote long, processed boolean")
    marked = store.mark(table, spark.read.parquet(str(tmp_path / "done")), "vote", "processed", F.lit(True))
    assert sorted(r["vote"] for r in marked.where("processed").collect()) == [1, 2, 3] and marked.count() == 5
