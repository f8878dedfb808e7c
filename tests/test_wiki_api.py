import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from revlens.functions import rendered
from revlens.sources import api, dumps, lines, wiki_api

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def answer(revs, after=None):
    told = [{"revid": r, "timestamp": "2020-01-01T00:00:00Z", "user": "u", "*": f"t{r}"} for r in revs]
    more = {"query-continue": {"revisions": {"rvstartid": after}}} if after is not None else {}
    return json.dumps({"query": {"pages": {"1": {"pageid": 1, "ns": 0, "title": "T", "revisions": told}}}, **more})


def server(page, start, limit):
    """Twenty revisions; page b fails for more than three at once, page c always, page d leads back."""
    if page == "c" or page == "b" and limit > 3:
        raise wiki_api.ApiError("busy")
    if page == "e":
        return "no json"
    revs = [r for r in range(20) if r >= start]
    if page == "d" and start >= 10:
        return answer(revs[:limit], 10)
    return answer(revs[:limit], revs[limit] if len(revs) > limit else None)


def test_pages_are_asked_in_turn_and_in_smaller_parts(spark):
    requests = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 5), ("e", 0), ("a2", 17)], "page string, start long")
    told = wiki_api.answers(requests, server, limit=10, tasks=3)
    got = {r["page"]: r for r in told.groupBy("page").agg(F.count("json").alias("n"), F.first("error", ignorenulls=True).alias("error"), F.sort_array(F.collect_list("start")).alias("starts")).collect()}
    assert got["a"]["n"] == 2 and got["a"]["error"] is None and got["a2"]["n"] == 1
    assert got["b"]["n"] == 10 and got["b"]["error"] is None  # ten, five and then two at a time
    assert got["c"]["n"] == 0 and "busy" in got["c"]["error"] and got["e"]["n"] == 0
    assert "no progress" in got["d"]["error"]
    revs = api.revisions_of_answers(told.where("page in ('a', 'b')"), "json").groupBy("rev_id").count().collect()
    assert sorted((r["rev_id"], r["count"]) for r in revs) == [(r, 2) for r in range(20)]


def test_what_is_known_is_not_asked_again(spark):
    pages = spark.createDataFrame([("a",), ("z",)], "page string")
    known = spark.createDataFrame([("a", 3), ("a", 11)], "page string, rev_id long")
    requests = wiki_api.requests_of(pages, known)
    assert sorted(map(tuple, requests.collect())) == [("a", 12), ("z", 0)]
    (row,) = wiki_api.answers(requests.where("page = 'a'"), server).collect()
    assert [r["revid"] for r in json.loads(row["json"])["query"]["pages"]["1"]["revisions"]] == list(range(12, 20))


def test_a_stream_of_changes_goes_on_behind_its_offset(spark, tmp_path):
    (tmp_path / "n").write_text("7")
    file = str(tmp_path / "n")

    def growing(page, start, limit):
        with open(file) as f:
            n = int(f.read())
        revs = [r for r in range(n) if r >= start]
        return answer(revs[:limit], revs[limit] if len(revs) > limit else None)

    spark.dataSource.register(wiki_api.changes_source(growing, 3))

    def run():
        query = spark.readStream.format("wiki_changes").option("page", "p").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination(120)
        return sorted(r["rev_id"] for r in api.revisions_of_answers(spark.read.parquet(str(tmp_path / "out")), "json").collect())

    assert run() == list(range(7))
    (tmp_path / "n").write_text("12")
    assert run() == list(range(12))


def test_updates_lie_in_a_tree_of_files_by_page(spark, tmp_path):
    revision = lambda n, s: f"<revision><id>{n}</id><timestamp>2020-01-01T00:00:{s:02d}Z</timestamp><contributor><ip>1.1.1.1</ip></contributor><text>t{n}</text></revision>"
    for page, body in ((123456, revision(5, 1) + revision(6, 9)), (7, revision(8, 30))):
        name = f"{page:012d}"
        folder = tmp_path / "up" / name[:3] / name[3:6] / name[6:9]
        folder.mkdir(parents=True)
        (folder / f"{name}.xml").write_text(body)
    (tmp_path / "d.xml").write_text(f"<mediawiki><page><title>A</title><id>123456</id>{revision(1, 0)}{revision(2, 5)}</page></mediawiki>")
    updates = dumps.read_updates(spark, str(tmp_path / "up"))
    assert sorted((r.page_id, r.rev_id) for r in updates.collect()) == [(7, 8), (123456, 5), (123456, 6)]
    whole = dumps.with_updates(dumps.read_dump(spark, str(tmp_path / "d.xml")), updates)
    assert sorted((r.page_id, r.title, r.rev_id) for r in whole.collect()) == [(123456, "A", 1), (123456, "A", 2), (123456, "A", 6)]


def test_marks_become_spans(spark):
    html = '<p>{{#t:9,12,ann}}one two <b>{{#t:0,13,b"o}}three</b> {{#t:4,1,x}}</p><dt>{{#t</dt>\n<dd>2,7,c}}term</dd> <span class="editsection" id=1>[<a title="Edit {{#t:1,2,d}}here">x</a></span>'
    told = rendered.with_spans(html, 5.0)
    assert '<span class="trust9" data-origin="12" title="ann">one two </span>' in told and '<span class="trust1" data-origin="13" title="b&quot;o">three</span>' in told
    assert '<dt><span class="trust5" data-origin="7" title="c">term</span></dt>' in told and 'title="Edit here"' in told and "{{#t" not in told
    (row,) = spark.createDataFrame([(html, 5.0)], "h string, m double").select(rendered.coloured_page("h", F.col("m")).alias("t")).collect()
    assert row["t"] == told and rendered.with_spans("", 0) == ""


def test_bad_lines_and_breaks_of_order_are_told(spark):
    df = spark.createDataFrame([('"Bo t"',), ("no quotes",), ("",), ('""',)], "value string")
    assert sorted(r["value"] for r in lines.bad_robot_lines(df).collect()) == ['""', "no quotes"]
    rows = spark.range(40).repartitionByRange(5, "id").sortWithinPartitions("id").select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(F.col("id")).alias("t"), F.monotonically_increasing_id().alias("place"))
    assert sorted((r["id"], r["before"]) for r in lines.order_breaks(rows, "place", "t").collect()) == [(10, 9), (20, 19), (30, 29)]


def test_days_are_read_in_their_order_without_an_exchange(spark, tmp_path):
    from pyspark.sql import Window

    from revlens.operators import stats

    rows = spark.range(500).select("id", F.timestamp_seconds(1_600_000_000 + F.col("id") * 7919 % 900_000).alias("ts"))
    days = stats.write_days(rows, f"days_{abs(hash(str(tmp_path)))}", str(tmp_path / "days"), "ts", 4)
    daily = days.groupBy("day").count()
    gaps = days.withColumn("before", F.lag("ts").over(Window.partitionBy("day").orderBy("ts")))
    for frame in (daily, gaps):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {r["day"]: r["count"] for r in daily.collect()} == {r["day"]: r["count"] for r in rows.groupBy(F.date_trunc("day", "ts").alias("day")).count().collect()}
