import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from revlens.operators import tracking
from revlens.streaming import pages as P

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "page string, event long, ts timestamp, kind int, author long, weight double, words array<string>"
RULE = tracking.Trust(kind="signed", recents=4)


def events(n, seed=5):
    r = random.Random(seed)
    texts, rows = {}, []
    for k in range(n):
        page = r.choice("aaaabc")
        past = texts.setdefault(page, [["w%d" % r.randint(0, 40) for _ in range(20)]])
        words = list(r.choice(past[-4:]))
        words[r.randint(0, len(words)) : 0] = ["n%d" % r.randint(0, 40) for _ in range(r.randint(0, 5))]
        del words[60:]
        vote = r.random() < 0.15
        rows.append((page, k, START + timedelta(minutes=7 * k), int(vote), r.randint(0, 5), r.choice([0.5, 3.0]), None if vote else words))
        if not vote:
            past.append(words)
    return rows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, P.ROCKSDB)
    yield
    spark.conf.set(key, before)


LATE = []


def run(spark, folder, step, per_batch=None):
    stream = spark.readStream.schema(SCHEMA)
    stream = stream.option("maxFilesPerTrigger", per_batch) if per_batch else stream
    out = step(stream.parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    LATE.append(P.late_events(out))
    return spark.read.parquet(f"{folder}/out")


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


END = ("end", 10**6, START + timedelta(days=400), 0, 0, 0.0, [])


def told(frame):
    return sorted((r["page"], r["revision"], r["ts"], r["words"], r["trust"], r["origin"], r["signature"]) for r in frame.where("page <> 'end'").collect())


@pytest.mark.parametrize(("files", "per_batch"), [(1, None), (4, 1)])
def test_a_page_in_the_state_store_is_the_page_of_the_fold(spark, rocks, tmp_path, files, per_batch):
    rows = events(90)
    shuffled = random.Random(1).sample
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        add(spark, tmp_path, shuffled(part, len(part)))
    add(spark, tmp_path, [END])
    got = told(run(spark, tmp_path, lambda s: P.page_trust(s, RULE), per_batch))
    batch = spark.createDataFrame(rows, SCHEMA).select("page", F.col("event").alias("revision"), "author", "ts", "weight", "words", (F.col("kind") == 1).alias("vote"), "kind")
    want = told(tracking.track_words(batch, ["ts", "kind", "revision"], RULE))
    assert got == want and len(got) == 90


def test_a_stream_that_is_stopped_goes_on_where_it_was(spark, rocks, tmp_path):
    rows = events(80, 9)
    add(spark, tmp_path, rows[:50])
    first = told(run(spark, tmp_path, lambda s: P.page_trust(s, RULE), 1))
    add(spark, tmp_path, rows[50:])
    add(spark, tmp_path, [END])
    got = told(run(spark, tmp_path, lambda s: P.page_trust(s, RULE), 1))
    batch = spark.createDataFrame(rows, SCHEMA).select("page", F.col("event").alias("revision"), "author", "ts", "weight", "words", (F.col("kind") == 1).alias("vote"), "kind")
    assert 0 < len(first) < 50 and got == told(tracking.track_words(batch, ["ts", "kind", "revision"], RULE))


def test_recent_texts_go_out_when_a_page_is_forgotten(spark, rocks, tmp_path):
    rows = events(40, 3)
    rule = tracking.Trust(kind="signed", recents=3, percolates=True)
    add(spark, tmp_path, rows)
    add(spark, tmp_path, [END])
    got = told(run(spark, tmp_path, lambda s: P.page_trust(s, rule, idle_ms=86_400_000), 1))
    batch = spark.createDataFrame(rows, SCHEMA).select("page", F.col("event").alias("revision"), "author", "ts", "weight", "words", (F.col("kind") == 1).alias("vote"), "kind")
    assert got == told(tracking.track_words(batch, ["ts", "kind", "revision"], rule))


def test_late_events_are_dropped_and_counted(spark, rocks, tmp_path):
    rows = events(30, 2)
    assert rows[0][0] == "a"
    end = START + timedelta(days=2)
    add(spark, tmp_path, rows[3:])
    add(spark, tmp_path, [(*END[:2], end, *END[3:])])
    run(spark, tmp_path, P.page_feed, 1)
    add(spark, tmp_path, rows[:1])
    add(spark, tmp_path, [("a", 500, end + timedelta(days=1), 0, 77, 0.0, None), ("end", 501, end + timedelta(days=3), 0, 0, 0.0, [])])
    feed = run(spark, tmp_path, P.page_feed, 1)
    got = feed.where("page = 'a'").orderBy("place").collect()
    own = [r for r in rows[3:] if r[0] == "a"]
    assert [r["event"] for r in got] == [*[r[1] for r in own], 500] and [r["place"] for r in got] == list(range(1, len(own) + 2))
    assert [r["previous"] for r in got] == [None, *[r[1] for r in own]]
    seen, counts = set(), []
    for r in own:
        seen.add(r[4])
        counts.append(len(seen))
    assert [r["n_authors"] for r in got] == [*counts, len(seen) + 1]
    assert LATE[-2:] == [0, 1] and {r["n_late"] for r in got} == {0}
