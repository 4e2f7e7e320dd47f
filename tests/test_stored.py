"""Merges into stored tables and discovery of results by their files."""

import glob
import hashlib

from pyspark.sql import functions as F

from timedspark.operators import merge as G
from timedspark.streaming import discovery as L
from timedspark.streaming import run as S


def files_of(path):
    return {f: hashlib.sha256(open(f, "rb").read()).hexdigest() for f in glob.glob(path.removeprefix("file:") + "/bucket=*/part-*")}


def test_untouched_buckets_keep_their_files(spark):
    path = S.new_folder(spark, "stored")
    first = spark.range(1_000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("at"))
    assert G.merge_stored(path, first, ["k"], "at", 16, 0) == list(range(16))
    before = files_of(path)
    rows = [(7, "new", 2), (7, "newer", 3), (8, "late", 0), (5_000, "added", 1)]
    touched = G.merge_stored(path, spark.createDataFrame(rows, "k long, v string, at int"), ["k"], "at", 16, 1)
    after = files_of(path)
    assert 1 <= len(touched) <= 3
    kept = lambda found: {f: h for f, h in found.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert kept(before) == kept(after) and len(kept(after)) == 16 - len(touched)
    got = {r["k"]: r["v"] for r in G.read_stored(spark, path, first.schema).collect()}
    assert len(got) == 1_001 and (got[7], got[8], got[9], got[5_000]) == ("newer", "old", "old", "added")


def test_a_merge_can_run_again(spark):
    """The same batch again changes nothing, also where the table lost a bucket while its folder was being replaced."""
    path = S.new_folder(spark, "again")
    rows = spark.createDataFrame([(k, "a", 1) for k in range(50)], "k long, v string, at int")
    G.merge_stored(path, rows, ["k"], None, 4, 0)
    changes = spark.createDataFrame([(3, "b", 0), (77, "c", 0)], "k long, v string, at int")
    touched = G.merge_stored(path, changes, ["k"], None, 4, 1)
    gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={touched[0]}")
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    assert G.merge_stored(path, changes, ["k"], None, 4, 1) == touched
    got = {r["k"]: r["v"] for r in G.read_stored(spark, path, rows.schema).collect()}
    assert len(got) == 51 and got[3] == "b" and got[77] == "c"


def test_an_empty_merge_and_a_table_not_yet_there(spark):
    path = S.new_folder(spark, "none")
    rows = spark.createDataFrame([], "k long, v string")
    assert G.merge_stored(path, rows, ["k"], None, 4, 0) == [] and G.read_stored(spark, path, rows.schema).count() == 0


def write_files(spark, folder, *names):
    spark.createDataFrame([(n, "x") for n in names], "file string, value string").write.mode("append").partitionBy("file").text(folder)


def test_a_result_appears_with_its_third_file(spark):
    folder, target = S.new_folder(spark, "reels"), S.new_folder(spark, "reels-found")
    rounds = [("a.mp4", "b.mp4", "a.captions.json", "c.txt", "d.jpg"), ("a.txt", "b.captions.json", "a.mp4"), ("b.txt", "a.txt", "c.mp4")]
    seen = []
    for names in rounds:
        write_files(spark, folder, *names)
        query = (L.finished_results(L.watch_files(spark, folder)).select("stem").writeStream.format("parquet").option("path", target)
                 .option("checkpointLocation", target + "-state").trigger(availableNow=True).start())
        assert query.awaitTermination(180)
        seen.append(sorted(r[0] for r in spark.read.schema("stem string").parquet(target).collect()))
    assert seen == [[], ["a"], ["a", "b"]]


def test_many_folders_are_listed_by_few_tasks(spark):
    """Not a task for each of them: 60 folders, 8 cores."""
    folder, context = S.new_folder(spark, "many"), spark.sparkContext
    write_files(spark, folder, *[f"{k}.mp4" for k in range(60)])
    context.setJobGroup("many-folders", "listing")
    L.watch_files(spark, folder)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many-folders") for s in tracker.getJobInfo(j).stageIds]
    context._jsc.clearJobGroup()
    assert stages and max(s.numTasks for s in stages) <= 2 * context.defaultParallelism


def test_a_batch_of_many_files_is_few_tasks(spark):
    """Names and times of 600 files are no work for a task per 32 of them."""
    folder, context = S.new_folder(spark, "batch"), spark.sparkContext
    L.write_files(spark.range(600).selectExpr("id || '.mp4' AS file", "'x' AS value"), folder, 4)
    with S.settings(spark, L.listing(spark)):
        query = L.watch_files(spark, folder).writeStream.format("noop").option("checkpointLocation", folder + "-state").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 600
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 2 * context.defaultParallelism


def test_tasks_write_the_files_themselves(spark, monkeypatch):
    """One plain file per row in a few folders, nothing beside them; Spark's writer, where Python cannot, gives the same results."""
    rows = [(f"{k}{suffix}", f"line {k}") for k in range(40) for suffix in L.SUFFIXES] + [("é 9.mp4", None), (None, "x"), ("x.jpg", "x")]
    frame = spark.createDataFrame(rows, "file string, value string").repartition(5)
    stems = lambda folder: sorted((r["stem"], r["suffix"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
                                  .select(F.regexp_extract("path", L.NAMED, 1).alias("stem"), F.regexp_extract("path", L.NAMED, 2).alias("suffix")).filter("stem <> ''").collect())
    folder, other = S.new_folder(spark, "plain"), S.new_folder(spark, "spark")
    for _ in range(2):
        L.write_files(frame, folder, 8)
    found = [f for f in glob.glob(L.local_path(folder) + "/**", recursive=True, include_hidden=True) if not f.endswith("/")]
    names = {f.rsplit("/", 1)[1]: f for f in found if f.rsplit("/", 1)[1] not in map(str, range(8))}
    assert set(names) == {n for n, _ in rows if n} and len(found) <= len(names) + 8
    assert open(names["7.txt"]).read() == "line 7\n" and open(names["é 9.mp4"]).read() == "\n"
    monkeypatch.setattr(L, "local_path", lambda folder: None)
    L.write_files(frame, other)
    assert stems(folder) == stems(other) and len(stems(folder)) == 121


def test_paths_that_python_can_open():
    got = [L.local_path(p) for p in ("file:/a/b c#1%20", "file:///a/b", "hdfs://n/a", "viewfs:/a", "s3a://a/b", "file://host/a", "/a/b")]
    assert got == ["/a/b c#1%20", "/a/b", None, None, None, None, None]


def test_results_make_no_folder_per_file(spark, monkeypatch):
    """The query writes plain files and lists the folder once to define its stream, not once a round."""
    from timedspark.plans import stream_queries as Q
    folders, watched, new, watch = {}, [], S.new_folder, L.watch_files
    monkeypatch.setattr(S, "new_folder", lambda session, name: folders.setdefault(name, new(session, name)))
    monkeypatch.setattr(L, "watch_files", lambda *given: watched.append(given) or watch(*given))
    got = sorted(tuple(r) for r in Q.stream_results(spark, "/root/testdata/sf0.001").collect())
    keys = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select("s_suppkey").collect()]
    assert got == sorted((k, 1, max((k * 7 + i * (k % 3)) % 3 for i in range(3))) for k in keys if k % 4 != 1)
    assert len(watched) == 1 and not glob.glob(folders["files"].removeprefix("file:") + "/**/file=*", recursive=True)


def test_names_of_files(spark):
    paths = ["s3://x/reels/12 b.captions.json", "file:/x/file=7.mp4/part-00000-a.txt", "/x/9.txt", "/x/9.jpg", "/x/file=9.jpg/part-0.txt"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [(r[0], r[1]) for r in frame.select(F.regexp_extract("path", L.NAMED, 1), F.regexp_extract("path", L.NAMED, 2)).collect()]
    assert got == [("12 b", ".captions.json"), ("7", ".mp4"), ("9", ".txt"), ("", ""), ("", "")]
