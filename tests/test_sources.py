"""Archives by members, batches of answers that count once, partitioned results, bucketed tables."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from brindle.sources import archives, files


def make(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    make(tmp_path / "a.zip", [(f"2001_10-K_{i}.txt", os.urandom(2000).hex() + f" äß {i}") for i in range(40)] + [("other.txt", "x"), ("dir_10-K_/", "")])
    make(tmp_path / "deep" / "b.zip", [("x_10-K_1.txt", b"\xff bytes"), ("empty_10-K_.txt", "")])
    make(tmp_path / "none.zip", [])
    make(tmp_path / "c.dat", [("y_10-K_1.txt", "not a zip's name")])
    return tmp_path


def test_members_are_those_of_whole_archives(spark, folder):
    rows = archives.read_members(spark, str(folder), task_bytes=10_000)
    got = sorted((os.path.basename(r["archive"]), r["entry"], r["text"]) for r in rows.collect())
    want = sorted((os.path.basename(r["archive"]), r["entry"], r["text"]) for r in files.read_archives(spark, str(folder)).collect())
    assert got == want and len(got) == 42 and ("b.zip", "x_10-K_1.txt", "� bytes") in got
    assert rows.rdd.getNumPartitions() >= 8


def test_names_are_tested_before_members_are_read(spark, folder):
    reader = archives.ArchiveReader({"path": str(folder), "taskbytes": "1000"})
    left = list(reader.pushFilters([archives.StringContains(("entry",), "10-K_1"), archives.StringContains(("text",), "x")]))
    assert len(left) == 1 and left[0].attribute == ("text",)
    parts = reader.partitions()
    assert sum(1 for p in parts for _ in reader.read(p)) == 12
    rows = archives.read_members(spark, f"file://{folder}").where("entry like '%K_7.txt'")
    assert [r["entry"] for r in rows.collect()] == ["2001_10-K_7.txt"]


def test_archives_of_nothing(spark, tmp_path):
    assert archives.read_members(spark, str(tmp_path)).collect() == []


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "answers")
    rows = spark.range(40).select(F.col("id").alias("sentence_index"), F.lit("s ä").alias("sentence"), F.lit(None).cast("string").alias("prompt"), F.lit("hr").alias("topic"), F.lit("e").alias("explanation"), F.lit(1).alias("probability"))
    archives.append_batch(rows.repartition(4), path, "one")
    archives.append_batch(rows.repartition(2), path, "one")  # again, from fewer tasks
    archives.append_batch(rows.where("sentence_index < 3"), path, "two")
    got = files.read_answers(spark, path).groupBy("sentence_index").count().collect()
    assert len(got) == 40 and {r["sentence_index"]: r["count"] for r in got} == {i: 2 if i < 3 else 1 for i in range(40)}
    assert files.read_answers(spark, path).first()["sentence"] == "s ä"


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "answers")
    good = spark.range(8).select(F.col("id").alias("sentence_index"))
    archives.append_batch(good, path, "one")

    def broken(batches):
        for b in batches:
            if (b["sentence_index"] == 7).any():
                raise RuntimeError("lost")
            yield b

    with pytest.raises(Exception, match="lost"):
        archives.append_batch(good.repartition(4, "sentence_index").mapInPandas(broken, "sentence_index long"), path, "two")
    assert files.read_answers(spark, path).count() == 8
    archives.append_batch(good, path, "two")  # what the failed one has left aside goes with the next
    assert files.read_answers(spark, path).count() == 16 and not [f for f in os.listdir(path) if f.startswith("_aside")]


def test_files_of_other_attempts_are_no_part(tmp_path):
    """Two attempts of a task write, one of them counts."""
    from pyspark.sql import Row

    writer = archives.AnswerWriter({"path": str(tmp_path), "batch": "b1"})
    first = writer.write(iter([Row(sentence_index=1)]))
    second = writer.write(iter([Row(sentence_index=1)]))
    assert first.path != second.path
    writer.commit([second])
    assert sorted(os.listdir(tmp_path)) == ["b1.part-00000.json"] and (tmp_path / "b1.part-00000.json").read_text().count("\n") == 1
    with pytest.raises(ValueError, match="named"):
        archives.AnswerWriter({"path": str(tmp_path), "batch": "../x"})


def test_results_by_settings(spark, tmp_path):
    path = str(tmp_path / "results")
    one, two = files.Experiment(), files.Experiment(sample="some")
    frame = lambda v: spark.createDataFrame([(1, v, "clash")], "id int, auc double, sample string")
    for experiment, model, v in ((one, "lr", 0.1), (two, "lr", 0.2), (one, "gbt", 0.3), (one, "lr", 0.4)):
        files.write_results(frame(v), path, experiment, model)
    got = {(r["model"], r["sample"]): r["auc"] for r in files.read_results(spark, path).collect()}
    assert got == {("lr", "full"): 0.4, ("lr", "some"): 0.2, ("gbt", "full"): 0.3}
    some = files.read_results(spark, path, one, "lr")
    assert [r["auc"] for r in some.collect()] == [0.4]
    pushed = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in pushed and len(some.inputFiles()) >= 1
    assert {r["auc"] for r in files.read_results(spark, path, one).collect()} == {0.3, 0.4}


def test_bucketed_tables_join_without_an_exchange(spark):
    keys = ["ticker", "year"]
    made = [f"statement_{k}" for k in range(3)]
    try:
        for k, name in enumerate(made):
            rows = spark.range(50 * k, 50 * k + 120).select((F.col("id") % 40).cast("string").alias("ticker"), (F.col("id") / 40).cast("int").alias("year"), F.col("id").alias(f"v{k}"))
            files.write_bucketed(rows, name, ("ticker", "year"), 4)
        tables = [spark.table(name) for name in made]
        joined = tables[0].hint("merge").join(tables[1].hint("merge"), keys, "left").join(tables[2].hint("merge"), keys, "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        outer = tables[0].hint("merge").join(tables[1].hint("merge"), keys, "full_outer")
        assert "Exchange" not in outer._jdf.queryExecution().executedPlan().toString()
        assert outer.count() == 170
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
