"""Data sources: npz ranges and samples, two-phase commit of state files, debug episodes in batches and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import custom
from tracewright.streaming import sampler


@pytest.fixture(scope="module")
def session(spark):
    return custom.register(spark)


def test_npz(session, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"hidden": rng.standard_normal((5, 3, 2)).astype("f4"), "tokens": np.array(["a", "é", "ccc"]), "meta": np.array('{"x": 1}'), "columns": np.asfortranarray(rng.standard_normal((4, 3))), "none": np.zeros((0, 2)), "objects": np.array([{}, 1], dtype=object)}
    np.savez(tmp_path / "response_1.npz", **arrays)
    (tmp_path / "deep").mkdir()
    np.savez_compressed(tmp_path / "deep" / "response_2.npz", hidden=arrays["hidden"] + 1)
    read = lambda **o: session.read.format("npz").options(**o).load(str(tmp_path))
    rows = read(rowsPerPartition=2).collect()
    by = {(r["path"].rsplit("/", 1)[-1], r["array"], r["row"]): r for r in rows}
    assert len(by) == len(rows) == 5 + 3 + 1 + 4 + 2 + 5
    for k in range(5):
        r = by["response_1.npz", "hidden", k]
        assert r["shape"] == [3, 2] and r["numbers"] == arrays["hidden"][k].astype(float).ravel().tolist()
        assert by["response_2.npz", "hidden", k]["numbers"] == (arrays["hidden"][k] + 1).astype(float).ravel().tolist()
    for k in range(4):
        assert by["response_1.npz", "columns", k]["numbers"] == arrays["columns"][k].tolist()
    assert [by["response_1.npz", "tokens", k]["texts"] for k in range(3)] == [["a"], ["é"], ["ccc"]]
    assert by["response_1.npz", "meta", 0]["texts"] == ['{"x": 1}'] and by["response_1.npz", "objects", 0]["numbers"] is None
    assert read(rowsPerPartition=2).rdd.getNumPartitions() == 3 + 2 + 1 + 1 + 1 + 3
    one = read(sampleFiles=1, seed=3)
    assert one.select("path").distinct().count() == 1 and one.collect() == read(sampleFiles=1, seed=3).collect()
    few = read(sampleRows=2, seed=3).where("array = 'hidden'")
    assert few.count() == 4 and few.subtract(read().where("array = 'hidden'")).count() == 0
    assert read(rowsPerPartition=2, sampleRows=1).where("array = 'hidden'").count() == 6


SCHEMA = "id long, label string, s struct<a: int, b: array<double>>, m map<string, int>"


def test_states_round_trip_and_failures(session, tmp_path):
    path = f"{tmp_path}/states"
    rows = [(k, None if k % 3 else f"é{k}", (k, [k / 2]) if k % 2 else None, {"x": k}) for k in range(500)]
    df = session.createDataFrame(rows, SCHEMA).repartition(3)
    read = lambda: session.read.format("states").schema(SCHEMA).load(path)
    df.write.format("states").mode("append").save(path)
    assert sorted(map(tuple, read().collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    # a job that fails in one task after others have written leaves no rows
    broken = df.withColumn("label", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("states").mode("append").save(path)
    assert read().count() == 500
    df.where("id < 10").write.format("states").mode("append").save(path)
    assert read().count() == 510
    df.where("id < 0").write.format("states").mode("overwrite").save(path)
    assert read().count() == 0


def test_files_of_other_attempts_are_no_rows(session, tmp_path):
    path = f"{tmp_path}/states"
    df = session.range(20)
    df.write.format("states").mode("append").save(path)
    writer = custom._StateWriter(path, df.schema, False)
    lost, kept = writer.write(iter(df.collect())), writer.write(iter(df.collect()))
    count = lambda: session.read.format("states").schema("id long").load(path).count()
    assert count() == 20
    writer.commit([kept, None])
    assert count() == 40
    writer.abort([lost])
    assert count() == 40


def test_debug_episodes_as_table_and_stream(session, tmp_path):
    load = lambda **o: session.read.format("debug_episodes").options(**o).load()
    rows = load(seed=7, partitions=3, episodesPerPartition=5, advantages="true").collect()
    assert [r["episode_id"] for r in sorted(rows)] == list(range(15)) and rows == load(seed=7, partitions=3, episodesPerPartition=5, advantages="true").collect()
    assert all(5 <= len(r["query"]) <= 15 and 1 <= min(r["query"]) and max(r["query"]) <= 100 and len(r["advantages"]) == len(r["response"]) and 0 <= r["reward"] < 10 for r in rows)
    options = {"seed": 7, "partitions": 2, "episodesPerPartition": 6, "batches": 3, "questions": 4}
    stream = session.readStream.format("debug_episodes").options(**options).load()
    states = sampler.followed(stream.select("question_id", "iteration", (F.col("reward") > 3).cast("double").alias("reward")), sampler.Sticky(give_up_after=9))
    seen = {}

    def keep(df, _):
        seen.update({r["question_id"]: r for r in df.collect()})

    q = states.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").outputMode("update").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    whole = load(**{**options, "partitions": 6})
    want = {r["question_id"]: r["n"] for r in whole.groupBy("question_id").agg(F.count("*").alias("n")).collect()}
    assert {k: r["rollouts"] for k, r in seen.items()} == want and sum(want.values()) == 36
