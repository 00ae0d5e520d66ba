"""The stream's ensembles are those of the whole table, over several batches and a restart from the checkpoint."""

import random

from simloom.operators.sequence import temporal_ensemble
from simloom.streaming.ensemble import ensemble_stream

SCHEMA = "episode long, start long, actions array<double>"


def test_same_as_at_once_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    chunks = [(e, s, [rng.random() for _ in range(4)]) for e in range(5) for s in range(6 + e)]
    ends = [(e, 99, None) for e in range(4)]  # the last episode stays open
    parts = [[c for c in chunks if c[1] < 3], [c for c in chunks if 3 <= c[1] < 7], [c for c in chunks if c[1] >= 7] + ends]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = ensemble_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", out).trigger(availableNow=True).start()
        query.awaitTermination()

    for part in parts:  # each run is a new query that goes on from the checkpoint
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run()
    found = sorted(map(tuple, spark.read.parquet(out).select("episode", "step", "n", "action").collect()))
    wanted = temporal_ensemble(spark.createDataFrame(chunks, SCHEMA)).collect()
    assert found == sorted(tuple(r) for r in wanted if r["episode"] < 4 or r["step"] <= 9)
