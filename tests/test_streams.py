"""References that wait for masters which arrive later, against the batch result."""

import random
from datetime import datetime, timedelta

import pytest

from graphloom.streaming.incremental import resolved_references, run_to_table

CHILD, MASTER = "child long, fk string, at timestamp", "pk string, since timestamp"


def replay(spark, folder, schema, batches):
    """A stream of a folder to which each batch is one file, in order."""
    import os
    import time

    os.makedirs(folder)
    for k, rows in enumerate(batches):
        part = f"{folder}-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        (name,) = (x for x in os.listdir(part) if x.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (time.time() - 100 + k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("salts", [1, 3])
def test_a_replayed_stream_gives_the_batch_result(spark, tmp_path, salts):
    rng = random.Random(salts)
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    children = [(k, rng.choice([None, "hot", "hot", *[f"m{x}" for x in range(12)]]), at(rng.randrange(0, 300))) for k in range(60)]
    masters = [("hot", at(90))] + [(f"m{x}", at(rng.randrange(0, 900))) for x in range(8)]
    end = [(1000, "m0", at(100_000))]
    streams = (
        replay(spark, str(tmp_path / "children"), CHILD, [children[:30], children[30:], end, end[:0] + [(1001, "zz", at(200_000))]]),
        replay(spark, str(tmp_path / "masters"), MASTER, [masters[:2], masters[2:5], masters[5:] + masters[:1], [("end", at(100_000)), ("last", at(200_000))]]),
    )
    rows = run_to_table(resolved_references(*streams, "2 hours", "1000 minutes", salts), str(tmp_path / "out")).collect()
    found = {r.child: (r.master, r.status) for r in rows if r.child < 1000}
    since = dict(masters)
    want = {k: (fk, "resolved") if fk in since and since[fk] <= t + timedelta(hours=2) else (None, "unresolved") for k, fk, t in children}
    assert found == want and sum(r.child < 1000 for r in rows) == 60
    assert {s for _, s in want.values()} == {"resolved", "unresolved"}
