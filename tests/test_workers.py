"""The package reaches Python workers of a session that was started in another folder."""

import os
import pathlib
import subprocess
import sys

import pyarrow as pa

from cueloom import shared

ROOT = pathlib.Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {root!r} + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + {shared!r}).getOrCreate()
)
plans = entry.queries()
for name in ("win2_utterances", "agg2_consensus_choice", "src7_context_encodings"):
    name = name if name in plans else next(k for k in plans if k.startswith(name.split("_")[0] + "_"))
    print("ROWS", name, plans[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=str(ROOT), shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("ROWS") == 3, done.stderr[-2000:]


def test_batches_are_bounded(spark):
    """Large texts reach a worker some megabytes at a time, and a limit the session sets stays."""
    own = spark.newSession()
    own.conf.unset(shared.BATCH_BYTES[0])
    shared.ship(own)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    texts = own.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000 + int(id)) AS t")
    assert max(r.n for r in texts.mapInArrow(sizes, "n bigint").collect()) < 10_000_000
    own.conf.set(shared.BATCH_BYTES[0], "16m")
    shared.ship(own)
    assert own.conf.get(shared.BATCH_BYTES[0]) == "16m"
