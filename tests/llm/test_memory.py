"""What bounds the memory of executors and their workers."""

import pyarrow as pa

from docloom import workers
from docloom.llm import packing


def test_batches_for_workers_are_bounded(spark):
    """A batch is closed at a number of bytes, not at 10,000 texts of any length."""
    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('word and ', 500) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    got = workers.map_arrow(docs, sizes, "rows bigint, bytes bigint").collect()
    assert sum(r["rows"] for r in got) == 4000
    assert max(r["bytes"] for r in got) < 4 << 20


def test_workers_return_memory(spark):
    """Arrow's free memory goes back to the system, during a task and after it."""

    def used(batches):
        def held():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096

        for _ in batches:
            before = held()
            many = [pa.array(range(100_000)) for _ in range(200)]
            during = held()
            many.clear()
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([during - before]), pa.array([held() - before]), pa.array([pa.default_memory_pool().backend_name])], ["during", "after", "pool"])

    row = workers.map_arrow(spark.range(0, 1, 1, 1), used, "during bigint, after bigint, pool string").first()
    assert row["during"] > 100 << 20 and row["after"] < 30 << 20
    assert row["pool"] == "system"


def test_packing_needs_no_worker(spark):
    """Its tables of slots come from Arrow tables, not from an RDD of Python rows, whose workers would stay beside the others."""
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(50)], "doc_id bigint, text string")
    packs = packing.pack_documents(docs)
    plan = packs._jdf.queryExecution().optimizedPlan().toString()
    rdds = [line for line in plan.splitlines() if "LogicalRDD" in line and ("s_bin" in line or "o_bin" in line)]
    assert not rdds
    assert sum(r.n_tokens for r in packs.collect()) == sum(range(1, 51))
