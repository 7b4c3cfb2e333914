from equitally.llm.common import CLEANUP, TEXT_BATCHES, write_table


def test_settings_hold_for_one_job(spark):
    """Whole texts go to Python in batches of a thousand rows at most; without the setting, ten thousand."""
    def count(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(5_000).coalesce(1).mapInArrow(count, "n long")
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, *TEXT_BATCHES)}
    small = [r.n for r in write_table(rows, "batches", settings=TEXT_BATCHES).collect()]
    assert sum(small) == 5_000 and max(small) <= 1_000
    assert {k: spark.conf.get(k, None) for k in (CLEANUP, *TEXT_BATCHES)} == before
    assert max(r.n for r in write_table(rows, "batches").collect()) > 1_000
