from tidemark.llm import valid_time


def test_stores_close_with_their_task_and_share_a_bound(spark, monkeypatch):
    """Stores of past starts, kept open, took more memory than an executor has."""
    names = ("unloadOnCommit", "rocksdb.boundedMemoryUsage")
    seen, moved = [], valid_time._renamed
    monkeypatch.setattr(valid_time, "_renamed", lambda s, *paths: seen.append([s.conf.get(f"spark.sql.streaming.stateStore.{n}", None) for n in names]) or moved(s, *paths))
    sales = spark.sql("SELECT 1L AS sale_id, 1L AS client_id, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS sold_at, TIMESTAMP_NTZ '2024-01-02 01:00:00' AS arrived_at")
    changes = spark.sql("SELECT 7L AS change_id, 1L AS client_id, 1L AS seq, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS valid_at, 1.0D AS balance, 'u' AS op")
    rows = valid_time.enrich(sales, changes, batches=2).collect()
    assert [(r["rec"], r["id"], r["change_id"], r["n_held"]) for r in rows] == [("sale", 1, 7, 1)]
    assert seen == [["true", "true"]] * 3
    assert spark.conf.get("spark.sql.streaming.stateStore.unloadOnCommit", "false") == "false"
