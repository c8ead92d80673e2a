"""One stream that keeps taste, sessions and saved books, and refreshes the feeds of the users it saw."""

from pyspark.sql import functions as F

from lectern.operators import product
from lectern.streaming import profiles as live

EVENT = "id long, user_id long, book_id string, action string, session_id string, created_at timestamp"


def test_follow(spark, tmp_path):
    root = str(tmp_path / "live")
    books = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "book_id string, scores array<double>")
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    batches = [
        [(1, 1, "a", "like", "s", at(1)), (2, 1, "a", "like", "s", at(2)), (3, 2, "b", "swipe_left", "t", at(1)), (4, 1, "b", "save", "", at(3))],
        [(5, 1, "a", "swipe_left", "s", at(5)), (6, 1, "a", "save", "u", at(0)), (7, 3, "b", "skip", "v", at(9))],
    ]
    asked = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3")], "user_id long, req_id string")
    refreshed = []

    def refresh(rows):
        live.refresh_feeds(rows, asked, lambda r: refreshed.append(sorted(x.req_id for x in r.collect())))

    log = []
    for rows in batches:
        log += rows
        df = spark.createDataFrame(rows, "id long, user_id long, book_id string, action string, session_id string, at string")
        df.select("id", "user_id", "book_id", "action", "session_id", F.col("at").cast("timestamp").alias("created_at")).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(EVENT).parquet(f"{root}/log")
        live.follow(stream, root, f"{root}/state", books, 2, refresh, {"availableNow": True}).awaitTermination()
    assert refreshed == [["r1", "r2"], ["r1", "r3"]]

    now = F.lit(at(9)).cast("timestamp")
    alive = {(r.user_id, r.session_id): (r.last_action, r.last_book_id) for r in live.live_sessions(spark, f"{root}/sessions", now, 4).collect()}
    assert alive == {(1, "s"): ("swipe_left", "a"), (3, "v"): ("skip", "b")}  # late events don't bring a session back
    live.expire_sessions(spark, f"{root}/sessions", now, 7, 4)
    assert live.live_sessions(spark, f"{root}/sessions", now, 1000).count() == 2

    events = spark.read.schema(EVENT).parquet(f"{root}/log")
    want, got = product.saved_lists(events), live.saved_items(spark, f"{root}/saved")
    for w, g in zip(want, got, strict=True):
        assert sorted(map(tuple, w.collect())) == sorted(map(tuple, g.select(*w.columns).collect()))
    assert live.stored_taste(spark, f"{root}/taste").where("user_id = 2 AND store = 'negative'").first().scores[1] > 0
