from pyspark.sql import functions as F

from ledgerloom.operators import governance as V
from ledgerloom.streaming.ledger_stream import verified


def test_ledgers_verified_as_they_arrive(spark, tmp_path):
    rows = V.chained(spark.createDataFrame([(f"L{k}", i, f"r{k}-{i}", f"p{i}") for k in range(3) for i in range(6)], "ledger_id string, pos bigint, record_id string, payload_digest string"))
    bad = rows.withColumn("payload_digest", F.when(F.expr("ledger_id = 'L1' AND pos = 4"), "x").otherwise(F.col("payload_digest"))).where("NOT (ledger_id = 'L2' AND pos = 2)")
    for name, part in (("a", "pos < 3"), ("b", "pos >= 3")):
        bad.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = verified(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.ledger_id, r.pos, r.code) for r in got) == [("L1", 4, "ledger-record-digest-mismatch"), ("L2", 3, "ledger-chain-broken")]
