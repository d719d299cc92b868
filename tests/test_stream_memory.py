from lectern.streaming.memory import summaries_due

SCHEMA = "chat_id string, context_version int, message_order long, role string, content string"


def test_state_holds_what_no_summary_covers(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def send(chat, *orders):
        spark.createDataFrame([(chat, 1, i, "USER" if i % 2 else "ASSISTANT", f"text {i}") for i in orders], SCHEMA).coalesce(1).write.mode("append").json(inbox)
        query = (
            summaries_due(spark.readStream.schema(SCHEMA).json(inbox)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        return {(r.chat_id, r.marker): list(r.orders) for r in spark.read.parquet(out).collect()}

    assert send("c", *range(101, 113)) == {}
    assert send("c", 113, 114) == {("c", 106): list(range(101, 107))}
    assert send("d", *range(1, 15)) == {("c", 106): list(range(101, 107)), ("d", 6): list(range(1, 7))}
    assert send("c", *range(115, 120))[("c", 111)] == list(range(107, 112))
