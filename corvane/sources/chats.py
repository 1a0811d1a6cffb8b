"""Chat databases read over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tables and columns of the chat database.
MESSAGES = "SELECT m.rowid AS message_id, cmj.chat_id AS chat_id, m.text AS text, m.date AS sent, m.is_from_me AS own, m.handle_id AS handle_id FROM message m JOIN chat_message_join cmj ON cmj.message_id = m.rowid"
CHATS = "SELECT rowid AS chat_id, chat_identifier AS identifier, display_name AS name FROM chat"
HANDLES = "SELECT rowid AS handle_id, id AS contact FROM handle"


def read_query(spark: SparkSession, url: str, sql: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """The rows of a query; with a numeric column and its bounds they are read in parts at once. Column names in lower case."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({sql}) q").options(**options)
    if column is not None and bounds is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts))
    df = reader.load()
    return df.toDF(*(c.lower() for c in df.columns))


def read_chats(spark: SparkSession, url: str, messages: str = MESSAGES, chats: str = CHATS, handles: str = HANDLES, least: int = 1, **options: str) -> DataFrame:
    """(chat_id, name, message_id, sent, sender, text) of chats with ``least`` messages that have text.

    The sender of an own message is ``me``, of others their contact, or
    ``unknown``; a chat without a name has its identifier.
    """
    read = lambda sql: read_query(spark, url, sql, **options)
    said = read(messages).where("text IS NOT NULL AND text <> ''")
    enough = said.groupBy("chat_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("chat_id")
    named = read(chats).select("chat_id", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("identifier")).alias("name"))
    sender = F.when(F.col("own").cast("int") == 1, "me").otherwise(F.coalesce("contact", F.lit("unknown")))
    return said.join(enough, "chat_id", "left_semi").join(named, "chat_id", "left").join(read(handles), "handle_id", "left").select("chat_id", "name", "message_id", "sent", sender.alias("sender"), "text")
