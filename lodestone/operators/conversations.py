"""The conversation log: append, read, sessions, delete; relations as in the store's schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changes import upsert


def append(conversation: DataFrame, message: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both relations after new messages (conversation_id, at, agent_name, message_json), numbered on in the order of `at`; a conversation without a row gets one."""
    counts = new.groupBy("conversation_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("conversation_id").orderBy("at")
    placed = new.join(conversation.select("conversation_id", "next_seq"), "conversation_id", "left")
    placed = placed.withColumn("seq", F.coalesce("next_seq", F.lit(1)) + F.row_number().over(order) - 1)
    rows = placed.select("conversation_id", F.col("seq").cast("long").alias("seq"), "agent_name", "message_json", now.alias("created_utc"))
    touched = counts.join(conversation, "conversation_id", "left").select("conversation_id", F.coalesce("created_utc", now).alias("created_utc"), now.alias("updated_utc"), (F.coalesce("next_seq", F.lit(1)) + F.col("n")).cast("long").alias("next_seq"))
    return upsert(conversation, touched, ["conversation_id"]), message.unionByName(rows)


def of_agent(message: DataFrame, agent: str) -> DataFrame:
    return message.where(F.col("agent_name") == agent)


def save_session(sessions: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(sessions, new, ["agent_name", "conversation_id"])


def delete(conversation_id: str, *relations: DataFrame) -> tuple[DataFrame, ...]:
    """Each relation without the conversation."""
    return tuple(r.where(F.col("conversation_id") != conversation_id) for r in relations)
