"""Conversation sessions and their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import session_title


def instant(c: Column) -> Column:
    """An ISO time in any of its spellings as UTC; one without zone is UTC; null where it is none."""
    return F.to_utc_timestamp(F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")), c.try_cast("timestamp")), F.lit("UTC"))


def list_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Every session with the number of its turns, 0 for an empty one."""
    counts = turns.groupBy("session_id").agg(F.count("id").alias("turn_count")).withColumnRenamed("session_id", "id")
    return sessions.join(counts, "id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))


def missing_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows for sessions that turns name but the table lacks: first and last time, and a course if any."""
    lost = turns.where("session_id is not null").join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
    return lost.groupBy("session_id").agg(F.coalesce(F.min("course_name"), F.lit("")).alias("course_name"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")).withColumnRenamed("session_id", "id")


def recent_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """The last n turns of every session with their place from 1, oldest first."""
    w = Window.partitionBy("session_id").orderBy(F.desc("turn_index"), F.desc("id"))
    last = turns.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index", "id"))).drop("__rn")


def next_turn(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(id, next_index): the index a session's next turn gets."""
    top = turns.groupBy(F.col("session_id").alias("id")).agg(F.max("turn_index").alias("m"))
    return sessions.select("id").join(top, "id", "left").select("id", (F.coalesce("m", F.lit(0)) + 1).alias("next_index"))


def append_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` turns numbered on from their sessions' last ones, in the order of their times."""
    top = turns.groupBy("session_id").agg(F.max("turn_index").alias("m"))
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return new.join(top, "session_id", "left").withColumn("turn_index", F.coalesce("m", F.lit(0)) + F.row_number().over(w)).drop("m")


def memory_block(turns: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, memory): the last turns as text for a prompt, with the note that it is no evidence."""
    r = recent_turns(turns, n)
    text = F.concat(F.lit("Turn "), F.col("turn_index").cast("string"), F.lit("\nUser: "), F.coalesce("user_original", F.lit("")), F.lit("\nAssistant: "), F.coalesce("assistant_final", F.lit("")))
    joined = r.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("memory"))
    return joined.withColumn("memory", F.concat(F.lit("Conversation memory (not evidence):\n"), F.col("memory")))


def titles(turns: DataFrame) -> DataFrame:
    """(session_id, title): a session's title from its first question."""
    first = turns.groupBy("session_id").agg(F.min_by("user_original", F.struct("turn_index", "id")).alias("q"))
    return first.select("session_id", session_title(F.coalesce("q", F.lit(""))).alias("title"))


def history_window(turns: DataFrame, least: int = 4, most: int = 6) -> DataFrame:
    """(session_id, n_messages, window): messages before the last question, if there are enough for a summary."""
    msgs = turns.select("session_id", F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("user_original").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("assistant_final").alias("text")))).alias("p", "m"), "turn_index", "id")
    every = msgs.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "id", "p", "m"))).alias("x"))
    before = every.withColumn("x", F.slice("x", 1, F.greatest(F.size("x") - 2, F.lit(0))))
    cut = F.when(F.size("x") >= least, F.slice("x", F.greatest(F.size("x") - most + 1, F.lit(1)), most)).otherwise(F.slice("x", 1, 0))
    return before.select("session_id", F.size("x").alias("n_messages"), F.array_join(F.transform(cut, lambda v: F.concat(v["m"]["role"], F.lit(": "), F.coalesce(v["m"]["text"], F.lit("")))), "\n").alias("window"))
