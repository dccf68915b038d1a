"""Conversation history: the last turns of each session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def recent_turns(turns: DataFrame, k: int = 5, session: str = "session_id", time: str = "timestamp", tie: str = "id") -> DataFrame:
    """The last ``k`` turns of each session with ``position`` from 1, oldest first."""
    back = Window.partitionBy(session).orderBy(F.desc(time), F.desc(tie))
    rows = turns.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= k)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(session).orderBy(F.desc("_back")))).drop("_back")


def appended(turns: DataFrame, new: DataFrame, k: int = 5, **names: str) -> DataFrame:
    """The view after ``new`` turns came in: retention is a view, the log only grows."""
    return recent_turns(turns.unionByName(new), k, **names).drop("position")


def last_messages(messages: DataFrame, k: int = 3, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, history): the last ``k`` messages as ``role: content`` lines, oldest first."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    rows = messages.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= k)
    who = F.when(F.col("role") == "user", "用户").otherwise("助手")
    line = F.concat(who, F.lit(": "), F.coalesce("content", F.lit("")))
    out = rows.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("_l"))
    return out.select(conversation, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"))


def prior_messages(messages: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """All messages but each conversation's last, which is the question."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    return messages.withColumn("_back", F.row_number().over(w)).where("_back > 1").drop("_back")


def prompt(question, context, history, grounded: bool = True):
    """A prompt from columns: context, question, and the history if there is one."""
    lead = "请仅基于以下【相关知识】回答用户问题，不要使用任何额外知识：" if grounded else "基于以下医学知识回答问题："
    name = "【对话历史（仅用于理解指代，不是医学事实依据）】" if grounded else "【对话历史】"
    past = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit(f"\n\n{name}\n"), history)).otherwise("")
    return F.concat(F.lit(f"{lead}\n\n【相关知识】\n"), F.coalesce(context, F.lit("")), F.lit("\n\n【用户问题】\n"), question, past)
