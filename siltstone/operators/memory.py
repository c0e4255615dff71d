"""Conversation history: windows, question and answer pairs, recall by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.similarity import sequence_ratio
from siltstone.functions.text import folded, stripped, truncated
from siltstone.operators.bm25 import top_k
from siltstone.operators.tools import ordered_text


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns messages of each session. messages: session, turn, role, text."""
    w = Window.partitionBy("session").orderBy(F.col("turn").desc())
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * turns).drop("_n")


def pairs(messages: DataFrame) -> DataFrame:
    """(session, turn, question, answer): user messages directly followed by an assistant's."""
    w = Window.partitionBy("session").orderBy("turn")
    nxt = messages.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return nxt.filter("role = 'user' and _role = 'assistant'").select("session", "turn", F.col("text").alias("question"), F.col("_text").alias("answer"))


def recall(queries: DataFrame, messages: DataFrame, turns: int = 6, k: int = 1, least: float = 0.3) -> DataFrame:
    """(query_id, key, score, rank): the k most similar past turns of the query's session.

    score is the greater of the question's ratio and 0.8 times that of the
    answer's first 300 characters, to 4 places. queries: query_id, session, query.
    """
    past = pairs(last_turns(messages, turns))
    both = queries.join(past, "session")
    q, a = sequence_ratio(folded(F.col("query")), folded(F.col("question"))), sequence_ratio(folded(F.col("query")), folded(F.substring("answer", 1, 300)))
    scored = both.withColumn("score", F.round(F.greatest(q, 0.8 * a), 4)).filter(F.col("score") >= least)
    return top_k(scored.select("query_id", F.col("turn").alias("key"), "score"), k)


def rewriting_history(messages: DataFrame, most: int = 4, length: int = 120, total: int = 300) -> DataFrame:
    """(session, history): the last user messages of each session, each cut to `length` and all to `total` characters."""
    own = messages.filter("role = 'user'").withColumn("text", stripped("text")).filter("text <> ''")
    w = Window.partitionBy("session").orderBy(F.col("turn").desc())
    last = own.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    line = F.concat(F.lit("用户: "), F.substring("text", 1, length))
    return last.groupBy("session").agg(F.substring(ordered_text(line, F.col("turn"), "\n"), 1, total).alias("history"))


def recalled_context(recalled: DataFrame, messages: DataFrame, chat: bool = False) -> DataFrame:
    """(query_id, context): recalled turns as numbered questions and answers, shortened more for answers from reports.

    recalled: query_id, session, key (turn), rank.
    """
    label, asked, told, most = ("历史", "用户之前问：", "之前回答：", (80, 220)) if chat else ("记忆", "历史问题：", "历史回答：", (60, 180))
    past = pairs(messages).withColumnRenamed("turn", "key")
    number = F.concat(F.lit(f"[{label}"), F.col("rank").cast("string"), F.lit("] "))
    block = F.concat(number, F.lit(asked), truncated(F.col("question"), most[0]), F.lit("\n"), number, F.lit(told), truncated(F.col("answer"), most[1]))
    return recalled.join(past, ["session", "key"]).groupBy("query_id").agg(ordered_text(block, F.col("rank"), "\n\n").alias("context"))
