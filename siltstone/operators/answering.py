"""What becomes of many questions at once: one job instead of a conversation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import tools


def outcomes(questions: DataFrame, hits: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, intent, rewriting, hits, outcome): chat, fallback for unclear questions, answer or fallback by the first hit's score.

    questions: query_id, query; hits: query_id, rank, score.
    """
    judged = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max(F.when(F.col("rank") == 1, F.struct(F.coalesce(F.col("score") >= least, F.lit(True)).alias("passed"))))["passed"].alias("passed"))
    asked = questions.select("query_id", text.intent(F.col("query")).alias("intent"), text.needs_rewriting(F.col("query")).alias("rewriting")).join(judged, "query_id", "left")
    outcome = F.when(F.col("intent") == "chat", "chat").when((F.col("intent") == "rag_qa") & F.coalesce("passed", F.lit(False)), "answer").otherwise("fallback")
    return asked.select("query_id", "intent", "rewriting", F.coalesce("hits", F.lit(0)).alias("hits"), outcome.alias("outcome"))


def prompts(questions: DataFrame, hits: DataFrame, least: float = 0.3) -> DataFrame:
    """(query_id, query, context, sources) of the questions that are to be answered from their hits: what a model is given.

    hits: as for outcomes, with text, file_name and page_num.
    """
    kept = outcomes(questions, hits, least).filter("outcome = 'answer'").select("query_id")
    return questions.join(kept, "query_id").join(tools.context(hits), "query_id").join(tools.sources(hits), "query_id").select("query_id", "query", "context", "sources")
