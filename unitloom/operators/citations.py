"""Citation checks: a response fails at its first citation that breaks a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F



def last_contexts(contexts: DataFrame) -> DataFrame:
    """(response_id, chunk_id, content, selected): of repeated chunks the last one counts.

    ``contexts``: response_id, pos, chunk_id, content, selected_for_generation.
    """
    last = F.max_by(F.struct("content", "selected_for_generation"), "pos")
    return contexts.groupBy("response_id", "chunk_id").agg(last.alias("c")).select("response_id", "chunk_id", F.col("c.content").alias("content"), F.col("c.selected_for_generation").alias("selected"))


def check(responses: DataFrame, citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """(response_id, pos, chunk_id, error): error is null for a citation that holds.

    ``responses``: response_id, answer.  ``citations``: response_id, pos, label, chunk_id, quote.
    """
    answers = responses.select("response_id", "answer")
    joined = citations.join(answers, "response_id").join(last_contexts(contexts), ["response_id", "chunk_id"], "left")
    error = (
        F.when(F.col("selected").isNull(), "unknown_chunk")
        .when(~F.col("selected"), "chunk_not_selected")
        .when(~F.contains("content", "quote"), "quote_not_in_chunk")
        .when(~F.contains("answer", "label"), "label_not_in_answer")
    )
    return joined.select("response_id", "pos", "chunk_id", error.alias("error"))


def verdicts(responses: DataFrame, citations: DataFrame, contexts: DataFrame) -> DataFrame:
    """(response_id, citations, first_error): a response without citations holds."""
    found = check(responses, citations, contexts).groupBy("response_id").agg(F.count("*").alias("citations"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("first_error"))
    return responses.select("response_id").join(found, "response_id", "left").select("response_id", F.coalesce("citations", F.lit(0)).alias("citations"), "first_error")
