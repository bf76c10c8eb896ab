"""Hits to text, and text to a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSTEM = (
    "You answer questions from the numbered passages below the question. "
    "Use only what the passages say, name the section each point comes from, "
    "and say so when they do not answer the question."
)
ANSWER_FORM = "Answer in short sections with bullet points.\n\n"
HIT_FORM = "--- Passage %d ---\nSection: %s\nSummary: %s\n%s\n"


def hit_block(form: str = HIT_FORM) -> Column:
    return F.format_string(
        form, F.col("rank"), F.col("parent_headings"), F.col("summary"), F.col("page_content")
    )


def format_hits(hits: DataFrame, form: str = HIT_FORM) -> DataFrame:
    """All hits of a question in one string, in rank order. A group holds at
    most ``k`` rows, as the search returned them."""
    return hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", hit_block(form).alias("block")))),
                lambda h: h["block"],
            ),
            "\n",
        ).alias("results")
    )


def build_prompts(questions: DataFrame, results: DataFrame, answer_form: str = ANSWER_FORM) -> DataFrame:
    """``query_id, prompt``: the question, the form of the answer, the hits. A
    question without hits still gets a prompt."""
    return questions.join(results, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("Question:\n"),
            F.col("question"),
            F.lit("\n\n" + answer_form + "Passages:\n"),
            F.coalesce("results", F.lit("")),
        ).alias("prompt"),
    )
