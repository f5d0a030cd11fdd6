"""Training examples, inference prompts, chat rendering, length cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketspark.functions.prompts import CHATML, ChatTemplate, classification_text
from ticketspark.functions.text import truncate_words, word_count
from ticketspark.operators.vocab import label_array


def label_line(labels_df: DataFrame, label_col: str = "intent", sep: str = ", "):
    """Scalar subquery: sorted distinct labels joined by ``sep`` (computed once)."""
    return F.array_join(label_array(labels_df, label_col), sep)


def sft_examples(df: DataFrame, labels_df: DataFrame, text_col: str = "instruction",
                 label_col: str = "intent", template: ChatTemplate = CHATML) -> DataFrame:
    """(ticket_id, intent, text): one training text per row, answer included."""
    line = label_line(labels_df, label_col)
    return df.select("ticket_id", label_col, classification_text(
        line, F.col(text_col), F.col(label_col), template).alias("text"))


def inference_prompts(df: DataFrame, labels_df: DataFrame, text_col: str = "instruction",
                      label_col: str = "intent", template: ChatTemplate = CHATML,
                      id_col: str = "ticket_id") -> DataFrame:
    """(id, prompt): same text without the answer, ending in the generation cue."""
    line = label_line(labels_df, label_col)
    return df.select(id_col, classification_text(line, F.col(text_col), None, template).alias("prompt"))


def render_chat(turns: DataFrame, template: ChatTemplate = CHATML, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, chat): one string per conversation, turns in order.

    One conversation is one group, as its text is one value of the output. Each turn is
    rendered row-wise first, so the per-conversation aggregate only
    gathers that conversation's own rendered turns (the output row itself).
    """
    rendered = turns.select(conv_col, turn_col,
                            template.turn(F.col(role_col), F.col(text_col)).alias("_t"))
    return rendered.groupBy(conv_col).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn_col, "_t"))),
                                 lambda s: s["_t"]), "").alias("chat"))


def truncate_examples(df: DataFrame, max_tokens: int, text_col: str = "text",
                      id_col: str = "ticket_id") -> DataFrame:
    """(id, n_tokens, truncated, text_cut): whitespace-token cut at ``max_tokens``."""
    return df.select(
        id_col, word_count(F.col(text_col)).alias("n_tokens"),
        (word_count(F.col(text_col)) > max_tokens).alias("truncated"),
        truncate_words(F.col(text_col), max_tokens).alias("text_cut"))
