"""Prompts, few-shot records and model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.labels import first_label, truncate_words

LEAST_LENGTH = 12


def few_shot_text(shots: Column) -> Column:
    """The shots as '### Input / ### Response' blocks."""
    return F.array_join(F.transform(shots, lambda s: F.concat(F.lit("### Input:\n"), s["input"], F.lit("\n### Response:\n"), s["output"], F.lit("\n\n"))), "")


def few_shot_records(rows: DataFrame, prompt: str, description: str = "few-shot") -> DataFrame:
    """(description, response_split, instruction, demo_part, query_part) of rows with shots and texts long enough."""
    kept = rows.where(F.length("input") > LEAST_LENGTH)
    return kept.select(
        "record_id", F.lit(description).alias("description"), F.lit("### Response:").alias("response_split"), F.lit(prompt).alias("instruction"),
        few_shot_text(F.col("shots")).alias("demo_part"), F.concat(F.lit("### Input:\n"), "input", F.lit("\n### Response:\n")).alias("query_part"),
    )


def chat_messages(prompt: str, shots: Column, text: Column) -> Column:
    """System message, a user and an assistant message for each shot, and the user's text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pairs = F.flatten(F.transform(shots, lambda s: F.array(message("user", s["input"]), message("assistant", s["output"]))))
    return F.concat(F.array(message("system", F.lit(prompt))), pairs, F.array(message("user", text)))


def prompt_text(instruction: Column, text: Column, shots: Column | None = None, most_words: int | None = None) -> Column:
    """An instruction, demonstrations if any, and the text to answer; long texts are cut to their first words."""
    text = truncate_words(text, most_words) if most_words else text
    demos = few_shot_text(shots) if shots is not None else F.lit("")
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n"), demos, F.lit("### Input:\n"), text, F.lit("\n### Response:\n"))


def seq2seq(instruction: Column, text: Column, output: Column) -> Column:
    return F.struct(prompt_text(instruction, text).alias("inputs"), output.alias("labels"))


def predict(rows: DataFrame, model: Callable[[list[str]], list[str]], text: str = "input") -> DataFrame:
    """Rows with ``prediction``, the label found in a model's answer; texts too short are not asked about.

    The model is a function of a list of texts, called batch by batch in the workers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(answer=model(b[text].tolist()) if len(b) else [])

    asked = rows.where(F.length(text) > LEAST_LENGTH)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{fields}, answer string").withColumn("prediction", first_label(F.col("answer")))


def tagged_words(rows: DataFrame, tagger: Callable[[str], list[str]], text: str = "text") -> DataFrame:
    """Rows with ``words``, what a tagger (a plug-in, loaded once a worker) finds in each text; a null text has null."""

    @F.pandas_udf("array<string>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: tagger(x) if x is not None else None)

    return rows.withColumn("words", tag(F.col(text)))


def predict_few_shot(rows: DataFrame, prompt: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Rows with shots answered by a model of the whole conversation, given as JSON, and the label in its answer."""
    asked = rows.where(F.length("input") > LEAST_LENGTH).select("record_id", F.to_json(chat_messages(prompt, F.col("shots"), F.col("input"))).alias("messages"))
    return predict(asked, model, "messages")


def replace_prompt(rows: DataFrame, prompt: str) -> DataFrame:
    return rows.withColumn("instruction", F.lit(prompt))


def to_records(rows: DataFrame, prompt: str, text: str, target: str) -> DataFrame:
    """(instruction, input, output); an empty prompt is refused."""
    if not prompt:
        raise ValueError("an empty prompt")
    return rows.select(F.lit(prompt).alias("instruction"), F.col(text).alias("input"), F.col(target).alias("output"))
