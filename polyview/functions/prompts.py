"""Prompt texts.  A missing field prints as ``None``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Templates and instructions.
PLAIN = """### Input:
{}

### Response:
{}"""
INSTRUCTED = """### Instruction:
{}

### Input:
{}

### Response:
{}"""
RECORD = """### python_solution:
{}
### tables:
{}
### question_id:
{}
### question:
{}
### topic:
{}
### ground_truth:
{}"""
IDENTITY = "{}"
NARRATIVE = (
    "{} This financial news describes an event involving the company {}, which operates in the {} sector. "
    "The primary event type is '{}', and the secondary event type is '{}'. "
    "The sentiment toward this event is {}."
)
SENTIMENT_INSTRUCTION = (
    "What is the sentiment of this news/tweet? "
    "Please choose an answer from {negative/neutral/positive}."
)
EVENT_INSTRUCTION = """
Market sentiment is often influenced by corporate events, with beneficial occurrences prompting positive market sentiment and detrimental events precipitating negative sentiment. 
Please analyze the following financial text and evaluate the potential impact of the financial events mentioned in the text on market sentiment.
You are required to select an appropriate response from the predefined set of options: {negative/neutral/positive}.
"""


def render(template: str, *fields: Column) -> Column:
    """``template`` with its ``{}`` marks filled in order."""
    texts = template.split("{}")
    if len(texts) != len(fields) + 1:
        raise ValueError(f"template takes {len(texts) - 1} fields, got {len(fields)}")
    parts = [F.lit(texts[0])]
    for field, text in zip(fields, texts[1:]):
        parts += [F.coalesce(field.cast("string"), F.lit("None")), F.lit(text)]
    return F.concat(*parts)


def train_prompt(source: Column, target: Column, eos: str, instruction: str | None = None) -> Column:
    if instruction is None:
        return F.concat(render(PLAIN, source, target), F.lit(eos))
    return F.concat(render(INSTRUCTED, F.lit(instruction), source, target), F.lit(eos))


def infer_prompt(source: Column, instruction: str | None = None) -> Column:
    """The same prompt with an empty response and no end mark."""
    if instruction is None:
        return render(PLAIN, source, F.lit(""))
    return render(INSTRUCTED, F.lit(instruction), source, F.lit(""))


def record_prompt(solution: Column, tables: Column, key: Column, question: Column, topic: Column,
                  truth: Column, eos: str) -> Column:
    """Six-field record; ``tables`` is any nested value and prints as JSON."""
    return F.concat(render(RECORD, solution, F.to_json(tables), key, question, topic, truth), F.lit(eos))


def identity_prompt(text: Column, eos: str) -> Column:
    return F.concat(render(IDENTITY, text), F.lit(eos))


def narrative(content: Column, events: Column, strict: bool = True) -> Column:
    """One sentence per document from the first of its events.

    ``events`` is an array of structs ``name, sentiment, label_1, label_2, category``.
    Strict fails on an empty list; lenient prints ``None`` fields.
    """
    first = events[0] if strict else F.get(events, F.lit(0))
    return render(
        NARRATIVE,
        content,
        first["name"],
        first["category"],
        first["label_1"],
        first["label_2"],
        first["sentiment"],
    )
