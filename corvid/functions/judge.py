"""Judge responses: tagged fields, scores, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mc_answer, py_strip

# A tagged field, and the start of one.
FIELD = r"(?s)<([a-zA-Z][-a-zA-Z0-9]*?)>(.*?)</\1>"
START = r"<[a-zA-Z][-a-zA-Z0-9]*?>"
#: A score field of older prompts.
OLDER_SCORE = "aria_shapedness"
#: Fields with columns of their own; all others are extra.
KNOWN = (OLDER_SCORE, "analysis", "impression", "needs_review", "errors", "improvement")


def _fields(text: Column) -> Column:
    names = F.transform(F.regexp_extract_all(text, F.lit(FIELD), F.lit(1)), lambda n: F.replace(n, F.lit("-"), F.lit("_")))
    values = F.transform(F.regexp_extract_all(text, F.lit(FIELD), F.lit(2)), py_strip)
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("key"), v.alias("value")))


#: Levels of nested fields that expressions unfold.
DEPTH = 8


def xml_entries(text: Column, depth: int = DEPTH) -> Column:
    """array of key, value of the tagged fields in order; a field that holds others gives way to them.

    Fields nested deeper than ``depth`` levels stay as the text of the field they stand in.
    A field with a start tag but no whole field in it gives none.
    """
    held = _fields(text)
    for _ in range(depth):
        held = F.flatten(F.transform(held, lambda e: F.when(e["value"].rlike(FIELD), _fields(e["value"])).when(e["value"].rlike(START), F.slice(F.array(e), 1, 0)).otherwise(F.array(e))))
    return held


def field_of(entries: Column, name: str) -> Column:
    """The last value of a field; null without one."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]


def last_wins(entries: Column) -> Column:
    """The map of entries in which a later one replaces an earlier one of the same key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]))


def xml_fields(text: Column) -> Column:
    """The map of all fields of a text, nested ones included."""
    return last_wins(xml_entries(text))


def typed_json(value: Column) -> Column:
    """A field's value as JSON: true and false (in any case) and whole numbers as such, anything else as a string."""
    low = F.lower(value)
    return F.when(low.isin("true", "false"), low).when(value.rlike(r"\A[0-9]+\z"), F.regexp_replace(value, r"\A0+(?=[0-9])", "")).otherwise(_quoted(value))


def _quoted(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)\A\{"v":(.*)\}\z', 1)


def typed_fields(text: Column) -> Column:
    """The map of all fields of a text with their values as JSON, and under "raw" the whole text."""
    fields = F.transform_values(xml_fields(text), lambda k, v: typed_json(v))
    return F.map_concat(F.map_filter(fields, lambda k, v: k != "raw"), F.create_map(F.lit("raw"), _quoted(text)))


def score_of(entries: Column, field: str = "score") -> Column:
    """The score: digits, or the lower end of a range of digits; null for anything else (true and false are no scores)."""
    raw = F.coalesce(field_of(entries, field), field_of(entries, OLDER_SCORE))
    return F.when(raw.rlike(r"\A[0-9]+(?:-[0-9]+)?\z"), F.regexp_extract(raw, "^([0-9]+)", 1).try_cast("int"))


def score_error(entries: Column, field: str = "score") -> Column:
    raw = F.coalesce(field_of(entries, field), field_of(entries, OLDER_SCORE))
    return F.when(raw.isNull(), "No score found").when(score_of(entries, field).isNull(), F.concat(F.lit("Non-numeric score: "), raw))


def assessment(entries: Column, field: str = "score") -> Column:
    """struct score, error, analysis, needs_review, errors, improvement, extra (a map, never null)."""
    known = (*KNOWN, field)
    text = lambda n: F.coalesce(field_of(entries, n), F.lit(""))
    others = F.filter(entries, lambda e: ~e["key"].isin(*known))
    return F.struct(
        score_of(entries, field).alias("score"), score_error(entries, field).alias("error"),
        F.coalesce(F.nullif(field_of(entries, "analysis"), F.lit("")), text("impression")).alias("analysis"),
        F.coalesce(F.lower(field_of(entries, "needs_review")) == "true", F.lit(False)).alias("needs_review"),
        text("errors").alias("errors"), text("improvement").alias("improvement"), last_wins(others).alias("extra"),
    )


def mc_verdict(response: Column, gold: Column) -> Column:
    """struct extracted, correct, score of a multiple-choice response; letters compare as they stand, reasoning is not stripped."""
    letter = mc_answer(response)
    correct = F.coalesce(letter == gold, F.lit(False))
    return F.struct(letter.alias("extracted"), correct.alias("correct"), correct.cast("double").alias("score"))


def judge_verdict(parsed: Column, max_score: int) -> Column:
    """struct score, correct, error from an assessment; correct is null without a score or for score 0."""
    score = parsed["score"]
    return F.struct(score.cast("double").alias("score"), F.when(score != 0, score == max_score).alias("correct"), parsed["error"].alias("error"))


def judge_prompt(criteria: Column, response: Column, prompt: Column | None = None, max_score: int = 10) -> Column:
    """What a judge is asked: criteria, the prompt if it is given, the response, and the form of the answer."""
    form = f"Reply with <analysis>your reasoning</analysis> and <score>1-{max_score}</score>."
    parts = [criteria, *([F.concat(F.lit("Prompt:\n"), prompt)] if prompt is not None else []), F.concat(F.lit("Response:\n"), response), F.lit(form)]
    return F.array_join(F.array(*parts), "\n\n")
