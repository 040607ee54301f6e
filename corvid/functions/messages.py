"""Message arrays: prompts, turns, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_content, sample_reason

ROLES = ("system", "user", "assistant", "tool")
#: Sampling parameters that a request may carry.
SAMPLING = ("temperature", "max_tokens", "top_p", "stop", "n")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def inject_system(messages: Column, prompt: Column, always: bool = False) -> Column:
    """messages with the system prompt first; unless always, only where they do not start with one. No or an empty prompt changes nothing."""
    has_one = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    skip = F.coalesce(prompt == "", F.lit(True))
    return F.when(skip if always else skip | has_one, messages).otherwise(F.concat(F.array(message("system", prompt)), messages))


def append_assistant(messages: Column, text: Column) -> Column:
    return F.concat(messages, F.array(message("assistant", text)))


def or_prompt(messages: Column, prompt: Column) -> Column:
    """messages, or the prompt as a single user message where there are none."""
    return F.when(F.coalesce(F.size(messages), F.lit(0)) > 0, messages).otherwise(F.array(message("user", F.coalesce(prompt, F.lit("")))))


def flatten_history(messages: Column) -> Column:
    """role and content (JSON: a string or typed blocks) as plain messages."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), normalize_content(m["content"]).alias("content")))


def turns_of(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def sample_validity(messages: Column) -> Column:
    """The reason of the first assistant message that does not fit for training; null if all fit, or there are none. Null contents are not judged."""
    judged = F.filter(messages, lambda m: (m["role"] == "assistant") & m["content"].isNotNull())
    reasons = F.transform(judged, lambda m: sample_reason(m["content"]))
    return F.try_element_at(F.filter(reasons, lambda r: r.isNotNull()), F.lit(1))


def chat_row_error(messages: Column) -> Column:
    """Why a chat row cannot train; null if it can. The first fault in reading order is named."""
    bad = F.transform(
        messages,
        lambda m, i: F.when(m.isNull(), F.concat(F.lit("message "), i, F.lit(": expected object")))
        .when(~F.coalesce(m["role"].isin(*ROLES), F.lit(False)), F.concat(F.lit("message "), i, F.lit(": invalid role "), F.coalesce(m["role"], F.lit("null"))))
        .when(m["content"].isNull(), F.concat(F.lit("message "), i, F.lit(": expected string content"))),
    )
    return (
        F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "'messages' must be a non-empty list")
        .otherwise(F.coalesce(F.try_element_at(F.filter(bad, lambda e: e.isNotNull()), F.lit(1)), F.when(F.size(turns_of(messages, "assistant")) == 0, "at least one assistant message is required")))
    )


def is_multi_turn(messages: Column) -> Column:
    return F.coalesce(F.size(turns_of(messages, "assistant")) > 1, F.lit(False))


def last_assistant(messages: Column) -> Column:
    """Index (from 0) of the turn that is trained on; null without an assistant turn."""
    return F.array_max(F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull()))


def sampling_params(params: Column) -> Column:
    """The parameters of a map that a request may carry, without nulls."""
    return F.map_filter(params, lambda k, v: k.isin(*SAMPLING) & v.isNotNull())
