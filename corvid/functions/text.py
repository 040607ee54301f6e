"""Reasoning-tag text, answers and provider payloads as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Python's str.strip.
_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
OPEN, CLOSE = "<think>", "</think>"


def py_strip(x: Column) -> Column:
    """x without white space (all of Unicode's) at both ends."""
    return F.regexp_replace(x, rf"\A{_WS}+|(?<!{_WS}){_WS}+\z", "")


def count_of(x: Column, part: str) -> Column:
    """How often part occurs in x, without overlaps."""
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(part)))) / len(part)).cast("int")


def think_reason(text: Column) -> Column:
    """Why the tags of text are not well formed; null if they are (or if there are none)."""
    opened, closed = count_of(text, OPEN), count_of(text, CLOSE)
    return (
        F.when(opened > 1, F.concat(F.lit("multiple_open_tags_"), opened))
        .when((opened == 0) & (closed > 0), "orphaned_close_tags")
        .when((opened == 1) & (closed > 1), "extra_close_tags")
        .when((opened == 1) & (closed == 0), "unclosed_think_tag")
        .when((opened == 1) & (F.locate(OPEN, text) > F.locate(CLOSE, text)), "think_tags_wrong_order")
    )


def thinking(text: Column) -> Column:
    """What stands in the first complete block, stripped; empty without one."""
    return py_strip(F.regexp_extract(text, f"(?s){OPEN}(.*?){CLOSE}", 1))


def response(text: Column) -> Column:
    """What follows the first complete block, stripped; the whole text, stripped, without one."""
    return py_strip(F.when(text.rlike(f"(?s){OPEN}.*?{CLOSE}"), F.regexp_extract(text, f"(?s){OPEN}.*?{CLOSE}(.*)", 1)).otherwise(text))


def sample_reason(content: Column) -> Column:
    """Why an assistant turn does not fit for training a reasoning model; null if it does."""
    x = py_strip(content)
    opened, closed = count_of(x, OPEN), count_of(x, CLOSE)
    return (
        F.when(~F.startswith(x, F.lit(OPEN)), "missing_think_tag")
        .when(opened != 1, F.concat(F.lit("multiple_open_tags_"), opened))
        .when(closed == 0, "unclosed_think_tag")
        .when(closed != 1, F.concat(F.lit("multiple_close_tags_"), closed))
        .when(thinking(x) == "", "empty_thinking")
        .when(response(x) == "", "empty_response")
    )


def strip_thinking(text: Column) -> Column:
    """text without its reasoning: complete blocks go; what precedes a lone close tag goes (its open tag stood in the prompt); leftover tags go."""
    whole = F.regexp_replace(text, rf"(?s){OPEN}.*?{CLOSE}(?U:\s*)", "")
    lone = F.contains(whole, F.lit(CLOSE)) & ~F.contains(whole, F.lit(OPEN))
    rest = F.when(lone, F.regexp_replace(whole, f"(?s)\\A.*?{CLOSE}", "")).otherwise(whole)
    return py_strip(F.regexp_replace(rest, r"</?think>(?U:\s*)", ""))


def normalize_content(content: Column) -> Column:
    """A message's content as one string, from JSON: a string, or a list of typed blocks.

    Blocks join without a separator: thinking in its tags, then text; other values as their
    JSON text. Null, false, 0 and empty values give "".
    """
    kind = F.schema_of_variant(F.try_parse_json(content))
    blocks = F.from_json(content, "array<string>")

    def block(b: Column) -> Column:
        kind_ = F.get_json_object(b, "$.type")
        return (
            F.when(kind_ == "thinking", F.concat(F.lit(OPEN), F.coalesce(F.get_json_object(b, "$.thinking"), F.lit("")), F.lit(CLOSE)))
            .when(F.get_json_object(b, "$.text").isNotNull(), F.get_json_object(b, "$.text"))
            .when(kind_ == "text", "")
            .otherwise(b)
        )

    return (
        F.when(content.isNull() | kind.isNull() | content.isin("null", "false", "0", "[]", "{}", '""'), "")
        .when(kind == "STRING", F.from_json(F.concat(F.lit('{"x":'), content, F.lit("}")), "x string")["x"])
        .when(F.startswith(kind, F.lit("ARRAY")), F.coalesce(F.array_join(F.transform(blocks, block), ""), F.lit("")))
        .otherwise(content)
    )


# How a multiple-choice answer may be written (Java's dialect); the first has precedence, then the others in order.
ANSWER_MARK = r"(?i)[*_]{0,2}Answer[*_]{0,2}(?U:\s*):(?U:[\s*_]{0,2}\s*)([A-D])(?![a-zA-Z0-9])"
ANSWER_FORMS = (
    r"\\boxed\{[^}]*([A-D])[^}]*\}",
    r"(?i)answer is ([A-D])",
    r"(?i)answer is \(([A-D])",
    r"(?md)^(?U:[^\S\r\n]*)([A-D])\)(?U:\s*)[^A-Z]*",
    r"(?i)([A-D])(?U:\s+)is(?U:\s+)the(?U:\s+)correct(?U:\s+)answer",
    r"(?d)([A-D])(?U:\s*)$",
    r"([A-D])(?U:\s*)\.",
)


def last_match(x: Column, pattern: str) -> Column:
    """Group 1 of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1))


def mc_answer(x: Column) -> Column:
    """The letter that a multiple-choice response settles on; null if none.

    The bare letter, else the last "Answer: X", else the first other form that occurs at
    all, its last match.
    """
    plain = py_strip(x)
    return F.when(plain.isin("A", "B", "C", "D"), plain).otherwise(F.upper(F.coalesce(*[last_match(x, p) for p in (ANSWER_MARK, *ANSWER_FORMS)])))


#: Where providers put their reasoning, in order.
REASONING_PATHS = ("$.reasoning", "$.reasoning_content", "$.choices[0].message.reasoning", "$.choices[0].message.reasoning_content")


def provider_reasoning(payload: Column) -> Column:
    """The first non-blank reasoning string of a provider's JSON response, unstripped."""
    parsed = F.try_parse_json(payload)

    def at(path: str) -> Column:
        text = F.try_variant_get(parsed, path, "string")
        is_text = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
        return F.when(is_text & (py_strip(text) != ""), text)

    return F.coalesce(*[at(p) for p in REASONING_PATHS])


def merge_reasoning(content: Column, reasoning: Column) -> Column:
    """content with the reasoning in tags before it, unless it has tags or there is no reasoning."""
    return F.when(reasoning.isNotNull() & ~F.contains(content, F.lit(OPEN)), F.concat(F.lit(OPEN), reasoning, F.lit(CLOSE + "\n"), content)).otherwise(content)


_DETAILS = '<details class="reasoning"><summary>Reasoning</summary><pre>'
_DETAILS_END = "</pre></details>"


def format_think_tags(text: Column) -> Column:
    """Complete blocks as HTML details, their content escaped (for display)."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pattern = f"(?s){OPEN}(.*?){CLOSE}"
    between, inside = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    shown = F.transform(inside, lambda x: F.concat(F.lit(_DETAILS), escaped(py_strip(x)), F.lit(_DETAILS_END)))
    return F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array_compact(F.array(a, b)))), "")


def strip_think_formatting(text: Column) -> Column:
    """The inverse of format_think_tags."""
    pattern = f"(?s){_DETAILS}(.*?){_DETAILS_END}"
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    between, inside = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    shown = F.transform(inside, lambda x: F.concat(F.lit(OPEN), plain(x), F.lit(CLOSE)))
    return F.array_join(F.flatten(F.zip_with(between, shown, lambda a, b: F.array_compact(F.array(a, b)))), "")
