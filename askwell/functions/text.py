"""Text expressions: JSON text, token estimate, words, clean-up of names and statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(text: Column) -> Column:
    """``text`` as a JSON string literal, non-ASCII kept, control characters in lower-case hex."""
    obj = F.to_json(F.struct(text.alias("x")))
    literal = F.substring(obj, F.lit(6), F.length(obj) - 6)
    # The JVM writer uses upper-case hex digits for control characters. An escape counts only after an
    # even number of backslashes.
    lowered = reduce(
        lambda col, digit: F.regexp_replace(
            col, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}"
        ),
        "ABCDEF", literal,
    )
    rare = text.rlike("[\\x0b\\x0e\\x0f\\x1a-\\x1f]")
    return F.when(text.isNull(), F.lit("null")).when(rare, lowered).otherwise(literal)


def pair_json(question: Column, sql: Column) -> Column:
    """The stored form of a question/SQL pair: a JSON object with a space after ``:`` and ``,``."""
    return F.concat(F.lit('{"question": '), json_string(question), F.lit(', "sql": '), json_string(sql), F.lit("}"))


def pair_text(question: Column, sql: Column, form: str = "json") -> Column:
    """Text of a pair to embed: ``json``, ``qa``, ``concat`` or ``question``."""
    forms = {
        "json": lambda: pair_json(question, sql),
        "qa": lambda: F.concat(F.lit("Question: "), question, F.lit("\n\nSQL: "), sql),
        "concat": lambda: F.concat(question, F.lit(" "), sql),
        "question": lambda: question,
    }
    if form not in forms:
        raise ValueError(f"unknown pair text form {form!r}; one of {sorted(forms)}")
    return forms[form]()


def approx_tokens(text: Column) -> Column:
    """Estimated model tokens: a quarter of the characters."""
    return F.length(text) / F.lit(4.0)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def strip_brackets(text: Column) -> Column:
    """Square brackets off both ends."""
    return F.regexp_replace(text, r"^[\[\]]+|[\[\]]+$", "")


def strip_semicolon(sql: Column) -> Column:
    """Trailing white space, then one closing semicolon, removed."""
    return F.regexp_replace(F.regexp_replace(sql, r"\s+\z", ""), r";\z", "")


def one_line(text: Column) -> Column:
    """Newlines to spaces, as done before embedding."""
    return F.regexp_replace(text, "\n", " ")


def sanitize_name(name: Column) -> Column:
    """Normalised key of a free-form name; null where nothing is left."""
    spaced = F.replace(F.lower(name), F.lit(" "), F.lit("-"))
    hyphened = F.replace(F.regexp_replace(spaced, "-+", "-"), F.lit("_"), F.lit("-"))
    unified = F.when(F.contains(spaced, F.lit("-")), hyphened).otherwise(spaced)
    plain = F.regexp_replace(unified, r"[^a-z0-9\-_]", "")
    trimmed = F.regexp_replace(F.regexp_replace(plain, r"[-_]\z", ""), r"\A[-_]", "")
    return F.when(F.length(trimmed) > 0, trimmed)
