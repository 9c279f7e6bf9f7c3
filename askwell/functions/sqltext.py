"""SQL and code taken out of free model responses, as regular expressions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extraction rules for mode "last" (fixed values): pattern, group; the first rule that hits wins, its
# last match is taken.
LAST_RULES = (
    (r"(?s)\bWITH\b .*?;", 0),
    (r"(?s)SELECT.*?;", 0),
    (r"(?s)```sql\n(.*)```", 1),
    (r"(?s)```(.*)```", 1),
)
# Rules for mode "first" (fixed values): the end marker is a group of its own.
FIRST_FENCED = r"(?s)```sql\n(.*?)(;|\[|```)"
FIRST_BARE = r"(?is)((select|with.*?as \().*?)(;|\[|```)"
# Rule for mode "simple" (fixed value)
SIMPLE = r"(?is)select.*?(?:;|```|$)"
# Code fences (fixed value): a fence naming python, else any fence
CODE_FENCE = r"(?i)```[\w\s]*python\n([\s\S]*?)```|```([\s\S]*?)```"

_COMMENT = r"""(?s)('[^']*'|"[^"]*"|`[^`]*`)|--[^\n]*|/\*.*?\*/"""
_LITERAL = r"""'[^']*'|"[^"]*"|`[^`]*`"""
_VERB = r"(?i)\b(select|insert|update|delete|merge|replace|upsert)\b"


def unescape(response: Column, drop_backslashes: bool = True) -> Column:
    """``\\_`` to ``_``; with ``drop_backslashes`` every other backslash goes too."""
    out = F.replace(response, F.lit("\\_"), F.lit("_"))
    return F.replace(out, F.lit("\\"), F.lit("")) if drop_backslashes else out


def _last(response: Column) -> Column:
    hits = [
        F.try_element_at(F.regexp_extract_all(response, F.lit(pattern), F.lit(group)), F.lit(-1))
        for pattern, group in LAST_RULES
    ]
    return F.coalesce(*hits, response)


def _first(response: Column) -> Column:
    text = unescape(response)
    return (
        F.when(text.rlike(FIRST_FENCED), F.regexp_extract(text, FIRST_FENCED, 1))
        .when(text.rlike(FIRST_BARE), F.regexp_extract(text, FIRST_BARE, 1))
        .otherwise(text)
    )


def _simple(response: Column) -> Column:
    return F.replace(F.regexp_extract(response, SIMPLE, 0), F.lit("```"), F.lit(""))


def extract_sql(response: Column, mode: str = "last") -> Column:
    """The SQL in a model response.

    ``last``: last upper-case statement, else the last fence, else the text. ``first``: backslashes
    dropped, then the first fenced, else first bare statement up to ``;``, ``[`` or a fence, else the text.
    ``simple``: first ``select`` up to ``;``, a fence or the end, else empty.
    """
    modes = {"last": _last, "first": _first, "simple": _simple}
    if mode not in modes:
        raise ValueError(f"unknown extraction mode {mode!r}; one of {sorted(modes)}")
    return modes[mode](response)


def _outside_parentheses(text: Column) -> Column:
    """The parts of ``text`` that stand in no parentheses."""
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))

    def step(acc, piece):
        depth = (
            F.when(piece == "(", acc["depth"] + 1)
            .when(piece == ")", F.greatest(acc["depth"] - 1, F.lit(0)))
            .otherwise(acc["depth"])
        )
        plain = (acc["depth"] == 0) & ~piece.isin("(", ")")
        kept = F.when(plain, F.concat(acc["kept"], piece)).otherwise(F.concat(acc["kept"], F.lit(" ")))
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    return F.aggregate(pieces, start, step, lambda acc: acc["kept"])


def is_select(sql: Column) -> Column:
    """True if any statement of the text reads data: SELECT, or WITH whose main verb is SELECT.

    Comments and quoted text never count, and ``;`` inside quotes does not split statements.
    """
    bare = F.regexp_replace(F.regexp_replace(sql, _COMMENT, "$1 "), _LITERAL, "''")

    def reads(statement: Column) -> Column:
        direct = statement.rlike(r"(?i)^\s*select\b")
        with_cte = statement.rlike(r"(?i)^\s*with\b") & (
            F.lower(F.regexp_extract(_outside_parentheses(statement), _VERB, 1)) == "select"
        )
        return direct | with_cte

    return F.coalesce(F.exists(F.split(bare, ";"), reads), F.lit(False))


def extract_code(markdown: Column) -> Column:
    """First code fence of a response (white space trimmed), without calls that show a figure."""
    text = F.regexp_replace(markdown, r"\A\s+|\s+\z", "")
    named = F.regexp_extract(text, CODE_FENCE, 1)
    either = F.when(named != "", named).otherwise(F.regexp_extract(text, CODE_FENCE, 2))
    code = F.when(text.rlike(CODE_FENCE), F.regexp_replace(either, r"\A\s+|\s+\z", "")).otherwise(text)
    return F.replace(code, F.lit("fig.show()"), F.lit(""))


def without_numbers(response: Column) -> Column:
    """``1. `` and the like taken off the start of every line."""
    return F.regexp_replace(response, r"(?m)^\d+\.\s*", "")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-insensitive: one of ``needles`` occurs in ``text``."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n.lower())) for n in needles], F.lit(False))
