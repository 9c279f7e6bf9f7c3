"""Secrets in texts: keys and tokens by pattern, passwords by what guessing them would cost.

A value in a credential context is cut into words, dates, repeats, keyboard walks and brute-force stretches; dynamic
programming finds the cut that is cheapest to guess. Values that cost ``least_log10`` powers of ten or more are secrets;
placeholders and plain words are not.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.llm.common import each_slice
from askwell.llm.tokens import vocabulary_path

#: Fixed by the contract: kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "password")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: Contexts of the method, wider than those of the patterns, with any printable value of any length. The key begins where no
#: letter or digit stands before it, or in camel case.
KEY = r"(password|passwd|passphrase|pass|pwd|pin|secret|credentials?|auth|token|api_?key|private_?key|access_?key)"
#: A value in quotes goes up to the same quote on its line; else it ends at a blank, a quote or a mark that ends values.
VALUE = r"""(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([^\s"'`<>,;]{6,}))"""
BEGIN = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
CONTEXT = re.compile(BEGIN + KEY + r"""["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*""" + VALUE, re.IGNORECASE | re.ASCII)
OPTION = re.compile(r"(?<![A-Za-z0-9-])--?(?:[a-z0-9]+[-_])?" + KEY + r"\x20+(?!-)" + VALUE, re.IGNORECASE | re.ASCII)
ELEMENT = re.compile(r"<(?:[a-z0-9]+[-_:])?" + KEY + r">()()([^<>\r\n]{6,})</", re.IGNORECASE | re.ASCII)
#: The password of a URL, after the user's name.
IN_URL = re.compile(r"""()://[^\s/:@"'<>]+:()()([^\s/@"'<>]{6,})@""")
#: Keys whose quoted value may be a phrase of several words; after others that is prose.
PHRASE_KEYS = ("pass", "pwd")
LEAST_LOG10 = 10.0
#: Letters that stand in a sentence and are cased like a word are random if guessing them costs nearly what brute force does:
#: words that the vocabulary lacks have parts that it holds. Nothing longer than this is a word.
RANDOM_SHARE = 0.84
LONGEST_PROSE = 40
WORDS = "word_bpe_49k.json"
#: Rows of a keyboard, along which walks go.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@831!0$57+", "aabeiiosstt")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
LONGEST_WORD = 24


@lru_cache(maxsize=1)
def word_ranks(path: str) -> dict[str, int]:
    """Whole words of a public vocabulary and their places in it: frequent words come first."""
    vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    ranks: dict[str, int] = {}
    for token, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        word = token.removesuffix("</w>")
        if word != token and len(word) > 2 and word.isascii() and word.isalpha():
            ranks.setdefault(word.lower(), len(ranks) + 1)
    return ranks


def neighbours() -> dict[str, str]:
    near: dict[str, str] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            near[key] = "".join(KEYBOARD[b][a] for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if 0 <= b < len(KEYBOARD) and 0 <= a < len(KEYBOARD[b]) and (a, b) != (x, y))
    return near


NEAR = neighbours()


def alphabet(text: str) -> int:
    """Characters a guesser must try for each place."""
    size = 10 * any(c.isdigit() for c in text) + 26 * any("a" <= c <= "z" for c in text) + 26 * any("A" <= c <= "Z" for c in text)
    return size + 33 * any(not (c.isascii() and c.isalnum()) for c in text) or 1


def words_at(value: str, low: str, plain: str, i: int, ranks: dict[str, int]) -> Iterator[tuple[int, int, float, str]]:
    """Words and the date that begin at place i."""
    for j in range(i + 3, min(len(value), i + LONGEST_WORD) + 1):
        for word, extra in ((low[i:j], 0.0), (plain[i:j], 0.5), (low[i:j][::-1], 0.4)):
            if word in ranks and any(c.isalpha() for c in low[i:j]):
                cased = 0.0 if value[i:j].islower() else 0.3 if value[i:j].istitle() or value[i:j].isupper() else 0.3 * (j - i)
                yield i, j, math.log10(ranks[word]) + extra + cased, "word"
                break
    found = DATE.match(value, i)
    if found:
        yield i, found.end(), math.log10(130) if found.end() - i == 4 else math.log10(130 * 365), "date"


def repeats_at(value: str, i: int, size: int) -> tuple[list[tuple[int, int, float, str]], int]:
    """The longest run of a block of this size that begins at place i, if any, and the place to look at next."""
    j = i + size
    while j < len(value) and value[j] == value[j - size]:
        j += 1
    if j - i < max(3, 2 * size):
        return [], i + 1
    return [(i, j, size * math.log10(alphabet(value[i : i + size])) + math.log10((j - i) / size), "repeat")], j - size + 1


def walks_at(value: str, low: str, i: int) -> tuple[list[tuple[int, int, float, str]], int]:
    """Keyboard walks and runs of the alphabet or digits that begin at place i, and the place to look at next."""
    n, out = len(value), []
    j, turns, way = i + 1, 0, None
    while j < n and low[j] in NEAR.get(low[j - 1], ""):
        step = NEAR[low[j - 1]].index(low[j])
        turns, way, j = turns + (way is not None and step != way), step, j + 1
    if j - i >= 4:
        out.append((i, j, math.log10(47 * (j - i)) + turns * math.log10(6), "walk"))
    k = i + 1
    while k < n and abs(ord(value[k]) - ord(value[k - 1])) == 1 and ord(value[k]) - ord(value[k - 1]) == ord(value[i + 1]) - ord(value[i]):
        k += 1
    if k - i >= 3:
        out.append((i, k, math.log10(alphabet(value[i:k]) * (k - i)), "walk"))
    return out, max(i + 1, max(j, k) - 1)


def pieces(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float, str]]:
    """``(start, end, log10 of guesses, kind)`` of everything in the value that is easier than brute force."""
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    for i in range(n):
        yield from words_at(value, low, plain, i, ranks)
    for size in range(1, n // 2 + 1):  # a block and its repeats: the longest run of each block size from each place
        i = 0
        while i + 2 * size <= n:
            found, i = repeats_at(value, i, size)
            yield from found
    i = 0
    while i < n - 2:
        found, i = walks_at(value, low, i)
        yield from found


def costs_at_least(value: str, ranks: dict[str, int], least_log10: float) -> bool:
    """Whether ``guess_cost`` is ``least_log10`` or more, of values of any length.

    Pieces are looked for from places that are reached for less only, as no cut gets cheaper by going on; a block of
    ``least_log10`` characters or more costs too much by itself. So the work ends where the value has cost enough.
    """
    n, low = len(value), value.lower()
    plain, per_char = low.translate(LEET), math.log10(alphabet(value))
    looked = {size: 0 for size in range(1, min(n // 2, math.ceil(least_log10)) + 1)}
    walked, best, todo = 0, {0: (0.0, False)}, [0]
    while todo:
        i = heapq.heappop(todo)
        cost, brute = best[i]
        if i == n:
            return False
        found = list(words_at(value, low, plain, i, ranks))
        for size in looked:
            while looked[size] <= i and looked[size] + 2 * size <= n:
                runs, looked[size] = repeats_at(value, looked[size], size)
                found += (r for r in runs if r[0] == i)
        while walked <= i and walked < n - 2:
            walks, walked = walks_at(value, low, walked)
            found += (w for w in walks if w[0] == i)
        ways = [(j, cost + more + (0.3 if i else 0), False) for _, j, more, _ in found]
        for j, total, by_brute in (*ways, (i + 1, cost + per_char + (0 if brute or i == 0 else 0.3), True)):
            old = best.get(j)
            if total < least_log10 and (old is None or total < old[0] or by_brute and total == old[0]):
                best[j] = total, by_brute
                if old is None:
                    heapq.heappush(todo, j)
    return True


def guess_cost(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 of guesses, and the cut it stands for.

    ``best[j]`` is the cheapest cost of the first j characters; each further piece costs 0.3 for not knowing where it ends.
    Brute force goes on character by character, so every stretch between pieces is tried.
    """
    n = len(value)
    per_char = math.log10(alphabet(value))
    ending: dict[int, list] = {}
    for i, j, cost, kind in pieces(value, ranks):
        ending.setdefault(j, []).append((i, cost, kind))
    best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
    for j in range(1, n + 1):
        going_on = back[j - 1] is not None and back[j - 1][1] == "brute"
        best[j], back[j] = best[j - 1] + per_char + (0 if going_on or j == 1 else 0.3), (j - 1, "brute")
        for i, cost, kind in ending.get(j, ()):
            if (total := best[i] + cost + (0.3 if i else 0)) < best[j]:
                best[j], back[j] = total, (i, kind)
    cut, j = [], n
    while j:
        i, kind = back[j]
        if kind == "brute" and cut and cut[-1][2] == "brute" and cut[-1][0] == j:
            cut[-1] = (i, cut[-1][1], kind)
        else:
            cut.append((i, j, kind))
        j = i
    return best[n], cut[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the patterns' matches."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def like_a_word(value: str, ranks: dict[str, int]) -> bool:
    """Letters only, in the case of a word, and cheaper than random ones."""
    if not value.isalpha() or len(value) > LONGEST_PROSE or not (value.islower() or value.isupper() or value.istitle()):
        return False
    return guess_cost(value, ranks)[0] < RANDOM_SHARE * len(value) * math.log10(alphabet(value))


def values(text: str) -> Iterator[tuple[str, int, int, bool, bool]]:
    """Values in credential contexts: key, start, end, whether the value is quoted or enclosed, and whether it stands in a sentence."""
    for pattern in (CONTEXT, OPTION, ELEMENT, IN_URL):
        for m in pattern.finditer(text):
            group = 2 if m[2] else 3 if m[3] else 4
            enclosed = pattern is ELEMENT or pattern is IN_URL or m.start(group) > 0 and text[m.start(group) - 1] in "\"'"
            value = m[group] if enclosed else m[group].rstrip(".:!?)]}")
            yield m[1].lower(), m.start(group), m.start(group) + len(value), enclosed, pattern is CONTEXT and not enclosed and "=" not in text[m.start() : m.start(group)]


def password_spans(text: str, ranks: dict[str, int], least_log10: float) -> list[tuple[int, int, int]]:
    """Values in credential contexts that cost enough, none of which overlaps another. Words of prose and references to variables are
    no values; what holds blanks is one only after a key of passwords."""
    out, free = [], 0
    for key, start, end, _, in_prose in sorted(values(text), key=lambda x: (x[1], -x[2])):
        value = text[start:end]
        if start < free or len(value) < 6 or value.startswith(("${", "$(", "{{", "%(")):
            continue
        if any(ch.isspace() for ch in value) and not key.startswith(PHRASE_KEYS):
            continue
        if costs_at_least(value, ranks, least_log10) and not (in_prose and like_a_word(value, ranks)):
            out.append((start, 3, end))
            free = end
    return out


KIND = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("n_password", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
SQL_KIND = "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, n_password: bigint, base_sha256: string, spans: string>"


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def scan(text: str | None, ranks: dict[str, int], least_log10: float = LEAST_LOG10) -> dict:
    text = text or ""
    base = base_spans(text)
    more = password_spans(text, ranks, least_log10)
    n = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return {
        "n_assign": n[0], "n_access": n[1], "n_hex": n[2], "n_password": len(more),
        "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(base + more),
    }


def secrets(docs: DataFrame, least_log10: float = LEAST_LOG10, folder: str | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_password`` of every document.

    ``spans`` has ``kind:start:end`` in code points, end exclusive, by start and kind; ``password`` spans cover the value. Null
    and empty texts have none, and the digest of an empty list. Repeated rows each get a row; an empty table gives none; other
    columns are not looked at.
    """
    path = vocabulary_path(WORDS, folder)

    @F.arrow_udf(SQL_KIND)
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = word_ranks(path)
        yield from each_slice(lambda texts: pa.array([scan(t, ranks, least_log10) for t in texts], KIND), columns, KIND)

    rows = docs.select("doc_id", found.asNondeterministic()("text").alias("found"))
    return rows.select("doc_id", *(F.col(f"found.{c}").alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_password")))
