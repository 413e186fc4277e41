"""Tokens and full-text predicates over the ``search`` column.

Tokens are lower-case runs of letters and digits, in text order, without
stemming or stop words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import LOG_COLUMNS, LogColumns

# Fixed value: what separates two tokens.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Text to its ordered token array; NULL text gives NULL."""
    return F.filter(F.split(F.lower(text), TOKEN_SEPARATOR), lambda t: t != "")


def check_words(words: Iterable[str]) -> list[str]:
    """Single words, lower-case if ASCII; raises ``ValueError`` for anything else."""
    out = []
    for word in words:
        if not isinstance(word, str) or not word or not all(c.isalnum() for c in word):
            raise ValueError(f"not a single word: {word!r} (use text_phrase)")
        out.append(word.lower() if word.isascii() else word)
    return list(dict.fromkeys(out))


def _has_word(word: str, cols: LogColumns) -> Column:
    """One word occurs. Beyond ASCII a word goes through :func:`tokens` as the text
    did, which may make several tokens of it: then they stand in a row."""
    if word.isascii():
        return F.array_contains(F.col(cols.search), word)
    return text_phrase(word, cols)


def text_all(*words: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """Every word occurs."""
    found = F.lit(True)
    for n, word in enumerate(check_words(words)):
        has = _has_word(word, cols)
        found = has if n == 0 else found & has
    return found


def text_any(*words: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """At least one of the words occurs."""
    wanted = check_words(words)
    if not wanted:
        return F.lit(False)
    plain = [F.lit(w) for w in wanted if w.isascii()]
    parts = [F.arrays_overlap(F.col(cols.search), F.array(*plain))] if plain else []
    parts += [_has_word(w, cols) for w in wanted if not w.isascii()]
    found = parts[0]
    for part in parts[1:]:
        found = found | part
    return found


def text_none(*words: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """None of the words occurs."""
    return ~text_any(*words, cols=cols)


def text_phrase(phrase: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """The tokens of ``phrase`` occur next to each other, in order."""
    if not any(c.isalnum() for c in phrase):
        raise ValueError(f"phrase without words: {phrase!r}")

    def framed(array: Column) -> Column:
        return F.concat(F.lit(" "), F.array_join(array, " "), F.lit(" "))

    return framed(F.col(cols.search)).contains(framed(tokens(F.lit(phrase))))


def text_search(
    all_words: Iterable[str] = (),
    any_words: Iterable[str] = (),
    no_words: Iterable[str] = (),
    phrases: Iterable[str] = (),
    cols: LogColumns = LOG_COLUMNS,
) -> Column:
    """Web-style search: all words, any of some, none of others, exact phrases."""
    parts = [text_all(w, cols=cols) for w in all_words]
    parts += [text_phrase(p, cols=cols) for p in phrases]
    if any_words := list(any_words):
        parts.append(text_any(*any_words, cols=cols))
    if no_words := list(no_words):
        parts.append(text_none(*no_words, cols=cols))
    if not parts:
        raise ValueError("nothing to search for")
    found = parts[0]
    for part in parts[1:]:
        found = found & part
    return found


_TERM = re.compile(r'(-?)(?:"([^"]*)"|([^\s"]+))')


def text_websearch(text: str, cols: LogColumns = LOG_COLUMNS) -> Column:
    """One search text: words, ``"phrases"``, ``or`` between groups, ``-`` to exclude.

    Terms of a group must all hold; ``a b or c`` is ``(a and b) or c``. A term of several
    tokens, such as ``web-1``, is a phrase. Without any word nothing matches.
    """
    groups: list[list[Column]] = [[]]
    for minus, phrase, word in _TERM.findall(text):
        if not minus and word.lower() == "or":
            groups.append([])
            continue
        term = phrase or word
        if any(c.isalnum() for c in term):
            single = term.isascii() and term.isalnum()
            has = text_all(term, cols=cols) if single else text_phrase(term, cols)
            groups[-1].append(~has if minus else has)
    found = F.lit(False)
    for n, terms in enumerate(g for g in groups if g):
        both = terms[0]
        for term in terms[1:]:
            both = both & term
        found = both if n == 0 else found | both
    return found
