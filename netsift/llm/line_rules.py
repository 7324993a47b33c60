"""Quality rules by line: lines that fail a rule go first, then documents that lose too much.

A line is judged by itself (punctuation, navigation, boilerplate); what is left of the document is its
clean text. A document is rejected when the lines removed hold more than ``max_lost`` of its words, or,
before that, by two measures of the whole text (too few words, too many in repeated three-word
windows). Everything concerns one document, so the work needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netsift.llm.common import WORD_RE, docs_of

#: Symbols that are counted, marks that end a sentence.
SYMBOLS = "#*$%&|<>"
ENDS = ".!?…:;\"'»”)"
#: A line that contains one of these (lower case) is boilerplate if it is short.
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "sign in",
    "log in",
    "subscribe to",
    "lorem ipsum",
    "javascript",
)
NAVIGATION = re.compile(r"\s[|»›·>]\s|\s\|$")
SYMBOL_RE = re.compile("[" + re.escape(SYMBOLS) + "]")
LONG_LINE, MOST_MARKS = 30, 0.3


def line_fault(line: str, n_words: int) -> str | None:
    """The rule a line fails, or None. A line of ``LONG_LINE`` words or more is prose for the rules on
    its end and on boilerplate."""
    text = line.strip()
    if not text:
        return None
    if len(NAVIGATION.findall(text)) >= 2:
        return "navigation"
    low = text.lower()
    if n_words < LONG_LINE and any(x in low for x in BOILERPLATE):
        return "boilerplate"
    if len(SYMBOL_RE.findall(text)) > MOST_MARKS * n_words:
        return "punctuation"
    if n_words < LONG_LINE and text[-1] not in ENDS:
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words covered by three-word windows that occur twice or more, first ones included."""
    if len(words) < 3:
        return 0
    index: dict = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
    _, back, times = np.unique(pair[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[back] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def judge(text: str | None, max_lost: float) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text,
    lines removed, words lost)."""
    text = text or ""
    words = WORD_RE.findall(text)
    n = len(words)
    seen: set = set()
    duplicates = removed = lost = 0
    clean = []
    for line in text.split("\n"):
        count = len(WORD_RE.findall(line))
        if count:
            duplicates += line in seen
            seen.add(line)
        if line_fault(line, count) if count else None:
            removed += 1
            lost += count
        else:
            clean.append(line)
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and lost <= max_lost * n
    chars = sum(map(len, words))
    return n, chars, len(SYMBOL_RE.findall(text)), duplicates, repeats, failed, kept, "\n".join(clean), removed, lost


def line_verdicts(documents: DataFrame, max_lost: float = 0.4) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text, lines_removed, words_lost. A null text counts as an
    empty one, which fails. Repeated rows are judged alike; extra columns are ignored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.int64()] * 2
        for batch in batches:
            got = list(zip(*[judge(t.as_py(), max_lost) for t in batch.column(1)], strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(got, kinds, strict=True)]],
                names=["doc_id", *NAMES],
            )

    schema = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    schema += "base_failed boolean, kept boolean, clean_text string, lines_removed bigint, words_lost bigint"
    kind = documents.schema["doc_id"].dataType.simpleString()
    return docs_of(documents, "doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {schema}")


NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text",
    "lines_removed", "words_lost",
)
