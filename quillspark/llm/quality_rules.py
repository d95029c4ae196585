"""Line-first cleaning: rules per line, then documents that lose too much of their text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _text as T
from quillspark.llm._common import BLANKS, load

MIN_WORDS = 50
#: A document keeps at least this share of its non-blank characters, or goes.
MIN_KEPT = 0.5

# Fixed patterns of the rules; ASCII only, so that every regular expression engine reads them alike.
SYMBOLS = r"[#*$%&|<>{}=_~^@\\]"
MARKS_ONLY = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
SEPARATORS = r"[|>]"
MENU = r"^(home|about us|about|contact us|contact|log ?in|sign ?in|sign ?up|register|menu|search|next|previous|share|subscribe|read more|click here|back to top|skip to content)[.!:]*$"
BOILERPLATE = r"cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|lorem ipsum|powered by|follow us on|sign up for our newsletter"

_symbols, _marks, _separators, _menu, _boiler, _word = (re.compile(x) for x in (SYMBOLS, MARKS_ONLY, SEPARATORS, MENU, BOILERPLATE, r"[^\x20\x09-\x0D]+"))
_LOWER = {i: i + 32 for i in range(65, 91)}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def line_fails(line: str, words: int, chars: int) -> bool:
    """Punctuation: over a tenth symbols, over a third as many ! as words (of three or more), or marks only.
    Navigation: two or more separators, one for at most four words, or a menu entry. Boilerplate: a stock phrase."""
    if len(_symbols.findall(line)) * 10 > chars or (words >= 3 and line.count("!") * 3 > words) or _marks.match(line):
        return True
    n = len(_separators.findall(line))
    low = line.translate(_LOWER)
    return (n >= 2 and n * 4 >= words) or bool(_menu.match(low)) or bool(_boiler.search(low))


def clean_lines(text: str) -> tuple[str, int, int]:
    """(text without the lines that fail, non-blank characters kept, lines that repeat an earlier one and have a word)."""
    kept, chars_kept, seen, repeats = [], 0, set(), 0
    for line in text.split("\n"):
        words = _word.findall(line)
        if not words:
            kept.append(line)
            continue
        repeats += line in seen
        seen.add(line)
        chars = sum(map(len, words))
        if not line_fails(line.strip(BLANKS), len(words), chars):
            kept.append(line)
            chars_kept += chars
    return "\n".join(kept), chars_kept, repeats


def repeated_words(w: T.Words, n: int, k: int = 3) -> np.ndarray:
    """Words of each document that lie in a window of k words which the document has twice or more."""
    h = T.window_hash(w.hash, k)
    at = np.flatnonzero(T.windows_inside(w.first, len(h), k))
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    key = T.mix(h[at] + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + k, -1)
    return np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=n)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_text"]


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """Counts, verdict and cleaned text, a row for each row of ``docs``.

    base_failed: fewer than ``min_words`` words, or over half of them in repeated 3-word windows. kept: not
    base_failed, and the lines that pass hold at least ``min_kept`` of the non-blank characters. Null and empty texts
    have no words and fail. Ids may be null or repeat; each row is judged by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).fill_null("")
            for a, z, data, offsets in T.spans(texts):
                n = z - a
                w = T.words(data, offsets)
                n_words = np.diff(w.first)
                solid = ~T.BLANK[data]
                chars = T.characters(data, offsets) - _per_row(~solid, offsets)
                symbols = _per_row(_SYMBOL[data], offsets)
                again = repeated_words(w, n)
                cleaned = [clean_lines(x) for x in texts.slice(a, n).to_pylist()]
                base = (n_words < min_words) | (100 * again > 50 * n_words)
                kept = ~base & (np.array([x[1] for x in cleaned]) >= min_kept * chars)
                long = [n_words, chars, symbols, np.array([x[2] for x in cleaned]), again]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), *[pa.array(x.astype(np.int64)) for x in long], pa.array(base), pa.array(kept), pa.array([x[0] for x in cleaned], pa.string())], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_text string")


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=acc[1:])
    return acc[offsets[1:]] - acc[offsets[:-1]]


def op8_query(spark, sf_dir):
    return judge(load(spark, sf_dir, "documents")).drop("kept_text")


_Q = {k: v.replace("'", "''") for k, v in {"SYMBOLS": SYMBOLS, "MARKS": MARKS_ONLY, "SEP": SEPARATORS, "MENU": MENU, "BOILER": BOILERPLATE}.items()}
_WORDS = r"[^\x20\x09-\x0D]+"
OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, text FROM d
), p AS (
  SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM w
), t AS (
  SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM t WHERE z IS NOT NULL
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) s(j) WHERE n > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d
), m AS (
  SELECT doc_id, line, pos, regexp_extract_all(line, '{_WORDS}') AS lw, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM l
), k AS (
  SELECT doc_id, line, pos, len(lw) AS n, length(array_to_string(lw, '')) AS chars,
         translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, s,
         length(s) - length(regexp_replace(s, '{_Q['SYMBOLS']}', '', 'g')) AS sy, length(s) - length(replace(s, '!', '')) AS ex,
         length(s) - length(regexp_replace(s, '{_Q['SEP']}', '', 'g')) AS se
  FROM m WHERE len(lw) > 0
), f AS (
  SELECT doc_id, line, pos, chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
         sy * 10 > chars OR (n >= 3 AND ex * 3 > n) OR regexp_matches(s, '{_Q['MARKS']}') OR (se >= 2 AND se * 4 >= n)
         OR regexp_matches(low, '{_Q['MENU']}') OR regexp_matches(low, '{_Q['BOILER']}') AS fails
  FROM k
), a AS (
  SELECT doc_id, sum(CASE WHEN dup THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN fails THEN 0 ELSE chars END) AS chars_kept FROM f GROUP BY doc_id
), b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(chars_kept, 0) AS chars_kept
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND chars_kept >= {MIN_KEPT} * word_chars AS kept
FROM b
"""
