"""Operator 1: quality rules as a short-circuit cascade.

On a sample every rule is timed and its rejections are counted; rules then run in the
order of rejections per second, and a document's first rejection ends its checks. The
order changes the work only, never a verdict: a document is kept if no rule rejects
it. The contract's base measures are taken of every document.

Null and empty texts have no words and fail the base. Repeated rows are judged each
on its own; extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import texts

#: Documents the costs and selectivities are estimated on, about.
SAMPLE_ROWS = 2000
WINDOW = 8

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SMALL = bytes(range(ord("a"), ord("z") + 1))


def repeat_words(ids: list[int], n: int = WINDOW) -> int:
    """Words in windows of ``n`` that occur twice or more, the first included."""
    x = np.array(ids, np.int64)
    m = len(x) - n + 1
    if m < 2:
        return 0
    # Windows as names: of 2 words, 4, 8; each name stands for one sequence exactly.
    names, width = x, 1
    while width < n:
        pairs = (names[:-width] << 32) | names[width:]
        if 2 * width == n:
            order = np.argsort(pairs)
            ranked = pairs[order]
            same = ranked[1:] == ranked[:-1]
            if not same.any():
                return 0
            twice = np.zeros(m, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, np.flatnonzero(twice), 1)
            np.add.at(edge, np.flatnonzero(twice) + n, -1)
            return int((np.cumsum(edge)[:-1] > 0).sum())
        names = np.unique(pairs, return_inverse=True)[1]
        if len(names) and names.max() + 1 == len(names):
            return 0  # all different already
        width *= 2
    return 0


class Document:
    """Base measures of one text."""

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        self.data = data
        self.n_words = len(words)
        self.word_chars = len(text) - (len(data) - len(data.translate(None, texts.SPACES)))
        self.n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        known: dict[bytes, int] = {}
        self.n_repeat_words = repeat_words([known.setdefault(w, len(known)) for w in words])
        self.base_failed = self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def _symbols(d: Document) -> bool:
    return 5 * d.n_symbols > d.n_words


def _capitals(d: Document) -> bool:
    capitals = len(d.data) - len(d.data.translate(None, _CAPITALS))
    return capitals > len(d.data) - len(d.data.translate(None, _SMALL))


def _exclaims(d: Document) -> bool:
    return 5 * d.data.count(b"!!") > d.n_words


def _dup_lines(d: Document) -> bool:
    return 10 * d.n_dup_lines > 3 * d.n_lines


def _word_length(d: Document) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 20 * d.n_words


Rule = Callable[[Document], bool]
#: Each rejects what it is true of.
RULES: dict[str, Rule] = {
    "symbols": _symbols, "capitals": _capitals, "exclaims": _exclaims,
    "dup_lines": _dup_lines, "word_length": _word_length,
}


def rule_order(df: DataFrame, text_column: str = "text", rules: dict[str, Rule] = RULES,
               sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections per second on a sample, best first."""
    total = df.count()
    # A hash of the text draws the sample; it only sets the order of the rules.
    share = max(1, total // max(1, sample_rows))
    sample = df.where(F.pmod(F.xxhash64(text_column), F.lit(share)) == 0).select(text_column)

    def make(batch: pa.RecordBatch) -> dict:
        found = [d for d in map(Document, texts.strings(batch, text_column)) if not d.base_failed]
        out = {"rule": [], "rejected": [], "nanos": []}
        for name, rule in rules.items():
            start = time.perf_counter_ns()
            rejected = sum(map(rule, found))
            out["rule"].append(name)
            out["nanos"].append(time.perf_counter_ns() - start)
            out["rejected"].append(rejected)
        return out

    measured = texts.map_slices(sample, text_column, make, "rule string, rejected bigint, nanos bigint")
    rates = {
        r.rule: r.rejected / max(1, r.nanos)
        for r in measured.groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("nanos").alias("nanos")).collect()
    }
    return sorted(rules, key=lambda x: -rates.get(x, 0))


def judge(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          rules: dict[str, Rule] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, base measures, base_failed, kept, and the columns of ``carry``."""
    cascade = [rules[x] for x in rule_order(df, text_column, rules)]
    whole = list(dict.fromkeys([id_column, *carry]))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in whole)

    def make(batch: pa.RecordBatch) -> dict:
        found = list(map(Document, texts.strings(batch, text_column)))
        return {c: batch.column(c) for c in whole} | {
            "n_words": [d.n_words for d in found],
            "word_chars": [d.word_chars for d in found],
            "n_symbols": [d.n_symbols for d in found],
            "n_dup_lines": [d.n_dup_lines for d in found],
            "n_repeat_words": [d.n_repeat_words for d in found],
            "base_failed": [d.base_failed for d in found],
            "kept": [not d.base_failed and not any(r(d) for r in cascade) for d in found],
        }

    return texts.map_slices(
        df.select(*dict.fromkeys([*whole, text_column])), text_column, make,
        schema + ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, kept boolean",
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(texts.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
         length(text) - length(regexp_replace(text, '[a-z]', '', 'g')) AS small,
         (length(text) - length(replace(text, '!!', ''))) / 2 AS exclaims
  FROM d
), l AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, p, array_to_string(words[p : p + 7], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(generate_series(1, CAST(len(words) AS BIGINT) - 7)) AS p FROM d WHERE len(words) > 7)
), r AS (
  SELECT doc_id, CAST(count(DISTINCT p + k) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
       (SELECT unnest(generate_series(0, 7)) AS k)
  WHERE times > 1 GROUP BY doc_id
), b AS (
  SELECT m.*, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM m LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR capitals > small OR 5 * exclaims > n_words
            OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""
