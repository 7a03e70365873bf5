"""Quality rules as a short-circuit cascade.

A sample of about `SAMPLE` texts measures each rule's cost (seconds a text) and rejections; the rules then run in order of
rejections per cost, each only on the texts that passed those before it. The verdict does not depend on the order: a text
is kept if no rule rejects it. A base that every text gets (counts of words, symbols, repeated lines and words) comes
first and rejects on its own.

Defined cases: null, empty and blank texts have no words and fail the base; very long texts are counted whole; repeated
rows come back as often as they are; other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 5_000
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
_SPACE = b" \t\n\x0b\x0c\r"
_BLANK_OR_LATER = bytes([*_SPACE, *range(0x80, 0xC0)])  # white space and the bytes that continue a code point
_NOT_UPPER = bytes(sorted(set(range(256)) - set(range(65, 91))))
_NOT_DIGIT = bytes(sorted(set(range(256)) - set(range(48, 58))))
_NOT_LETTER = bytes(sorted(set(range(0x80)) - set(range(65, 91)) - set(range(97, 123)))) + bytes(range(0x80, 0xC0))


@dataclass
class Base:
    """What every text gets, and its words."""

    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return len(self.words) < 50 or 100 * self.n_repeat_words > 50 * len(self.words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in some window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) < 2_000_000:
        windows = pairs[:-1] * len(number) + ids[2:]
    else:  # the product would overflow
        windows = np.unique(pairs, return_inverse=True)[1][:-1].astype(np.int64) * len(number) + ids[2:]
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def base(text: bytes) -> Base:
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACE):
            seen.add(line)
    chars = len(text.translate(None, _BLANK_OR_LATER))
    return Base(words, chars, len(text.translate(None, _NOT_SYMBOLS)), dup, repeated_words(words))


Rule = Callable[[bytes, Base], bool]
#: True rejects. Shares are of words or of their characters, in whole numbers so that SQL gives the same verdict.
RULES: dict[str, Rule] = {
    "symbols": lambda t, b: 10 * b.n_symbols > 3 * len(b.words),
    "duplicate_lines": lambda t, b: 2 * b.n_dup_lines > t.count(b"\n") + 1,
    "word_length": lambda t, b: b.word_chars < 2 * len(b.words) or b.word_chars > 14 * len(b.words),
    "capitals": lambda t, b: 10 * len(t.translate(None, _NOT_UPPER)) > 6 * b.word_chars,
    "exclamations": lambda t, b: 10 * t.count(b"!") > 3 * len(b.words),
    "digits": lambda t, b: 10 * len(t.translate(None, _NOT_DIGIT)) > 3 * b.word_chars,
    "letters": lambda t, b: 10 * len(t.translate(None, _NOT_LETTER)) < 6 * b.word_chars,
    "placeholders": lambda t, b: re.search(rb"(?i)lorem ipsum dolor", t) is not None,
}


def measured(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> list[str]:
    """The rules' names by rejections per second on a sample of about `sample` texts; dearer or idle rules come last."""
    names = list(RULES)
    rows = docs.select(text_col).count()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                b = base(t or b"")
                if b.failed:
                    continue
                for name in names:
                    began = time.perf_counter_ns()
                    rejected[name] += RULES[name](t, b)
                    cost[name] += time.perf_counter_ns() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([cost[n] for n in names], pa.int64()), pa.array([rejected[n] for n in names], pa.int64())],
            ["rule", "cost", "rejected"],
        )

    taken = docs.select(F.col(text_col).cast("binary").alias("t")).sample(min(1.0, sample / max(1, rows)), 11)
    sums = taken.mapInArrow(run, "rule string, cost long, rejected long").groupBy("rule").agg(F.sum("cost").alias("c"), F.sum("rejected").alias("r"))
    rate = {r["rule"]: (r["r"] / max(1, r["c"]), -r["c"]) for r in sums.collect()}
    return sorted(names, key=lambda n: rate.get(n, (0.0, 0)), reverse=True)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each row."""
    cascade = [(n, RULES[n]) for n in (order or measured(docs, text_col))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            bases = [base(t) for t in texts]
            kept = [not b.failed for b in bases]
            alive = [i for i, k in enumerate(kept) if k]
            for _, rule in cascade:
                still = []
                for i in alive:
                    if rule(texts[i], bases[i]):
                        kept[i] = False
                    else:
                        still.append(i)
                alive = still
            counts = [[len(b.words) for b in bases], *([getattr(b, k) for b in bases] for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([b.failed for b in bases]), pa.array(kept, pa.bool_())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return src.mapInArrow(run, schema)


#: The same in SQL; the order of rules does not matter to it.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM p
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) x WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) x GROUP BY rid
), l AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT rid, CAST(sum(n - 1) AS BIGINT) AS n FROM (
    SELECT rid, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) x GROUP BY rid
), b AS (
  SELECT w.doc_id, t, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
    OR 10 * n_symbols > 3 * n_words
    OR 2 * n_dup_lines > length(t) - length(replace(t, chr(10), '')) + 1
    OR word_chars < 2 * n_words OR word_chars > 14 * n_words
    OR 10 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 6 * word_chars
    OR 10 * (length(t) - length(replace(t, '!', ''))) > 3 * n_words
    OR 10 * length(regexp_replace(t, '[^0-9]', '', 'g')) > 3 * word_chars
    OR 10 * length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) < 6 * word_chars
    OR regexp_matches(t, '(?i)lorem ipsum dolor')) AS kept
FROM b
"""
