"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole with a byte-level BPE vocabulary. The tokens' bytes are the text's bytes, so their
running sum gives each token's span. Sections are spans too (here the lines of the text, each with its line break); the
two sorted lists are joined by interval. A token within one section counts there. A token that crosses a boundary goes,
whole, to the section that holds most of its bytes, of equals to the first (rule `majority`), or to the one that holds
its first byte (rule `start`). So sections' counts add up to the document's.

Defined cases: null and empty texts have one empty section with no tokens; a last line without a break is a section, an
empty one after a break is not; texts are read whole; repeated rows and null ids are kept; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte offset after each token."""
        return np.cumsum(self.size[self.encoding.encode_to_numpy(text, disallowed_special=())])


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    if (vocabulary, pattern) not in _loaded:
        _loaded[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _loaded[vocabulary, pattern]


def line_ends(text: bytes) -> np.ndarray:
    """The byte offset after each line and its break."""
    ends = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    starts = np.concatenate(([0], token_ends[:-1]))
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    crossing = np.flatnonzero(first < last)
    home = first.copy()
    if rule == "majority":
        for i in crossing:
            inner = section_ends[first[i] : last[i]]
            parts = np.diff(np.concatenate(([starts[i]], inner, [token_ends[i]])))
            home[i] = first[i] + int(np.argmax(parts))
    return np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)


def section_tokens(
    docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, rule: str = "majority", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, section from 0, n_bytes, n_tokens, n_crossing) of each section of each row."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary, pattern)
        for whole in batches:
            for i in range(0, max(1, whole.num_rows), 1000):
                b = whole.slice(i, 1000)
                ids, cols = [], []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    text = text or ""
                    ends = line_ends(text.encode())
                    tokens, crossing = attributed(e.ends(text), ends, rule)
                    ids += [doc] * len(ends)
                    cols.append(np.column_stack([np.arange(len(ends)), np.diff(ends, prepend=0), tokens, crossing]))
                m = np.vstack(cols) if cols else np.zeros((0, 4), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(m[:, 0].astype(np.int32)), *(pa.array(m[:, k].astype(np.int64)) for k in (1, 2, 3))],
                    ["doc_id", "section", "n_bytes", "n_tokens", "n_crossing"],
                )

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, "doc_id long, section int, n_bytes long, n_tokens long, n_crossing long")
