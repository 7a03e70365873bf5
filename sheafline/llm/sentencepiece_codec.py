"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A model file gives pieces and scores. The automaton reads a text once; at each position it reports, along its output
links, every piece that ends there, longest first, and the best score up to that position is relaxed. In a unigram model
a text's ids are the path of the best total. In a merge model (BPE) scores rank merges, so a piece may only follow one
beside which merging would leave it standing; one path is left, which is what merging makes, and ids equal the
library's. A character that no piece covers costs the lowest score less 10 and becomes byte pieces.
As no piece goes on past a space mark that follows something else, nor over a line break, the lattice has a single node
there, and words are looked up in a bounded cache of their own best paths.

Defined cases: null texts have null ids and decode to null; an empty text has no ids; other texts get a space mark in
front, which decoding takes away; a space mark that stands in the text itself becomes its bytes, so decoding is exact for
every text; texts are read whole; repeated rows and other columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
CACHE, PAIRS = 100_000, 400_000  # words that each of two generations holds, and pairs of pieces
_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Paths(dict):
    """Word: its ids, found by `path` where they are not held; of the words met last, `size` to twice as many are."""

    def __init__(self, path: Callable[[str], list[int]], size: int = CACHE) -> None:
        super().__init__()
        self.path, self.size, self.older = path, size, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.path(word)).tobytes()
        if len(word) <= 48:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, model: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = proto.SentencePiece
        self.by_merges = proto.trainer_spec.model_type == proto.trainer_spec.BPE
        self.bytes_of: list[bytes] = [b""] * len(proto.pieces)
        self.byte_id = [0] * 256
        self.piece: dict[str, tuple[float, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
                self.piece[p.piece] = (p.score, i)
        self.automaton.make_automaton()
        self.fallback = min((x for x, _ in self.piece.values()), default=0.0) - 10.0
        self.paths = Paths(self.best_path)
        self.text_of = {i: x for x, (_, i) in self.piece.items()}
        self.pairs: dict[int, bool] = {}
        self.shown = pa.array(self.bytes_of, pa.large_binary())
        self.is_byte = np.isin(np.arange(len(proto.pieces)), self.byte_id)

    def merges(self, text: str) -> list[str]:
        """text after merging, again and again, the neighbours that form the best piece, of equals the first."""
        parts = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (got := self.piece.get(parts[i] + parts[j])):
                heappush(queue, (-got[0], i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, made = heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in parts if x]

    def stands(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b side by side as they are; a path of such pairs is what merging makes."""
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            ok = self.merges(self.text_of[a] + self.text_of[b]) == [self.text_of[a], self.text_of[b]]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = ok
        return ok

    def merge_path(self, text: str) -> list[int]:
        """Ids of the one path over marked text whose neighbours all stand; each position has one last piece at most."""
        last: list[int | None] = [None] * (len(text) + 1)  # the piece that ends here; none where a character is in bytes
        size = [1] * (len(text) + 1)
        known, stands = self.pairs.get, self.stands
        for end, (k, _, i) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                a = last[end - k]
                if a is not None:
                    ok = known(a << 32 | i)
                    if not (stands(a, i) if ok is None else ok):
                        continue
                last[end], size[end] = i, k
        out: list[int] = []
        j = len(text)
        while j:
            if last[j] is None:
                out.extend(self.byte_id[b] for b in reversed(text[j - 1].encode()))
            else:
                out.append(last[j])
            j -= size[j]
        out.reverse()
        return out

    def best_path(self, text: str) -> list[int]:
        """Ids of the best path over marked text."""
        if self.by_merges and text.startswith(MARK * 2):  # pieces of marks alone all have one score, so pairs do not tell
            return [i for x in self.merges(text) for i in ([self.piece[x][1]] if x in self.piece else [self.byte_id[b] for b in x.encode()])]
        if self.by_merges:
            return self.merge_path(text)
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        came: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # start, id; -1 for a character in bytes
        done = 0  # positions up to here are final
        for end, (size, score, i) in self.automaton.iter(text):
            end += 1
            if end > done:
                for j in range(max(1, done), end):
                    self._bare(text, best, came, j)
                done = end
            start = end - size
            s = best[start] + score
            if s > best[end]:
                best[end], came[end] = s, (start, i)
        for j in range(max(1, done), n + 1):
            self._bare(text, best, came, j)
        out: list[int] = []
        j = n
        while j:
            start, i = came[j]
            if i < 0:
                out.extend(self.byte_id[b] for b in reversed(text[start:j].encode()))
            else:
                out.append(i)
            j = start
        out.reverse()
        return out

    def _bare(self, text: str, best: list[float], came: list[tuple[int, int]], j: int) -> None:
        """Relax position j by its last character in bytes, if that is no piece."""
        s = best[j - 1] + self.fallback
        if s > best[j] and text[j - 1] not in self.piece:
            best[j], came[j] = s, (j - 1, -1)

    def _marked(self, text: str) -> bytes:
        return b"".join(map(self.paths.__getitem__, _PARTS.findall(text)))

    def packed(self, text: str) -> bytes:
        """The ids of text, each as four bytes."""
        if not text:
            return b""
        if MARK not in text:
            return self._marked(MARK + text.replace(" ", MARK))
        literal = array("i", [self.byte_id[b] for b in MARK.encode()]).tobytes()
        return literal.join(self._marked((MARK if k == 0 else "") + part.replace(" ", MARK)) for k, part in enumerate(text.split(MARK)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def shown_bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """What the ids of each text stand for, the space in front included; ends are those of the texts' ids."""
        flat = self.shown.take(pa.array(ids))
        at = np.frombuffer(flat.buffers()[1], np.int64) if len(ids) else np.zeros(1, np.int64)
        data = flat.buffers()[2] if len(ids) else b""
        cut = at[np.concatenate(([0], ends))].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(view[a:z]) for a, z in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


_loaded: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The worker's codec of a model file, read once."""
    if model not in _loaded:
        _loaded[model] = Codec(model)
    return _loaded[model]


def encoded(docs: DataFrame, model: str | None = None, text_col: str = "text", verify: bool = False, slice_rows: int = 256) -> DataFrame:
    """docs without its text but with ids (array of int), n_tokens and n_fallback (byte pieces).

    With verify also round_trip: whether decoding gives the text again.
    """
    model = model or default_model()
    own = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for whole in batches:
            for i in range(0, max(1, whole.num_rows), slice_rows):
                b = whole.slice(i, slice_rows)
                texts = b.column(0).to_pylist()
                found = [c.packed(t or "") for t in texts]
                ids = np.frombuffer(b"".join(found), np.int32)
                ends = np.cumsum([len(x) // 4 for x in found], dtype=np.int64)
                starts = np.concatenate(([0], ends))
                byte_pieces = np.concatenate(([0], np.cumsum(c.is_byte[ids])))
                cols = [
                    pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids), mask=pa.array([t is None for t in texts], pa.bool_())),
                    pa.array(np.diff(starts)),
                    pa.array(np.diff(byte_pieces[starts])),
                ]
                if verify:
                    shown = c.shown_bytes(ids, ends)
                    cols.append(pa.array([(b" " + t.encode() if t else b"") == x for t, x in zip(texts, shown, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(b.column(k + 1) for k in range(len(own))), *cols], names)

    names = [f"c{k}" for k in range(len(own))] + ["__ids", "__n", "__f"] + ["__ok"] * verify
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"c{k} {types[x]}" for k, x in enumerate(own)), "__ids array<int>", "__n long", "__f long", *(["__ok boolean"] * verify)])
    src = docs.select(F.col(text_col).alias("__t"), *[F.col(x).alias(f"c{k}") for k, x in enumerate(own)])
    out = src.mapInArrow(run, schema)
    end = [F.col("__ids").alias("ids"), F.col("__n").alias("n_tokens"), F.col("__f").alias("n_fallback")]
    keep = [F.col(f"c{k}").alias(x) for k, x in enumerate(own) if x not in ("ids", "n_tokens", "n_fallback", "round_trip")]
    return out.select(*keep, *end, *([F.col("__ok").alias("round_trip")] if verify else []))


def decoded(rows: DataFrame, model: str | None = None, ids_col: str = "ids", key_col: str = "doc_id") -> DataFrame:
    """(key_col, text) of rows with ids."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            texts = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["k", "text"])

    kind = dict(rows.dtypes)[key_col]
    return rows.select(F.col(key_col).alias("k"), ids_col).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key_col)
