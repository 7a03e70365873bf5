"""Removal of byte strings that occur more than once, by the interval tree of a sparse suffix array.

Anchors: of the `LENGTH - GRAM + 1` places in a window of LENGTH bytes, the one whose 16 bytes hash lowest (the first of
equals) is the window's anchor, so equal windows have their anchor at the same offset. An anchor answers for a run of
windows; its context is their bytes. Windows can only be equal if the GRAM bytes at their anchors are, so occurrences are
grouped by that gram (first a count, so that what occurs once is never moved again), and equal contexts are one class.
A row is a class within a text, with all its places there: a line that a text repeats a thousand times is one row.

Suffix array: within a gram's group the classes are sorted by what follows the gram; a stack scan over the common-prefix
lengths of neighbours builds the interval tree. In each interval the text before the gram is tested for diversity: if
all members agree, the interval extends to the left as a whole, else each member extends as far as any other agrees with
it. Left and right extent together must span LENGTH bytes. So every occurrence in an interval counts, not just
neighbours, and each gets the union of all its repeated windows.

A group with more than GROUP classes is split until none is left: the window offsets are cut into PARTS ranges, of which
the higher need more bytes to the left and the lower more to the right, and each range is regrouped by the gram with those
bytes; at a single offset a group is one class.

In words: with `words` the same runs over texts in which each word is four bytes of its hash, so that a passage counts by
its words, however short or long they are. Chance equality adds a word to a passage once in about 2 ** 32 ends.

Defined cases: null texts are empty; texts under LENGTH bytes keep every byte; equal rows count as two occurrences;
null doc_ids stay (rows of a null id and of the lowest id there is share spans only if their texts are equal); other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, sized, staged

LENGTH, GRAM, GROUP = 400, 100, 1024
#: Ranges into which the offsets of a large group are cut at a time.
PARTS = 8
#: A word is WIDE bytes of its hash where repeats are counted in words.
WIDE, WORD_GRAM = 4, 13
#: Words whose codes a task keeps from one batch to the next.
WORDS = 200_000
NO_ID = -(1 << 63)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_SIGNED = 1 << 63


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGNED else x


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of text, and the lowest and highest offset of the windows that each answers for."""
    n = len(text) - gram + 1
    at = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    key = (at[:n] * _A) ^ (at[8 : n + 8] * _B)
    key ^= key >> np.uint64(29)
    key *= _C
    key &= _HIGH
    key |= np.arange(n, dtype=np.uint64)
    width, left = 1, length - gram + 1
    while 2 * width <= left:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if left > width:
        key = np.minimum(key[: len(key) - (left - width)], key[left - width :])
    own = (key & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    last = np.append(first[1:], len(own)) - 1
    pos = own[first]
    return pos, pos - last, pos - first


def _anchor_rows(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of each text its classes, each with all its places."""
    names = ["k1", "k2", "ctx", "doc_key", "r", "pos", "lo", "hi"]
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] + [pa.int32()] * 2

    def packed(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    digest, whole = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
    for b in batches:
        out: list[list] = [[] for _ in names]
        held = 0
        for doc, r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_buffer()
            if text is None or len(text) < length:
                continue
            text = text.to_pybytes()
            pos, lo, hi = (x.tolist() for x in anchors(text, length, gram))
            places: dict[tuple[int, int, int, int], list[int]] = {}
            for p, a, z in zip(pos, lo, hi, strict=True):
                places.setdefault((digest(text[p : p + gram]), whole(text[p - z : p - a + length], a << 16 | z), a, z), []).append(p)
            for k, c, a, z in places:
                out[0].append(_signed(k >> 64))
                out[1].append(_signed(k & 0xFFFFFFFFFFFFFFFF))
                out[2].append(_signed(c))
                out[6].append(a)
                out[7].append(z)
            out[3] += [doc] * len(places)
            out[4] += [r] * len(places)
            out[5] += places.values()
            held += len(pos)
            if held > 100_000:
                yield packed(out)
                out, held = [[] for _ in names], 0
        yield packed(out)


def _context_rows(batches: Iterable[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Of each wanted anchor, what stands before the gram (reversed) and after it, as far as its windows reach."""
    kind = [("k1", pa.int64()), ("k2", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]
    for b in batches:
        texts, lists = b.column(0).to_pylist(), b.column(1).to_pylist()
        rows = [(w, t[w["pos"] - w["hi"] : w["pos"]][::-1], t[w["pos"] + gram : w["pos"] - w["lo"] + length]) for t, ws in zip(texts, lists, strict=True) for w in ws]
        for i in range(0, max(1, len(rows)), 20_000):
            part = rows[i : i + 20_000]
            cols = [pa.array([w[k] for w, _, _ in part], t) for k, t in kind]
            cols += [pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [k for k, _ in kind] + ["left", "right"])


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a and b agree up to low, not up to n
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of each interval of the tree over an array with lcp[i] between entries i and i + 1."""
    stack = [(0, 0)]  # value, first
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > v:
            value, first = stack.pop()
            if i > first:
                yield value, first, i
        if not stack or stack[-1][0] < v:
            stack.append((v, first))
    # the root is popped by the closing -1


def extents(group: list[tuple[bytes, bytes, int, int, int]], span: int = LENGTH - GRAM) -> list[tuple[int, int] | None]:
    """For each (left, right, n, lo, hi) of a gram's group the lowest and highest offset at which a window of it repeats."""
    best: list[tuple[int, int] | None] = [(lo, hi) if n > 1 else None for _, _, n, lo, hi in group]

    def put(i: int, low: int, high: int) -> None:
        if high >= low:
            best[i] = (low, high) if best[i] is None else (min(low, best[i][0]), max(high, best[i][1]))

    order = sorted(range(len(group)), key=lambda i: group[i][1])
    lcp = [common(group[i][1], group[j][1]) for i, j in zip(order, order[1:], strict=False)]
    for value, first, last in intervals(lcp):
        members = sorted(order[first : last + 1], key=lambda i: group[i][0])
        least = span - value
        whole = common(group[members[0]][0], group[members[-1]][0])
        if whole >= least and whole == max(len(group[i][0]) for i in members):  # no diversity to the left
            for i in members:
                put(i, least, whole)
            continue
        near = [common(group[i][0], group[j][0]) for i, j in zip(members, members[1:], strict=False)]
        for k, i in enumerate(members):
            put(i, least, max(near[k - 1] if k else -1, near[k] if k < len(near) else -1))
    return best


def _extent_rows(batches: Iterable[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (k1, k2); a group has at most GROUP rows."""
    names = ["k1", "k2", "ctx", "lmin", "lmax"]
    types = [pa.int64()] * 3 + [pa.int32()] * 2
    out: list[tuple] = []
    held: list[tuple] = []

    def close() -> None:
        if len(held) > 1 or held and held[0][3] > 1:
            for row, e in zip(held, extents([(x[6], x[7], x[3], x[4], x[5]) for x in held], span), strict=True):
                if e:
                    out.append((*row[:3], *e))
        held.clear()

    def packed() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        out.clear()
        return batch

    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("k1", "k2", "ctx", "n", "lo", "hi", "left", "right")), strict=True):
            if held and held[0][:2] != row[:2]:
                close()
            held.append(row)
        if len(out) > 50_000:
            yield packed()
    close()
    yield packed()


_CLASS = "k1 long, k2 long, ctx long, n long, lo int, hi int, left binary, right binary"


def _ranges(batches: Iterable[pa.RecordBatch], span: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The parts of each row's range of offsets [a, b]: new group, new class, and the row's own share of the range."""
    names = ["o1", "o2", "octx", "k1", "k2", "ctx", "n", "lo", "hi", "left", "right", "a", "b"]
    types = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.binary()] * 2 + [pa.int32()] * 2
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for o1, o2, octx, k1, k2, n, lo, hi, left, right, a, b in zip(*(batch.column(k).to_pylist() for k in ("o1", "o2", "octx", "k1", "k2", "n", "lo", "hi", "left", "right", "a", "b")), strict=True):
            cuts = [a + (b - a + 1) * i // parts for i in range(parts + 1)]
            for x, y in ((x, y - 1) for x, y in zip(cuts, cuts[1:], strict=False)):
                low, high = max(lo, x), min(hi, y)
                if low > high:
                    continue
                k = xxhash.xxh3_128_intdigest(b"%d,%d,%d,%d,%d:%b%b" % (k1, k2, x, y, min(x, len(left)), left[:x], right[: span - y]))
                own_left, own_right = left[:high], right[: span - low]
                c = xxhash.xxh3_64_intdigest(own_left + own_right, low << 16 | high)
                row = (o1, o2, octx, _signed(k >> 64), _signed(k & 0xFFFFFFFFFFFFFFFF), _signed(c), n, low, high, own_left, own_right, x, y)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


def _resolved(classes: DataFrame, span: int) -> DataFrame:
    """(k1, k2, ctx, lmin, lmax) of the classes that have a repeated window."""
    sizes = staged(classes.groupBy("k1", "k2").agg(F.count("*").alias("c")).filter(F.col("c") > GROUP), "repeats-large", (classes,))
    sorted_groups = lambda d: d.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "ctx").mapInArrow(lambda batches: _extent_rows(batches, span), "k1 long, k2 long, ctx long, lmin int, lmax int")
    if sizes.isEmpty():
        return sorted_groups(classes.select(*[c.split()[0] for c in _CLASS.split(", ")]))
    own = [c.split()[0] for c in _CLASS.split(", ")]
    done = sorted_groups(classes.join(sized(sizes), ["k1", "k2"], "left_anti").select(*own))
    parts, last = PARTS, ()
    rows = classes.join(sized(sizes), ["k1", "k2"], "left_semi").select(
        F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("ctx").alias("octx"), *own, F.lit(0).alias("a"), F.lit(span).alias("b")
    )
    schema = f"o1 long, o2 long, octx long, {_CLASS}, a int, b int"
    while True:
        rows = staged(rows.mapInArrow(lambda batches: _ranges(batches, span, parts), schema), "repeats-ranges")
        released(*last)
        part = rows.groupBy("k1", "k2", "ctx").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("lo", "hi", "left", "right")])
        part = staged(part, "repeats-classes", (rows,))
        sizes = staged(part.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.sum("n").alias("all")).filter("all > 1"), "repeats-sizes", (part,))
        small = part.join(sized(sizes, sizes.filter(F.col("c") <= GROUP)), ["k1", "k2"], "left_semi").select(*own)
        found = sorted_groups(small).join(rows.select("o1", "o2", "octx", "k1", "k2", "ctx").hint("merge"), ["k1", "k2", "ctx"])
        found = staged(found.select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.col("octx").alias("ctx"), "lmin", "lmax"), "repeats-reach", (rows,))
        done = done.unionByName(found)
        large = sizes.filter(F.col("c") > GROUP)
        if large.isEmpty():
            released(rows, part, sizes)
            return done.groupBy("k1", "k2", "ctx").agg(F.min("lmin").alias("lmin"), F.max("lmax").alias("lmax"))
        last = rows, part, sizes
        rows = rows.join(sized(sizes, large), ["k1", "k2"], "left_semi").select(*[c.split()[0] for c in schema.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_key and r name a row for joins; rows that share both are equal."""
    return docs.withColumns({
        "__k": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "__r": F.xxhash64(text_col), "__t": F.col(text_col).cast("binary"),
    })


class _Codes(dict):
    """Codes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh32_intdigest(word)
        return code


def _word_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column __t with each word replaced by WIDE bytes."""
    codes = _Codes()
    for b in batches:
        if len(codes) > WORDS:  # a missed word is computed again
            codes.clear()
        found = [np.array([codes[w] for w in t.split()], f"<u{WIDE}").tobytes() if t else t for t in b.column("__t").to_pylist()]
        yield b.set_column(b.schema.get_field_index("__t"), "__t", pa.array(found, pa.binary()))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, in_words: bool = False) -> DataFrame:
    """(k1, k2, doc_key, r, pos, before, after): a row for each class of repeats in a text; (k1, k2) names the group.

    At each place p of the list pos the bytes from p - before to p + after repeat: bytes of the text or, with in_words, of
    its words' codes, as are length and gram.
    """
    assert 16 <= gram <= length < gram + (1 << 16)  # an anchor hashes 16 bytes; two offsets are packed by 16 bits
    keyed = _keyed(docs, id_col, text_col).select("__k", "__r", "__t")
    coded = keyed.mapInArrow(_word_rows, "__k long, __r long, __t binary") if in_words else keyed
    rows = coded.mapInArrow(
        lambda batches: _anchor_rows(batches, length, gram), "k1 long, k2 long, ctx long, doc_key long, r long, pos array<int>, lo int, hi int"
    )
    rows = staged(rows, "repeats-anchors")
    # per gram its occurrences, its classes, and the class that most of them are in
    counted = rows.groupBy("k1", "k2", "ctx").agg(F.sum(F.size("pos")).alias("n"))
    groups = counted.groupBy("k1", "k2").agg(F.sum("n").alias("all"), F.count("*").alias("c"), F.max(F.struct("n", "ctx")).alias("m")).filter("all > 1")
    # written first, so that both sides of the join are plain shuffles, whose hot keys adaptive execution splits
    groups = staged(groups.select("k1", "k2", "c", F.when(F.col("m.n") > 1, F.col("m.ctx")).alias("main")), "repeats-groups", (rows,))
    found = staged(rows.join(groups.hint("merge"), ["k1", "k2"]), "repeats-found", (rows,))
    released(rows, groups)
    # all windows of a class that occurs twice repeat; those of the largest need no other look-up
    alike = found.filter(F.col("ctx").eqNullSafe(F.col("main"))).withColumns({"lmin": F.col("lo"), "lmax": F.col("hi")})
    several = found.filter(~F.col("ctx").eqNullSafe(F.col("main")))
    classes = found.filter("c > 1").groupBy("k1", "k2", "ctx").agg(
        F.sum(F.size("pos")).alias("n"), F.min(F.struct("doc_key", "r", F.col("pos")[0].alias("pos"), "lo", "hi")).alias("o")
    )
    wanted = classes.groupBy(F.col("o.doc_key").alias("__k"), F.col("o.r").alias("__r")).agg(
        F.collect_list(F.struct("k1", "k2", "ctx", "n", F.col("o.pos").alias("pos"), F.col("o.lo").alias("lo"), F.col("o.hi").alias("hi"))).alias("w")
    )
    texts = keyed.hint("merge").join(wanted, ["__k", "__r"]).select("__t", "w")
    if in_words:  # only the texts that are wanted are coded again
        texts = texts.mapInArrow(_word_rows, f"__t binary, w {dict(wanted.dtypes)['w']}")
    contexts = staged(texts.mapInArrow(lambda batches: _context_rows(batches, length, gram), _CLASS), "repeats-contexts")
    reach = _resolved(contexts, length - gram)
    spread = several.join(reach.hint("merge"), ["k1", "k2", "ctx"])
    cols = ["k1", "k2", "doc_key", "r", "pos", F.col("lmax").alias("before"), (F.lit(length) - F.col("lmin")).alias("after")]
    return alike.select(*cols).unionByName(spread.select(*cols))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as maximal runs."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def in_text(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words' codes as spans of text: whole words, each with the white space behind it."""
    if not spans:
        return []
    at = np.frombuffer(text, np.uint8)
    word = (at != 32) & ((at < 9) | (at > 13))
    starts = np.append(np.flatnonzero(word & np.concatenate(([True], ~word[:-1]))), len(text))
    first, last = np.array(spans).T
    return list(zip(starts[-(-first // WIDE)].tolist(), starts[last // WIDE].tolist(), strict=True))


def _spans(rows: list[dict] | None) -> list[tuple[int, int]]:
    """What repeats at the places of rows."""
    return [(p - x["before"], p + x["after"]) for x in rows or () for p in x["pos"]]


def left_of(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """text without the runs in cut."""
    ends, starts = [0, *(e for _, e in cut)], [*(a for a, _ in cut), len(text)]
    return b"".join(text[a:z] for a, z in zip(ends, starts, strict=True))


def _cut_rows(batches: Iterable[pa.RecordBatch], as_text: bool, apart: bool) -> Iterator[pa.RecordBatch]:
    """Adds what is left of column __t without the spans in column __s and those of words' codes in column __w.

    With apart the latter are only left out of one more column, __clean.
    """
    kind = pa.string() if as_text else pa.binary()
    for b in batches:
        texts, bytewise, wordwise = (b.column(c).to_pylist() for c in ("__t", "__s", "__w"))
        n, removed, runs, kept, clean = [], [], [], [], []
        for t, s, w in zip(texts, bytewise, wordwise, strict=True):
            t = t or b""
            own, coded = _spans(s), in_text(t, _spans(w))
            whole = merged(own + coded)
            cut = merged(own) if apart and coded else whole
            n.append(len(t))
            removed.append(sum(e - a for a, e in cut))
            runs.append(len(cut))
            left = left_of(t, cut)
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
            if apart:
                clean.append((left_of(t, whole) if coded else left).decode("utf-8", "ignore"))
        same = [i for i, k in enumerate(b.schema.names) if k not in ("__t", "__s", "__w")]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in same), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, kind), *([pa.array(clean, pa.string())] * apart)],
            [*(b.schema.names[i] for i in same), "__n", "__removed", "__runs", "__kept", *(["__clean"] * apart)],
        )


def without_repeats(
    docs: DataFrame,
    keep: list[str],
    as_text: bool = False,
    names: tuple[str, str, str, str] = ("n_bytes", "n_removed", "n_spans", "kept"),
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    words: int | None = None,
    apart: str | None = None,
) -> DataFrame:
    """The columns `keep` of each row and, under `names`, its bytes, those removed, their runs, and the bytes left.

    Removed is what repeats over `length` bytes and, where `words` is given, what repeats over that many words (at least
    WORD_GRAM), whatever their bytes; between words any white space is alike. If `apart` names a further column, a string,
    repeats in words are missing from that column only.

    With as_text what is left is a string: bytes of a code point that was cut through are left out.
    """
    by_row = lambda d, name: d.groupBy(F.col("doc_key").alias("__k"), F.col("r").alias("__r")).agg(F.collect_list(F.struct("pos", "before", "after")).alias(name))
    spans = by_row(repeated_spans(docs, id_col, text_col, length, gram), "__s")
    if words is None:
        spans = spans.withColumn("__w", F.lit(None).cast("array<struct<pos:array<int>,before:int,after:int>>"))
    else:
        coded = repeated_spans(docs, id_col, text_col, words * WIDE, WORD_GRAM * WIDE, in_words=True)
        spans = spans.hint("merge").join(by_row(coded, "__w"), ["__k", "__r"], "full")
    keyed = _keyed(docs, id_col, text_col).select("__k", "__r", "__t", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)])
    joined = keyed.hint("merge").join(spans, ["__k", "__r"], "left").drop("__k", "__r")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"__c{i} {types[c]}" for i, c in enumerate(keep)), f"__n long, __removed long, __runs long, __kept {'string' if as_text else 'binary'}", *(["__clean string"] if apart else [])])
    cut = joined.select(*[f"__c{i}" for i in range(len(keep))], "__t", "__s", "__w").mapInArrow(lambda batches: _cut_rows(batches, as_text, bool(apart)), schema)
    return cut.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(c).alias(n) for c, n in zip(("__n", "__removed", "__runs", "__kept"), names, strict=True)],
        *([F.col("__clean").alias(apart)] if apart else []),
    )
