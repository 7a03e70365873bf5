"""Near-duplicates by bottom-k sketches of one hash function, confirmed by the exact Jaccard similarity.

A document's set holds its distinct shingles as hashes; its sketch is the K smallest of them, or all if there are fewer.
Let two sets have at least the similarity t = LEAST. Of the K smallest values of their union the share t or more is
expected in both, so more than `most(K)` of them are unshared with a probability under 1e-7 (a binomial tail), and never if
both sketches are whole sets. So of each sketch's values, rarest first, the first `most + 1` suffice in the inverted lists:
one of them is shared. Rare values come first because a passage that very many documents share then stands in lists only of
documents that consist of little else.

A list's nodes (sets, copies count once) are compared with its smallest node only. Where nodes of a list are still in
different components afterwards, a short list's pairs between components are compared too. Nodes of long lists get new
lists from their whole sets, where the first `n - ceil(t n) + 1` rarest values suffice without any doubt, of the smaller
set of a pair even the first `n - ceil(2 t n / (1 + t)) + 1`. There nodes are compared with a few more of the list, and
then the pairs that are still in different components, if as many values as t asks for can follow the value they meet at,
and if few of 256 parities of the two sets differ. Each pair is first judged by the union's sketch (unshared values over
the limit: not alike), then by both whole sets. So a group of n copies or near copies costs n comparisons a list. Documents
that share a frequent passage meet only if it makes up nearly all of them.

Defined cases: only A-Z are lower-cased; null, empty and blank texts have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; a null doc_id stays a row, is linked, and is a component's id only where all its
ids are null; repeated rows come back as often as they are; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import components, released, sized, staged

K = 64
#: Similarity from which two sets are linked: LEAST[0] / LEAST[1] or more.
LEAST = (85, 100)
#: A list of at most so many nodes is compared pair by pair where its nodes are still apart.
SHORT = 64
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
PARITIES = ("odd0", "odd1", "odd2", "odd3")
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_M = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1


@cache
def most(n: int, least: tuple[int, int] = LEAST) -> int:
    """So many of n values of a union's sketch are unshared at most, but for a chance under 1e-7."""
    p = 1 - least[0] / least[1]
    tail, m = 1.0, 0
    while tail >= 1e-7:
        tail -= math.comb(n, m) * p**m * (1 - p) ** (n - m)
        m += 1
    return m - 1


def _digests(text: bytes) -> np.ndarray:
    """128-bit hashes of the words, as rows of two."""
    parts, i = [], 0
    while i < len(text):
        found = _SPACE.search(text, i + PIECE) if len(text) - i > PIECE else None
        j = found.start() if found else len(text)
        parts.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, text[i:j].lower().split())), "<u8").reshape(-1, 2))
        i = j
    return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


def _shingles(words: np.ndarray, shingle_words: int) -> np.ndarray:
    """Hashes of the shingles in order, a column for each column of words."""
    n, width = max(1, len(words) - shingle_words + 1), min(shingle_words, len(words))
    s = np.full((n, words.shape[1]), width, np.uint64)
    for j in range(width):
        s = (s ^ words[j : j + n]) * _M
        s ^= s >> np.uint64(29)
    return s


def values(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The set of a text as ascending 63-bit hashes."""
    words = _digests(text or b"")
    return np.unique(_shingles(words[:, :1], shingle_words) >> np.uint64(1)).view(np.int64) if len(words) else np.zeros(0, np.int64)


def whole_set(text: bytes | None, shingle_words: int) -> np.ndarray:
    """The set of a text as distinct 128-bit hashes in ascending order."""
    words = _digests(text or b"")
    if not len(words):
        return np.zeros((0, 2), np.uint64)
    s = _shingles(words, shingle_words)
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    return s[np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])]


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether two whole sets have the similarity `least`."""
    if min(len(a), len(b)) * least[1] < max(len(a), len(b)) * least[0] or not len(a):
        return False
    s = np.concatenate([a, b])
    s = s[np.lexsort((s[:, 1], s[:, 0]))]
    both = int((s[1:] == s[:-1]).all(axis=1).sum())
    return both * least[1] >= (len(s) - both) * least[0]


def likely(a: np.ndarray, b: np.ndarray, k: int, least: tuple[int, int] = LEAST) -> bool:
    """Whether two sketches, ascending, leave it possible that their sets are alike."""
    union = np.sort(np.concatenate([a, b]))
    twice = union[1:] == union[:-1]
    distinct = np.concatenate([[True], ~twice])
    shared = np.concatenate([twice, [False]])[distinct]
    if len(a) < k and len(b) < k:
        return int(shared.sum()) * least[1] >= len(shared) * least[0]
    return int((~shared[:k]).sum()) <= most(min(k, len(shared)), least)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, r, t): an id that is never null, a hash of the text, the text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("k"), F.xxhash64(text_col).alias("r"), F.col(text_col).cast("binary").alias("t"))


def sketches(keyed: DataFrame, shingle_words: int, k: int, simhash: bool = False) -> DataFrame:
    """(k, r, n, h1, h2, f, sketch) of each row: its set's size, 128 bits that tell sets apart (null if empty), its sketch.

    f is the SimHash fingerprint if that is asked for, else null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(2):
                text = t.as_py()
                v = values(text, shingle_words)
                h = np.frombuffer(xxhash.xxh3_128_digest(v), np.int64) if len(v) else (None, None)
                f = simhash_dedup.fingerprint(text, shingle_words) if simhash else None
                for column, x in zip(out, (len(v), h[0], h[1], f if f is None or f < 1 << 63 else f - (1 << 64), v[:k]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, out, kinds)], ["k", "r", "n", "h1", "h2", "f", "sketch"])

    return keyed.mapInArrow(run, "k long, r long, n long, h1 long, h2 long, f long, sketch array<long>")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints (f) are equal or linked: each class of equal ones goes by its smallest node."""
    least = staged(nodes.groupBy("f").agg(F.min("node").alias("m")), "bottomk-fingerprints", (nodes,))
    equal = nodes.select("node", "f").hint("merge").join(least, "f").filter("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b"))
    linked = staged(simhash_dedup.links(least.select("f")), "bottomk-simhash", (least,))
    own = lambda c: least.select(F.col("f").alias(c), F.col("m").alias(f"m{c}"))
    other = sized(linked).join(own("a"), "a").hint("merge").join(own("b"), "b")
    return equal.unionByName(other.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")))


def _lists(nodes: DataFrame, wanted: Column, label: str, carried: list[str] = []) -> DataFrame:  # noqa: B006
    """Inverted lists (v, node, n, at, size, m) of nodes (node, n, sketch): of each its `wanted` rarest values.

    `at` is the value's place among the node's, from 1; m is the list's smallest node; `carried` columns of nodes come along.
    """
    posted = nodes.select("node", "n", *carried, F.size("sketch").alias("k"), wanted.alias("wanted"), F.explode("sketch").alias("v"))
    often = staged(posted.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), f"{label}-often", (nodes,))
    per_node = posted.hint("merge").join(often, "v").groupBy("node", "n", *carried, "k", "wanted").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("a"))
    left = F.col("wanted") - (F.col("k") - F.size("a"))  # values that one node alone holds are the rarest
    kept = per_node.filter(left > 0).select("node", "n", *carried, "k", F.size("a").alias("s"), F.posexplode(F.slice("a", F.lit(1), left)).alias("i", "x"))
    chosen = staged(kept.select("x.v", "node", "n", *carried, (F.col("k") - F.col("s") + F.col("i") + 1).alias("at")), f"{label}-chosen", (nodes,))
    sizes = staged(chosen.groupBy("v").agg(F.count("*").alias("size"), F.min("node").alias("m")).filter("size > 1"), f"{label}-sizes", (chosen,))
    lists = staged(chosen.hint("merge").join(sizes, "v"), f"{label}-lists", (chosen,))
    released(often, chosen, sizes)
    return lists


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle_words: int, k: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that are alike: first by the sketches of nodes (node, sketch), then by the whole sets of texts (node, t)."""

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("sa"), batch.column("sb")
            keep = [likely(x.values.to_numpy(), y.values.to_numpy(), k, least) for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.zeros((0, 2), np.uint64))
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c) for c in ("a", "ta", "tb")), strict=True):
                if held[0] != a.as_py():
                    held = (a.as_py(), whole_set(ta.as_py(), shingle_words))
                keep.append(alike(held[1], whole_set(tb.as_py(), shingle_words), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def sided(df: DataFrame, c: str, value: str) -> DataFrame:
        return df.select(F.col("node").alias(c), F.col(value).alias(f"{value[0]}{c}"))

    met = pairs.hint("merge").join(sided(nodes, "b", "sketch"), "b").hint("merge").join(sided(nodes, "a", "sketch"), "a")
    likely_pairs = staged(met.select("a", "b", "sa", "sb").mapInArrow(by_sketch, "a long, b long"), "bottomk-likely", (nodes,))
    both = sized(likely_pairs).join(sided(texts, "b", "t"), "b").hint("merge").join(sided(texts, "a", "t"), "a")
    out = staged(both.select("a", "b", "ta", "tb").mapInArrow(by_text, "a long, b long"), "bottomk-confirmed", (texts,))
    released(likely_pairs)
    return out


def _sizes_fit(x: str, y: str, least: tuple[int, int]) -> Column:
    return F.least(x, y) * least[1] >= F.greatest(x, y) * least[0]


def _stars(lists: DataFrame) -> DataFrame:
    return lists.filter("node <> m").select(F.col("m").alias("a"), F.col("node").alias("b")).distinct()


def _more_stars(lists: DataFrame, centres: int = 4) -> DataFrame:
    """Pairs of each list's nodes with some of them, drawn by hashes: nodes that the smallest one misses may meet at another."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node"))["node"] for i in range(centres)]
    centre = staged(lists.groupBy("v").agg(F.array_distinct(F.array(*drawn)).alias("c")), "bottomk-centres", (lists,))
    met = lists.select("v", "node").hint("merge").join(centre, "v").select("node", F.explode("c").alias("c")).filter("node <> c")
    return met.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _labels(links: DataFrame, hops: int = 4) -> DataFrame:
    """(node, root) of linked nodes: the smallest node within `hops` links. Equal roots show that nodes are in one component."""
    both = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "bottomk-both")
    near = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node")
    for _ in range(hops - 1):
        near = staged(near, "bottomk-labels", (both,))
        reached = both.join(sized(near, near.withColumnRenamed("node", "b")), "b").select(F.col("a").alias("node"), "root")
        near = near.unionByName(reached).groupBy("node").agg(F.min("root").alias("root"))
    return staged(near, "bottomk-labels", (both,))


def _unsettled(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes roots do not show to be in one component."""
    own = lambda c: sized(roots, roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")))
    placed = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return placed.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose nodes are in different components, by roots: (v, node, n, at, size, root, main), main the component of most."""
    placed = lists.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = staged(placed.groupBy("v", "root").agg(F.count("*").alias("c")), "bottomk-roots", (lists,))
    main = sizes.groupBy("v").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root"))["root"].alias("main")).filter("roots > 1")
    return staged(placed.join(sized(staged(main.select("v", "main"), "bottomk-main", (sizes,))), "v"), "bottomk-apart", (lists,))


def _pairs(apart: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of one list and different components, those within its largest component excepted: they change nothing."""
    x = apart.filter("root <> main").select("v", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"))
    y = apart.select("v", F.col("node").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"))
    met = x.hint("merge").join(y, "v").filter("rx <> ry").filter(_sizes_fit("nx", "ny", least))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _following(apart: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Pairs of one list of whole sets and different components that can be alike if they first meet at this value.

    Sets differ in at least as many values as their parities differ in bits.
    """
    num, den = least
    index = F.col("n") - F.ceil(2 * num * F.col("n") / (num + den)) + 1
    sides = {"i": apart.filter(F.col("at") <= index), "p": apart}
    columns = ("node", "root", "n", "at", *PARITIES)
    own = {c: d.select("v", *[F.col(f).alias(f"{f}_{c}") for f in columns]) for c, d in sides.items()}
    few = {c: d.filter("root <> main").select("v", *[F.col(f).alias(f"{f}_{c}") for f in columns]) for c, d in sides.items()}
    smaller = (F.col("n_i") < F.col("n_p")) | ((F.col("n_i") == F.col("n_p")) & (F.col("node_i") < F.col("node_p")))
    room = F.least(F.col("n_i") - F.col("at_i"), F.col("n_p") - F.col("at_p")) + 1
    odd = reduce(Column.__add__, [F.bit_count(F.col(f"{x}_i").bitwiseXOR(F.col(f"{x}_p"))) for x in PARITIES])
    both_sizes = F.col("n_i") + F.col("n_p")
    fits = smaller & _sizes_fit("n_i", "n_p", least) & (room * (num + den) >= num * both_sizes) & (odd * (num + den) <= (den - num) * both_sizes)
    both = few["i"].hint("merge").join(own["p"], "v").unionByName(few["p"].hint("merge").join(own["i"], "v"))
    met = both.filter("root_i <> root_p").filter(fits)
    return met.select(F.least("node_i", "node_p").alias("a"), F.greatest("node_i", "node_p").alias("b")).distinct()


def _whole_sketches(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, n, sketch, parities) of texts (node, t), the sketch the whole set.

    The parities are 256 bits: whether an odd number of values ends in each of 256 ways.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one text's set at a time
                v = values(b.column(1)[i].as_py(), shingle_words)
                odd = np.packbits(np.bincount(v & 255, minlength=256) & 1).view(np.int64)
                arrays = [b.column(0).slice(i, 1), pa.array([len(v)], pa.int64()), pa.array([v], pa.list_(pa.int64())), *(pa.array([x], pa.int64()) for x in odd)]
                yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "sketch", *PARITIES])

    return texts.select("node", "t").mapInArrow(run, "node long, n long, sketch array<long>, " + ", ".join(f"{x} long" for x in PARITIES))


def _linked(
    found: DataFrame, keyed: DataFrame, shingle_words: int, k: int, least: tuple[int, int], simhash: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, k, r, h1, h2), one for each set of found, and (node, root) of those that are linked."""
    values_of = [F.first(c).alias(c) for c in ("n", "f", "sketch")]
    sets = found.filter("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("k", "r")).alias("first"), *values_of)
    nodes = staged(sets.select(F.monotonically_increasing_id().alias("node"), "first.k", "first.r", "h1", "h2", "n", "f", "sketch"), "bottomk-nodes", (found,))
    exact = (F.col("n") - F.ceil(F.col("n") * least[0] / least[1]) + 1).cast("int")
    # Partners of a set of so few values have whole sketches as well.
    wanted = F.when(F.col("n") * least[1] <= k * least[0], exact).otherwise(most(k, least) + 1)
    lists = _lists(nodes, wanted, "bottomk")

    pairs, wanted_nodes = _stars(lists), lists.select("node")
    if simhash:
        near = staged(_by_simhash(nodes), "bottomk-near", (nodes,))
        wanted_nodes = wanted_nodes.unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    placed = staged(wanted_nodes.distinct().hint("merge").join(nodes.select("node", "k", "r"), "node"), "bottomk-keys", (nodes,))
    texts = keyed.hint("merge").join(placed, ["k", "r"]).groupBy("node").agg(F.first("t").alias("t"))  # rows that agree on both are alike
    texts = staged(texts, "bottomk-texts")
    if simhash:  # what fingerprints have linked is settled: sketches are compared where that leaves nodes apart
        links = _confirmed(near, nodes, texts, shingle_words, k, least)
        links = links.unionByName(_confirmed(_unsettled(pairs, _labels(links)), nodes, texts, shingle_words, k, least))
    else:
        links = _confirmed(pairs, nodes, texts, shingle_words, k, least)
    apart = _apart(lists, _labels(links))
    more = _pairs(apart.filter(F.col("size") <= SHORT), least)
    crowded = staged(apart.filter(F.col("size") > SHORT).select("node").distinct(), "bottomk-crowded", (apart,))
    if crowded.isEmpty():
        links = links.unionByName(_confirmed(more, nodes, texts, shingle_words, k, least))
    else:
        whole = staged(_whole_sketches(texts.join(sized(crowded), "node", "left_semi"), shingle_words), "bottomk-whole", (texts,))
        finer = _lists(whole, exact, "bottomk-finer", [*PARITIES])
        links = links.unionByName(_confirmed(more.unionByName(_stars(finer)).unionByName(_more_stars(finer)).distinct(), nodes, texts, shingle_words, k, least))
        rest = _following(_apart(finer, _labels(links)), least)
        links = links.unionByName(_confirmed(rest, nodes, texts, shingle_words, k, least))
    return nodes, components(links, "bottomk-components")


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, least: tuple[int, int] = LEAST, k: int = K, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    keyed = _keyed(docs, id_col, text_col)
    found = staged(sketches(keyed, shingle_words, k), "bottomk-sketches")
    nodes, roots = _linked(found, keyed, shingle_words, k, least)
    placed = nodes.select("node", "k", "h1", "h2").hint("merge").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("k").alias("lowest"))
    classes = staged(placed.hint("merge").join(lowest, "root").select("h1", "h2", "lowest"), "bottomk-classes")
    ids = found.select("k", "n", "h1", "h2").hint("merge").join(classes, ["h1", "h2"], "left")
    given = lambda c: F.when(c != _NO_ID, c)
    doc_id, component = given(F.col("k")), given(F.coalesce("lowest", "k"))
    return ids.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), doc_id.eqNullSafe(component).alias("kept"))


def representatives(
    docs: DataFrame, shingle_words: int = 5, least: tuple[int, int] = (4, 5), k: int = K, simhash: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of docs from each group: that of the smallest id (null ids last), of equal ids that of the lower text hash.

    Rows without words are one group here. With `simhash` pairs come from SimHash fingerprints too.
    """
    keyed = _keyed(docs, id_col, text_col)
    found = staged(sketches(keyed, shingle_words, k, simhash), "bottomk-sketches")
    nodes, roots = _linked(found, keyed, shingle_words, k, least, simhash)
    placed = nodes.hint("merge").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("k", "r")).alias("first"))
    blank = found.filter("n = 0").groupBy("n").agg(F.min(F.struct("k", "r")).alias("first"))
    winners = staged(placed.select("first.*").unionByName(blank.select("first.*")), "bottomk-winners", (found,))
    own = {"__k": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__r": F.xxhash64(text_col)}
    first = docs.withColumns(own).join(sized(winners, winners.toDF("__k", "__r")), ["__k", "__r"], "left_semi")
    one = F.row_number().over(Window.partitionBy("__k", "__r").orderBy(F.lit(0)))
    return first.withColumn("__i", one).filter("__i = 1").select(*docs.columns)


#: The near-duplicates of op11 by all pairs that share a shingle, for another engine.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT id, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), keyed AS MATERIALIZED (
  SELECT id, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM sets
), nodes AS MATERIALIZED (
  SELECT k, min(doc_id) AS least, any_value(n) AS n, any_value(s) AS s FROM keyed WHERE n > 0 GROUP BY k
), posted AS MATERIALIZED (SELECT k, n, unnest(s) AS v FROM nodes
), links AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM posted a JOIN posted b ON a.v = b.v AND a.k <> b.k AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (SELECT k AS a, k AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), lowest AS (SELECT r.a, min(n.least) AS c FROM reached r JOIN nodes n ON r.b = n.k GROUP BY r.a
)
SELECT d.doc_id, d.n AS n_shingles, CASE WHEN d.n = 0 THEN d.doc_id ELSE l.c END AS component_id, d.doc_id IS NOT DISTINCT FROM CASE WHEN d.n = 0 THEN d.doc_id ELSE l.c END AS kept
FROM keyed d LEFT JOIN lowest l ON d.n > 0 AND l.a = d.k"""
