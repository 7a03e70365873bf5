"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

The tree is domain, language, source; a leaf is a language and source within a domain. The token budget goes down from
the root in proportion to the weights of siblings. A leaf can give at most its tokens times `max_epochs`. What a node
cannot use goes to its siblings in proportion to their weights, filled up one after the other, and only what all of them
cannot use goes back to their parent's siblings. Leaf budgets come from a table with a row per leaf.

A leaf is read in epochs, each in its own seeded order; it gives the shortest prefix of that sequence which reaches its
budget. Whole epochs come first. In the last, order keys fall into hash ranges, 4096 to a level: sums by range show which
ranges are in whole and which one holds the end; that one is divided in the same way until it has few keys, and only
those are added up one by one. Rows equal in id and text are one key with a count, so the end can fall between them.

Defined cases: null and blank texts have no tokens and are never taken; a null language or source is a leaf of its own;
siblings without a weight, and a null one, weigh what `weights` gives None at their level, 0 where it names others only,
and all weigh 1 where it names none; repeated rows are rows of
their own; other columns are kept, but those called domain, n_tokens or epoch are replaced. Of rows equal in id and text whose
other columns differ, which ones a prefix takes is left open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

RANGES_HEX = 3  # 16 ** 3 ranges to a level
EDGE_ROWS = 4096  # keys that one task may add up
BROADCAST = 10_000  # leaves; a line of the plan has under 1 KB
LEVELS = ["domain", "lang", "source"]
#: Production weights; sources of a language weigh the same. Every language not listed, and a null one, weighs that of None.
WEIGHTS = {
    "domain": {"web": 0.5, "books": 0.3, "code": 0.2},
    "lang": {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1, None: 0.05},
}
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text_col: str) -> Column:
    """Words of a text; stands for its tokens."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: Column, weights: dict[str | None, float] | None) -> Column:
    out = F.lit(float(weights.get(None, 0.0)) if weights else 1.0)
    for name, w in (weights or {}).items():
        if name is None:
            continue
        out = F.when(level == name, F.lit(float(w))).otherwise(out)
    return out


def _shared(rows: DataFrame, over: list[str], total: str, weight: str, most: str, name: str) -> DataFrame:
    """`name`: the share of `total` of each sibling (rows that agree on `over`), by weight, none over `most`.

    Siblings are filled in order of most / weight: each gets its share of what is left, or all it can use.
    """
    rest = Window.partitionBy(*over).orderBy("__fill", "__key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = Window.partitionBy(*over).orderBy("__fill", "__key").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*over)
    fill = F.when(F.col(weight) > 0, F.col(most) / F.col(weight)).otherwise(F.lit(float("inf")))
    d = rows.withColumn("__fill", fill).withColumn("__key", F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in LEVELS if c in rows.columns]))
    d = d.withColumn("__w", F.sum(weight).over(rest)).withColumn("__used", F.coalesce(F.sum(most).over(done), F.lit(0.0)))
    # a sibling is full if its share of what those before it left is at least what it can use
    level = (F.col(total) - F.col("__used")) / F.when(F.col("__w") > 0, F.col("__w"))
    d = d.withColumn("__full", F.coalesce(level >= F.col("__fill"), F.lit(False)))
    # the first that is not full sets the level for itself and all after it
    d = d.withColumn("__level", F.min(F.when(~F.col("__full"), F.struct("__fill", "__key", level.alias("v")))).over(later)["v"])
    given = F.when(F.col("__full"), F.col(most)).otherwise(F.coalesce(F.col("__level") * F.col(weight), F.lit(0.0)))
    return d.withColumn(name, given).drop("__fill", "__key", "__w", "__used", "__full", "__level")


def budgets(leaves: DataFrame, budget: float, weights: dict[str, dict[str | None, float]], max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, n) with `budget`: tokens that each leaf is to give."""
    d = leaves.withColumn("m3", (F.col("n") * max_epochs).cast("double"))
    for level in LEVELS:
        d = d.withColumn(f"w_{level}", weight_of(F.col(level), weights.get(level)))
    d = d.withColumn("m3", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("m3")).otherwise(0.0))
    langs = d.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("m3").alias("m2"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum("m2").alias("m1")).withColumns({"one": F.lit(1), "b0": F.lit(float(budget))})
    domains = _shared(domains, ["one"], "b0", "w_domain", "m1", "b1").select("domain", "b1")
    langs = _shared(langs.join(domains.hint("merge"), "domain"), ["domain"], "b1", "w_lang", "m2", "b2")
    langs = langs.select("domain", F.col("lang").alias("l2"), "b2")
    both = d.withColumnRenamed("domain", "d3").join(langs.hint("merge"), (F.col("d3") == F.col("domain")) & F.col("lang").eqNullSafe(F.col("l2")))
    out = _shared(both.drop("d3", "l2"), ["domain", "lang"], "b2", "w_source", "m3", "budget")
    return out.select(*LEVELS, "n", "budget")


def binding_budget(leaves: DataFrame, weights: dict[str, dict[str | None, float]], max_epochs: int) -> float:
    """The largest budget of which every domain that has tokens can give its share by weight, and not over the tokens there are."""
    d = leaves
    for level in LEVELS:
        d = d.withColumn(f"w_{level}", weight_of(F.col(level), weights.get(level)))
    usable = d.withColumn("m", F.when((F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("n") * max_epochs).otherwise(0))
    domains = usable.groupBy("domain", "w_domain").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).filter("m > 0 and w_domain > 0")
    least, all_weights, all_tokens = domains.agg(F.min(F.col("m") / F.col("w_domain")), F.sum("w_domain"), F.sum("n")).first()
    return min(least * all_weights, float(all_tokens)) if least else 0.0


def _with_plan(rows: DataFrame, plan: DataFrame, n_leaves: int, how: str = "inner") -> DataFrame:
    """rows joined with their leaf's line of plan (__p_domain, __p_lang, __p_source); broadcast only up to BROADCAST leaves."""
    same = [F.col("__domain") == F.col("__p_domain"), F.col("lang").eqNullSafe(F.col("__p_lang")), F.col("source").eqNullSafe(F.col("__p_source"))]
    return rows.join(plan.hint("broadcast" if n_leaves <= BROADCAST else "merge"), same[0] & same[1] & same[2], how)


def mixed(
    docs: DataFrame,
    share: float | None = 0.5,
    weights: dict[str, dict[str | None, float]] | None = None,
    max_epochs: int = 2,
    seed: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_tokens: Column | None = None,
    domain: Column | None = None,
) -> DataFrame:
    """The rows of docs that are taken, once for each epoch that takes them, with domain, n_tokens and epoch (from 0).

    The budget is `share` of all tokens, or where that is None as many as let every domain give its share by weight. Tokens
    are counted by `n_tokens` if given (a count that op6 or op8 has made), else by words; `domain` names each row's domain,
    by default one for all.
    """
    added = {"__n": tokens(text_col) if n_tokens is None else F.coalesce(n_tokens.cast("long"), F.lit(0)), "__domain": F.lit("all") if domain is None else domain}
    rows = docs.withColumns({**added, "__h": F.hex(F.xxhash64(text_col)), "__i": F.coalesce(F.col(id_col).cast("string"), F.lit("-"))}).filter("__n > 0")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__whole").cast("string"), "__i", "__h"))
    keyed = staged(rows.select("__i", "__h", "__domain", "lang", "source", "__n"), "mixing-keys")
    leaves = staged(keyed.groupBy(F.col("__domain").alias("domain"), "lang", "source").agg(F.sum("__n").alias("n")), "mixing-leaves")
    total, n_leaves = leaves.agg(F.sum("n"), F.count("*")).first()
    budget = share * (total or 0) if share is not None else binding_budget(leaves, weights or {}, max_epochs)
    plan = budgets(leaves, budget, weights or {}, max_epochs).filter("budget > 0")
    plan = plan.withColumn("__whole", F.least(F.floor(F.col("budget") / F.col("n")), F.lit(max_epochs)))
    plan = staged(plan.select(
        F.col("domain").alias("__p_domain"), F.col("lang").alias("__p_lang"), F.col("source").alias("__p_source"),
        "__whole", (F.col("budget") - F.col("__whole") * F.col("n")).alias("__rest"),
    ), "mixing-plan")
    leaf = ["__p_domain", "__p_lang", "__p_source"]

    # the hash range in which the last epoch's prefix ends, level by level, then its last key
    counted = keyed.groupBy("__i", "__h", "__domain", "lang", "source", "__n").agg(F.count("*").alias("__c"))
    turns = staged(_with_plan(counted, plan, n_leaves).withColumn("__o", order).select(*leaf, "__rest", "__n", "__c", "__o"), "mixing-turns")
    ends = turns.select(*leaf, "__rest").distinct().withColumns({"__end": F.lit(""), "__used": F.lit(0).cast("long")})
    edge, level = turns.withColumns({"__used": F.lit(0).cast("long")}), 0
    while True:
        level += 1
        place = F.substring("__o", 1, RANGES_HEX * level)
        ranges = edge.groupBy(*leaf, "__rest", "__used", place.alias("__r")).agg(F.sum(F.col("__n") * F.col("__c")).alias("s"), F.count("*").alias("k"))
        before = Window.partitionBy(*leaf).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
        ends = ranges.withColumn("__used", F.col("__used") + F.coalesce(F.sum("s").over(before), F.lit(0))).filter("__used < __rest and __used + s >= __rest")
        ends = staged(ends.select(*[F.col(c).alias(f"e{i}") for i, c in enumerate(leaf)], F.col("__r").alias("__end"), "__used", "k"), "mixing-ends")
        same = [F.col(c).eqNullSafe(F.col(f"e{i}")) for i, c in enumerate(leaf)]
        inside = edge.drop("__used").join(ends.hint("broadcast" if n_leaves <= BROADCAST else "merge"), same[0] & same[1] & same[2])
        edge = staged(inside.filter(place == F.col("__end")).select(*leaf, "__rest", "__n", "__c", "__o", "__used"), "mixing-edge")
        if level == 10 or (ends.agg(F.max("k")).first()[0] or 0) <= EDGE_ROWS:
            break
    so_far = Window.partitionBy(*leaf).orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
    last = edge.withColumn("__left", F.col("__rest") - F.col("__used") - F.coalesce(F.sum(F.col("__n") * F.col("__c")).over(so_far), F.lit(0)))
    last = last.filter("__left > 0").withColumn("__take", F.least("__c", F.ceil(F.col("__left") / F.col("__n"))))
    cut = last.groupBy(*leaf).agg(F.max(F.struct("__o", "__take", "__c")).alias("m")).select(
        *leaf, F.col("m.__o").alias("__last"), F.when(F.col("m.__take") < F.col("m.__c"), F.col("m.__take")).alias("__take")
    )
    cut = cut.withColumnsRenamed({"__p_domain": "__domain", "__p_lang": "lang", "__p_source": "source"})
    plan = staged(_with_plan(cut, plan, n_leaves, "right").select(*leaf, "__whole", "__last", "__take"), "mixing-last")

    taken = _with_plan(rows, plan, n_leaves).withColumn("__o", order)
    fits = F.col("__o") <= F.col("__last")
    if not plan.filter("__take is not null").isEmpty():
        # of the equal rows at the end only some fit; which, is settled by counts of each input partition
        tie = (F.col("__o") == F.col("__last")) & F.col("__take").isNotNull()
        ties = staged(taken.filter(tie).withColumn("__b", F.spark_partition_id()), "mixing-ties")
        offset = Window.partitionBy("__o").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        counts = ties.groupBy("__o", "__b").agg(F.count("*").alias("__seen")).withColumn("__seen", F.coalesce(F.sum("__seen").over(offset), F.lit(0)))
        number = F.row_number().over(Window.partitionBy("__o", "__b").orderBy(F.lit(0)))
        numbered = ties.withColumn("__k", number).join(counts.hint("merge"), ["__o", "__b"])
        numbered = numbered.withColumn("__fits", F.col("__k") + F.col("__seen") <= F.col("__take")).select(*taken.columns, "__fits")
        taken = taken.filter(~F.coalesce(tie, F.lit(False))).withColumn("__fits", fits).unionByName(numbered)
        fits = F.col("__fits")
    times = F.col("__whole") + F.coalesce(fits.cast("int"), F.lit(0))
    out = taken.withColumn("__times", times.cast("int")).filter("__times > 0").withColumn("__e", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    own = [F.col(c) for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    return out.select(*own, F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"), F.col("__e").cast("int").alias("epoch"))
