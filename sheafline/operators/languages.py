"""Items of papers that print two languages side by side: each language's column is itemised on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..relations import frame
from ..staging import staged


def segments_by_language(page_lines: DataFrame, figures: DataFrame, settings: dict[str, str | int | float] | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of d_segments with their language: 0 or 1 in papers that d_bilingual_split calls bilingual, else null.

    Sides, recovered markers and furniture are found on whole pages, as a header may stand in one column only; then the
    lines, markers and figures of a bilingual paper's first two columns become papers of their own and go through the same
    chain (further columns are left out). The language is the low bit of their ids, so doc_id must be below 2**62. Items
    are numbered within a paper and language. Papers of one language have the rows of d_segments. Papers without lines
    have none.
    """
    spark = page_lines.sparkSession
    made = {"page_lines": page_lines, "figures": figures, **tables}
    look = lambda name: frame(spark, "", name, made, settings)
    paired = staged(look("d_bilingual_split").groupBy("doc_id").agg(F.bool_or("bilingual").alias("paired")), "language-papers")
    columns = {"seq": look("c_column_of"), "fig_id": look("figure_column_of")}

    def parted(df: DataFrame, key: str) -> DataFrame:
        """The rows of the first two columns of bilingual papers under their languages' ids, and all of others."""
        keys = ["doc_id", "page", key]
        own = columns[key].select(*keys, F.col("col").alias("own_column"))
        found = df.join(own.hint("merge"), keys, "left").join(paired.hint("merge"), "doc_id", "left")
        language = F.when(F.col("paired"), F.coalesce("own_column", F.lit(0))).otherwise(F.lit(0))
        return found.filter(language < 2).withColumn("doc_id", F.col("doc_id") * 2 + language).select(*df.columns)

    furniture = look("d_find_furniture")
    both = furniture.withColumn("language", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("doc_id", F.col("doc_id") * 2 + F.col("language")).select(*furniture.columns)
    own = {
        "figures": parted(figures, "fig_id"), "d_find_furniture": staged(both, "language-furniture"),
        **{name: staged(parted(look(name), "seq"), f"language-{name}") for name in ("page_lines", "e_section_state", "sided_markers", "c_recover_markers")},
    }
    found = frame(spark, "", "d_segments", own, settings)
    low = F.pmod("doc_id", F.lit(2)).cast("int")
    seg = found.withColumn("language", low).withColumn("doc_id", F.shiftright("doc_id", 1)).join(paired.hint("merge"), "doc_id", "left")
    return seg.withColumn("language", F.when(F.col("paired"), F.col("language"))).drop("paired")
