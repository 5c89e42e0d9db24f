"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes, a digit of several bytes a round, until a group is a single document
or its texts have ended. Groups are compared by their bytes alone: no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, ascii_lower_bytes, fresh_names, release, written

#: Bytes in the first digit; each later digit is WIDEN times as wide, so rounds grow with the log of the longest text.
FIRST_DIGIT = 64
WIDEN = 8
LAST_DIGIT = 1 << 24


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, widen: int = WIDEN) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of a group the row with the largest id stays; null ids
    rank lowest, and of repeated rows with one id exactly one is marked kept. Null text counts as empty; an empty
    table gives an empty result; other columns are ignored, whatever their names.

    Each round counts the groups with a map-side combine and joins the counts back, so a group of a third of
    all rows arrives as one count row per task, and the join's hot side is split by adaptive execution. Only
    members of groups that are still open carry their remaining bytes into the next round. Rows are numbered when
    the first round is written, and groups where their counts are, so nothing rests on reading ``docs`` twice in the
    same order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    work = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.sha2(ascii_lower(text), 256).alias("text_sha256"),
        F.lit(-1).cast("long").alias("grp"),
        text.cast("binary").alias("rest"),
    )
    done: list[DataFrame] = []
    width, level, before = first_digit, 0, None
    while True:
        digit = ascii_lower_bytes(F.substring("rest", 1, width))
        work = work.withColumn("digit", digit)
        numbered = level > 0
        top = F.max(F.struct("doc_id", "rid")) if numbered else F.max(F.struct("doc_id"))
        shared = work.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).where("n > 1")
        shared = written(shared.withColumn("next", F.monotonically_increasing_id()), f"radix-groups-{level}")
        ended = (F.octet_length("rest") < width) & F.lit(numbered)  # the first round closes no group: rows have no number yet
        open_ = F.col("n").isNotNull() & ~ended
        out = work.join(shared.hint("merge"), ["grp", "digit"], "left").select(
            "doc_id", (F.col("rid") if numbered else F.monotonically_increasing_id()).alias("rid"), "text_sha256", F.col("next").alias("grp"),
            F.coalesce("n", F.lit(1)).alias("n"), F.col("top.doc_id").alias("top_id"),
            (F.col("top.rid") if numbered else F.lit(None).cast("long")).alias("top_rid"),
            F.when(open_, F.coalesce(F.substring("rest", width + 1, 2147483647), F.lit("").cast("binary"))).alias("rest"), open_.alias("open"),
        )
        level_out = written(out, f"radix-level-{level}", partition_by="open")
        release(shared)
        if before is not None:
            release(before, part="open=true")
        before = level_out
        closed = level_out.where("not open").select(
            "doc_id",
            F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("top_id")).alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("grp").isNull() | (F.col("top_rid") == F.col("rid"))).alias("kept"),
            "text_sha256",
            "rid",
        )
        done.append(closed)
        work = level_out.where("open").select("doc_id", "rid", "text_sha256", "grp", "rest")
        if work.isEmpty():
            break
        width, level = min(width * widen, LAST_DIGIT), level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of each group of equal texts one.
    A row is told by its id and its text's digest, so rows that share an id, or have none, are judged each for itself;
    rows that repeat both leave one row. Null text counts as empty; an empty table gives no rows."""
    gone_id, gone_sha, sha, norm = fresh_names(docs, "gone_id", "gone_sha", "sha", "norm")
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = written(exact_groups(docs, id_col, text_col).select("doc_id", "text_sha256", "kept"), "exact-kept")
    rows = groups.groupBy(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)).agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("n"))
    rows = written(rows.where("n > 1 or not any_kept"), "exact-gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id)) & (F.col(sha) == F.col(gone_sha))
    left = docs.withColumn(sha, F.sha2(ascii_lower(text), 256)).join(rows.where("not any_kept").select(gone_id, gone_sha), same, "left_anti")
    if rows.where("any_kept").isEmpty():
        return left.drop(sha)
    return left.withColumn(norm, ascii_lower(text)).dropDuplicates([id_col, norm]).drop(norm, sha)
