"""Issue / PR / comment dumps -> samples.

Items and comments are two tables keyed by ``item_id`` / ``parent_key``.
The first five comments per parent (L5) are cut with ``row_number() <= 5``
*before* the join, so a parent with a huge comment thread contributes at most
five rows per map task to the shuffle; the join (J2) is then an equi-join of
bounded rows per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplesmith.operators import convert as C
from samplesmith.operators.limits import head_n, head_per_group

COMMENTS_PER_ITEM = 5  # fixed value: first five comments per issue or PR


def is_issue(items: DataFrame):
    """an issue is an item without the ``pull_request`` marker."""
    return F.col("pull_request").isNull()


def first_comments(comments: DataFrame, n: int = COMMENTS_PER_ITEM) -> DataFrame:
    """The first ``n`` comments of every parent, in arrival order ``ord``."""
    return head_per_group(comments, ["parent_key"], ["ord"], n).drop("rank_in_group")


def thread_samples(items: DataFrame, comments: DataFrame, max_items: int | None = None) -> DataFrame:
    """W4 ``ingest_github_discussions`` over dumps.

    Issues: the first ``max_items`` items (the cap precedes the PR filter, L6),
    minus PRs (F11) -> P22.  PRs: the first ``max_items // 2`` PRs -> P23.
    Each kept item is followed by its first five comments -> P24 (J2, L5).
    ``max_items`` falsy means no cap.  Output order key:
    ``(kind, item_id, ord)`` with kind 0 = issue, 1 = PR; ``ord`` -1 for the item.
    """
    base = items.select("item_id", "title", "body", "pull_request")
    issues = head_n(base, max_items, ["item_id"]).where(is_issue(base))
    prs = head_n(base.where(~is_issue(base)), (max_items // 2) if max_items else None, ["item_id"])
    kept = (issues.withColumn("kind", F.lit(0)).unionByName(prs.withColumn("kind", F.lit(1))))
    item_rows = kept.select("kind", "item_id", F.lit(-1).cast("bigint").alias("ord"), "title", "body", "pull_request")
    item_samples = C.issue_samples(item_rows.where(F.col("kind") == 0)).unionByName(
        C.pr_samples(item_rows.where(F.col("kind") == 1)))
    c = first_comments(comments).withColumnRenamed("parent_key", "item_id")
    joined = c.join(kept.select("item_id", "kind"), "item_id")
    comment_rows = C.comment_samples(joined.select("kind", "item_id", F.col("ord").cast("bigint").alias("ord"), "body"))
    return item_samples.unionByName(comment_rows)
