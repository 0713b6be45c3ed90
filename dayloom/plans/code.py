"""Queries over pull requests, commits and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.times import in_order, period, within_days

#: The columns that listings return.
PULL_COLUMNS = [
    "pr_event_id", "pr_key", "owner", "repo", "repo_full_name", "pr_number", "action", "state", "is_merged", "title", "labels", "created_at_utc", "updated_at_utc",
    "merged_at_utc", "comments_count", "review_comments_count", "reviews_count", "additions", "deletions", "changed_files_count",
]
COMMIT_COLUMNS = ["commit_event_id", "owner", "repo", "repo_full_name", "sha", "message", "committed_at_utc", "changed_files_count", "additions", "deletions"]
REPOSITORY_COLUMNS = [
    "repo_id", "owner", "repo", "repo_full_name", "description", "is_private", "is_fork", "archived", "primary_language", "topics", "stargazers_count", "forks_count",
    "open_issues_count", "size_kb", "created_at_utc", "updated_at_utc", "pushed_at_utc", "repo_summary_text", "summary_source",
]


def _listed(rows: DataFrame, columns: list[str], newest: str, key: str, limit: int | None, **equal: str | None) -> DataFrame:
    for column, value in equal.items():
        if value:
            rows = rows.where(F.col(column) == value)
    rows = rows.select(*columns).orderBy(F.desc(newest), F.asc_nulls_last(key))
    return rows.limit(limit) if limit else rows


def pull_requests(pulls: DataFrame, start: str, end: str, owner: str | None = None, repo: str | None = None, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Pull request events, the latest first."""
    return _listed(pulls.where(within_days(F.col("updated_at_utc"), start, end)), PULL_COLUMNS, "updated_at_utc", "pr_event_id", limit, owner=owner, repo=repo, state=state)


def commits(rows: DataFrame, start: str, end: str, owner: str | None = None, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Commits, the latest first."""
    return _listed(rows.where(within_days(F.col("committed_at_utc"), start, end)), COMMIT_COLUMNS, "committed_at_utc", "commit_event_id", limit, owner=owner, repo=repo)


def repositories(rows: DataFrame, owner: str | None = None, repo: str | None = None, limit: int | None = None) -> DataFrame:
    """Repositories, the latest updated first."""
    return _listed(rows, REPOSITORY_COLUMNS, "updated_at_utc", "repo_id", limit, owner=owner, repo=repo)


def _pull_level(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """One row for each key and pull request: whether it was opened and merged, and its size when merged."""
    is_ = lambda action: F.col("action") == action
    flag = lambda action: F.max(F.when(is_(action), 1).otherwise(0))
    size = lambda c: F.coalesce(F.max(F.when(is_("merged"), F.col(c))), F.lit(0))
    return rows.groupBy(*keys, "pr_key").agg(flag("opened").alias("opened"), flag("merged").alias("merged"), size("additions").alias("additions"), size("deletions").alias("deletions"))


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def activity_stats(pulls: DataFrame, commits: DataFrame, start: str, end: str, granularity: str) -> DataFrame:
    """Pull requests created and merged, commits and changed lines of each period. A pull request counts in every period it has events in."""
    p = _pull_level(pulls.where(within_days(F.col("updated_at_utc"), start, end)), [period(F.col("updated_at_utc"), granularity).alias("period")])
    c = commits.where(within_days(F.col("committed_at_utc"), start, end))
    # one relation of both, so that a single aggregate takes the place of a full join; no period is null
    zero = F.lit(0)
    p = p.select("period", "opened", "merged", zero.alias("commits"), F.col("additions").cast("long"), F.col("deletions").cast("long"))
    c = c.select(period(F.col("committed_at_utc"), granularity).alias("period"), zero.alias("opened"), zero.alias("merged"), F.lit(1).alias("commits"), F.col("additions").cast("long"), F.col("deletions").cast("long"))
    found = p.unionByName(c).groupBy("period").agg(
        *[F.sum(x).alias(n) for x, n in (("opened", "prs_created"), ("merged", "prs_merged"), ("commits", "commits_count"))],
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("additions", "deletions")],
    )
    return in_order(found)


def repo_summary(pulls: DataFrame, commits: DataFrame, start: str, end: str, owner: str | None = None, repo: str | None = None) -> DataFrame:
    """Totals of each repository. The sides meet on owner and repo alone, so one with two full names gives a row for each pair."""
    keys = ["owner", "repo", "repo_full_name"]
    p = _pull_level(pulls.where(within_days(F.col("updated_at_utc"), start, end)), [F.col(k).alias(f"p_{k}") for k in keys])
    p = p.groupBy(*[f"p_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("prs_total"), F.sum("merged").alias("prs_merged"), F.sum("additions").alias("p_add"), F.sum("deletions").alias("p_del"))
    c = commits.where(within_days(F.col("committed_at_utc"), start, end)).groupBy(*[F.col(k).alias(f"c_{k}") for k in keys])
    c = c.agg(F.count(F.lit(1)).alias("commits_total"), F.sum("additions").alias("c_add"), F.sum("deletions").alias("c_del"), F.max("committed_at_utc").alias("last_commit_at"))
    found = p.join(c, (F.col("p_owner") == F.col("c_owner")) & (F.col("p_repo") == F.col("c_repo")), "full_outer").select(
        *[F.coalesce(f"p_{k}", f"c_{k}").alias(k) for k in keys], *[_or_zero(x).alias(x) for x in ("prs_total", "prs_merged", "commits_total")],
        (_or_zero("p_add") + _or_zero("c_add")).alias("total_additions"), (_or_zero("p_del") + _or_zero("c_del")).alias("total_deletions"),
        F.lit(None).cast("timestamp_ntz").alias("last_pr_updated_at"), "last_commit_at",
    )
    for column, value in (("owner", owner), ("repo", repo)):
        if value:
            found = found.where(F.col(column) == value)
    return found.orderBy((F.col("total_additions") + F.col("total_deletions")).desc(), *[F.asc_nulls_last(k) for k in keys])
