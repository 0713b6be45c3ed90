"""Pull requests, commits and repositories from a code host's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayloom.functions.ids import sha_key
from dayloom.functions.values import fields_of

#: The fields that are read from the code host's answers.
REPO = (
    "struct<id:bigint,name:string,full_name:string,owner:struct<login:string>,description:string,homepage:string,private:boolean,fork:boolean,archived:boolean,default_branch:string,"
    "language:string,topics:array<string>,stargazers_count:bigint,forks_count:bigint,open_issues_count:bigint,size:bigint,created_at:string,updated_at:string,pushed_at:string>"
)
PULL_ITEM = (
    f"id bigint, number bigint, title string, state string, created_at string, updated_at string, closed_at string, merged_at string, labels array<struct<name:string>>, base struct<ref:string>, "
    f"head struct<ref:string,repo:{REPO}>, comments bigint, review_comments bigint, reviews_count bigint, commits bigint, additions bigint, deletions bigint, changed_files bigint"
)
COMMIT_ITEM = "repo_full_name string, sha string, commit struct<message:string,author:struct<date:string>>, stats struct<additions:bigint,deletions:bigint>, files array<struct<filename:string>>"


def pull_action(state: Column, created: Column, updated: Column, closed: Column, merged: Column) -> Column:
    """What an event of a pull request stands for, the most telling first; no state counts as open."""
    now = F.coalesce(state, F.lit("open"))
    given = lambda c: c.isNotNull() & (c != "")
    return (
        F.when(given(merged), "merged")
        .when(now == "closed", "closed")
        .when((now == "open") & given(closed), "reopened")
        .when(given(created) & given(updated) & (created != updated), "updated")
        .otherwise("opened")
    )


def pull_requests(items: DataFrame, login: str, ingested_at: Column) -> DataFrame:
    """Rows of pull requests (``PULL_ITEM``) in repositories that ``login`` owns.

    The repository is that of the head; where a fork's is gone the row goes, as do those of other owners.
    """
    repo, c = F.col("head.repo"), F.col
    state, name = F.coalesce(c("state"), F.lit("open")), F.coalesce(repo["full_name"], F.lit(""))
    return items.where(repo["owner"]["login"] == login).select(
        sha_key(name, c("number"), c("updated_at"), state).alias("pr_event_id"), sha_key(name, c("number")).alias("pr_key"), F.lit("github").alias("source"),
        repo["owner"]["login"].alias("owner"), F.coalesce(repo["name"], F.lit("")).alias("repo"), name.alias("repo_full_name"), c("number").alias("pr_number"), c("id").alias("pr_id"),
        pull_action(c("state"), c("created_at"), c("updated_at"), c("closed_at"), c("merged_at")).alias("action"), state.alias("state"), c("merged_at").isNotNull().alias("is_merged"),
        "title", fields_of(c("labels"), "name", drop_empty=True).alias("labels"), c("base.ref").alias("base_ref"), c("head.ref").alias("head_ref"),
        *[c(f"{x}_at").alias(f"{x}_at_utc") for x in ("created", "updated", "closed", "merged")],
        c("comments").alias("comments_count"), c("review_comments").alias("review_comments_count"), "reviews_count", c("commits").alias("commits_count"), "additions", "deletions",
        c("changed_files").alias("changed_files_count"), ingested_at.alias("ingested_at_utc"),
    )


def commits(items: DataFrame, ingested_at: Column) -> DataFrame:
    """Rows of commits (``COMMIT_ITEM``) that have a sha; a missing list of files gives a null count."""
    full = F.coalesce(F.col("repo_full_name"), F.lit(""))
    part = lambda i: F.coalesce(F.get(F.split(full, "/", 2), F.lit(i)), F.lit(""))
    return items.where(F.col("sha") != "").select(
        F.concat_ws(":", full, "sha").alias("commit_event_id"), F.lit("github").alias("source"), part(0).alias("owner"), part(1).alias("repo"), full.alias("repo_full_name"), "sha",
        F.col("commit.message").alias("message"), F.col("commit.author.date").alias("committed_at_utc"), F.when(F.col("files").isNotNull(), F.size("files").cast("long")).alias("changed_files_count"),
        F.col("stats.additions").alias("additions"), F.col("stats.deletions").alias("deletions"), ingested_at.alias("ingested_at_utc"),
    )


def repo_summary(description: Column, topics: Column) -> Column:
    """Description and the first five topics in one line; empty if there are neither."""
    listed = F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice(topics, 1, 5), ", ")))
    return F.concat_ws(" | ", F.nullif(description, F.lit("")), listed)


def repositories(items: DataFrame, login: str, now: Column) -> DataFrame:
    """Master rows of repositories (fields of ``REPO`` as columns) that ``login`` owns."""
    c, no = F.col, F.lit(False)
    return items.where(c("owner.login") == login).select(
        c("id").alias("repo_id"), F.lit("github").alias("source"), c("owner.login").alias("owner"), F.coalesce("name", F.lit("")).alias("repo"),
        F.coalesce("full_name", F.lit("")).alias("repo_full_name"), "description", c("homepage").alias("homepage_url"), F.coalesce("private", no).alias("is_private"),
        F.coalesce("fork", no).alias("is_fork"), F.coalesce("archived", no).alias("archived"), "default_branch", c("language").alias("primary_language"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "stargazers_count", "forks_count", "open_issues_count", c("size").alias("size_kb"),
        *[c(f"{x}_at").alias(f"{x}_at_utc") for x in ("created", "updated", "pushed")],
        repo_summary(c("description"), c("topics")).alias("repo_summary_text"), F.lit("template").alias("summary_source"), now.alias("summary_updated_at_utc"),
    )
