"""Fixed schemas of the datasets and payloads. Readers fill missing columns with null and drop unknown ones."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

KINDS: dict[str, DataType] = {
    "string": StringType(),
    "bigint": LongType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
    "timestamp_ntz": TimestampNTZType(),
    "array<string>": ArrayType(StringType()),
}


def _struct(columns: str) -> StructType:
    """A schema from ``name kind`` pairs; built without a session, so that modules can be imported before there is one."""
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, KINDS[kind]) for name, kind in pairs])


PLAYS = _struct(
    "play_id string, played_at_utc timestamp_ntz, track_id string, track_name string, artist_ids array<string>, artist_names array<string>, "
    "album_id string, album_name string, ms_played bigint, context_type string, popularity bigint, explicit boolean"
)
TRACKS = _struct(
    "track_id string, name string, artist_ids array<string>, artist_names array<string>, album_id string, album_name string, "
    "duration_ms bigint, popularity bigint, explicit boolean, preview_url string, updated_at timestamp"
)
ARTISTS = _struct("artist_id string, name string, genres array<string>, popularity bigint, followers_total bigint, updated_at timestamp")
PULL_REQUESTS = _struct(
    "pr_event_id string, pr_key string, source string, owner string, repo string, repo_full_name string, pr_number bigint, pr_id bigint, action string, "
    "state string, is_merged boolean, title string, labels array<string>, base_ref string, head_ref string, created_at_utc timestamp_ntz, "
    "updated_at_utc timestamp_ntz, closed_at_utc timestamp_ntz, merged_at_utc timestamp_ntz, comments_count bigint, review_comments_count bigint, "
    "reviews_count bigint, commits_count bigint, additions bigint, deletions bigint, changed_files_count bigint, ingested_at_utc timestamp_ntz"
)
COMMITS = _struct(
    "commit_event_id string, source string, owner string, repo string, repo_full_name string, sha string, message string, committed_at_utc timestamp_ntz, "
    "changed_files_count bigint, additions bigint, deletions bigint, ingested_at_utc timestamp_ntz"
)
REPOSITORIES = _struct(
    "repo_id bigint, source string, owner string, repo string, repo_full_name string, description string, homepage_url string, is_private boolean, "
    "is_fork boolean, archived boolean, default_branch string, primary_language string, topics array<string>, stargazers_count bigint, forks_count bigint, "
    "open_issues_count bigint, size_kb bigint, created_at_utc timestamp_ntz, updated_at_utc timestamp_ntz, pushed_at_utc timestamp_ntz, "
    "repo_summary_text string, summary_source string, summary_updated_at_utc timestamp_ntz"
)
PAGE_VIEWS = _struct(
    "sync_id string, page_view_id string, started_at_utc timestamp, ended_at_utc timestamp, url string, title string, browser string, profile string, "
    "source_device string, transition string, visit_span_count bigint, synced_at_utc timestamp, ingested_at_utc timestamp"
)
WATCH_EVENTS = _struct(
    "watch_event_id string, watched_at_utc timestamp, video_id string, video_url string, video_title string, channel_id string, channel_name string, "
    "content_type string, source string, source_event_id string, source_device string, ingested_at_utc timestamp, browser_history_sync_id string"
)
VIDEOS = _struct(
    "video_id string, title string, channel_id string, channel_name string, duration_seconds bigint, view_count bigint, like_count bigint, "
    "comment_count bigint, published_at timestamp, thumbnail_url string, description string, category_id string, tags array<string>, updated_at timestamp, content_type string"
)
CHANNELS = _struct(
    "channel_id string, channel_name string, subscriber_count bigint, video_count bigint, view_count bigint, published_at timestamp, "
    "thumbnail_url string, description string, country string, updated_at timestamp"
)
WATCH_HISTORY = _struct(
    "watch_id string, account_id string, watched_at_utc timestamp, video_id string, video_title string, channel_id string, channel_name string, video_url string, context string"
)
#: A push of raw visits by a browser.
VISIT_PAYLOAD = StructType(
    [
        *_struct("sync_id string, source_device string, browser string, profile string, synced_at string").fields,
        StructField("items", ArrayType(_struct("url string, visit_time string, title string, visit_id string, referring_visit_id string, transition string"))),
    ]
)
BROWSERS = ["edge", "brave", "chrome"]  # fixed values: browsers that may push visits
