"""The catalogue as named tools with checked parameters; each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import DataFrame

from dayloom.functions.times import GRANULARITIES
from dayloom.plans import adhoc, code, music, video, web
from dayloom.sources.catalog import Lake


@dataclass(frozen=True)
class Rule:
    """What a parameter may be: ``read`` gives the value to use or raises; the error then begins with ``code``."""

    code: str
    says: str
    read: Callable[[Any], Any]

    def apply(self, value: Any) -> Any:
        try:
            return self.read(value)
        except (TypeError, ValueError) as e:
            raise ValueError(f"{self.code}: {self.says}") from e


def _one_of(values: tuple[str, ...]) -> Callable[[Any], str]:
    return lambda v: values[values.index(v)]


def limit_rule(most: int) -> Rule:
    return Rule("invalid_limit", f"a whole number from 1 to {most} is expected", lambda v: range(1, most + 1)[range(1, most + 1).index(v)] if type(v) is int else _fail())


def _fail() -> None:
    raise ValueError


_day = lambda v: (v if isinstance(v, date) else date.fromisoformat(v)).isoformat()[:10]
#: The codes that errors begin with.
RULES = {
    "start_date": Rule("invalid_start_date", "a date such as 2024-01-31 is expected", _day),
    "end_date": Rule("invalid_end_date", "a date such as 2024-01-31 is expected", _day),
    "granularity": Rule("invalid_granularity", f"one of {', '.join(GRANULARITIES)} is expected", _one_of(GRANULARITIES)),
    "limit": limit_rule(100),
}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, Any]  # name to default; REQUIRED for those without
    run: Callable[..., DataFrame]
    rules: dict[str, Rule] = field(default_factory=dict)  # where they differ from ``RULES``

    def schema(self) -> dict[str, Any]:
        """JSON schema of the parameters."""
        kinds = {"limit": "integer", "params": "array"}
        return {
            "name": self.name,
            "description": self.description,
            "inputSchema": {"type": "object", "properties": {p: {"type": kinds.get(p, "string")} for p in self.parameters}, "required": [p for p, d in self.parameters.items() if d is REQUIRED]},
        }


REQUIRED = object()
DATES = {"start_date": REQUIRED, "end_date": REQUIRED}


class ToolRegistry:
    """Tools by name; an unknown name is a KeyError."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool:
        return self._tools[name]

    def schemas(self) -> list[dict[str, Any]]:
        return [t.schema() for t in self._tools.values()]

    def execute(self, name: str, **given: Any) -> DataFrame:
        """Check the parameters and run the tool."""
        tool = self.get(name)
        if unknown := set(given) - set(tool.parameters):
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        values = {**tool.parameters, **given}
        if missing := [p for p, v in values.items() if v is REQUIRED]:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        for name, rule in {**RULES, **tool.rules}.items():
            if values.get(name) is not None:
                values[name] = rule.apply(values[name])
        if values.get("start_date", "") > values.get("end_date", ""):
            raise ValueError("invalid_date_range: the first day comes after the last")
        return tool.run(**values)


def build_registry(lake: Lake, layer: str = "compacted") -> ToolRegistry:
    """All tools over the datasets of a lake, in one layer."""

    def scan(name: str, start: str | None = None, end: str | None = None) -> DataFrame:
        return lake.scan(name, start, end, layer)

    def watched(start: str, end: str) -> DataFrame:
        return video.enriched(scan("youtube/watch_events", start, end), scan("youtube/videos"), scan("youtube/channels"), start, end)

    pulls, commits, views, plays = "github/pull_requests", "github/commits", "browser_history/page_views", "spotify/plays"
    registry = ToolRegistry()
    for tool in (
        Tool("get_top_tracks", "Most played tracks", {**DATES, "limit": 10}, lambda start_date, end_date, limit: music.top_tracks(scan(plays, start_date, end_date), start_date, end_date, limit)),
        Tool("get_listening_stats", "Listening time by period", {**DATES, "granularity": "day"}, lambda start_date, end_date, granularity: music.listening_stats(scan(plays, start_date, end_date), start_date, end_date, granularity)),
        Tool("get_page_views", "Latest page views", {**DATES, "browser": None, "profile": None, "limit": 50}, lambda start_date, end_date, browser, profile, limit: web.page_views(scan(views, start_date, end_date), start_date, end_date, browser, profile, limit)),
        Tool("get_top_domains", "Most viewed domains", {**DATES, "browser": None, "profile": None, "limit": 20}, lambda start_date, end_date, browser, profile, limit: web.top_domains(scan(views, start_date, end_date), start_date, end_date, browser, profile, limit)),
        Tool("get_pull_requests", "Latest pull request events", {**DATES, "owner": None, "repo": None, "state": None, "limit": 100}, lambda start_date, end_date, owner, repo, state, limit: code.pull_requests(scan(pulls, start_date, end_date), start_date, end_date, owner, repo, state, limit)),
        Tool("get_commits", "Latest commits", {**DATES, "owner": None, "repo": None, "limit": 100}, lambda start_date, end_date, owner, repo, limit: code.commits(scan(commits, start_date, end_date), start_date, end_date, owner, repo, limit)),
        Tool("get_repositories", "Repositories", {"owner": None, "repo": None, "limit": 10}, lambda owner, repo, limit: code.repositories(scan("github/repositories"), owner, repo, limit), {"limit": limit_rule(1000)}),
        Tool("get_activity_stats", "Coding activity by period", {**DATES, "granularity": "day"}, lambda start_date, end_date, granularity: code.activity_stats(scan(pulls, start_date, end_date), scan(commits, start_date, end_date), start_date, end_date, granularity)),
        Tool("get_repo_summary_stats", "Totals of each repository", {**DATES, "owner": None, "repo": None}, lambda start_date, end_date, owner, repo: code.repo_summary(scan(pulls, start_date, end_date), scan(commits, start_date, end_date), start_date, end_date, owner, repo)),
        Tool("data_query", "A SELECT over the views", {"sql": REQUIRED, "params": None}, lambda sql, params: adhoc.data_query(lake.spark, sql, params)),
        Tool("get_youtube_watch_events", "Latest watch events", {**DATES, "limit": None}, lambda start_date, end_date, limit: video.watch_events(watched(start_date, end_date), limit)),
        Tool("get_youtube_watching_stats", "Watching by period", {**DATES, "granularity": "day"}, lambda start_date, end_date, granularity: video.watching_stats(watched(start_date, end_date), granularity)),
        Tool("get_youtube_top_videos", "Most watched videos", {**DATES, "limit": 10}, lambda start_date, end_date, limit: video.top_videos(watched(start_date, end_date), limit)),
        Tool("get_youtube_top_channels", "Most watched channels", {**DATES, "limit": 10}, lambda start_date, end_date, limit: video.top_channels(watched(start_date, end_date), limit)),
    ):
        registry.register(tool)
    return registry
