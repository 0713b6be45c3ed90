"""Parts of URLs. Text that is no URL gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose pages are video pages.
LONG_HOSTS = ["www.youtube.com", "youtube.com", "m.youtube.com"]
SHORT_HOSTS = ["youtu.be", "www.youtu.be"]


def authority(url: Column) -> Column:
    """What stands between :// and the path, with user and port; null if there is none."""
    return F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def query_value(url: Column, key: str) -> Column:
    """Decoded value of a query parameter; null if it is missing or empty."""
    return F.nullif(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(key))), F.lit(""))


def _short_id(url: Column) -> Column:
    return F.nullif(F.get(F.split(F.regexp_replace(path(url), "^/+", ""), "/", 2), F.lit(0)), F.lit(""))


def video_id(url: Column) -> Column:
    """Id of the video that a watch, shorts or short-link page shows."""
    shorts = F.nullif(F.get(F.split(path(url), "/"), F.lit(2)), F.lit(""))
    watch = F.when(path(url).startswith("/shorts/"), shorts).when(path(url) == "/watch", query_value(url, "v"))
    return F.when(host(url).isin(SHORT_HOSTS), _short_id(url)).when(host(url).isin(LONG_HOSTS), watch)


def video_page(url: Column) -> Column:
    """The page's URL, short links written out; null for pages of other hosts."""
    return F.when(host(url).isin(SHORT_HOSTS), F.concat(F.lit("https://www.youtube.com/watch?v="), _short_id(url))).when(host(url).isin(LONG_HOSTS), url)


def content_type(url: Column) -> Column:
    return F.when(path(url).startswith("/shorts/"), F.lit("short")).otherwise(F.lit("video"))


def quoted(part: Column) -> Column:
    """A path segment, percent-encoded: letters, digits and -._~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
