from __future__ import annotations

import pytest

from dayloom.plans import adhoc
from dayloom.plans.tools import build_registry
from dayloom.sources import sinks
from dayloom.sources.catalog import Lake


@pytest.fixture(scope="module")
def registry(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    rows = spark.createDataFrame([("p1", "2024-01-05T00:00:00Z", "N", ["X"], 60000)], "play_id string, played_at_utc string, track_name string, artist_names array<string>, ms_played bigint")
    sinks.append_events(rows, lake, "spotify/plays")
    sinks.compact(lake, "spotify/plays")
    lake.register_views()
    return build_registry(lake)


def test_all_tools_run(registry):
    assert len(registry.schemas()) == 14
    days = {"start_date": "2024-01-01", "end_date": "2024-01-31"}
    for schema in registry.schemas():
        if schema["name"] == "data_query":
            continue
        given = {p: days[p] for p in schema["inputSchema"]["required"]}
        assert registry.execute(schema["name"], **given).count() == (1 if schema["name"] in ("get_top_tracks", "get_listening_stats") else 0)


@pytest.mark.parametrize(
    ("given", "error"),
    [
        ({"start_date": "x", "end_date": "2024-01-01"}, "invalid_start_date"),
        ({"start_date": "2024-01-01", "end_date": "x"}, "invalid_end_date"),
        ({"start_date": "2024-01-02", "end_date": "2024-01-01"}, "invalid_date_range"),
        ({"start_date": "2024-01-01", "end_date": "2024-01-02", "limit": 0}, "invalid_limit"),
        ({"start_date": "2024-01-01", "end_date": "2024-01-02", "limit": 101}, "invalid_limit"),
        ({"start_date": "2024-01-01", "end_date": "2024-01-02", "limit": "5"}, "invalid_limit"),
        ({"start_date": "2024-01-01"}, "missing"),
        ({"start_date": "2024-01-01", "end_date": "2024-01-02", "color": 1}, "unknown"),
    ],
)
def test_validation(registry, given, error):
    with pytest.raises(ValueError, match=error):
        registry.execute("get_top_tracks", **given)


def test_granularity_and_names(registry):
    with pytest.raises(ValueError, match="invalid_granularity"):
        registry.execute("get_listening_stats", start_date="2024-01-01", end_date="2024-01-02", granularity="year")
    with pytest.raises(KeyError):
        registry.get("no_such_tool")


@pytest.mark.parametrize("sql", ["", ";", "-- SELECT\nSHOW VIEWS", "/* SELECT */ REFRESH TABLE spotify_plays", "WITH s AS (SELECT 1 AS a) SELECT a FROM s", "(SELECT 1)", "VALUES (1)", "FROM spotify_plays SELECT 1", "EXPLAIN SELECT 1", "CACHE TABLE c AS SELECT 1", "TRUNCATE TABLE spotify_plays"])
def test_text_must_begin_with_select(spark, sql):
    with pytest.raises(ValueError, match="only SELECT"):
        adhoc.data_query(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1 AS CommandCount", "SELECT 'InsertInto' AS x", "select (SELECT 'DropTable') AS x", "SELECT x FROM (WITH c AS (SELECT 1 AS x) SELECT * FROM c)"])
def test_words_that_look_like_commands_are_text(spark, sql):
    assert len(adhoc.rows(adhoc.data_query(spark, sql))) == 1


@pytest.mark.parametrize("inner", ["SHOW TABLES", "CREATE VIEW v AS SELECT 1", "SET x = 1"])
def test_commands_do_not_hide_in_a_subselect(spark, inner):
    with pytest.raises(Exception):  # noqa: B017  a command does not parse there
        adhoc.data_query(spark, f"SELECT * FROM ({inner})")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) FROM text.`/etc/passwd`",
        "SELECT (SELECT max(value) FROM text.`/etc/passwd`)",
        "SELECT * FROM (WITH t AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM t)",
        "SELECT * FROM guarded g WHERE EXISTS (SELECT 1 FROM text.`/etc/passwd` p WHERE p.value = g.id)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT id FROM guarded WHERE java_method('java.lang.System', 'getProperty', 'user.home') = 'x'",
        "SELECT * FROM (WITH t AS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS x) SELECT * FROM t)",
    ],
)
def test_files_and_foreign_code_are_refused(spark, sql):
    spark.range(3).createOrReplaceTempView("guarded")
    with pytest.raises(ValueError, match="only SELECT"):
        adhoc.data_query(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM guarded", "SELECT a.id FROM guarded a JOIN guarded b USING (id)", "SELECT (SELECT max(id) FROM guarded) FROM range(3)", "SELECT * FROM guarded WHERE id IN (SELECT id FROM guarded)"])
def test_views_are_read_wherever_they_stand(spark, sql):
    spark.range(3).createOrReplaceTempView("guarded")
    assert len(adhoc.rows(adhoc.data_query(spark, sql))) == 3


def test_nodes_of_commands_are_found(spark):
    plan = spark.sql("SHOW TABLES")._jdf.queryExecution().analyzed()
    kind = spark._jvm.java.lang.Class.forName(adhoc.COMMANDS[0])
    assert any(kind.isInstance(n) for n in adhoc._nodes(plan))


def test_repositories_may_be_a_thousand(registry):
    assert registry.execute("get_repositories", limit=1000).count() == 0
    for limit in (1001, True, 0):
        with pytest.raises(ValueError, match="invalid_limit"):
            registry.execute("get_repositories", limit=limit)


def test_data_query(spark, registry):
    assert adhoc.rows(registry.execute("data_query", sql="select count(*) as n from spotify_plays where track_name = ?", params=["N"])) == [{"n": 1}]
    assert adhoc.rows(adhoc.data_query(spark, "SELECT 1 AS a WHERE 1 = 0")) == []
    with pytest.raises(ValueError, match="more than 1000"):
        adhoc.rows(adhoc.data_query(spark, "SELECT id FROM range(2000)"))
    with pytest.raises(Exception):  # noqa: B017  a second statement does not parse inside the subselect
        adhoc.data_query(spark, "SELECT 1) AS x; DROP VIEW spotify_plays; SELECT * FROM (SELECT 1")
