"""Ad-hoc SELECT over the registered views, with a row cap."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MAX_ROWS = 1000
#: Interfaces of plan nodes that do more than read.
COMMANDS = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
VIEW = "View"
#: Leaves that a query may have beside views: constants, ranges, references to its own WITH clauses.
OWN_LEAVES = frozenset(("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "WithCTE", "CTERelationDef"))
#: Expressions that call any Java method.
REFLECTION = "expressions.CallMethodViaReflection"


def _nodes(plan: Any) -> Iterator[Any]:
    """A plan's nodes down to its views, those of its subqueries included."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        if node.nodeName() == VIEW:
            continue
        for found in (node.children(), node.subqueries(), node.innerChildren()):
            waiting += [found.apply(i) for i in range(found.size())]


def _only_reads_views(spark: SparkSession, plan: Any) -> bool:
    """Whether a plan reads nothing but registered views and calls no foreign code."""
    if REFLECTION in plan.toJSON():  # one call for all expressions, those within views too, which have none
        return False
    kinds = [spark._jvm.java.lang.Class.forName(name) for name in COMMANDS]
    for node in _nodes(plan):
        if any(kind.isInstance(node) for kind in kinds):
            return False
        if node.nodeName() != VIEW and not node.children().size() and node.nodeName() not in OWN_LEAVES:
            return False  # a table or file that was named in the text
    return True


def data_query(spark: SparkSession, sql: str, params: list[Any] | None = None) -> DataFrame:
    """Rows of a SELECT, at most ``MAX_ROWS`` + 1; text that does not begin with SELECT, does more than read, reads anything but views or calls Java is a ValueError."""
    text = sql.strip().rstrip(";")
    if not text.upper().startswith("SELECT"):
        raise ValueError("only SELECT is allowed")
    df = spark.sql(f"SELECT * FROM ({text}) AS _sub LIMIT {MAX_ROWS + 1}", args=params or None)
    if not _only_reads_views(spark, df._jdf.queryExecution().analyzed()):
        raise ValueError("only SELECT is allowed, of views and without calls of foreign code")
    return df


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """The rows as dictionaries; more than ``MAX_ROWS`` of them are a ValueError."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    if len(found) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows")
    return found
