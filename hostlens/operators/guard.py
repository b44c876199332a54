"""Guarded read-only SQL, frame callables, preview and emptiness.

The guard is a text check applied to user SQL before Spark parses it, in the
reference's order:

1. the statement (after stripping) must start with ``SELECT`` or ``(SELECT``;
2. none of 13 write/DDL keywords may occur anywhere as a whole word, any case
   (inside string literals too);
3. ``SELECT * FROM`` may not occur anywhere (``SELECT t.*``,
   ``SELECT DISTINCT *`` and ``SELECT *, x`` pass).

``;``-chained statements are a parse error in ``spark.sql``; file-path tables
(``parquet.`/x```) are refused by a fourth text rule and are unresolvable
anyway because ``spark.sql.runSQLOnFiles`` is off.

A statement that passes the text check is parsed (not run): no IDENTIFIER
clause, no script transformation (``TRANSFORM ... USING`` runs a shell
command), and no function that is not on a list of pure ones (``reflect`` and
its kin call into the JVM).  It is then resolved, still without running, and
the resolved plan is walked, subqueries included: its leaves must be views of
the session, whatever names the text holds, and its steps and expressions must
be of known classes.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.text import strip_ws
from hostlens.session import EngineSession

# Fixed values that must equal the reference's: the guard's patterns, keywords
# and messages, and the variable names that the emptiness check looks at.
_SELECT_START = r"^\(?\s*SELECT\b"
_STAR = r"SELECT\s+\*\s+FROM"
CHECKED_FRAMES = ("data", "result", "df_filtered", "df")
FORBIDDEN_KEYWORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH",
    "DETACH", "COPY", "PRAGMA", "EXPORT", "IMPORT", "CALL",
)
SELECT_ONLY_MSG = "Error: only SELECT statements are allowed."
FORBIDDEN_MSG = ("Error: query contains a forbidden keyword — only a read-only "
                 "SELECT is allowed.")

# Own wording.
STAR_MSG = "Error: name the columns to read; `SELECT * FROM` is refused."
EMPTY_MSG = "Error: no row matched. Loosen the filter, or look up the stored values with SELECT DISTINCT first."
PROGRAM_MSG = "Error: running scripts from SQL is refused."
IDENTIFIER_MSG = "Error: write table and function names out; IDENTIFIER is refused."
FUNCTION_MSG = "Error: {!r} is not a function that a query may call."
RELATION_MSG = "Error: a query may read these views only: {}."
MAX_PREVIEW_ROWS = 1000
DEFAULT_PREVIEW_ROWS = 50

_FORBIDDEN = r"\b(" + "|".join(FORBIDDEN_KEYWORDS) + r")\b"
# file-path tables (format.`/path`); refused by text as well as by
# spark.sql.runSQLOnFiles=false, in case a session cannot change that setting
_FILE_TABLE = r"\b\w+\s*\.\s*`[^`]*[/\\:][^`]*`"

_SELECT_START_RE = re.compile(_SELECT_START, re.IGNORECASE)
_FORBIDDEN_RE = re.compile(_FORBIDDEN, re.IGNORECASE)
_STAR_RE = re.compile(_STAR, re.IGNORECASE)
_FILE_TABLE_RE = re.compile(_FILE_TABLE)
FILE_TABLE_MSG = "Error: file-path tables are not allowed — query the registered views."


class GuardError(ValueError):
    """A statement refused by the guard or an empty result."""


def check_sql(sql: str) -> str | None:
    """Return the refusal message for ``sql``, or None if it passes."""
    stripped = sql.strip()
    if not _SELECT_START_RE.match(stripped):
        return SELECT_ONLY_MSG
    if _FORBIDDEN_RE.search(stripped):
        return FORBIDDEN_MSG
    if _STAR_RE.search(stripped):
        return STAR_MSG
    if _FILE_TABLE_RE.search(stripped):
        return FILE_TABLE_MSG
    return None


def audit_rule(statement: Column) -> Column:
    """The same three checks as a column expression over logged
    statements; the first failing rule wins, NULL when the statement passes.
    Java regex with ``(?i)``; surrounding whitespace is stripped as in G1."""
    s = strip_ws(statement)
    return (
        F.when(~s.rlike("(?i)" + _SELECT_START), F.lit("select_only"))
        .when(s.rlike("(?i)" + _FORBIDDEN), F.lit("forbidden_keyword"))
        .when(s.rlike("(?i)" + _STAR), F.lit("select_star"))
    )


# Functions a statement may call: all built-in ones of these groups of Spark's
# function registry, pure functions of the group "misc", and the session's own.
_GROUPS = frozenset(f"{g}_funcs" for g in (
    "agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "generator", "hash", "json",
    "lambda", "map", "math", "predicate", "st", "string", "struct", "url", "variant", "window", "xml"))
_PURE_MISC = re.compile(r"typeof|(bitmap|hll|theta|kll|approx_top_k)_\w+")

# Expressions that come from syntax, from coercion, or from functions whose
# registry entry names a builder instead of the class it builds.
_EXPRESSIONS = frozenset("""
    Alias AttributeReference OuterReference LateralColumnAliasReference Literal Cast SortOrder MultiAlias
    ScalarSubquery ListQuery Exists InSubquery LateralSubquery LambdaFunction NamedLambdaVariable
    WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnboundedPreceding$ UnboundedFollowing$ CurrentRow$
    AggregateExpression GroupingSets Rollup Cube Grouping GroupingID GetStructField GetArrayItem GetMapValue GetArrayStructFields
    CreateNamedStruct CheckOverflow TryEval GeneratorOuter TimeAdd TimestampAddInterval DateAddInterval DateAddYMInterval
    TimestampAddYMInterval SubtractDates SubtractTimestamps DatetimeSub Extract
    Ceil RoundCeil Floor RoundFloor Average Sum Mode PercentileCont PercentileDisc CountMinSketchAgg Explode PosExplode Inline
    Second SecondWithFraction Hour Minute SecondsOfTime SecondsOfTimeWithFraction HoursOfTime MinutesOfTime DatePart CurrentDate CurDateExpressionBuilder
    MakeTimestamp MakeTimestampNTZ MakeTimestampLTZ TryMakeTimestamp TryMakeTimestampNTZ TryMakeTimestampLTZ ParseToDate ParseToTimestamp TryToTimestampExpressionBuilder
    StringLPad StringRPad BinaryPad Contains StartsWith EndsWith Like ILike RLike LikeAll NotLikeAll LikeAny NotLikeAny Collate Collation ToCharacter ToBinary Mask
    With CommonExpressionDef CommonExpressionRef PipeOperator VariantGet ParseJson InSet ArrayTransform ListAgg Count PivotFirst
    PreciseTimestampConversion MultiplyYMInterval MultiplyDTInterval DivideYMInterval DivideDTInterval MakeTimestampFromDateTime
    TryMakeTimestampFromDateTime ExtractANSIIntervalYears ExtractANSIIntervalMonths ExtractANSIIntervalDays ExtractANSIIntervalHours
    ExtractANSIIntervalMinutes ExtractANSIIntervalSeconds BinaryPredicate StringDecode ResolvedCollation TypedNullLiteral KnownNullable KnownNotNull
""".split())

# Steps a resolved statement may be made of, besides the session's views.
_STEPS = frozenset("""
    Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Union Intersect Except Window
    WithWindowDefinition Expand Generate Pivot Unpivot Sample SubqueryAlias WithCTE CTERelationDef CTERelationRef ResolvedHint UnresolvedHint
    RepartitionByExpression RebalancePartitions OneRowRelation LocalRelation Range View
""".split())
# what a table function may be
_TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))
_SPARK_SQL = "org.apache.spark.sql.catalyst."


@functools.lru_cache(maxsize=1)
def _allowed() -> tuple[frozenset[str], frozenset[str]]:
    """(names, classes) of the built-in functions that a statement may call."""
    registry = SparkSession.getActiveSession()._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    names, classes, found = set(), set(), registry.listFunction().iterator()
    while found.hasNext():
        info = registry.lookupFunction(found.next()).get()
        name = info.getName().lower()
        if info.getGroup() in _GROUPS or _PURE_MISC.fullmatch(name):
            names.add(name)
            classes.add(info.getClassName().rsplit(".", 1)[-1])
    return frozenset(names), frozenset(classes) | _EXPRESSIONS


def _trees(x):
    """The trees in a JSON value: (node, its child trees) from nodes listed in preorder."""
    if isinstance(x, list) and x and isinstance(x[0], dict) and "num-children" in x[0]:
        at = 0

        def take():
            nonlocal at
            node = x[at]
            at += 1
            return node, [take() for _ in range(node["num-children"])]

        while at < len(x):
            yield take()
    elif isinstance(x, list | dict):
        for y in x if isinstance(x, list) else x.values():
            yield from _trees(y)


def _nodes(trees, below_views: bool = True):
    """All nodes of trees, expressions and subqueries included, but not what a
    temporary view is made of unless ``below_views``."""
    for node, children in trees:
        yield node
        if below_views or not _kind(node) == "View":
            yield from _nodes(_trees([v for v in node.values() if isinstance(v, list | dict)]), below_views)
            yield from _nodes(children, below_views)


def _kind(node: dict) -> str:
    return node["class"].rsplit(".", 1)[-1]


def _name(parts) -> list[str]:
    """Parts of a name as toJSON writes it: ``[a, b]`` or a list."""
    return [p.strip() for p in parts.strip("[]").split(",")] if isinstance(parts, str) else list(parts or [""])


def check_parsed(session: EngineSession, sql: str) -> str | None:
    """Refusal message for what ``sql`` asks for by name, before any name is
    looked up: no IDENTIFIER clause, no script, no function or table function
    off the lists."""
    plan = session.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    own = {f.lower() for f in session.functions}
    for node in _nodes(_trees(json.loads(plan.toJSON()))):
        kind = _kind(node)
        if "UnresolvedIdentifier" in kind:
            return IDENTIFIER_MSG
        if "ScriptTransformation" in kind:
            return PROGRAM_MSG
        if kind == "UnresolvedTableValuedFunction":
            name = ".".join(_name(node.get("functionName") or node.get("name"))).lower()
            if name not in _TABLE_FUNCTIONS:
                return FUNCTION_MSG.format(name)
        elif kind == "UnresolvedFunction":
            name = ".".join(_name(node.get("nameParts"))).lower()
            if name not in own and name not in _allowed()[0]:
                return FUNCTION_MSG.format(name)
    return None


def check_resolved(session: EngineSession, df: DataFrame) -> str | None:
    """Refusal message for what the resolved plan of a statement reads or runs.

    Whatever a name was written as, or where, only what it resolved to counts:
    every leaf must be one of the session's views (or rows written in the
    statement), every step and expression must be on the lists."""
    views, own = {v.lower() for v in session.views}, {f.lower() for f in session.functions}
    for node in _nodes(_trees(json.loads(df._jdf.queryExecution().analyzed().toJSON())), below_views=False):
        kind, place = _kind(node), node["class"]
        if kind == "View":
            name = node.get("desc", {}).get("identifier", {})
            if not node.get("isTempView") or name.get("database") or name.get("table", "").lower() not in views:
                return _unknown_relation(session)
        elif kind in ("PythonUDF", "ScalaUDF"):
            if str(node.get("name")).lower() not in own:
                return FUNCTION_MSG.format(node.get("name"))
        elif place.startswith(_SPARK_SQL + "plans."):
            if kind not in _STEPS:
                return _unknown_relation(session)
        elif not place.startswith(_SPARK_SQL + "expressions.") or kind not in _allowed()[1]:
            return _unknown_relation(session) if ".execution.datasources" in place or "Relation" in kind else FUNCTION_MSG.format(kind)
    return None


def _unknown_relation(session: EngineSession) -> str:
    """The same words for what does not exist and for what may not be read."""
    return RELATION_MSG.format(", ".join(sorted(session.views)))


def guarded_sql(session: EngineSession, sql: str, check_empty: bool = True) -> DataFrame:
    """G1: run a guarded SELECT; on success it becomes ``df_host``.

    A materialising session computes the result once; the emptiness test
    reads that copy.  A failure (refusal, analysis error or 0 rows) leaves
    the previous ``df_host``.
    """
    sql = sql.strip()
    if msg := check_sql(sql) or check_parsed(session, sql):
        raise GuardError(msg)
    try:
        df = session.spark.sql(sql)      # resolved, not run
    except AnalysisException as e:
        if e.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "REQUIRES_SINGLE_PART_NAMESPACE"):
            raise GuardError(_unknown_relation(session)) from None
        raise
    if msg := check_resolved(session, df):
        raise GuardError(msg)
    df, path = session.stage(df)
    if check_empty and df.isEmpty():
        session.drop(path)
        raise GuardError(EMPTY_MSG)
    return session.set_result(df, path)


FrameFn = Callable[[DataFrame | None, DataFrame | None], DataFrame]
NO_RESULT_MSG = "Error: df_host is not available — run query_host_sql first."


class _NoResult:
    """Stands for ``df_host`` before any guarded query: any use of it fails."""

    def __getattr__(self, name: str):
        raise GuardError(NO_RESULT_MSG)

    def __getitem__(self, name):
        raise GuardError(NO_RESULT_MSG)


def query_frames(session: EngineSession, fn: FrameFn, check_empty: bool = True) -> DataFrame:
    """Run a callable over (df_taxo, df_host).

    Touching ``df_host`` before any guarded query is an explicit error (work
    on the taxonomy alone needs none); the result must be a DataFrame and
    non-empty.
    """
    out = fn(session.taxonomy, _NoResult() if session.df_host is None else session.df_host)
    if isinstance(out, _NoResult):
        raise GuardError(NO_RESULT_MSG)
    if not isinstance(out, DataFrame):
        raise GuardError(f"Error: result must be a DataFrame, got {type(out).__name__}.")
    if check_empty and (msg := check_not_empty({"result": out})):
        raise GuardError(msg)
    return out


def check_not_empty(frames: dict[str, DataFrame]) -> str | None:
    """The first of data/result/df_filtered/df that is empty → message."""
    for name in CHECKED_FRAMES:
        df = frames.get(name)
        if isinstance(df, DataFrame) and df.isEmpty():
            return f"Error: nothing to show, '{name}' has 0 rows."
    return None


@dataclass
class Preview:
    total: int
    rows: list[dict]
    columns: list[str]
    text: str


def preview_counts(df: DataFrame, preview_rows: int = DEFAULT_PREVIEW_ROWS) -> DataFrame:
    """G4 as a one-row frame (total, shown, remaining): one count job."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = F.lit(preview_rows).cast("bigint")
    return total.select(
        F.col("total"),
        F.least(F.col("total"), n).alias("shown"),
        F.greatest(F.col("total") - n, F.lit(0).cast("bigint")).alias("remaining"),
    )


def table_result(df: DataFrame, preview_rows: int = DEFAULT_PREVIEW_ROWS) -> Preview:
    """Total rows, the first N rows as ISO-dated JSON records, wording.

    One count and one ``limit(n)``; at most N rows (and never more than
    MAX_PREVIEW_ROWS) reach the driver.
    """
    preview_rows = min(preview_rows, MAX_PREVIEW_ROWS)
    total = df.count()
    head = df.limit(preview_rows)
    rows = [json.loads(r[0]) for r in head.select(
        F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                  {"ignoreNullFields": "false",
                   "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
                   "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
                   "dateFormat": "yyyy-MM-dd"})).collect()]
    lines = [" | ".join(df.columns)]
    lines += [" | ".join("" if r.get(c) is None else str(r.get(c)) for c in df.columns) for r in rows]
    text = "\n".join(lines)
    if total > preview_rows:
        text += f"\n({total - preview_rows} further rows are not shown)"
    content = f"The result has {total} row{'s' if total != 1 else ''}.\n{text}"
    return Preview(total=total, rows=rows, columns=list(df.columns), text=content)
