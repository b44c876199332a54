"""Tool-shaped entry points: the reference's seven tools as Spark jobs.

Each returns ``{"success": bool, "content": str, "artifacts": [...]}``.  The
work is distributed; only bounded results reach the driver (a preview of
``preview_rows``, top-k lists, one article), and charts and maps name a table
with every row.  Frame "code" is a Python
callable over DataFrames instead of a code string.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.text import WIKI_URL, ncbi_url
from hostlens.operators import frames as FR
from hostlens.operators import article_index, closest, geo, guard, search
from hostlens.session import EngineSession

MAX_PUBMED_RESULTS = 5
MAX_TAXONOMY_MATCHES = 5
DEFAULT_WIKIPEDIA_LIMIT = 4000
ARTICLE_FIELDS = ("title", "authors", "journal", "year", "doi", "abstract")
TAXON_FIELDS = ("rank", "division", "lineage", "synonyms")


@dataclass
class Outcome:
    """What a tool hands back; ``as_dict`` has the fixed keys."""

    content: str
    artifacts: list = field(default_factory=list)
    success: bool = True

    def as_dict(self) -> dict:
        return {"success": self.success, "content": self.content, "artifacts": self.artifacts}


def tool(fn: Callable[..., Outcome]) -> Callable[..., dict]:
    """A tool reports every failure of its query or callable as a result."""
    @functools.wraps(fn)
    def run(*args, **kwargs) -> dict:
        try:
            return fn(*args, **kwargs).as_dict()
        except guard.GuardError as e:
            return Outcome(str(e), success=False).as_dict()
        except Exception as e:  # noqa: BLE001  analysis errors, bad columns, failed jobs
            return Outcome(f"Error: {type(e).__name__}: {e}", success=False).as_dict()
    return run


def _table(df: DataFrame, preview_rows: int) -> Outcome:
    p = guard.table_result(df, preview_rows)
    return Outcome(p.text, [{"type": "table", "rows": p.rows, "columns": p.columns, "total_rows": p.total}])


@tool
def query_host_sql(session: EngineSession, sql: str,
                   preview_rows: int = guard.DEFAULT_PREVIEW_ROWS) -> Outcome:
    """Guarded SELECT over ``host``; on success the result becomes df_host."""
    return _table(guard.guarded_sql(session, sql), preview_rows)


@tool
def query_dataframe(session: EngineSession, fn: Callable[[DataFrame, DataFrame], DataFrame],
                    preview_rows: int = guard.DEFAULT_PREVIEW_ROWS) -> Outcome:
    """A callable over (df_taxo, df_host) returning a non-empty DataFrame."""
    return _table(guard.query_frames(session, fn), preview_rows)


@contextlib.contextmanager
def _once(session: EngineSession, frame: DataFrame):
    """The rows of ``frame`` computed once, and their path; removed again if what
    is done with them fails, so gates and artifact see the same rows."""
    rows, path = session.stage(frame)
    try:
        yield rows, path
    except BaseException:
        session.drop(path)
        raise


def _drawn(rows: DataFrame, path: str | None, preview_rows: int, **about) -> tuple[int, dict]:
    """(rows, artifact) of a frame to draw: every row of it as a table in the
    shared folder (``path``, and the ``frame``), a few as a preview."""
    p = guard.table_result(rows, preview_rows)
    return p.total, {**about, "rows": p.rows, "columns": p.columns, "total_rows": p.total, "path": path, "frame": rows}


@tool
def create_visualization(session: EngineSession, fn: Callable[[DataFrame, DataFrame], DataFrame],
                         kind: str, x: str, y: str | None = None,
                         preview_rows: int = guard.DEFAULT_PREVIEW_ROWS) -> Outcome:
    """Chart frame for ``bar``/``pie``/``histogram``/``scatter`` from the
    callable's frame; refused when it has no plottable point.  Drawing is
    left to the caller: the artifact names the whole frame."""
    kinds = {"bar": lambda b: FR.group_size(b, x), "pie": lambda b: FR.category_share(b, x),
             "histogram": lambda b: FR.histogram(b, x), "scatter": lambda b: b.select(x, y)}
    if kind not in kinds:
        raise guard.GuardError(f"Error: unknown chart kind {kind!r}.")
    with _once(session, guard.query_frames(session, fn, check_empty=False)) as (base, base_path):
        if msg := guard.check_not_empty({"result": base}):
            raise guard.GuardError(msg)
        with _once(session, kinds[kind](base)) as (chart, path):
            counts = FR.chart_has_points(chart, chart.columns).first()
            if not any(counts[c] for c in chart.columns):
                raise guard.GuardError("Error: the figure has no data points.")
            total, artifact = _drawn(chart, path, preview_rows, type="chart", kind=kind)
    session.drop(base_path)
    return Outcome(f"{kind} chart with {total} rows.", [artifact])


@tool
def create_map(session: EngineSession, fn: Callable[[DataFrame, DataFrame], DataFrame],
               preview_rows: int = guard.DEFAULT_PREVIEW_ROWS) -> Outcome:
    """Map frame (lon, lat, sample_id, ...): refused without a single point
    that has coordinates, then by both traceability gates.  Every point is
    in the artifact's table."""
    frame = guard.query_frames(session, fn, check_empty=False)
    with _once(session, frame.dropna(subset=["lon", "lat"])) as (points, path):
        if points.isEmpty():
            raise guard.GuardError("Error: the map has no point with coordinates.")
        if msg := geo.check_traceability(points):
            raise guard.GuardError(msg)
        total, artifact = _drawn(points, path, preview_rows, type="map")
    return Outcome(f"Map with {total} points.", [artifact])


@tool
def wikipedia_search(pages: DataFrame, search_term: str,
                     wikipedia_limit: int = DEFAULT_WIKIPEDIA_LIMIT) -> Outcome:
    """Article from landed pages: the exact title, else the closest within a few edits,
    else one that shares the rarest word (one row collected)."""
    terms = pages.sparkSession.createDataFrame([(search_term,)], "term STRING")
    near = closest.article_closest(terms, pages, wikipedia_limit).first()
    if near is not None and near["found"]:
        r = {**near.asDict(), "fuzzy": near["edits"] > 0}
    else:
        r = search.article_lookup(terms, pages, wikipedia_limit).first()
    if r is None or not r["found"]:
        raise guard.GuardError(f"Error: no article matches {search_term!r}.")
    url = WIKI_URL + (r["title"] or "").replace(" ", "_")
    note = f"\n(closest title; there is no page called {search_term!r})" if r["fuzzy"] else ""
    return Outcome(f"{r['title']}\n{url}{note}\n\n{r['extract']}", [{"type": "url", "url": url}])


def article_details(top: DataFrame, articles: DataFrame, id_col: str = "pmid") -> DataFrame:
    """Ranked hits (query_id, rank, doc_id, score) with title, abstract, authors,
    journal, year and DOI of each article, where ``articles`` has them."""
    fields = [c for c in ARTICLE_FIELDS if c in articles.columns]
    return top.join(articles.select(F.col(id_col).cast("bigint").alias("doc_id"), *fields), "doc_id", "left") \
        .select("query_id", "rank", "doc_id", "score", *fields)


@tool
def pubmed_search(articles: DataFrame, query: str, max_results: int = MAX_PUBMED_RESULTS,
                  id_col: str = "pmid", text_col: str = "text", index: str | None = None) -> Outcome:
    """Top articles for one query (at most ``max_results``), with their bibliographic
    fields where the table has them: by BM25 from the stored ``index``
    (``article_index.build_index``) where there is one, else by shared tokens."""
    q = articles.sparkSession.createDataFrame([(0, query)], "qid BIGINT, text STRING")
    if index:
        top, unit = article_index.search_index(q, "qid", "text", index, k=max_results), "score"
    else:
        top, unit = search.search_topk(q, "qid", "text", articles, id_col, text_col, k=max_results), "shared words"
    rows = article_details(top, articles, id_col).orderBy("rank").collect()
    if not rows:
        raise guard.GuardError(f"Error: no article shares a word with {query!r}.")
    parts = [f"{len(rows)} article(s) for {query!r}"]
    for r in rows:
        d = r.asDict()
        more = [", ".join(d[f]) if isinstance(d[f], list) else str(d[f]) for f in ARTICLE_FIELDS if d.get(f)]
        parts.append("\n".join([f"{d['rank']}. PMID {d['doc_id']}, {d['score']} {unit}", *more]))
    return Outcome("\n\n".join(parts), [{"type": "pubmed", "pmids": [int(r["doc_id"]) for r in rows]}])


def taxon_details(hits: DataFrame, taxa: DataFrame) -> DataFrame:
    """Resolved names with rank, division, lineage and synonyms of each taxon,
    where ``taxa`` (tax_id and any of them) has them."""
    fields = [c for c in TAXON_FIELDS if c in taxa.columns]
    more = taxa.select(F.col("tax_id"), *[F.col(c).alias(f"taxon_{c}") for c in fields])
    return hits.join(more, "tax_id", "left").select(*hits.columns, *[f"taxon_{c}" for c in fields])


@tool
def ncbi_taxonomy_search(names: DataFrame, name: str, taxa: DataFrame | None = None) -> Outcome:
    """Up to five taxa for one name, best first (see ``search.resolve_names``),
    with their details when ``taxa`` is given."""
    terms = names.sparkSession.createDataFrame([(name,)], "term STRING")
    hits = search.resolve_names(terms, names, MAX_TAXONOMY_MATCHES).withColumn("url", ncbi_url(F.col("tax_id")))
    rows = (hits if taxa is None else taxon_details(hits, taxa)).orderBy("rank").collect()
    if not rows or not rows[0]["found"]:
        raise guard.GuardError(f"Error: no taxon is called {name!r}.")
    parts = [f"{len(rows)} taxon match(es) for {name!r}"]
    for r in rows:
        d = r.asDict()
        more = [f"{f}: {', '.join(v[:6]) if isinstance(v, list) else v}" for f in TAXON_FIELDS if (v := d.get(f"taxon_{f}"))]
        parts.append("\n".join([f"{d['rank']}. {d['name']} ({d['name_class']}, TaxID {d['tax_id']})", d["url"], *more]))
    return Outcome("\n\n".join(parts), [{"type": "ncbi_taxonomy", "url": rows[0]["url"], "tax_id": str(rows[0]["tax_id"])}])
