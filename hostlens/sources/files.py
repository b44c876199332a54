"""File sources and sinks: taxonomy CSV (S1), column dictionaries (S4),
bibliographic and taxonomy XML (S5, S6), agent logs (S7, L5), report
export (S8).  All are Spark readers/writers with explicit schemas; nothing
is read whole into the driver or into one task.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# -- S1 -----------------------------------------------------------------------------
TAXONOMY_SCHEMA = T.StructType([
    T.StructField("ORGANISM_NAME", T.StringType()),
    T.StructField("SPECIES_NAME", T.StringType()),
    T.StructField("FAMILY_NAME", T.StringType()),
])


def load_taxonomy(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  **options) -> DataFrame:
    """Header CSV, one row per taxon; doubled quotes and line breaks inside
    quoted fields are read as text.  Columns go by the header's names, all as
    strings (no inference pass over the data); with ``schema`` its columns
    are picked by name and cast, and one the file lacks is an error."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("quote", '"').option("escape", '"').option("multiLine", True).options(**options).csv(path))
    if schema is None:
        return df
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


# -- S4 -------------------------------------------------------------------------------
DICTIONARY_COLUMNS = ["dataset", "column_name", "description", "type"]


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_column_dictionary(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Column descriptions: CSV ``column_name, description, Type`` or JSON
    ``{"columns": [{"name"|"column_name", "description", "type"}], ...}``.
    A missing file warns and gives an empty dictionary."""
    empty = spark.createDataFrame([], ", ".join(f"{c} STRING" for c in DICTIONARY_COLUMNS))
    if not _path_exists(spark, path):
        warnings.warn(f"column description file not found: {path}")
        return empty
    if path.endswith(".json"):
        doc = spark.read.option("multiLine", True).json(path)
        cols = doc.select(F.explode("columns").alias("c"))
        fields = cols.schema["c"].dataType.fieldNames()
        name = F.col("c.column_name") if "column_name" in fields else F.col("c.name")
        ctype = F.col("c.type") if "type" in fields else F.col("c.Type") if "Type" in fields else F.lit(None)
        desc = F.col("c.description") if "description" in fields else F.lit(None)
        return cols.select(F.lit(dataset).alias("dataset"), name.cast("string").alias("column_name"),
                           desc.cast("string").alias("description"), ctype.cast("string").alias("type"))
    d = spark.read.option("header", True).csv(path)
    return d.select(F.lit(dataset).alias("dataset"), F.col("column_name"), F.col("description"),
                    F.col("Type").alias("type"))


def load_dictionary_document(spark: SparkSession, path: str) -> DataFrame:
    """Everything a JSON column dictionary says beside its columns (name,
    description, primary key, row definition, ...): one row (field, value)
    per top-level member, arrays and objects as JSON text."""
    doc = spark.read.option("multiLine", True).json(path)
    rest = [f for f in doc.schema if f.name != "columns"]
    plain = [F.struct(F.lit(f.name).alias("field"), (
        F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f"`{f.name}`").cast("string")
    ).alias("value")) for f in rest]
    return doc.select(F.explode(F.array(*plain)).alias("m")).select("m.field", "m.value") if rest else \
        spark.createDataFrame([], "field STRING, value STRING")


def undocumented_columns(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns of ``df`` that the dictionary does not describe (tiny: one row
    per column of the schema)."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(c, t) for c, t in df.dtypes], "column_name STRING, spark_type STRING")
    return cols.join(dictionary.select("column_name"), "column_name", "left_anti")


def with_column_comments(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """Attach descriptions as ``StructField.metadata['comment']``."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": descriptions[c]})
                       if c in descriptions else F.col(c) for c in df.columns])


# -- S5 -------------------------------------------------------------------------------------
# Fixed defaults that must equal the reference's.
NO_TITLE = "No title available"
NO_ABSTRACT = "No abstract available"
UNKNOWN_JOURNAL = "Unknown journal"
UNKNOWN_YEAR = "Unknown year"
NO_PMID = "N/A"

_VALUE = T.StructType([T.StructField("_VALUE", T.StringType())])
PUBMED_SCHEMA = T.StructType([
    T.StructField("MedlineCitation", T.StructType([
        T.StructField("PMID", _VALUE),
        T.StructField("Article", T.StructType([
            T.StructField("ArticleTitle", T.StringType()),
            T.StructField("Abstract", T.StructType([
                T.StructField("AbstractText", T.ArrayType(_VALUE)),
            ])),
            T.StructField("AuthorList", T.StructType([
                T.StructField("Author", T.ArrayType(T.StructType([
                    T.StructField("LastName", T.StringType()),
                    T.StructField("ForeName", T.StringType()),
                ]))),
            ])),
            T.StructField("Journal", T.StructType([
                T.StructField("Title", T.StringType()),
                T.StructField("JournalIssue", T.StructType([
                    T.StructField("PubDate", T.StructType([T.StructField("Year", T.StringType())])),
                ])),
            ])),
        ])),
    ])),
    T.StructField("PubmedData", T.StructType([
        T.StructField("ArticleIdList", T.StructType([
            T.StructField("ArticleId", T.ArrayType(T.StructType([
                T.StructField("_VALUE", T.StringType()),
                T.StructField("_IdType", T.StringType()),
            ]))),
        ])),
    ])),
])


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``PubmedArticle``: pmid, title, abstract (first
    AbstractText), first three authors as "Fore Last", journal, year, doi,
    url; the reference's defaults apply to missing elements."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path)
    art = F.col("MedlineCitation.Article")
    authors = F.filter(F.coalesce(art["AuthorList"]["Author"], F.array()), lambda a: a["LastName"].isNotNull())
    names = F.transform(authors, lambda a: F.when(a["ForeName"].isNotNull(),
                                                  F.concat_ws(" ", a["ForeName"], a["LastName"]))
                        .otherwise(a["LastName"]))
    ids = F.coalesce(F.col("PubmedData.ArticleIdList.ArticleId"), F.array())
    doi = F.try_element_at(F.filter(ids, lambda i: i["_IdType"] == "doi"), F.lit(1))["_VALUE"]
    pmid = F.coalesce(F.col("MedlineCitation.PMID._VALUE"), F.lit(NO_PMID))
    return raw.select(
        pmid.alias("pmid"),
        F.coalesce(art["ArticleTitle"], F.lit(NO_TITLE)).alias("title"),
        F.coalesce(F.try_element_at(art["Abstract"]["AbstractText"], F.lit(1))["_VALUE"], F.lit(NO_ABSTRACT)).alias("abstract"),
        F.slice(names, 1, 3).alias("authors"),
        F.coalesce(art["Journal"]["Title"], F.lit(UNKNOWN_JOURNAL)).alias("journal"),
        F.coalesce(art["Journal"]["JournalIssue"]["PubDate"]["Year"], F.lit(UNKNOWN_YEAR)).alias("year"),
        doi.alias("doi"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"),
    )


def author_line(authors) -> F.Column:
    """authors joined with ', ', or 'Unknown authors'."""
    return F.when(F.size(authors) > 0, F.array_join(authors, ", ")).otherwise(F.lit("Unknown authors"))


# -- S6 -------------------------------------------------------------------------------------
# Fixed values that must equal the reference's (tag order matters).
SYNONYM_TAGS = ("Synonym", "Acronym", "EquivalentName", "GenbankSynonym",
                "GenbankAcronym", "GenbankCommonName", "CommonName", "Inpart")
TAXON_SCHEMA = T.StructType([
    T.StructField("TaxId", T.StringType()),
    T.StructField("ScientificName", T.StringType()),
    T.StructField("Rank", T.StringType()),
    T.StructField("Division", T.StringType()),
    T.StructField("Lineage", T.StringType()),
    T.StructField("OtherNames", T.StructType(
        [T.StructField(t, T.ArrayType(T.StringType())) for t in SYNONYM_TAGS])),
])


def read_taxon_xml(spark: SparkSession, path: str) -> DataFrame:
    """Top-level ``Taxon`` records only (ancestors nested in ``LineageEx`` are
    not rows): tax_id, name, rank ('no rank' default), division, lineage,
    synonyms from the eight tags in fixed order."""
    raw = spark.read.format("xml").option("rowTag", "Taxon").schema(TAXON_SCHEMA).load(path)
    syn = F.flatten(F.array(*[F.coalesce(F.col(f"OtherNames.{t}"), F.array().cast("array<string>"))
                              for t in SYNONYM_TAGS]))
    syn = F.filter(syn, lambda s: s.isNotNull() & (s != ""))
    return raw.select(
        F.col("TaxId").alias("tax_id"), F.col("ScientificName").alias("name"),
        F.coalesce(F.nullif(F.col("Rank"), F.lit("")), F.lit("no rank")).alias("rank"),
        F.coalesce(F.col("Division"), F.lit("")).alias("division"),
        F.coalesce(F.col("Lineage"), F.lit("")).alias("lineage"),
        syn.alias("synonyms"))


def synonym_line(synonyms, n: int = 6) -> F.Column:
    """first ``n`` synonyms joined with ', '."""
    return F.array_join(F.slice(synonyms, 1, n), ", ")


# -- S7 / L5 ----------------------------------------------------------------------------------
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \| (\w+) \| (.*)$"
TAIL_DEFAULT, TAIL_MAX = 200, 2000


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``ts | LEVEL | message``; lines that do not parse keep NULL ts/level
    and the whole line as message."""
    v = F.col(value)
    ok = v.rlike(LOG_LINE)
    return lines.select(
        "*",
        F.when(ok, F.to_timestamp(F.regexp_extract(v, LOG_LINE, 1), "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.when(ok, F.regexp_extract(v, LOG_LINE, 2)).alias("level"),
        F.when(ok, F.regexp_extract(v, LOG_LINE, 3)).otherwise(v).alias("message"))


def read_logs(spark: SparkSession, path: str, month: str | None = None) -> DataFrame:
    """Monthly agent logs (``agent_YYYY-MM.log``): one row per line with the
    file, its month, a per-file line order key (byte block of the split, then
    line in it) and the parsed fields.  With ``month`` only that month's file
    below ``path`` is read."""
    if month is not None:
        if not re.fullmatch(r"\d{4}-\d{2}", month):
            raise ValueError(f"not a month: {month!r}")
        path = f"{path.rstrip('/')}/agent_{month}.log"
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("file"),
        # increasing in line order inside each split; splits of a file are
        # numbered in file order
        F.monotonically_increasing_id().alias("line_key"))
    raw = raw.withColumn("month", F.regexp_extract("file", r"(\d{4}-\d{2})", 1))
    return parse_log_lines(raw)


def log_lines(parsed: DataFrame) -> DataFrame:
    """month, ts, line_key and line (the whole text) of parsed log lines."""
    return parsed.select("month", "ts", "line_key", F.col("value").alias("line"))


def log_tail(spark: SparkSession, path: str, month: str, lines: int = TAIL_DEFAULT) -> DataFrame:
    """The last ``lines`` lines of one month's log (clamped to 1..2000), in
    file order; no other month's file is opened, and only ``lines`` rows
    leave each task."""
    n = max(1, min(int(lines), TAIL_MAX))
    return read_logs(spark, path, month).orderBy(F.col("line_key").desc()).limit(n).orderBy("line_key")


# -- T2 helpers --------------------------------------------------------------------------------
TOOL_MARKERS = ("TOOL_CALL", "TOOL_OK", "TOOL_FAIL")


def tool_events(parsed: DataFrame) -> DataFrame:
    """Tool markers in parsed log lines: (ts, marker, tool)."""
    marker = F.regexp_extract("message", r"^(TOOL_CALL|TOOL_OK|TOOL_FAIL)\b", 1)
    tool = F.trim(F.element_at(F.split("message", r"\|"), 2))
    return parsed.filter(marker != "").select("ts", marker.alias("marker"), tool.alias("tool"))


# -- S8 ------------------------------------------------------------------------------------------
def export_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per report (id, timestamp, user_email, user_comment,
    question, answer, executed_codes, recent_logs), partitioned by month, to
    a path that does not exist yet.  Lists may be arrays or their JSON text."""
    arr = "ARRAY<STRING>"

    def listed(name: str) -> F.Column:
        value = F.col(name) if isinstance(reports.schema[name].dataType, T.ArrayType) else F.from_json(name, arr)
        return F.coalesce(value, F.array().cast(arr)).alias(name)

    out = reports.select(
        "id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "user_email", F.col("comment").alias("user_comment") if "comment" in reports.columns
        else F.lit(None).cast("string").alias("user_comment"),
        "question", "answer",
        listed("executed_codes"), listed("recent_logs"),
        F.date_format("created_at", "yyyy-MM").alias("month"))
    out.write.partitionBy("month").json(path)
