"""Sources and sinks: JSON Lines, CSV, JSON maps, file inventories, images,
result documents, retrieval tables, tokenizer corpora, landed HTTP responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import WS_CLASS_JAVA, col_

# FIXED VALUES: control characters removed before the second parse attempt
# (everything below 0x20 except tab, line feed and carriage return).
CTL_CLASS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"


# --------------------------------------------------------------------------- JSON Lines
def read_jsonl(spark: SparkSession, paths, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One record per non-blank line; ``.gz`` decompressed by codec; malformed lines fail
    the job (FAILFAST) unless ``strict=False`` (then they land in ``_corrupt_record``)."""
    r = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return r.json(paths)


def read_jsonl_dirs(spark: SparkSession, dirs: list[str], schema: T.StructType | str,
                    glob: str = "*.jsonl", with_path: bool = False) -> DataFrame:
    """Non-recursive ``*.jsonl`` files of several folders, concatenated (``.gz`` not matched)."""
    r = (spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", glob)
         .option("recursiveFileLookup", "false"))
    df = r.json(list(dirs))
    return df.withColumn("source_file", F.col("_metadata.file_path")) if with_path else df


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """One JSON object per line, nulls written (not dropped), non-ASCII kept as is."""
    w = df.write.mode(mode).option("ignoreNullFields", "false")
    if compression:
        w = w.option("compression", compression)
    w.json(path)


# --------------------------------------------------------------------------- CSV
def read_csv_records(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Header CSV with every value a string (no inference); quoted fields may span lines."""
    r = (spark.read.option("header", "true").option("multiLine", "true").option("quote", '"')
         .option("escape", '"').option("inferSchema", "false"))
    if columns:
        r = r.schema(", ".join(f"`{c}` string" for c in columns))
    return r.csv(path)


# --------------------------------------------------------------------------- JSON maps
def read_json_map(spark: SparkSession, path: str, value_type: str = "array<string>") -> DataFrame:
    """Whole-file JSON object -> (pos, key, value) in file order; absent file -> empty."""
    from ..operators.label import read_json_map as _r
    return _r(spark, path, value_type)


# --------------------------------------------------------------------------- results
RESULT_SCHEMA = ("dataset string, mode string, role string, n bigint, metrics map<string,double>, "
                 "timestamp bigint")


def write_result_json(results: DataFrame, path: str) -> None:
    """Append run results (one JSON document per run) to a results folder."""
    results.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, pattern: str, multiline: bool = False) -> DataFrame:
    """Every result document matching the glob (pretty-printed files need multiline)."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", str(multiline).lower()).json(pattern)


# --------------------------------------------------------------------------- files and images
def list_files(spark: SparkSession, root: str, exts=K.IMAGE_EXTENSIONS) -> DataFrame:
    """Recursive inventory (path, name, length); extension match is case-insensitive,
    backslashes become slashes.  The file content column is pruned, never read."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
         .select("path", "length"))
    p = F.translate(F.regexp_replace("path", "^file:", ""), "\\", "/")
    f = f.select(p.alias("path"), F.regexp_extract(p, r"([^/]*)$", 1).alias("name"), "length")
    low = F.lower("name")
    cond = F.lit(False)
    for e in exts:
        cond = cond | low.endswith(e.lower())
    return f.filter(cond)


def image_min_resolution(spark: SparkSession, root: str, min_w: int = K.IMAGE_MIN_RESOLUTION[0],
                         min_h: int = K.IMAGE_MIN_RESOLUTION[1]) -> DataFrame:
    """(path, width, height, ok) for readable images; undecodable files are dropped
    (they count as not valid)."""
    img = (spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true")
           .load(root))
    p = F.translate(F.regexp_replace("image.origin", "^file:", ""), "\\", "/")
    return img.select(p.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
                      ((F.col("image.width") >= min_w) & (F.col("image.height") >= min_h)).alias("ok"))


# --------------------------------------------------------------------------- landed payloads
def parse_json_tolerant(df: DataFrame, col: str, schema: T.StructType, out: str = "parsed",
                        status: str = "parse_status") -> DataFrame:
    """Parse with control characters allowed inside strings; if that fails, strip
    control characters and parse again; rows failing both get status 'failed' (quarantine).
    ``<out>_text`` holds the text that parsed (raw or cleaned).

    A malformed text yields a struct of nulls (not null) in from_json, so the
    decision uses the corrupt-record column, not coalesce.
    """
    sch = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    opts = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_corrupt_record"}
    c = F.col(col)
    cleaned = F.regexp_replace(c, CTL_CLASS, "")
    p1 = F.from_json(c, sch, opts)
    p2 = F.from_json(cleaned, sch, opts)
    ok1 = c.isNotNull() & p1["_corrupt_record"].isNull()
    ok2 = c.isNotNull() & p2["_corrupt_record"].isNull()
    fields = [f.name for f in schema.fields]
    pick = lambda p: F.struct(*[p[f].alias(f) for f in fields])
    return df.withColumns({
        out: F.when(ok1, pick(p1)).when(ok2, pick(p2)),
        status: F.when(ok1, F.lit("ok")).when(ok2, F.lit("cleaned")).otherwise(F.lit("failed")),
        f"{out}_text": F.when(ok1, c).when(ok2, cleaned),     # the text that parsed (for key presence)
    })


def json_parses(c: Column) -> Column:
    """Strict JSON validity (any JSON value)."""
    return F.try_parse_json(c).isNotNull()


def triage_responses(df: DataFrame, status: str = "status", content_type: str = "content_type",
                     body: str = "body") -> DataFrame:
    """Classify landed HTTP responses as 'ok' or 'retry' (with the reason), in the order
    the fetch loop checks them.  A 404 whose body is valid JSON under a JSON content type is 'ok'."""
    st = F.col(status)
    ct = F.lower(F.coalesce(F.col(content_type), F.lit("")))
    b = F.coalesce(F.col(body), F.lit(""))
    strict_ok = json_parses(b)
    tolerant_ok = strict_ok | json_parses(F.regexp_replace(b, CTL_CLASS, ""))
    starts_lt = F.regexp_replace(b, f"^{WS_CLASS_JAVA}+", "").startswith("<")
    reason = (F.when(st.isin(*K.RETRY_STATUS), F.lit("server_status"))
               .when(ct.contains("text/html") | ct.contains("xml"), F.lit("non_json_type"))
               .when(ct.contains("application/json"),
                     F.when(strict_ok, F.lit("ok")).when(starts_lt, F.lit("html_as_json"))
                      .when(tolerant_ok, F.lit("ok")).otherwise(F.lit("unparseable")))
               .when(st >= 400, F.lit("http_error"))
               .when(tolerant_ok, F.lit("ok")).otherwise(F.lit("unparseable")))
    return df.withColumns({"reason": reason,
                           "action": F.when(reason == "ok", F.lit("ok")).otherwise(F.lit("retry"))})


# --------------------------------------------------------------------------- tables
def write_retrieval_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(id, passage_no, text, source, license, embedding) as parquet, keyed by id and passage (not by position)."""
    cols = ["id", "passage_no", "text", "source", "license", "embedding"]
    df.select(*[c for c in cols if c in df.columns]).write.mode(mode).parquet(path)


def read_retrieval_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tokenizer_corpus(lines: DataFrame, path: str, col: str = "line") -> None:
    """One text line per row."""
    lines.select(col_(col).alias("value")).write.mode("overwrite").text(path)


def ingest_cap(df: DataFrame, max_docs: int | None, order_by: str = "id") -> DataFrame:
    """Stop after max_docs records in key order (0/None = all)."""
    from ..operators.split import limit_rows
    return limit_rows(df, max_docs, order_by)
