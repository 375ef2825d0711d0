"""Unify, clean and filter records (schema v2).  Pure DataFrame expressions:
no shuffle except where a count or a dedup needs one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import falsy_coalesce, nonempty, normalize_text, truncate
from ..schema import LABELS_TYPE, META_TYPE
from ..session import evaluate_once


def _empty_codes() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def meta_struct(source=None, license=None, **extra) -> Column:
    """Build a schema-v2 meta struct; unspecified fields are null."""
    given = {"source": source, "license": license, **extra}
    fields = []
    for f in META_TYPE.fields:
        v = given.get(f.name)
        if v is None:
            v = F.lit(None)
        elif not isinstance(v, Column):
            v = F.lit(v)
        fields.append(v.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def conform_meta(df: DataFrame, name: str = "meta") -> Column:
    """Re-shape whatever meta struct a source has into META_TYPE; fields it does not know follow unchanged."""
    dt = df.schema[name].dataType
    have = {f.name for f in dt.fields} if isinstance(dt, T.StructType) else set()
    c = F.col(name)
    fields = [
        (c.getField(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in META_TYPE.fields
    ]
    known = {f.name for f in META_TYPE.fields}
    if isinstance(dt, T.StructType):
        fields += [c.getField(f.name).alias(f.name) for f in dt.fields if f.name not in known]
    return F.when(c.isNotNull(), F.struct(*fields))


def _defaults() -> dict[str, Column]:
    return {
        "id": F.lit(None).cast("string"),
        "modality": F.array(*[F.lit(m) for m in K.DEFAULT_MODALITY]),
        "task": F.lit(K.DEFAULT_TASK),
        "text": F.lit(None).cast("string"),
        "image_path": F.lit(None).cast("string"),
        "answer": F.lit(None).cast("string"),
        "rationale": F.lit(None).cast("string"),
        "labels": F.create_map().cast(LABELS_TYPE),
        "meta": meta_struct(K.DEFAULT_SOURCE, K.DEFAULT_LICENSE),
        "split": F.lit(K.DEFAULT_SPLIT),
    }


def unify(df: DataFrame, strict_presence: bool = False, raw_col: str = "raw",
          icd10_codes: Column | None = None, snomed_codes: Column | None = None,
          title_as_text: bool = False, vocab: DataFrame | None = None) -> DataFrame:
    """Fill the ten schema-v2 defaults, normalise text, add label keys.

    Default mode treats an explicit null like a missing key.  With
    ``strict_presence`` the raw JSON line in ``raw_col`` decides: a key that is
    present with value null stays null, exactly like ``dict.setdefault``.
    ``icd10_codes``/``snomed_codes`` are code-array columns computed by the
    labelling operators; with ``vocab`` the normalised texts are labelled here
    (keys that a record has already are kept); without either the added label
    lists are empty (no vocabulary shipped).  Unknown columns pass through
    untouched, as do unknown fields of meta.
    """
    cols = set(df.columns)
    out = df
    if title_as_text and "title" in cols:
        out = out.withColumn("text", F.coalesce(F.col("text"), F.col("title")) if "text" in cols else F.col("title"))
        cols.add("text")
    if "meta" in cols:
        out = out.withColumn("meta", conform_meta(out, "meta"))
    if "labels" in cols:
        out = out.withColumn("labels", F.col("labels").cast(LABELS_TYPE))
    keys = F.json_object_keys(F.col(raw_col)) if strict_presence else None
    new = {}
    defaults = _defaults()
    if "meta" in cols:
        own = [f for f in out.schema["meta"].dataType.fields if f.name not in {k.name for k in META_TYPE.fields}]
        defaults["meta"] = F.struct(*[defaults["meta"][f.name].alias(f.name) for f in META_TYPE.fields],
                                    *[F.lit(None).cast(f.dataType).alias(f.name) for f in own])
    for name, default in defaults.items():
        if name not in cols:
            new[name] = default
        elif strict_presence:
            new[name] = F.when(F.array_contains(keys, name), F.col(name)).otherwise(default)
        else:
            new[name] = F.coalesce(F.col(name), default)
    out = out.withColumns(new)
    out = out.withColumn("text", F.when(nonempty("text"), normalize_text("text")).otherwise(F.col("text")))
    out = evaluate_once(out, "text")
    if vocab is not None:
        from .label import auto_label

        return auto_label(out, vocab)
    icd = icd10_codes if icd10_codes is not None else _empty_codes()
    sno = snomed_codes if snomed_codes is not None else _empty_codes()
    added = F.map_filter(
        F.create_map(F.lit("icd10"), icd, F.lit("snomed"), sno),
        lambda k, v: ~F.map_contains_key(F.col("labels"), k),
    )
    labels = F.when(nonempty("text"), F.map_concat(F.col("labels"), added)).otherwise(F.col("labels"))
    return out.withColumn("labels", labels)


def flat_records(df: DataFrame, keep=()) -> DataFrame:
    """Scalar projection of records (maps/arrays joined) for grouping, output and checks."""
    return df.select(
        *keep, "id",
        F.array_join("modality", ",").alias("modality"),
        "task", "text", "image_path", "answer", "rationale",
        F.array_join(F.try_element_at("labels", F.lit("icd10")), ",").alias("labels_icd10"),
        F.array_join(F.try_element_at("labels", F.lit("snomed")), ",").alias("labels_snomed"),
        F.col("meta.source").alias("source"),
        F.col("meta.license").alias("license"),
        "split",
    )


def merge_sources(*dfs: DataFrame) -> DataFrame:
    """Union all of every source, columns unioned by name (no dedup)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def normalize_column(df: DataFrame, col: str = "text") -> DataFrame:
    """C03."""
    return df.withColumn(col, normalize_text(col))


def nonempty_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop null/empty text."""
    return df.filter(nonempty(col))


def language_allow(df: DataFrame, allow=None, col: str = "lang") -> DataFrame:
    """Keep allowed languages (default ``en``)."""
    return df.filter(F.col(col).isin(list(allow or K.ALLOWED_LANGUAGES)))


def min_text_len(df: DataFrame, n: int = K.MIN_TEXT_LEN, col: str = "text") -> DataFrame:
    """Keep texts with at least n code points (apply after normalisation)."""
    return df.filter(F.length(col) >= n)


def license_allow(df: DataFrame, allow=None, col: Column | str = "meta.license") -> DataFrame:
    """Keep records whose license is in the allow list (a literal IN list, pushed to scans)."""
    c = F.col(col) if isinstance(col, str) else col
    return df.filter(c.isin(list(allow or K.ALLOWED_LICENSES)))


def truncate_text(df: DataFrame, n: int, col: str = "text", out: str | None = None) -> DataFrame:
    """First n code points."""
    return df.withColumn(out or col, truncate(col, n))


def join_image_path(root: Column | str, rel: Column | str) -> Column:
    """C11: join(root, rel) with backslashes turned into forward slashes.

    Like os.path.join: an absolute ``rel`` replaces ``root``; a root ending in a
    separator is not doubled.
    """
    r = F.col(root) if isinstance(root, str) else root
    p = F.col(rel) if isinstance(rel, str) else rel
    joined = F.when(p.startswith("/"), p).when(
        (r == "") | r.endswith("/") | r.endswith("\\"), F.concat(r, p)
    ).otherwise(F.concat(r, F.lit("/"), p))
    return F.translate(joined, "\\", "/")


def corpus_profile(df: DataFrame, step: str, by=("source", "split")) -> DataFrame:
    """Row counts per step / group (partial aggregation, one small shuffle)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step))


def observe_counts(df: DataFrame, step: str):
    """C12 without a second pass: attach row/empty-text counts to the job that writes ``df``.

    Returns (df, observation); ``observation.get`` holds {"rows", "empty_text"}
    once an action on the returned DataFrame has finished.
    """
    from pyspark.sql import Observation

    obs = Observation(step)
    has_text = "text" in df.columns
    metrics = [F.count(F.lit(1)).alias("rows")]
    if has_text:
        metrics.append(F.sum(F.when(nonempty("text"), 0).otherwise(1)).alias("empty_text"))
    return df.observe(obs, *metrics), obs


def concat_fields(df: DataFrame, fields=None, out: str = "text") -> DataFrame:
    """Text from the configured fields, empty/null fields skipped, space separated."""
    fields = [f for f in (fields or K.RAG_FIELDS) if f in df.columns]
    return df.withColumn(out, F.concat_ws(" ", *[F.nullif(F.col(f), F.lit("")) for f in fields]))


def redact_pii(df: DataFrame, col: str = "text") -> DataFrame:
    """Mask e-mail, IPv4 and phone numbers and count each kind (rules are ours)."""
    c = F.col(col)
    out = df.withColumns({
        "n_email": F.regexp_count(c, F.lit(EMAIL_RE)),
        "n_ip": F.regexp_count(c, F.lit(IPV4_RE)),
    })
    masked = F.regexp_replace(F.regexp_replace(c, EMAIL_RE, "[EMAIL]"), IPV4_RE, "[IP]")
    out = out.withColumn("_masked", masked)
    out = out.withColumn("n_phone", F.regexp_count(F.col("_masked"), F.lit(PHONE_RE)))
    return out.withColumn(col, F.regexp_replace("_masked", PHONE_RE, "[PHONE]")).drop("_masked")


# Our own masking rules (the configuration only names the flag).  Written in the
# regex subset Java and RE2 share, so the SQL oracle uses the same strings.
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4_RE = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
PHONE_RE = r"\+?[0-9][0-9 ()-]{7,}[0-9]"


def falsy(*cols, default: str | None = "") -> Column:
    return falsy_coalesce(*cols, default=default)
