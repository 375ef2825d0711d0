"""Schema v2: the canonical record every source is mapped to."""

from pyspark.sql import types as T

META_TYPE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("nct", T.StringType()),
    T.StructField("spl_set_id", T.StringType()),
    T.StructField("isic_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("sex", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("modalities", T.ArrayType(T.StringType())),
])

LABELS_TYPE = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

RECORD_V2 = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("modality", T.ArrayType(T.StringType())),
    T.StructField("task", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("image_path", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("labels", LABELS_TYPE),
    T.StructField("meta", META_TYPE),
    T.StructField("split", T.StringType()),
])

RECORD_FIELDS = [f.name for f in RECORD_V2.fields]

# Flat projection used wherever records are compared, grouped or written as rows.
FLAT_RECORD_COLUMNS = [
    "id", "modality", "task", "text", "image_path", "answer", "rationale",
    "labels_icd10", "labels_snomed", "source", "license", "split",
]
