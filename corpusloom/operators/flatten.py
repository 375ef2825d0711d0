"""Raw payloads / metadata rows -> schema-v2 records.

Each operator reads a DataFrame of raw API payload strings (``payload``) or of
CSV-like string columns and returns records.  All parsing is ``from_json``
with explicit schemas (JVM-side, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import falsy_coalesce, mint_id, truncate
from .clean import join_image_path, meta_struct

def _codes0() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def _record(id_col: Column, text: Column, task: str, source: str, license: str, modality: str = "text",
            image_path: Column | None = None, answer: Column | None = None, labels: Column | None = None,
            **meta) -> list[Column]:
    return [
        id_col.alias("id"),
        F.array(F.lit(modality)).alias("modality"),
        F.lit(task).alias("task"),
        text.cast("string").alias("text"),
        (image_path if image_path is not None else F.lit(None)).cast("string").alias("image_path"),
        (answer if answer is not None else F.lit(None)).cast("string").alias("answer"),
        F.lit(None).cast("string").alias("rationale"),
        (labels if labels is not None else F.create_map().cast("map<string,array<string>>")).alias("labels"),
        meta_struct(source, license, **meta).alias("meta"),
        F.lit(K.DEFAULT_SPLIT).alias("split"),
    ]


PUBMED_REC = "struct<title:string,pubdate:string,authors:array<struct<name:string>>,fulljournalname:string>"


def flatten_pubmed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """esummary pages -> (pmid, title, pubdate, authors, journal, source) in uid order.

    The result object has dynamic keys, so it is read as map<string,string>
    (values stay raw JSON); uids without an entry, or with an empty one, are skipped.
    """
    m = df.select(F.from_json(F.col(payload), "struct<result:map<string,string>>").alias("p"))
    m = m.select(F.col("p.result").alias("r"))
    # The entries are looked up inside the page, so a row carries its own entry and not the whole page.
    entry = F.transform(F.from_json(F.col("r")["uids"], "array<string>"), lambda k: F.struct(k.alias("uid"), F.col("r")[k].alias("raw")))
    u = m.select(F.explode(entry).alias("u")).select("u.uid", "u.raw")
    u = u.filter(F.col("raw").isNotNull() & (F.size(F.json_object_keys("raw")) > 0))
    rec = F.from_json("raw", PUBMED_REC)
    return u.select(
        F.col("uid").alias("pmid"), rec["title"].alias("title"), rec["pubdate"].alias("pubdate"),
        F.transform(F.coalesce(rec["authors"], F.array()), lambda a: a["name"]).alias("authors"),
        rec["fulljournalname"].alias("journal"), F.lit("pubmed_esummary").alias("source"))


TRIAL = ("struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,"
         "conditionsModule:struct<conditions:array<string>>,statusModule:struct<overallStatus:string>,"
         "descriptionModule:struct<briefSummary:string>>>")


def flatten_trials(df: DataFrame, payload: str = "payload") -> DataFrame:
    """study -> summarize record, text '{title} ({nct}). Conditions=... Status=... Summary: ...'."""
    s = F.from_json(F.col(payload), TRIAL)["protocolSection"]
    nct = F.coalesce(s["identificationModule"]["nctId"], F.lit(""))
    title = F.coalesce(s["identificationModule"]["briefTitle"], F.lit(""))
    conds = F.array_join(F.coalesce(s["conditionsModule"]["conditions"], _codes0()), ", ")
    status = F.coalesce(s["statusModule"]["overallStatus"], F.lit(""))
    desc = F.coalesce(s["descriptionModule"]["briefSummary"], F.lit(""))
    text = F.concat(title, F.lit(" ("), nct, F.lit("). Conditions="), conds, F.lit(". Status="), status,
                    F.lit(". Summary: "), desc)
    return df.select(*_record(mint_id("ct", F.coalesce(F.nullif(nct, F.lit("")), F.md5(F.col(payload)))), text, "summarize", "clinicaltrials", "public-domain", nct=nct))


LABEL_DOC = ("struct<openfda:struct<brand_name:array<string>,generic_name:array<string>>,"
             "boxed_warning:array<string>,adverse_reactions:array<string>,indications_and_usage:array<string>,"
             "spl_set_id:string>")


def _first_or_empty(arr: Column) -> Column:
    """' '.join(list[:1]): first element or ''."""
    return F.when(F.size(F.coalesce(arr, _codes0())) > 0, F.coalesce(F.get(arr, 0), F.lit(""))).otherwise(F.lit(""))


def flatten_labels(df: DataFrame, payload: str = "payload") -> DataFrame:
    """drug label -> record; product = brand, else generic, else 'unknown' (empty lists fall through)."""
    d = F.from_json(F.col(payload), LABEL_DOC)
    brand, generic = d["openfda"]["brand_name"], d["openfda"]["generic_name"]
    product = (F.when(F.size(F.coalesce(brand, _codes0())) > 0, F.get(brand, 0))
                .when(F.size(F.coalesce(generic, _codes0())) > 0, F.get(generic, 0))
                .otherwise(F.lit("unknown")))
    text = F.concat(F.lit("Label for "), F.coalesce(product, F.lit("None")), F.lit(". Indications: "),
                    _first_or_empty(d["indications_and_usage"]), F.lit(". Boxed warning: "),
                    _first_or_empty(d["boxed_warning"]), F.lit(". Adverse reactions: "),
                    _first_or_empty(d["adverse_reactions"]))
    spl = F.coalesce(d["spl_set_id"], F.lit(""))
    key = F.coalesce(F.nullif(spl, F.lit("")), F.md5(F.col(payload)))
    return df.select(*_record(mint_id("openfda", key), text, "summarize", "openfda", "public-domain",
                              spl_set_id=spl))


SPL_DOC = "struct<data:struct<title:string,sections:array<struct<code:string,text:string>>>>"


def _last_section(sections: Column, code: str) -> Column:
    """Text of the last section with this code (dict built in order: last duplicate wins)."""
    hits = F.filter(F.coalesce(sections, F.array()), lambda s: F.coalesce(s["code"], F.lit("")) == code)
    return F.when(F.size(hits) > 0, F.coalesce(F.element_at(hits, -1)["text"], F.lit("")))


def flatten_spl(df: DataFrame, payload: str = "payload") -> DataFrame:
    """SPL -> ddi record: '{title}. Indications: {600}. Interactions: {600}'."""
    d = F.from_json(F.col(payload), SPL_DOC)["data"]
    secs = d["sections"]
    ind_codes = K.SPL_INDICATIONS_CODES
    indications = falsy_coalesce(_last_section(secs, ind_codes[0]), _last_section(secs, ind_codes[1]))
    ddix = falsy_coalesce(_last_section(secs, K.SPL_INTERACTIONS_CODE))
    text = F.concat(F.coalesce(d["title"], F.lit("")), F.lit(". Indications: "), truncate(indications, K.SPL_SECTION_CHARS),
                    F.lit(". Interactions: "), truncate(ddix, K.SPL_SECTION_CHARS))
    # Labels often share a title, so the id is of title and text.
    return df.select(*_record(mint_id("dailymed", F.coalesce(d["title"], F.lit("")), F.md5(text)), text, "ddi", "dailymed", "public-domain"))


def flatten_chexpert(df: DataFrame, images_root: str) -> DataFrame:
    """CSV rows (Path, Cardiomegaly) -> image classification records."""
    answer = F.when(F.coalesce(F.col("Cardiomegaly"), F.lit("")) == "1.0", F.lit("Cardiomegaly")) \
        .otherwise(F.lit("No cardiomegaly"))
    path = join_image_path(F.lit(images_root), F.col("Path"))
    return df.select(*_record(mint_id("chexpert", F.col("Path")), F.lit(None), "classification", "chexpert", "custom",
                              modality="image", image_path=path, answer=answer))


def _empty_labels() -> Column:
    return F.create_map(F.lit("icd10"), _codes0(), F.lit("snomed"), _codes0())


def flatten_isic_csv(df: DataFrame, images_dir: str) -> DataFrame:
    """metadata rows -> records; file = file_name or image or name (row dropped if none)."""
    c = set(df.columns)
    g = lambda n: F.col(n) if n in c else F.lit(None).cast("string")
    fn = falsy_coalesce(g("file_name"), g("image"), g("name"), default=None)
    dx = falsy_coalesce(g("diagnosis_3"), g("diagnosis"), default=None)
    out = df.withColumn("_fn", fn).filter(F.col("_fn").isNotNull())
    return out.select(*_record(mint_id("isic", g("isic_id"), F.col("_fn")), F.lit(None), "classification", "isic_cli", "CC-BY",
                               modality="image", image_path=join_image_path(F.lit(images_dir), F.col("_fn")),
                               answer=dx, labels=_empty_labels(), isic_id=g("isic_id")))


def flatten_isic_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """no metadata CSV: one record per image file (answer null)."""
    p = F.translate(F.col(path_col), "\\", "/")
    return files.select(*_record(mint_id("isic", p), F.lit(None), "classification", "isic_cli", "CC-BY",
                                 modality="image", image_path=p, labels=_empty_labels()))


def flatten_ham10000(meta: DataFrame, inventory: DataFrame, images_root: str, name_col: str = "name") -> DataFrame:
    """rows whose '{image_id}.jpg' exists in the file inventory (left-semi join)."""
    m = meta.withColumn("_file", F.concat(F.col("image_id").cast("string"), F.lit(".jpg")))
    inv = inventory.select(F.col(name_col).alias("_file")).distinct()
    m = m.join(inv, "_file", "left_semi")
    age = F.when(F.isnan(F.col("age").cast("double")), F.lit(None)).otherwise(F.col("age").cast("double").cast("int"))
    return m.select(*_record(mint_id("isic", F.col("_file")), F.lit(None), "classification", "isic_ham10000", "CC-BY",
                             modality="image", image_path=join_image_path(F.lit(images_root), F.col("_file")),
                             answer=F.col("dx").cast("string"), labels=_empty_labels(),
                             age=age, sex=F.col("sex"), site=F.col("localization")))


MODALITY_RE = r"_(flair|t1ce|t1|t2)\.nii[^/]*$"


def group_subject_modalities(files: DataFrame, out_img_dir: str, path_col: str = "path") -> DataFrame:
    """per subject folder, the first file of each modality (min path); subjects with none dropped.

    Record image = composite when two or more modalities exist, else the single slice.
    """
    p = F.translate(F.col(path_col), "\\", "/")
    f = files.select(p.alias("p"))
    f = f.select("p", F.regexp_extract("p", r"^(.*)/[^/]*$", 1).alias("folder"),
                 F.regexp_extract("p", MODALITY_RE, 1).alias("mod")).filter(F.col("mod") != "")
    f = f.withColumn("subject", F.regexp_extract("folder", r"([^/]*)$", 1))
    mods = K.BRATS_MODALITIES
    g = f.groupBy("folder", "subject").pivot("mod", mods).agg(F.min("p"))
    present = F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.lit(m)) for m in mods]))
    g = g.withColumn("modalities", present)
    target = F.when(F.size("modalities") >= 2, F.concat(F.lit(out_img_dir + "/"), F.col("subject"), F.lit("_composite.png"))) \
        .otherwise(F.concat(F.lit(out_img_dir + "/"), F.col("subject"), F.lit("_"), F.get("modalities", 0), F.lit(".png")))
    return g.select(*_record(mint_id("brats", F.col("folder")), F.lit(None), "classification", "brats", "research-only",
                             modality="image", image_path=F.translate(target, "\\", "/"),
                             modalities=F.col("modalities")), *[F.col(m).alias(f"src_{m}") for m in mods])
