"""Table loading and record-shaped views derived from the driver tables.

Everything here is a lazy DataFrame over the given parquet tables, so the work
of every registered query grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators.clean import meta_struct

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# FIXED VALUES: license catalogue used to give every test source a license
# (the allow list followed by two licenses outside it).
LICENSE_CATALOGUE = ["public-domain", "CC-BY", "CC-BY-NC", "ODbL", "MIT", "custom", "unknown"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def license_of(source_col) -> F.Column:
    """Deterministic license per source name: catalogue[md5(source)[:2 hex] mod 7]."""
    idx = F.conv(F.substring(F.md5(source_col), 1, 2), 16, 10).cast("int") % F.lit(len(LICENSE_CATALOGUE))
    return F.element_at(F.array(*[F.lit(x) for x in LICENSE_CATALOGUE]), idx + 1)


def documents_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> partial schema-v2 records (id, text, meta); unify fills the rest."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
        "text", "lang",
        meta_struct(F.col("source"), license_of(F.col("source"))).alias("meta"),
    )


def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("bench_"), F.col("item_id").cast("string")).alias("id"), "text",
                    F.lit("benchmark").alias("source"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        "text", F.lit("conversations").alias("source"), "role",
    )


def qa_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer items from conversations: each user turn and the reply numbered after it.

    id = conv_id*100 + turn, question = user text, pred = the text of turn+1
    when that turn is an assistant turn (else ''), gold = the user text itself,
    type by conversation: mcq / yn / short in turn.  An equi-join on
    (conv_id, turn) pairs the turns, so a very long conversation spreads over
    tasks instead of being sorted in one window partition.
    """
    c = load(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("_nrole"),
                   F.col("text").alias("_ntext"))
    t = c.filter(F.col("role") == "user").join(nxt, ["conv_id", "turn"], "left")
    t = t.withColumn("pred", F.when(F.col("_nrole") == "assistant", F.col("_ntext")).otherwise(F.lit("")))
    qtype = F.element_at(F.array(F.lit("mcq"), F.lit("yn"), F.lit("short")), (F.col("conv_id") % 3 + 1).cast("int"))
    return t.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        "conv_id", "turn", qtype.alias("type"),
        F.col("text").alias("question"), "pred", F.col("text").alias("gold"),
    )


# FIXED VALUES: interaction rules over the part-name vocabulary of the driver
# tables (same shape as the shipped rule file), used by the basket queries.
BASKET_RULES = {
    "synonyms": {
        "plate": ["red plate", "blue plate", "hot plate"],
        "ring": ["hot ring", "small ring"],
        "gizmo": ["red plate", "old gizmo"],
    },
    "pairs": [
        {"a": "plate", "b": "ring", "note": "plates and rings ↑ wear — avoid"},
        {"a": "old rod", "b": "new rod", "note": "mixed rod ages"},
        {"a": "gizmo", "b": "plate", "note": "gizmo on plate"},
    ],
    "classes": [
        {"classA": ["gearish"], "classB": ["boltish"], "note": "gear before bolt"},
        {"classA": ["boltish", "hotstuff"], "classB": ["gearish"], "note": "bolt or hot item before gear"},
    ],
    "class_members": {
        "gearish": ["Small Gear", "large gear", "cold gear"],
        "boltish": ["new bolt", "old bolt", "hot bolt"],
        "hotstuff": ["hot bolt", "hot gizmo", "plate", "Small Gear"],
    },
}


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets = orders; items = their line items' part names in line order.

    Even lines carry the name upper-cased with a leading space, to exercise
    the lower/strip step of the canonical-name lookup.
    """
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_name"))
    return j.select(F.col("l_orderkey").alias("basket"), F.col("l_linenumber").alias("pos"), name.alias("name"))


# FIXED VALUES: test vocabularies.  FUZZY_VOCAB targets the part-name
# vocabulary (near spellings, a one-letter term, two systems); PHRASE_VOCAB
# holds words and phrases of the generated document prose.
FUZZY_VOCAB = [
    ("icd10", "small rings", ["R10", "R11"]),
    ("icd10", "red widgets", ["W20"]),
    ("icd10", "blue bolt", ["B30", "R10"]),
    ("icd10", "hot gears", ["G40"]),
    ("icd10", "cold anvils", ["A50"]),
    ("icd10", "large plate", ["P60"]),
    ("icd10", "old rods", ["D70"]),
    ("icd10", "new gizmo", ["Z80"]),
    ("icd10", "x", ["X90"]),
    ("icd10", "blue bolts", ["B31"]),
    ("snomed", "small ring", ["1001"]),
    ("snomed", "hot gear", ["1002", "1003"]),
    ("snomed", "hot gears", ["1004"]),
    ("snomed", "Red Plate", ["1005"]),
    ("snomed", "new widget", ["1006"]),
    ("rxnorm", "old gizmos", ["RX1"]),
    ("meddra", "cold plates", ["M1"]),
]

PHRASE_VOCAB = [
    ("icd10", "of the", ["T001"]),
    ("icd10", "de la", ["T002", "T003"]),
    ("icd10", "In the", ["T004"]),
    ("icd10", "orantion", ["T005"]),
    ("icd10", "hehely hehely", ["T006"]),
    ("icd10", "und", ["T007"]),
    ("icd10", "der der die", ["T008"]),
    ("icd10", "to the", ["T001", "T009"]),
    ("icd10", "worthless", ["T010"]),
    ("icd10", "the and of the", ["T011"]),
]


# --------------------------------------------------------------------------- raw payload fixtures
def pubmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """esummary-style pages built from orders: one page per (customer, block of 1000 order keys).

    Every 7th order has an empty entry and every page lists one extra uid
    without an entry (both must be skipped).  Page size is bounded by the key
    block, so no customer becomes one unbounded payload.
    """
    o = load(spark, sf_dir, "orders")
    uid = F.col("o_orderkey").cast("string")
    rec = F.to_json(F.struct(
        F.concat(F.lit("Order "), uid, F.lit(" status "), F.col("o_orderstatus")).alias("title"),
        F.date_format("o_orderdate", "yyyy MMM dd").alias("pubdate"),
        F.array(F.struct(F.col("o_orderpriority").alias("name")), F.struct(F.lit("clerk").alias("name"))).alias("authors"),
        F.concat(F.lit("Journal of "), F.col("o_orderstatus")).alias("fulljournalname")))
    entry = F.concat(F.to_json(F.array(uid)).substr(F.lit(2), F.length(F.to_json(F.array(uid))) - 2), F.lit(":"),
                     F.when(F.col("o_orderkey") % 7 == 0, F.lit("{}")).otherwise(rec))
    pages = (o.select("o_custkey", (F.col("o_orderkey") / 1000).cast("long").alias("blk"), "o_orderkey", entry.alias("e"))
              .groupBy("o_custkey", "blk")
              .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "e"))).alias("es")))
    missing = F.concat(F.lit("missing-"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("blk").cast("string"))
    uids = F.concat(F.transform("es", lambda s: s["o_orderkey"].cast("string")), F.array(missing))
    payload = F.concat(F.lit('{"result":{"uids":'), F.to_json(uids), F.lit(","),
                       F.array_join(F.transform("es", lambda s: s["e"]), ","), F.lit("}}"))
    return pages.select(payload.alias("payload"))


def trial_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ClinicalTrials-style studies from orders + their distinct line return flags; every 5th
    order lacks the description module."""
    o = load(spark, sf_dir, "orders")
    flags = (load(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_set("l_returnflag")).alias("conds")))
    j = o.join(flags, o["o_orderkey"] == flags["l_orderkey"], "left")
    k = F.col("o_orderkey").cast("string")
    ident = F.struct(F.concat(F.lit("NCT"), k).alias("nctId"), F.concat(F.lit("Trial "), k).alias("briefTitle"))
    conds = F.struct(F.coalesce("conds", F.array().cast("array<string>")).alias("conditions"))
    status = F.struct(F.col("o_orderstatus").alias("overallStatus"))
    desc = F.struct(F.col("o_orderpriority").alias("briefSummary"))
    full = F.to_json(F.struct(F.struct(ident.alias("identificationModule"), conds.alias("conditionsModule"),
                                       status.alias("statusModule"), desc.alias("descriptionModule"))
                              .alias("protocolSection")))
    short = F.to_json(F.struct(F.struct(ident.alias("identificationModule"), conds.alias("conditionsModule"),
                                        status.alias("statusModule")).alias("protocolSection")))
    return j.select(F.when(F.col("o_orderkey") % 5 == 0, short).otherwise(full).alias("payload"))


def label_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """openFDA-label-style documents from part: empty brand lists, missing openfda, missing warnings."""
    p = load(spark, sf_dir, "part")
    of = F.struct(F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>"))
                  .otherwise(F.array("p_brand")).alias("brand_name"),
                  F.array("p_name").alias("generic_name"))
    doc = F.struct(
        F.when(F.col("p_size") % 7 != 0, of).alias("openfda"),
        F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit("second"))).alias("boxed_warning"),
        F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("adverse_reactions"),
        F.array(F.col("p_name")).alias("indications_and_usage"),
        F.concat(F.lit("spl-"), F.col("p_partkey").cast("string")).alias("spl_set_id"))
    return p.select("p_partkey", F.to_json(doc).alias("payload"))


SPL_CODES = ["34067-9", "34067-9 Indications & Usage", "34073-7", "34073-7", "other"]


def spl_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DailyMed-SPL-style documents: one per (order, block of 8 line numbers); section codes
    cycle through both indication codes, a duplicated interaction code and an unrelated one."""
    li = load(spark, sf_dir, "lineitem")
    code = F.element_at(F.array(*[F.lit(c) for c in SPL_CODES]), (F.col("l_linenumber") % len(SPL_CODES) + 1).cast("int"))
    q = F.col("l_quantity").cast("int")
    text = F.repeat(F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" qty "), q.cast("string"),
                             F.lit("; ")), q)
    blk = (F.col("l_linenumber") / 8).cast("int")
    g = (li.select("l_orderkey", blk.alias("blk"), "l_linenumber", F.struct(code.alias("code"), text.alias("text")).alias("s"))
           .groupBy("l_orderkey", "blk").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s"))).alias("ss")))
    title = F.concat(F.lit("SPL "), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("blk").cast("string"))
    doc = F.struct(F.struct(title.alias("title"), F.transform("ss", lambda x: x["s"]).alias("sections")).alias("data"))
    return g.select("l_orderkey", "blk", F.to_json(doc).alias("payload"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for fixture files under the reliable checkpoint location."""
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fixtures/{name}-{uuid.uuid4().hex}"


def props_with_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props with a control character injected between tokens on every 5th event and
    the closing brace cut on every 11th (those fail both parses)."""
    e = load(spark, sf_dir, "events")
    raw = (F.when(F.col("event_id") % 11 == 0, F.regexp_replace("props", "}$", ""))
            .when(F.col("event_id") % 5 == 0, F.regexp_replace("props", '"k":', '"k":\u0001'))
            .otherwise(F.col("props")))
    return e.select("event_id", raw.alias("raw"))


def landed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP responses from pages: status, content type and body cycle through the cases."""
    p = load(spark, sf_dir, "pages")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 503, 200, 429, 301, 500)]),
                          (F.col("page_id") % 7 + 1).cast("int"))
    ctype = F.element_at(F.array(*[F.lit(x) for x in ("application/json", "text/html; charset=utf-8",
                                                        "application/json; charset=utf-8", "text/plain",
                                                        "application/xml", "APPLICATION/JSON")]),
                         (F.col("page_id") % 6 + 1).cast("int"))
    body = (F.when(F.col("page_id") % 4 == 0, F.col("html"))
             .when(F.col("page_id") % 4 == 1, F.to_json(F.struct("page_id", "url")))
             .when(F.col("page_id") % 4 == 2, F.concat(F.lit(" \n"), F.col("html")))
             .otherwise(F.concat(F.lit('{"url": "'), F.col("page_id").cast("string"), F.lit('"'))))
    return p.select("page_id", status.alias("status"), ctype.alias("content_type"), body.alias("body"))


def png_folder(spark: SparkSession, sf_dir: str) -> str:
    """One small PNG per supplier, written by the tasks: <folder>/<nation>/sup_<key>.png (every 7th is no image, every 5th ends in .PNG).

    Width and height follow the supplier key, so both sides of a size limit occur.
    """
    from ..session import ship_code

    folder = scratch_dir(spark, "images")
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")

    def run(batches):
        import struct
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        files, root = (fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(
            folder if "://" in folder else f"file://{folder}")

        def chunk(kind, data):
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        for rb in batches:
            for key, nation in zip(rb.column("s_suppkey").to_pylist(), rb.column("s_nationkey").to_pylist()):
                w, h = 200 + key % 120, 230 + key % 60
                data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
                data += chunk(b"IDAT", zlib.compress((b"\0" + bytes([key % 251]) * w) * h)) + chunk(b"IEND", b"")
                name = f"{root}/n{nation}/sup_{key}" + (".PNG" if key % 5 == 0 else ".png")
                files.create_dir(f"{root}/n{nation}", recursive=True)
                with files.open_output_stream(name) as out:
                    out.write(b"no image" if key % 7 == 0 else data)
            yield pa.RecordBatch.from_arrays([rb.column("s_suppkey")], ["k"])

    ship_code()
    rows.mapInArrow(run, "k long").write.format("noop").mode("overwrite").save()
    return folder
