"""Basket rule matching (drug-interaction checks) without enumerating pairs.

Input is long: (basket, pos, name).  Rules are four small tables (synonyms,
pairs, class rules, class members) that are broadcast behind a size check.

* Pair rules are unordered: a basket hits rule (a, b) iff it holds a at one
  position and b at another, so a (basket, rule) aggregate decides it.
* Class rules are ordered: drug x in a classA class must come before drug y in
  a classB class.  Per (basket, rule, drug) we keep the first position (A side)
  and the last position (B side); x precedes y somewhere iff first(x) < last(y).
  The A/B check is per (basket, rule) and bounded by the class member lists,
  not by the basket length, so a hot basket is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import strip_ws
from ..functions.text import col_

# FIXED VALUES: JavaScript String.prototype.trim whitespace (for the UI list parser)
JS_WS_CLASS = r"[\x{09}-\x{0d}\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


class Rules:
    """Rule tables as DataFrames, built from the JSON-shaped rule object."""

    def __init__(self, spark: SparkSession, rules: dict | None = None):
        rules = rules if rules is not None else K.DDI_RULES
        syn_rows = []
        for prio, (canon, syns) in enumerate(rules.get("synonyms", {}).items()):
            syn_rows.append((canon, canon, prio))
            syn_rows.extend((s, canon, prio) for s in syns)
        self.synonyms = spark.createDataFrame(syn_rows, "name string, canon string, prio int")
        self.pairs = spark.createDataFrame(
            [(i, p["a"], p["b"], p["note"]) for i, p in enumerate(rules.get("pairs", []))],
            "rule int, ra string, rb string, note string")
        self.class_rules = spark.createDataFrame(
            [(i, list(c["classA"]), list(c["classB"]), c["note"]) for i, c in enumerate(rules.get("classes", []))],
            "rule int, class_a array<string>, class_b array<string>, note string")
        member_rows = []
        for cpos, (cls, members) in enumerate(rules.get("class_members", {}).items()):
            member_rows.extend((m.lower(), cls, cpos) for m in members)
        self.members = spark.createDataFrame(member_rows, "drug string, class string, class_pos int")
        # Every table derived from the rules is bounded by the rule object's size, which is known
        # here on the driver: the broadcast decision needs no Spark job.
        n_class_entries = sum(len(c["classA"]) + len(c["classB"]) for c in rules.get("classes", []))
        self.size_bound = len(syn_rows) + 2 * len(rules.get("pairs", [])) + len(member_rows) * max(1, n_class_entries)

    def bcast(self, df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
        """Broadcast a rule-derived table when the rule object is small enough."""
        return F.broadcast(df) if self.size_bound <= max_rows else df


def parse_med_list(c) -> Column:
    """Comma list -> trimmed array; empty/null string -> []."""
    s = col_(c)
    parts = F.transform(F.split(s, ","), lambda x: F.regexp_replace(x, rf"^{JS_WS_CLASS}+|{JS_WS_CLASS}+$", ""))
    return F.when(s.isNull() | (s == ""), F.array().cast(T.ArrayType(T.StringType()))).otherwise(parts)


def explode_baskets(df: DataFrame, basket_col: str, list_col: str) -> DataFrame:
    """Array baskets -> long (basket, pos, name)."""
    return df.select(F.col(basket_col).alias("basket"), F.posexplode(list_col).alias("pos", "name"))


def canonical_name(items: DataFrame, rules: Rules, name_col: str = "name", out: str = "drug") -> DataFrame:
    """lower+strip, first synonym group (rule order) containing it, else itself.
    Null/empty names are dropped first (blank strings survive as '')."""
    it = items.filter(F.col(name_col).isNotNull() & (F.col(name_col) != ""))
    it = it.withColumn("_n", F.lower(strip_ws(F.col(name_col))))
    syn = rules.synonyms.groupBy("name").agg(F.min_by("canon", "prio").alias("_canon"))
    it = it.join(rules.bcast(syn), it["_n"] == syn["name"], "left").drop(syn["name"])
    return it.withColumn(out, F.coalesce("_canon", "_n")).drop("_n", "_canon")


def drug_classes(drugs: DataFrame, rules: Rules, drug_col: str = "drug") -> DataFrame:
    """Every class containing the drug, in rule order -> (drug, classes array)."""
    d = drugs.select(drug_col).distinct()
    m = rules.bcast(rules.members)
    j = d.join(m, d[drug_col] == m["drug"]).drop(m["drug"])
    return j.groupBy(drug_col).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("class_pos", "class"))), lambda s: s["class"]).alias("classes"))


def pair_rules(items: DataFrame, rules: Rules) -> DataFrame:
    """(basket, msg) for unordered pair rules; items carry canonical ``drug``."""
    ends = rules.pairs.select("rule", "ra", "rb", "note", F.explode(F.array("ra", "rb")).alias("end")).distinct()
    j = items.join(rules.bcast(ends), items["drug"] == ends["end"])
    g = j.groupBy("basket", "rule", "ra", "rb", "note").agg(
        F.max(F.when(F.col("drug") == F.col("ra"), 1).otherwise(0)).alias("has_a"),
        F.max(F.when(F.col("drug") == F.col("rb"), 1).otherwise(0)).alias("has_b"),
        F.countDistinct("pos").alias("npos"))
    hit = g.filter((F.col("has_a") == 1) & (F.col("has_b") == 1) & (F.col("npos") >= 2))
    return hit.select("basket", F.concat_ws("", "ra", F.lit(" + "), "rb", F.lit(": "), "note").alias("msg")).distinct()


def class_rules(items: DataFrame, rules: Rules) -> DataFrame:
    """(basket, msg) for ordered class rules; message lists all classes of both drugs.

    Equi-joins only: items -> (drug, class) members -> (class, rule, side) rule sides.
    """
    members = rules.bcast(rules.members.select("drug", "class"))
    sides = rules.class_rules.select("rule", F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.col("class_a").alias("cls")),
        F.struct(F.lit("B").alias("side"), F.col("class_b").alias("cls")))).alias("s"))
    sides = rules.bcast(
        sides.select("rule", F.col("s.side").alias("side"), F.explode("s.cls").alias("class")).distinct())
    tagged = items.join(members, "drug").join(sides, "class")
    per = tagged.groupBy("basket", "rule", "drug", "side").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    a = per.filter(F.col("side") == "A").select("basket", "rule", F.col("drug").alias("a"), "first_pos")
    b = per.filter(F.col("side") == "B").select("basket", "rule", F.col("drug").alias("b"), "last_pos")
    hit = a.join(b, ["basket", "rule"]).filter(F.col("first_pos") < F.col("last_pos"))
    hit = hit.join(rules.bcast(rules.class_rules.select("rule", "note")), "rule")
    cls = drug_classes(rules.members.select("drug"), rules)
    ca = cls.select(F.col("drug").alias("a"), F.array_join("classes", ",").alias("ca"))
    cb = cls.select(F.col("drug").alias("b"), F.array_join("classes", ",").alias("cb"))
    hit = hit.join(rules.bcast(ca), "a").join(rules.bcast(cb), "b")
    msg = F.concat_ws("", "a", F.lit(" (class "), "ca", F.lit(") + "), "b", F.lit(" (class "), "cb",
                      F.lit("): "), "note")
    return hit.select("basket", msg.alias("msg")).distinct()


def _endpoints(rules: Rules) -> DataFrame:
    """One table for both rule kinds: (drug, kind, rule, side).

    Pair rule (a, b): a on side A, b on side B (matched in either order).
    Class rule: every member of a classA class on side A, of a classB class on side B.
    """
    pairs = rules.pairs.select(F.explode(F.array(
        F.struct(F.col("ra").alias("drug"), F.lit("A").alias("side")),
        F.struct(F.col("rb").alias("drug"), F.lit("B").alias("side")))).alias("e"), "rule")
    pairs = pairs.select(F.col("e.drug").alias("drug"), F.lit("P").alias("kind"), "rule", F.col("e.side").alias("side"))
    sides = rules.class_rules.select("rule", F.explode(F.array(
        F.struct(F.lit("A").alias("side"), F.col("class_a").alias("cls")),
        F.struct(F.lit("B").alias("side"), F.col("class_b").alias("cls")))).alias("s"))
    sides = sides.select("rule", F.col("s.side").alias("side"), F.explode("s.cls").alias("class"))
    cls = rules.members.join(sides, "class").select("drug", F.lit("C").alias("kind"), "rule", "side")
    return pairs.unionByName(cls).distinct()


def _messages(rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Message parts: pair rule text; class lists per drug and class-rule notes."""
    pm = rules.pairs.select(F.lit("P").alias("kind"), "rule", F.concat_ws("", "ra", F.lit(" + "), "rb",
                                                                        F.lit(": "), "note").alias("pair_msg"))
    cm = rules.class_rules.select(F.lit("C").alias("kind"), "rule", "note")
    return pm, cm


def check_interactions(items: DataFrame, rules: Rules, baskets: DataFrame | None = None) -> DataFrame:
    """Per basket the sorted distinct messages of both rule kinds; baskets without hits -> [].

    One pass over the items: a broadcast join to the combined rule endpoints,
    one aggregate per (basket, kind, rule, drug) keeping the first and last
    position on each side, one row per (basket, rule) with its matching drugs,
    and the A/B check inside that row.  A pair rule fires when both drugs are
    present at different positions; a class rule when the A drug comes before
    the B drug.  The work per (basket, rule) is bounded by the rule's member
    lists, never by the basket length.
    """
    canon = canonical_name(items, rules).select("basket", "pos", "drug")
    ends = rules.bcast(_endpoints(rules))
    per = (canon.join(ends, "drug")
                .groupBy("basket", "kind", "rule", "drug")
                .agg(F.min(F.when(F.col("side") == "A", F.col("pos"))).alias("a_first"),
                     F.max(F.when(F.col("side") == "A", F.col("pos"))).alias("a_last"),
                     F.min(F.when(F.col("side") == "B", F.col("pos"))).alias("b_first"),
                     F.max(F.when(F.col("side") == "B", F.col("pos"))).alias("b_last")))
    # one row per (basket, rule): its matching drugs (at most the rule's member count)
    g = per.groupBy("basket", "kind", "rule").agg(
        F.collect_list(F.struct("drug", "a_first", "a_last", "b_first", "b_last")).alias("ds"))
    a_side = F.filter("ds", lambda d: d["a_first"].isNotNull())
    b_side = F.filter("ds", lambda d: d["b_first"].isNotNull())
    is_pair = F.col("kind") == "P"

    def fires(x, y):
        ordered = x["a_first"] < y["b_last"]
        return F.when(is_pair, ordered | (y["b_first"] < x["a_last"])).otherwise(ordered)

    pairs = F.flatten(F.transform(a_side, lambda x: F.transform(
        F.filter(b_side, lambda y: fires(x, y)), lambda y: F.struct(x["drug"].alias("a"), y["drug"].alias("b")))))
    hit = g.select("basket", "kind", "rule", F.explode(pairs).alias("p")).select(
        "basket", "kind", "rule", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    pm, cm = _messages(rules)
    cls = drug_classes(rules.members.select("drug"), rules).select("drug", F.array_join("classes", ",").alias("cl"))
    hit = (hit.join(rules.bcast(pm), ["kind", "rule"], "left")
              .join(rules.bcast(cm), ["kind", "rule"], "left")
              .join(rules.bcast(cls.select(F.col("drug").alias("a"), F.col("cl").alias("ca"))), "a", "left")
              .join(rules.bcast(cls.select(F.col("drug").alias("b"), F.col("cl").alias("cb"))), "b", "left"))
    class_msg = F.concat_ws("", "a", F.lit(" (class "), "ca", F.lit(") + "), "b", F.lit(" (class "), "cb",
                            F.lit("): "), "note")
    msgs = hit.select("basket", F.when(F.col("kind") == "P", F.col("pair_msg")).otherwise(class_msg).alias("msg"))
    per_basket = msgs.groupBy("basket").agg(F.array_sort(F.collect_set("msg")).alias("ddi"))
    if baskets is None:
        baskets = items.select("basket").distinct()
    return baskets.join(per_basket, "basket", "left").withColumn(
        "ddi", F.coalesce("ddi", F.array().cast(T.ArrayType(T.StringType()))))


def append_findings(text, ddi) -> Column:
    """Answer text plus the interaction section when there is any message."""
    d = col_(ddi)
    return F.when(F.size(d) > 0, F.concat(col_(text), F.lit(K.DDI_HEADER), F.array_join(d, K.DDI_JOIN))) \
        .otherwise(col_(text))
