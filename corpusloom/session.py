"""Session helpers: a local session for tests and a reliable checkpoint location.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (a shared
file system).  Only a local-mode session without that setting gets a scratch
folder of its own, so tests can run; a cluster session without it is an error.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ship_code() -> None:
    """Make Python tasks independent of where this package is installed.

    Functions of this package used inside mapInPandas are pickled by value, so
    executors (and local Python workers started from another folder) need no
    copy of the package on their path.
    """
    import sys

    from pyspark import cloudpickle

    for name, mod in list(sys.modules.items()):
        if mod is not None and (name == "corpusloom" or name.startswith("corpusloom.")):
            try:
                cloudpickle.register_pickle_by_value(mod)
            except Exception:  # noqa: BLE001 - already registered or not a module object
                pass


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only for local sessions."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="corpusloom-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def evaluate_once(df: DataFrame, col: str) -> DataFrame:
    """Compute ``col`` once per row, even when later filters use it.

    Catalyst pushes a filter below the projection that defines a column by
    substituting the defining expression, so an expensive expression (a regex
    over a whole text) would be evaluated again in every such filter.  A
    one-element explode is a generator: filters on its output stay above it.
    """
    from pyspark.sql import functions as F

    return df.select(*[F.explode(F.array(F.col(c))).alias(c) if c == col else F.col(c) for c in df.columns])


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of ``columns`` is (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


HOT_SHARE = 1000


def join_hot(big: DataFrame, unique: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Inner join of ``big`` with rows unique by ``keys`` that say in ``count_col`` how many rows of ``big`` meet them.

    Keys that hold more than 1/``HOT_SHARE`` of those rows are fewer than ``HOT_SHARE`` however large the
    tables are; they are broadcast and their rows stay where they are, all others are joined by a shuffle.
    Both inputs are read twice, so they should be tables.
    """
    from pyspark.sql import functions as F

    total = unique.agg(F.coalesce(F.sum(count_col), F.lit(0))).first()[0]
    hot = unique.where(F.col(count_col) > total // HOT_SHARE + 1)
    names = F.broadcast(hot.select(*keys))
    return big.join(F.broadcast(hot), keys).unionByName(big.join(names, keys, "left_anti").join(unique.join(names, keys, "left_anti"), keys))


def row_hash(df: DataFrame):
    """A hash of the whole row, for columns of any type (maps count as sorted entries)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def hashable(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if "map" not in f.dataType.simpleString():
            return c
        if isinstance(f.dataType, T.MapType) and "map" not in f.dataType.valueType.simpleString():
            return F.array_sort(F.map_entries(c)) if "map" not in f.dataType.keyType.simpleString() else F.to_json(F.struct(c))
        return F.to_json(F.struct(c))

    return F.xxhash64(*[hashable(f) for f in df.schema.fields])


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only behind a check of rows and bytes of the (dimension) side.

    One scalar action on at most ``max_rows + 1`` rows of a small table; above a
    bound the plain DataFrame is returned and Catalyst/AQE pick a shuffle join.
    The size is that of the rows as JSON text, in characters: near enough to bytes for a guard.
    """
    from pyspark.sql import functions as F

    size = F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return F.broadcast(df) if row["n"] <= max_rows and row["b"] <= max_bytes else df
