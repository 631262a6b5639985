"""Sources and sinks.

Reads are lazy Spark scans; writes are Spark writers.  Paths may be local
or any Hadoop file system URI; existence checks use the Hadoop FileSystem
API of the session, never the driver's local disk.
"""

from __future__ import annotations

import datetime as _dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvid.operators.setops import anti_join_seen, union_by_name


# --- file system helpers ----------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def path_size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


# --- A1 / A2 / A3 / A4 reads ---------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """A1: CSV with header (typed by ``schema`` or inferred) or Parquet."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        r = spark.read
        return (r.schema(schema) if schema else r).parquet(path)
    r = spark.read.option("header", True).option("nullValue", "").option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema else r.option("inferSchema", True)
    return r.csv(path)


def read_optional(spark: SparkSession, path: str, schema: StructType | str,
                  fmt: str | None = None) -> DataFrame:
    """A2: a missing path gives an empty table of the given schema."""
    if not path_exists(spark, path):
        print(f"nothing at {path}: an empty table stands for it")
        return spark.createDataFrame([], schema)
    return read_table(spark, path, schema, fmt)


def read_many_tagged(spark: SparkSession, paths: dict, tag_col: str = "source_dataset",
                     fmt: str | None = None) -> DataFrame:
    """A3: read each source that is there, tag, union by name; a source that is
    there but cannot be read is an error."""
    frames = [read_table(spark, path, None, fmt).withColumn(tag_col, F.lit(name))
              for name, path in paths.items() if path_exists(spark, path)]
    if not frames:
        raise ValueError(f"none of the sources is there: {', '.join(sorted(paths.values()))}")
    return union_by_name(frames)


def land_once(df: DataFrame, path: str, min_bytes: int = 100) -> bool:
    """A5: write only when the target is absent or smaller than ``min_bytes``.
    Returns True when written."""
    spark = df.sparkSession
    if path_exists(spark, path) and path_size(spark, path) > min_bytes:
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def csv_text_to_table(lines: DataFrame, schema: StructType | str, text_col: str = "value",
                      header: bool = True) -> DataFrame:
    """CSV text rows -> typed table.  Blank lines are dropped and cells
    trimmed (as the upload form does); parsing is ``from_csv`` on executors.

    With ``header`` one line, wherever it stands, names the columns: cells are
    taken by name (in any letter case), so order and further columns do not matter,
    and copies of that line are no data.  A table whose header lacks names (it has
    over half of them), or with lines that name the columns in different orders,
    is refused.  Without ``header``, or where no line is one, cells are taken by
    place."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    body = lines.where(F.trim(F.col(text_col)) != "")
    names, order, is_header = [f.name.lower() for f in st], None, F.lit(False)
    if header:
        cells = F.transform(F.split(F.regexp_replace(F.lower(F.col(text_col)), r'["\x{FEFF}]', ""), ","), lambda x: F.trim(x))
        absent = F.size(F.array_except(F.array(*[F.lit(n) for n in names]), cells))
        # the header comes first: few names are absent from it
        found = body.where(absent < len(names) / 2).select(cells.alias("c"), absent.alias("absent")).distinct() \
            .orderBy("absent", "c").limit(2).collect()
        if found and found[0]["absent"]:
            raise ValueError(f"the header lacks {sorted(set(names) - set(found[0]['c']))}")
        if len(found) > 1 and not found[1]["absent"]:
            raise ValueError("lines name the columns in different orders")
        if found:
            order, is_header = list(found[0]["c"]), absent == 0
    order = order or names
    place = {n: order.index(n) for n in names}
    kinds = {place[f.name.lower()]: f.dataType.simpleString() for f in st}
    ddl = ", ".join(f"_{i} {kinds.get(i, 'string')}" for i in range(len(order)))
    parsed = body.where(~is_header).select(F.from_csv(F.col(text_col), ddl, {"ignoreLeadingWhiteSpace": "true",
                                                                             "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return parsed.select(*[F.col("r")[f"_{place[f.name.lower()]}"].alias(f.name) for f in st])


def write_snapshot(df: DataFrame, root: str, ts: str | None = None) -> str:
    """Each upload stored under its ingest timestamp partition."""
    ts = ts or _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    df.withColumn("ingest_ts", F.lit(ts)).write.mode("append").partitionBy("ingest_ts").parquet(root)
    return ts


def append_master(new: DataFrame, master: DataFrame | None, append: bool = True) -> DataFrame:
    """Union with the master, drop exact duplicates; ``append=False``
    keeps the upload only (still de-duplicated)."""
    if not append or master is None:
        return new.dropDuplicates()
    return union_by_name([master, new]).dropDuplicates()


def append_master_incremental(new: DataFrame, master: DataFrame) -> DataFrame:
    """A8 incremental form (C4): the master plus only unseen upload rows."""
    fresh = anti_join_seen(new.dropDuplicates(), master, master.columns)
    return master.unionByName(fresh, allowMissingColumns=True)


def write_versioned(df: DataFrame, root: str) -> str:
    """Staged overwrite: write a new version folder, then let ``CURRENT``
    name it by one atomic rename, so a reader sees the old or the new table at
    every moment and a crash leaves the old one."""
    spark = df.sparkSession
    version = _dt.datetime.now(_dt.timezone.utc).strftime("v%Y%m%d%H%M%S%f")
    target = f"{root.rstrip('/')}/{version}"
    df.write.mode("errorifexists").parquet(target)
    jvm = spark.sparkContext._jvm
    fs, draft = _fs(spark, f"{root.rstrip('/')}/CURRENT-{version}")
    out = fs.create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/CURRENT"), overwrite)
    return target


def read_versioned(spark: SparkSession, root: str) -> DataFrame | None:
    cur = f"{root.rstrip('/')}/CURRENT"
    if not path_exists(spark, cur):
        fs, p = _fs(spark, root.rstrip("/"))
        if fs.exists(p) and any(s.getPath().getName().startswith("v") for s in fs.listStatus(p)):
            raise RuntimeError(f"{root} holds versions but no pointer to the current one")
        return None
    version = spark.read.text(cur).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/{version}")


# fixed values: the fields of the manual form
MANUAL_SCHEMA = ("koi_period double, koi_duration double, koi_depth double, koi_prad double, "
                 "koi_teq double, koi_insol double, koi_model_snr double, koi_steff double, "
                 "koi_slogg double, koi_srad double, label string")
REQUIRED_MANUAL = ("koi_period", "koi_duration", "koi_depth", "koi_prad")


def manual_rows(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Validated manual records; the label text is also written to
    ``koi_disposition`` so that the rows train (mends the lost-label case)."""
    for r in records:
        missing = [k for k in REQUIRED_MANUAL if r.get(k) is None]
        if missing:
            raise ValueError(f"missing required fields: {missing}")
        if r.get("label") not in ("PLANET", "NOT_PLANET"):
            raise ValueError("label must be PLANET or NOT_PLANET")
    df = spark.createDataFrame([tuple(r.get(f.split()[0]) for f in MANUAL_SCHEMA.split(", ")) for r in records],
                               MANUAL_SCHEMA)
    return df.withColumn("koi_disposition",
                         F.when(F.col("label") == "PLANET", "CONFIRMED").otherwise("FALSE POSITIVE"))


def validate_manual(df: DataFrame) -> DataFrame:
    """A9 over a table of manual records: rows missing a required field or
    with a label outside PLANET / NOT_PLANET are flagged, valid rows get the
    label text mapped into ``koi_disposition``."""
    ok = F.lit(True)
    for c in REQUIRED_MANUAL:
        ok = ok & F.col(c).isNotNull()
    ok = ok & F.coalesce(F.col("label").isin("PLANET", "NOT_PLANET"), F.lit(False))
    return (df.withColumn("valid", ok)
            .withColumn("koi_disposition", F.when(ok, F.when(F.col("label") == "PLANET", "CONFIRMED")
                                                  .otherwise("FALSE POSITIVE"))))


def manual_disposition(col: str):
    """The disposition that a manual label text stands for; other texts: null."""
    return F.when(F.col(col) == "PLANET", "CONFIRMED").when(F.col(col) == "NOT_PLANET", "FALSE POSITIVE")


def resolve_training_source(spark: SparkSession, master_root: str, raw_root: str) -> DataFrame:
    """A10: the master if present, else the last raw upload."""
    master = read_versioned(spark, master_root)
    if master is not None:
        return master
    if not path_exists(spark, raw_root):
        raise FileNotFoundError("no master and no raw upload")
    raw = spark.read.parquet(raw_root)
    last = raw.agg(F.max("ingest_ts")).first()[0]
    return raw.where(F.col("ingest_ts") == last).drop("ingest_ts")


def write_result_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables (comparison, importance, counts, describe)."""
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


# --- A13 run history -------------------------------------------------------------------
HISTORY_SCHEMA = ("ts timestamp, samples long, features long, "
                  "metrics map<string, map<string, double>>, hyperparameters string, "
                  "master_dataset_saved boolean")


def append_history(spark: SparkSession, path: str, samples: int, features: int, metrics: dict,
                   hyperparameters: dict, master_saved: bool) -> None:
    row = (_dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), int(samples), int(features),
           {m: {k: float(v) for k, v in d.items() if v is not None} for m, d in metrics.items()},
           json.dumps(hyperparameters, sort_keys=True), bool(master_saved))
    spark.createDataFrame([row], HISTORY_SCHEMA).write.mode("append").parquet(path)


def last_runs(history: DataFrame, n: int = 10, ts_col: str = "ts", tie_col: str | None = None) -> DataFrame:
    """The last ``n`` runs (top-k by time; per-partition top-n, then merge)."""
    order = [F.desc(ts_col)] + ([F.desc(tie_col)] if tie_col else [])
    return history.orderBy(*order).limit(n)


def report_text(report: DataFrame, path: str) -> None:
    """Classification report as text lines."""
    lines = report.select(F.format_string("%12s %9.4f %9.4f %9.4f %9d", F.col("label"),
                                          F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)),
                                          F.coalesce("f1", F.lit(0.0)), F.col("support")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


# --- A16 training logs -------------------------------------------------------------------
def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated per-iteration log with a header (iter, metric columns)."""
    return spark.read.option("header", True).option("sep", "\t").option("inferSchema", True).csv(path)


def best_iteration(log: DataFrame, metric: str = "AUC", iter_col: str = "iter", mode: str = "max") -> DataFrame:
    """Iteration of the best metric (max for AUC-like, min for losses); ties
    go to the earliest iteration."""
    key = F.struct(F.col(metric) if mode == "max" else -F.col(metric), -F.col(iter_col))
    return log.agg(F.max_by(iter_col, key).alias("best_iter"),
                   (F.max(metric) if mode == "max" else F.min(metric)).alias(f"best_{metric.lower()}"))


def write_training_log(log: DataFrame, path: str) -> None:
    """Per-iteration metrics as a tab-separated file with a header."""
    log.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
