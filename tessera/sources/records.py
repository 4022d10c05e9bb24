"""Record sources and sinks: queue, profiles, parameters and settings as JSON, model graphs as text, log lines."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import planning as P
from tessera.sources.images import publish, published

PLAN = "struct<targetScale:int,allowBasePlusDownsample:boolean>"
OPTIONS = "struct<format:string,quality:int,keepExif:boolean,keepIccProfile:boolean,pngCompression:int,webpLossless:boolean>"
JOB = (
    f"id string, sourceUri string, sourceDisplayName string, sourceSizeBytes long, sourceWidth int, sourceHeight int, engineId string, upscalePlan {PLAN}, "
    f"encodeOptions {OPTIONS}, status string, progress float, createdAt long, startedAt long, finishedAt long, retryCount int, lastError string, outputUri string"
)
CAPABILITIES = "struct<baseScale:int,maxInputEdge:int,maxInputPixels:long,inputLayout:string,inputDtype:string,mean:float,std:float,fixedSize:boolean,channels:int>"
PROFILE = f"id string, displayName string, source string, modelUri string, domain string, capabilities {CAPABILITIES}, note string, createdAt long, lastDryRunAt long, dryRunPassed boolean, sha256 string"
PARAM = "struct<enabled:boolean,value:double,defaultValue:double>"


def queue(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a JSON-lines queue; running ones wait again. Unknown fields are ignored, broken lines dropped."""
    rows = spark.read.schema(JOB).option("mode", "DROPMALFORMED").json(path)
    running = F.col("status") == "running"
    return rows.withColumns({
        "status": F.when(running, "pending").otherwise(F.coalesce("status", F.lit("pending"))),
        "progress": F.when(running, F.lit(0.0)).otherwise(F.coalesce("progress", F.lit(0.0))).cast("float"),
        "startedAt": F.when(running, F.lit(0)).otherwise(F.coalesce("startedAt", F.lit(0))),
        "retryCount": F.coalesce("retryCount", F.lit(0)), "lastError": F.coalesce("lastError", F.lit("")),
    })


def profiles(spark: SparkSession, path: str, seeds: DataFrame) -> DataFrame:
    """Profiles of a JSON file: none of a blank one, the seeds where it is missing or holds none that can be read."""
    try:
        blank = spark.read.text(path).where("trim(value) <> ''").isEmpty()
    except AnalysisException:  # no such file
        return seeds
    rows = spark.read.schema(PROFILE).option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")
    return rows if blank or not rows.isEmpty() else seeds


SETTINGS = "concurrency string, quality int, format string, defaultEngineId string, outputDirUri string, maxQueueSize int"
# Settings that nobody has changed.
DEFAULTS = {"concurrency": "balanced", "quality": 95, "format": "jpeg", "defaultEngineId": "", "outputDirUri": "", "maxQueueSize": 5000}
_writing = threading.Lock()


def settings(spark: SparkSession, path: str) -> DataFrame:
    """The one row of settings, defaults for what is missing or cannot be read."""
    kept = published(spark, path, "json")
    row = {} if kept is None else {k: v for k, v in (kept.select("*").first() or Row()).asDict().items() if k in DEFAULTS and v is not None}
    return spark.createDataFrame([tuple((DEFAULTS | row)[k] for k in DEFAULTS)], SETTINGS)


def update_settings(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> DataFrame:
    """Read, change and write the settings. Writers of this process wait for each other; readers see the old or the new row."""
    with _writing:
        now = settings(spark, path).first().asDict()
        publish(spark.createDataFrame([tuple((now | change(now))[k] for k in DEFAULTS)], SETTINGS).coalesce(1), path, "json")
        return settings(spark, path)


def parameters(text: DataFrame) -> DataFrame:
    """(engine, name, enabled, value, effective) of JSON maps engine -> name -> parameter in a column ``json``."""
    maps = text.select(F.explode(F.from_json("json", f"map<string,map<string,{PARAM}>>")).alias("engine", "params"))
    rows = maps.select("engine", F.explode("params").alias("name", "p"))
    return rows.select("engine", "name", "p.enabled", "p.value", F.when(F.col("p.enabled"), F.col("p.value")).otherwise(F.col("p.defaultValue")).alias("effective"))


def layers(lines: DataFrame) -> DataFrame:
    """Layers of graph files from their lines (file, n, value): type, name, inputs, outputs and parameters.

    The first two lines are a magic number and counts; array-valued parameters keep their text.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where("n > 1 AND length(trim(value)) > 0").select("file", "n", parts.alias("p"))
    n_in, n_out = F.get("p", F.lit(2)).cast("int"), F.get("p", F.lit(3)).cast("int")
    rest = F.slice("p", 5 + n_in + n_out, F.greatest(F.lit(0), F.size("p") - 4 - n_in - n_out))
    return rows.select(
        "file", "n", F.get("p", F.lit(0)).alias("type"), F.get("p", F.lit(1)).alias("name"), F.slice("p", 5, n_in).alias("inputs"), F.slice("p", 5 + n_in, n_out).alias("outputs"),
        F.map_from_entries(F.transform(rest, lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))).alias("params"),
    )


def edges(layers: DataFrame) -> DataFrame:
    """A layer's output that is another's input: an equi join on file and blob."""
    made = layers.select("file", F.col("name").alias("source"), F.explode("outputs").alias("blob"))
    used = layers.select("file", F.col("name").alias("target"), F.explode("inputs").alias("blob"))
    return made.join(used, ["file", "blob"])


def graph_ends(layers: DataFrame) -> DataFrame:
    """First input and last output blob of every graph, in0 and out0 where there is none."""
    first = F.min_by(F.get("outputs", F.lit(0)), F.when(F.col("type") == "Input", F.col("n")))
    last = F.max_by(F.element_at("outputs", -1), "n")
    return layers.groupBy("file").agg(F.coalesce(first, F.lit("in0")).alias("input"), F.coalesce(last, F.lit("out0")).alias("output"))


def _line() -> Column:
    return F.format_string("%s %s/%s: %s", P.clock_text(F.col("ts")), "level", "tag", "message").alias("value")


def log_text(entries: DataFrame) -> DataFrame:
    """Entries (ts, level, tag, message) as lines: time, level/tag: message."""
    return entries.select(_line())


def append_log(entries: DataFrame, path: str) -> None:
    """Lines in order of time behind those that the log folder holds."""
    log_text(entries.orderBy("ts")).write.mode("append").text(path)


def log_dump(entries: DataFrame, captured: str) -> DataFrame:
    """The log as text to hand on: three head lines, a blank one, then all entries in order of time (n, value)."""
    n = entries.count()
    spark = entries.sparkSession
    head = spark.createDataFrame([(-4, "# debug log"), (-3, f"# captured at {captured}"), (-2, f"# entries: {n}"), (-1, "")], "n long, value string")
    body = entries.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("n"), _line())
    return head.unionByName(body).orderBy("n").select("value")


# Phrases that mark a crash in a system log.
CRASHES = ("fatal", "unsatisfiedlink", "abort message", "sigsegv", "sigabrt", "jni detected", "dlopen", "process died", "was decommissioned")
MIRROR = "Logcat"


def system_log(lines: DataFrame, pid: int, tags: tuple[str, ...], mirror: str = MIRROR) -> DataFrame:
    """Own crash and tag lines of a system log, but those that the mirror wrote itself.

    Own lines name the process between spaces or in brackets. The level is the fifth field between single spaces, as E, W, D or
    else I; messages of over 400 characters are cut and end with an ellipsis.
    """
    value, low = F.col("value"), F.lower("value")
    crash = F.exists(F.array(*map(F.lit, CRASHES)), lambda t: F.contains(low, t))
    tagged = F.exists(F.array(*[F.lit(t.lower() + ":") for t in tags]), lambda t: F.contains(low, t)) if tags else F.lit(False)
    own = F.contains(value, F.lit(f" {pid} ")) | F.contains(value, F.lit(f"({pid})"))
    field = F.get(F.split(value, " "), F.lit(4))
    level = F.when(field.isin("E", "W", "D"), field).otherwise("I")
    message = F.when(F.length(value) > 400, F.concat(F.substring(value, 1, 400), F.lit("…"))).otherwise(value)
    return lines.where(own & (crash | tagged) & ~F.contains(value, F.lit(mirror))).select(level.alias("level"), message.alias("message"))
