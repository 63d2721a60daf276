"""Event stores, flow data sets and artifacts on files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardline.functions.casts import instant
from wardline.functions.fields import first_field
from wardline.operators.slices import newest
from wardline.session import settle
from wardline.sources.schemas import AUTH_FLOW, CANONICAL_EVENT, TIMELINE_EVENT

BAD = "_malformed"
#: Files whose headers go to every task with the lines; more of them are joined with a shuffle.
FEW_FILES = 100_000


def json_fields(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The lines with the fields of their JSON beside them, and whether they are malformed; blank lines are left out."""
    filled = lines.filter(F.trim(F.col(column)) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = filled.withColumn("_json", F.from_json(column, f"{schema}, {BAD} string", options))
    broken = F.col("_json").isNull() | F.col(f"_json.{BAD}").isNotNull()
    return parsed.select(*lines.columns, "_json.*", broken.alias("_broken")).drop(BAD)


def parse_json_lines(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a text column; blank lines are neither."""
    filled = lines.filter(F.trim(F.col(column)) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    parsed = filled.withColumn("_json", F.from_json(column, f"{schema}, {BAD} string", options))
    others = [name for name in lines.columns if name != column]
    broken = F.col("_json").isNull() | F.col(f"_json.{BAD}").isNotNull()
    good = parsed.filter(~broken).select(*others, "_json.*").drop(BAD)
    bad = parsed.filter(broken).select(*others, column, F.lit("malformed JSON").alias("dlq_reason"))
    return good, bad


def read_events_jsonl(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    schema: str = CANONICAL_EVENT,
    timestamp: str = "timestamp",
    tie: str = "event_id",
) -> DataFrame:
    """Records of JSON-lines files, malformed lines skipped; with ``limit`` the last ones by time."""
    records, _ = parse_json_lines(spark.read.text(path), schema)
    if limit is None:
        return records
    # Rows without a readable time count as oldest.
    timed = records.withColumn("_at", F.coalesce(F.unix_micros(instant(timestamp)), F.lit(0).cast("bigint")))
    tied = timed.withColumn(tie, F.coalesce(F.col(tie).cast("string"), F.lit("")))
    return newest(tied, [], "_at", [tie], limit).drop("_at")


def append_events(df: DataFrame, path: str, at: str = "at", tenant: str = "tenant_id", form: str = "parquet") -> None:
    """Append to an event store laid out by day and tenant, so range and tenant reads prune folders.

    Rows are rebalanced by day and tenant: adaptive execution splits a busy tenant over many tasks by
    its size, and a day does not break into a file per task.
    """
    day = F.to_date(F.timestamp_micros(F.col(at)))
    dated = df.withColumn("day", day)
    spread = dated.hint("rebalance", "day", tenant)
    spread.write.mode("append").partitionBy("day", tenant).format(form).save(path)


def timeline_export(df: DataFrame, tenant: str, path: str) -> None:
    """One tenant's events as JSON lines."""
    df.filter(F.col("tenant_id") == tenant).write.mode("overwrite").json(path)


def timeline_import(spark: SparkSession, path: str, schema: str = TIMELINE_EVENT) -> DataFrame:
    """Events of JSON lines, with empty lists and forensic mode where missing."""
    records, _ = parse_json_lines(spark.read.text(path), schema)
    filled = {}
    for name, kind in records.dtypes:
        if kind.startswith("array"):
            filled[name] = F.coalesce(name, F.array().cast(kind))
    if "mode" in records.columns:
        filled["mode"] = F.coalesce("mode", F.lit("forensic"))
    return records.withColumns(filled)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed lower-case column names with underscores for spaces and slashes."""
    return df.toDF(*[name.strip().lower().replace(" ", "_").replace("/", "_") for name in df.columns])


_FILE = "_file"


def _lines(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(value, _file, _head, _at): the filled lines of all files, whether they are of a file's first split, and their order there."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder)
    named = read.select(
        "value", F.col("_metadata.file_path").alias(_FILE), (F.col("_metadata.file_block_start") == 0).alias("_head"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return named.filter(F.trim("value") != "")


def _positional(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _cells(line: str, width: int) -> Column:
    """The cells of a CSV line as an array, with nulls for empty and missing ones."""
    parsed = F.from_csv(line, _positional(width), {"mode": "PERMISSIVE", "escape": '"'})
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def read_csv_folder(spark: SparkSession, folder: str, pattern: str = "*.csv", one_header: bool = False) -> DataFrame | None:
    """All CSV files below a folder as text columns, files matched by column name; None without files.

    However many files there are, one job gathers their headers, each under its file's name, and the read itself maps a
    line's cells to names by the header of its file; the driver sees the different column names only. A record is a
    line, and a line that repeats its file's header is none. With ``one_header`` the files are known to agree and are read at once without looking; their first line is
    the header.
    """
    if one_header:
        whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder, header=True, escape='"')
        return normalize_columns(whole) if whole.columns else None
    lines = _lines(spark, folder, pattern)
    return _by_header(lines)


def _by_header(lines: DataFrame) -> DataFrame | None:
    # A text as the only aggregate makes Spark sort all lines of a split; beside a set it keeps one line a file.
    first = lines.filter("_head").groupBy(_FILE).agg(F.min_by("value", "_at").alias("_header"), F.collect_set("_head").alias("_heads"))
    headers = settle(first.filter(F.size("_heads") > 0).drop("_heads").withColumn("_line", F.regexp_replace("_header", "^\ufeff", "")))
    files, width = headers.agg(F.count(F.lit(1)), F.max(F.size(F.split("_line", ",")))).first()
    if not files:
        return None
    names = F.transform(
        F.filter(_cells("_line", width), lambda c: c.isNotNull()), lambda c: F.regexp_replace(F.lower(F.trim(c)), "[ /]", "_")
    )
    headers = headers.select(_FILE, "_header", names.alias("_names"))
    found = headers.select(_FILE, F.posexplode("_names").alias("place", "name")).groupBy("name").agg(F.min(F.struct(_FILE, "place")).alias("at"))
    columns = [r["name"] for r in found.orderBy("at").collect()]
    # A row per file; broadcast only while they are few.
    rows = lines.join(F.broadcast(headers) if files <= FEW_FILES else headers, _FILE).filter(F.col("value") != F.col("_header"))
    cells = rows.select("_names", _cells("value", width).alias("_cells"))
    # Of columns with one name in a file the first counts.
    return cells.select(*[F.try_element_at("_cells", F.nullif(F.array_position("_names", name), F.lit(0)).cast("int")).alias(name) for name in columns])


def union_datasets(*frames: DataFrame | None) -> DataFrame | None:
    """All frames that are there, matched by column name."""
    present = [frame for frame in frames if frame is not None]
    if not present:
        return None
    whole = present[0]
    for frame in present[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def _number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


# Column names of the two flow data sets, first match counts; a pair is summed.
CICIDS_COLUMNS = {
    "timestamp": ["timestamp"],
    "src_ip": ["source_ip", "src_ip"],
    "dst_ip": ["destination_ip", "dst_ip"],
    "src_port": ["source_port", "src_port"],
    "dst_port": ["destination_port", "dst_port"],
    "protocol": ["protocol"],
    "service": ["protocol"],
    "state": ["flow_id", "fwd_psh_flags"],
    "duration": ["flow_duration"],
    "bytes_sent": ["total_length_of_fwd_packets", "totlen_fwd_pkts"],
    "bytes_received": ["total_length_of_bwd_packets", "totlen_bwd_pkts"],
    "packets_out": ["total_fwd_packets", "tot_fwd_pkts"],
    "packets_in": ["total_backward_packets", "tot_bwd_pkts"],
}
UNSW_COLUMNS = {
    "timestamp": ["timestamp", "stime"],
    "src_ip": ["srcip", "src_ip"],
    "dst_ip": ["dstip", "dst_ip"],
    "src_port": ["sport", "src_port"],
    "dst_port": ["dsport", "dst_port"],
    "protocol": ["proto", "protocol"],
    "service": ["service"],
    "state": ["state"],
    "duration": ["dur", "duration"],
    "bytes_sent": ["sbytes"],
    "bytes_received": ["dbytes"],
    "packets_out": ["spkts"],
    "packets_in": ["dpkts"],
}


def _flows(df: DataFrame, dataset: str, names: dict[str, list[str]], category: Column, label: Column) -> DataFrame:
    def text(name: str) -> Column:
        return first_field(df, names[name], None if name == "timestamp" else "unknown").cast("string").alias(name)

    def number(name: str) -> Column:
        return _number(first_field(df, names[name], 0).cast("string"))

    return df.select(
        F.lit(dataset).alias("dataset"),
        *[text(n) for n in ("timestamp", "src_ip", "dst_ip")],
        *[number(n).alias(n) for n in ("src_port", "dst_port")],
        *[text(n) for n in ("protocol", "service", "state")],
        *[number(n).alias(n) for n in ("duration", "bytes_sent", "bytes_received")],
        (number("packets_out") + number("packets_in")).alias("packets"),
        category.alias("attack_category"),
        label.alias("label"),
    )


def cicids_flows(raw: DataFrame) -> DataFrame:
    """Flow columns of a frame with that set's (cleaned) headers; anything not BENIGN is an attack."""
    category = F.coalesce(first_field(raw, ["label"], "BENIGN").cast("string"), F.lit("nan"))
    return _flows(raw, "CICIDS2017", CICIDS_COLUMNS, category, (F.upper(category) != "BENIGN").cast("int"))


def unsw_flows(raw: DataFrame) -> DataFrame:
    """Flow columns of a frame with that set's (cleaned) headers; the label is a number."""
    category = F.coalesce(first_field(raw, ["attack_cat", "attack_category"], "normal").cast("string"), F.lit("nan"))
    label = _number(first_field(raw, ["label", "attack_label"], 0).cast("string")).cast("int")
    return _flows(raw, "UNSW-NB15", UNSW_COLUMNS, category, label)


def load_flows_cicids(spark: SparkSession, folder: str, one_header: bool = False) -> DataFrame | None:
    raw = read_csv_folder(spark, folder, one_header=one_header)
    return None if raw is None else cicids_flows(raw)


def load_flows_unsw(spark: SparkSession, folder: str, one_header: bool = False) -> DataFrame | None:
    raw = read_csv_folder(spark, folder, one_header=one_header)
    return None if raw is None else unsw_flows(raw)


def auth_flows_lanl(raw: DataFrame) -> DataFrame:
    """Authentication flows: epoch seconds to time, action from two columns, failure from success."""
    seconds = _number(F.col("time")).cast("bigint")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("nan"))

    return raw.select(
        F.lit("LANL").alias("dataset"),
        F.timestamp_seconds(seconds).alias("timestamp"),
        text("user").alias("user_id"),
        text("src").alias("source_host"),
        text("dst").alias("destination_host"),
        text("auth_type").alias("auth_type"),
        text("logon_type").alias("logon_type"),
        text("auth_orientation").alias("auth_orientation"),
        F.concat(text("auth_type"), F.lit(":"), text("logon_type")).alias("action"),
        (~F.upper(text("success")).isin("1", "TRUE", "SUCCESS")).cast("int").alias("failed_logins"),
    )


def load_auth_lanl(spark: SparkSession, folder: str) -> DataFrame | None:
    """CSV files with a header and headerless text files (plain or gzip) of authentication flows."""
    with_header = read_csv_folder(spark, folder)
    plain = spark.read.schema(AUTH_FLOW).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,txt.gz}").csv(folder)
    without = None if plain.isEmpty() else plain
    raw = union_datasets(with_header, without)
    return None if raw is None else auth_flows_lanl(raw)


def write_artifacts(
    folder: str,
    network: DataFrame | None = None,
    auth: DataFrame | None = None,
    training: DataFrame | None = None,
    profiles: DataFrame | None = None,
) -> None:
    """Feature tables as gzip Parquet, profiles as JSON, and last a manifest with the rows of each.

    Rows are counted while they are written, so nothing is read twice; a reader that finds the manifest finds
    whole tables.
    """
    spark, counted = None, []
    tables = {"network_features": network, "auth_features": auth, "training_set": training, "ueba_profiles": profiles}
    for name, df in tables.items():
        if df is None:
            continue
        spark = df.sparkSession
        seen = Observation(f"rows of {name}")
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if name == "ueba_profiles":
            writer.json(f"{folder}/{name}.json")
        else:
            writer.option("compression", "gzip").parquet(f"{folder}/{name}.parquet")
        counted.append((name, int(seen.get["rows"]), "1.0"))
    if spark is not None:
        manifest = spark.createDataFrame(counted, "dataset string, rows bigint, pipeline_version string")
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata.json")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, rows, pipeline_version) of a folder of artifacts."""
    return spark.read.schema("dataset string, rows bigint, pipeline_version string").json(f"{folder}/metadata.json")
