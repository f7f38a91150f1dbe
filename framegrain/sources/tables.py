"""Readers and writers of episodic tables, manifests, metrics and listings, on any file system that Spark reads."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The storage types of feature declarations.
DTYPES = {"float32": T.FloatType(), "float64": T.DoubleType(), "float16": T.FloatType(), "int64": T.LongType(), "int32": T.IntegerType(), "bool": T.BooleanType(), "string": T.StringType(), "image": T.BinaryType()}
#: Columns that every frame table has.
INDEX_FEATURES = {name: {"dtype": "float32" if name == "timestamp" else "int64", "shape": (1,)} for name in ("timestamp", "frame_index", "episode_index", "index", "task_index")}


def schema_of(features: dict) -> T.StructType:
    """A table schema from {name: {dtype, shape}}: shape (1,) is a scalar, each further dimension an array.

    Videos have no column. Names must not contain a slash. The declared shape and type stay in the metadata.
    """
    fields = []
    for name, f in (features | INDEX_FEATURES).items():
        if "/" in name:
            raise ValueError(f"feature name contains a slash: {name}")
        if f["dtype"] == "video":
            continue
        kind = DTYPES[f["dtype"]]
        shape = tuple(f["shape"])
        if f["dtype"] != "image" and shape != (1,):
            for _ in shape:
                kind = T.ArrayType(kind, False)
        fields.append(T.StructField(name, kind, True, {"dtype": f["dtype"], "shape": list(shape)}))
    return T.StructType(fields)


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """Nested structs as columns whose names join the path."""
    def leaves(schema, path):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    quoted = lambda p: ".".join(f"`{x}`" for x in p)
    return df.select(*[F.col(quoted(p)).alias(separator.join(p)) for p in leaves(df.schema, [])])


def grouped(df: DataFrame, prefix: str, into: str, defaults: dict | None = None) -> DataFrame:
    """Columns `prefix*` into one struct `into`; missing columns in `defaults` are added first."""
    for name, value in (defaults or {}).items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    names = [c for c in df.columns if c.startswith(prefix)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in names]).alias(into))


def packed(names: list[str]):
    """Named scalars as one vector of float."""
    return F.array(*[F.col(f"`{n}`") for n in names]).cast("array<float>")


def read_episodes(spark: SparkSession, root: str, episodes: list[int] | None = None) -> DataFrame:
    """Frames of a dataset; of a choice of episodes only the folders are listed. Chosen episodes that are not there have no rows."""
    if episodes is None:
        return spark.read.parquet(root)
    some = ",".join(str(int(e)) for e in episodes)
    try:
        return spark.read.option("basePath", root).parquet(f"{root}/episode_chunk=*/episode_index={{{some}}}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.read.parquet(root).filter(F.lit(False))


def write_episodes(df: DataFrame, root: str, chunk: int = 1_000, mode: str = "errorifexists") -> None:
    """Frames as Parquet in partitions of `chunk` episodes and of one episode (a number), rows in order of frames.

    In a new folder on local or mounted disks (`file:`, or no scheme where that is the default) tasks write the files by Arrow:
    Hadoop's local file system starts two processes a file to set permissions. The folder appears once all files are there.
    Elsewhere Spark's writer is used.
    """
    rows = df.withColumn("episode_chunk", F.floor(F.col("episode_index") / chunk))
    path = _local(df.sparkSession, root)
    if path and not os.path.lexists(path) and not re.search(_SPARK_ONLY, rows.schema.json()):
        return _write_local_episodes(rows, path)
    rows = rows.repartition("episode_chunk", "episode_index").sortWithinPartitions("episode_index", "frame_index")
    rows.write.mode(mode).partitionBy("episode_chunk", "episode_index").option("compression", "zstd").parquet(root)


#: Types that Arrow's Parquet lacks or reads as others.
_SPARK_ONLY = r'"(variant|void|interval[^"]*|time\([^"]*|geo[^"]*|udt)"'


def _local(spark: SparkSession, root: str) -> str | None:
    """The path of a `file:` URI; without a scheme the session's default file system decides, as in Spark's readers and writers."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", root):
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    found = re.fullmatch(r"file:(?://)?(/[^/].*?)/*", root, re.DOTALL)
    return found[1] if found else None


def _write_local_episodes(rows: DataFrame, path: str) -> None:
    data, spark = rows.drop("episode_chunk", "episode_index"), rows.sparkSession
    columns = data.columns
    stage, name = f"{os.path.dirname(path)}/_{os.path.basename(path)}-{uuid.uuid4().hex}", f"part-{uuid.uuid4().hex}.zstd.parquet"
    opened = f"{stage}-open"
    # As Spark's writer does: types and metadata of the columns come back, dates need no calendar.
    about = {"org.apache.spark.sql.parquet.row.metadata": data.schema.json(), "org.apache.spark.version": spark.version}

    def task(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        at = out = hidden = None
        files = 0

        def close():
            if out is not None:
                out.close()
                os.replace(hidden, f"{stage}/{at}/{name}")

        for b in batches:
            folders, lo = pc.run_end_encode(b.column(len(columns))), 0
            cells = pa.RecordBatch.from_arrays(b.columns[:-1], columns)
            for hi, folder in zip(folders.run_ends.to_pylist(), folders.values.to_pylist(), strict=True):
                if folder != at:
                    close()
                    at, hidden, files = folder, f"{opened}/{uuid.uuid4().hex}", files + 1
                    os.makedirs(f"{stage}/{at}", exist_ok=True)
                    out = pq.ParquetWriter(hidden, cells.schema, compression="zstd", store_schema=False)
                    out.add_key_value_metadata(about)
                out.write_batch(cells.slice(lo, hi - lo))
                lo = hi
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    part = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    rows = rows.withColumn("_folder", F.concat_ws("/", part("episode_chunk"), part("episode_index")))
    rows = rows.repartition("_folder").sortWithinPartitions("episode_index", "_folder", "frame_index")
    rows = rows.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(columns)], "_folder")  # mapInArrow takes no name with a dot
    os.makedirs(stage)
    os.makedirs(opened)
    try:
        rows.mapInArrow(task, "files long").agg(F.sum("files")).collect()
        open(f"{stage}/_SUCCESS", "w").close()
        os.rename(stage, path)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    finally:
        shutil.rmtree(opened, ignore_errors=True)  # of attempts that were cut short


def episode_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rows) of each file of a dataset that has rows, from its footer; on local or mounted disks (as in `write_episodes`) tasks list the chunks."""
    path = _local(spark, root)
    if not path or not os.path.isdir(path):
        return spark.read.parquet(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))

    def task(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            for top in b.column(0).to_pylist():
                found = [] if os.path.isdir(top) else [top]
                for folder, below, names in os.walk(top):
                    below[:] = filter(_shown, below)
                    found += [f"{folder}/{n}" for n in filter(_shown, names)]
                rows = [pq.read_metadata(f).num_rows for f in found]
                yield pa.RecordBatch.from_pydict({"path": pa.array([_uri(f) for f in found], pa.string()), "rows": pa.array(rows, pa.int64())})

    tops = [(f"{path}/{n}",) for n in sorted(os.listdir(path)) if _shown(n)]  # one a chunk
    return spark.createDataFrame(tops, "path string").mapInArrow(task, "path string, rows long").filter("rows > 0")


def _shown(name: str) -> bool:
    """Whether Spark reads a file or folder of that name."""
    return not name.startswith(".") and (not name.startswith("_") or "=" in name)


def _uri(path: str) -> str:
    """As in _metadata.file_path."""
    return "file:" + re.sub(r"[^\w/\-!.~'()*,;:$&+=@]", lambda m: quote(m[0]), path)


def find_files(spark: SparkSession, root: str, name: str, limit: int = 0) -> DataFrame:
    """(path, length) of files of that name below a root, in order of path; contents are not read."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root).select("path", "length").orderBy("path")
    return out.limit(limit) if limit else out


def from_manifest(df: DataFrame, manifest: DataFrame, root: str, key: str = "path") -> DataFrame:
    """Files of df that a manifest names; a path outside the root, twice or missing fails the job."""
    names = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(df.withColumn("_there", F.lit(True)), key, "left")
    wrong = F.when(~F.startswith(F.col(key), F.lit(root)), "outside the root: ").when(F.col("_n") > 1, "listed twice: ").when(F.col("_there").isNull(), "missing: ")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col(key))).cast("boolean")).otherwise(True)
    return names.withColumn("_ok", checked).filter("_ok").drop("_ok", "_n", "_there")


def read_lines(spark: SparkSession, path: str, schema=None, order: str | None = None) -> DataFrame:
    """JSON lines, in order of a column if asked."""
    df = spark.read.schema(schema).json(path) if schema else spark.read.json(path)
    return df.orderBy(order) if order else df


def read_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON files of one value each, with their path."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path).select("*", F.col("_metadata.file_path").alias("path"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(mode, global_step, metric, value) of metric lines with free keys; a line that is no object fails.

    Booleans and text are not metrics.
    """
    blank = F.length(F.trim("value")) == 0
    lines = spark.read.text(path).filter(~blank)
    m = F.when(F.trim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    wrong = F.raise_error(F.concat(F.lit("not an object: "), "value")).cast("map<string,string>")
    rows = lines.select(F.when(m.isNull() & ~blank, wrong).otherwise(m).alias("m"))  # filters may run in any order
    long = rows.select(F.try_element_at("m", F.lit("mode")).alias("mode"), F.try_element_at("m", F.lit("global_step")).try_cast("long").alias("global_step"), F.explode("m").alias("metric", "v"))
    return long.filter(~F.col("metric").isin("mode", "global_step")).select("mode", "global_step", "metric", F.col("v").try_cast("double").alias("value")).filter("value is not null")


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; nested values as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cols = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("header", "true").csv(path)


def append_journal(records: DataFrame, path: str, status: str, error: str | None = None) -> None:
    """Appends records with status, error and time as JSON lines."""
    records.withColumns({"status": F.lit(status), "error": F.lit(error).cast("string"), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")}).write.mode("append").json(path)


def parse_listing(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name) of directories in the lines of an object-store listing: `PRE name/`."""
    name = F.regexp_extract(column, r"^\s*PRE\s+(\S.*?)/?\s*$", 1)
    return lines.select(name.alias("name")).filter("name <> ''")


def typed_records(df: DataFrame, legacy: dict[str, str], status: str = "quality_status", old: str = "status") -> DataFrame:
    """Records with the status under its new name, taken from the old field where that is all there is."""
    table = F.create_map(*[F.lit(x) for kv in legacy.items() for x in kv])
    new = F.col(status) if status in df.columns else F.lit(None).cast("string")
    return df.withColumn(status, F.coalesce(new, table[F.col(old)], F.col(old))).drop(old) if old in df.columns else df


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, labels) of annotation documents {data: {episodeLabels: [...]}}; the last file of an id wins."""
    schema = "struct<data:struct<episodeLabels:array<struct<episode_id:string,labels:array<struct<start:bigint,end:bigint,text:string>>>>>>"
    docs = spark.read.option("multiLine", "true").schema(T._parse_datatype_string(schema)).json(path).select("data", F.col("_metadata.file_path").alias("file"))
    rows = docs.select("file", F.explode("data.episodeLabels").alias("e")).select("file", "e.*")
    return rows.groupBy("episode_id").agg(F.max_by("labels", "file").alias("labels"))


def latest_gauges(metrics: DataFrame) -> DataFrame:
    """(metric, value): the finite value of the last step of each metric."""
    rows = metrics.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return rows.groupBy("metric").agg(F.max_by("value", "global_step").alias("value"))


def export_order(ring: DataFrame, sequence: str, done: str, stream: str) -> DataFrame:
    """A replay ring in order of age with episode_index and frame_index, cut after each done row."""
    from framegrain.operators.frames import finished_episodes, number_frames

    rows = ring.withColumn("episode_index", finished_episodes(done, [sequence], stream))
    return number_frames(rows, "episode_index", [sequence])


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line, text): a table as Markdown, one row a line, in order of `line` from 0; null is empty and `|` is escaped.

    Rows come in the given order, which should be total; lines are made where the rows are.
    """
    from framegrain.operators.ranges import running

    spark = df.sparkSession
    cell = lambda c: F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    joined = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*cells), " | "), F.lit(" |"))
    head = spark.range(2).select(F.col("id").alias("line"), F.when(F.col("id") == 0, joined([F.lit(c) for c in df.columns])).otherwise(joined([F.lit("---") for _ in df.columns])).alias("text"))
    return head.unionByName(running(df, order).select((F.col("number") + 2).alias("line"), joined([cell(c) for c in df.columns]).alias("text")))


def write_markdown(df: DataFrame, order: list[str], path: str) -> None:
    """The lines of `markdown_lines` as text files whose names keep their order."""
    markdown_lines(df, order).repartitionByRange("line").sortWithinPartitions("line").select("text").write.text(path)


#: Rows of a report that is rendered on the driver.
MOST_REPORT_ROWS = 10_000


def markdown(df: DataFrame) -> str:
    """A report table of at most MOST_REPORT_ROWS rows as Markdown; a longer one fails."""
    rows = df.limit(MOST_REPORT_ROWS + 1).collect()
    if len(rows) > MOST_REPORT_ROWS:
        raise ValueError(f"a report has at most {MOST_REPORT_ROWS} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"
