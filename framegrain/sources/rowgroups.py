"""Single rows of many Parquet files by place: requests meet the files' row groups, and tasks read those groups only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _file(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(name))


def row_groups(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, row_group, first_row, rows): the row groups of each file, from its footer, read by tasks.

    A path that is there twice is read once; its file must be on a file system that Arrow opens.
    """
    def task(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                with _file(path) as f:
                    rows = [f.metadata.row_group(g).num_rows for g in range(f.num_row_groups)]
                starts = list(accumulate(rows, initial=0))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(starts, pa.int64()), pa.array(rows, pa.int64())], ["path", "row_group", "first_row", "rows"])

    names = paths.select(F.col(column).cast("string").alias("path")).distinct()
    return names.mapInArrow(task, "path string, row_group int, first_row long, rows long")


#: Rows of a span, in which requests look for their row group; requests whose rows lie as close are read by one task.
SPAN = 1 << 10
TASK_SPANS = 1 << 7
#: Requests that are put out at once.
BATCH_ROWS = 1 << 14


def rows_at(requests: DataFrame, groups: DataFrame, schema: T.StructType | str, path: str = "path", row: str = "row_index") -> DataFrame:
    """requests with the columns of `schema` from the row at each (path, row): one row for each request, repeats included.

    Requests meet row groups by path and by span of rows, then go to tasks by path and range of rows, in order of place; a task
    reads a file's footer and each group that is hit once, with these columns alone. A row beyond its file, and an unknown file,
    fail the job. Columns of the requests that the schema has are replaced.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = kind.names
    kept = [c for c in requests.columns if c not in names]
    span = lambda c: F.floor(F.col(c) / SPAN).cast("long")
    asked = requests.select(*kept, F.col(path).alias("_path"), F.col(row).cast("long").alias("_row")).withColumn("_span", span("_row"))
    held = groups.filter("rows > 0").select(F.col("path").alias("_path"), F.col("first_row").alias("_first"), (F.col("first_row") + F.col("rows") - 1).alias("_last"), F.col("row_group").alias("_group"))
    # A row group is there for each span that it touches: all row groups of a file for its number of spans and groups at most.
    held = held.withColumn("_span", F.explode(F.sequence(span("_first"), span("_last"))))
    held = held.groupBy("_path", "_span").agg(F.sort_array(F.collect_list(F.struct("_first", "_last", "_group"))).alias("_groups"))  # those that touch SPAN rows
    inside = F.filter("_groups", lambda g: (g["_first"] <= F.col("_row")) & (F.col("_row") <= g["_last"]))
    lost = F.raise_error(F.concat(F.lit("no such row: "), F.coalesce("_path", F.lit("null")), F.lit(":"), F.coalesce(F.col("_row").cast("string"), F.lit("null"))))
    met = asked.join(held, ["_path", "_span"], "left").withColumn("_g", F.get(inside, F.lit(0)))
    met = met.withColumn("_group", F.when(F.col("_g").isNull(), lost.cast("int")).otherwise(F.col("_g._group"))).withColumn("_at", F.col("_row") - F.col("_g._first")).drop("_groups", "_g")
    met = met.repartition("_path", F.floor(F.col("_span") / TASK_SPANS)).sortWithinPartitions("_path", "_group", "_at").select(*kept, "_path", "_group", "_at")
    out = T.StructType([*requests.select(*kept).schema.fields, *kind.fields])

    def read(batches):
        import pyarrow as pa

        file = opened = group = found = None

        def taken(part):
            nonlocal file, opened, group, found
            path, number = part.column("_path")[0].as_py(), part.column("_group")[0].as_py()
            if path != opened:
                if file is not None:
                    file.close()
                file, opened, group = _file(path), path, None
            if number != group:
                found, group = file.read_row_group(number, columns=names), number
            return found.take(part.column("_at"))

        try:
            for b in batches:
                for start in range(0, b.num_rows, BATCH_ROWS):
                    part = b.slice(start, BATCH_ROWS)
                    if not part.num_rows:
                        continue
                    keys = list(zip(part.column("_path").to_pylist(), part.column("_group").to_pylist(), strict=True))
                    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
                    rows = pa.concat_tables([taken(part.slice(x, y - x)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
                    columns = {**{c: part.column(c) for c in kept}, **{c: rows.column(c) for c in names}}
                    yield from pa.table(columns).combine_chunks().to_batches()
        finally:
            if file is not None:
                file.close()

    return met.mapInArrow(read, out)


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the Parquet files below a root."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
