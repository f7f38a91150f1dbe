"""A journal as a Spark data source that appends each run once.

    spark.dataSource.register(JournalSource)
    records.write.format("journal").option("run", "2024-05-01").mode("append").save(path)
    spark.read.format("journal").schema(schema).load(path)

Each task writes its records to a file of its own under `parts/`. The run is committed by one small file `runs/<run>.json`,
made exclusively, which lists the files of the tasks that succeeded and their numbers of records. Files of tasks that were
tried again, or of a run that broke off, are listed nowhere and read by nobody. A run that is there already adds nothing:
its tasks write no file, so a job can simply be run again. Paths are URIs or local paths of a file system that Arrow opens.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    from pyarrow import fs

    system, root = _opened(path)
    return sorted(i.base_name for i in system.get_file_info(fs.FileSelector(f"{root}/runs", allow_not_found=True)) if i.base_name.endswith(".json"))


def committed_runs(path: str) -> list[dict]:
    """{run, files, records} of every committed run, by name."""
    system, root = _opened(path)
    out = []
    for name in _listed(path):
        with system.open_input_stream(f"{root}/runs/{name}") as f:
            out.append(json.loads(f.read()))
    return out


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: a file, or None, and how many records."""

    file: str | None
    records: int


class JournalWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        if not re.fullmatch(r"[\w.=-]+", run):
            raise ValueError(f"a run's name has letters, digits, `_`, `.`, `=` and `-` only: {run}")
        self.path, self.run = path, run
        self.there = f"{run}.json" in _listed(path)

    def write(self, iterator):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        if self.there:
            return Written(None, 0)
        system, root = _opened(self.path)
        system.create_dir(f"{root}/parts", recursive=True)
        task = TaskContext.get()
        name = f"{self.run}-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.parquet"
        records, out, sink = 0, None, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    sink = system.open_output_stream(f"{root}/parts/{name}")
                    out = pq.ParquetWriter(sink, batch.schema, compression="zstd")
                out.write_batch(batch)
                records += batch.num_rows
        if out is None:
            return Written(None, 0)
        out.close()
        sink.close()
        return Written(name, records)

    def commit(self, messages):
        if self.there:
            return
        system, root = _opened(self.path)
        system.create_dir(f"{root}/runs", recursive=True)
        done = [m for m in messages if m is not None and m.file]
        entry = json.dumps({"run": self.run, "files": sorted(m.file for m in done), "records": sum(m.records for m in done)}).encode()
        # A whole file moves into place; a second committer of the run finds it there and leaves its own files unlisted.
        with system.open_output_stream(draft := f"{root}/runs/.{self.run}-{uuid.uuid4().hex}") as f:
            f.write(entry)
        if f"{self.run}.json" in _listed(self.path):
            system.delete_file(draft)
        else:
            system.move(draft, f"{root}/runs/{self.run}.json")

    def abort(self, messages):
        system, root = _opened(self.path)
        for m in messages:
            if m is not None and m.file:
                system.delete_file(f"{root}/parts/{m.file}")


class JournalReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self):
        return [InputPartition((r["run"], name)) for r in committed_runs(self.path) for name in r["files"]] or [InputPartition(None)]

    def read(self, partition):
        import pyarrow.parquet as pq

        if partition.value is None:
            return
        system, root = _opened(self.path)
        with system.open_input_file(f"{root}/parts/{partition.value[1]}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=self.names):
                yield batch.select(self.names)


class JournalSource(DataSource):
    """Format `journal`; a write needs the option `run` and appends, a read needs a schema, whose columns alone are read."""

    @classmethod
    def name(cls):
        return "journal"

    def reader(self, schema):
        return JournalReader(self.options["path"], schema.names)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a journal is only appended to")
        return JournalWriter(self.options["path"], self.options["run"])


def append_run(records, path: str, run: str) -> None:
    """Appends the records as one run; a run that is there already adds nothing."""
    records.sparkSession.dataSource.register(JournalSource)
    records.write.format("journal").option("run", run).mode("append").save(path)


def read_runs(spark, path: str, schema: str):
    spark.dataSource.register(JournalSource)
    return spark.read.format("journal").schema(schema).load(path)
