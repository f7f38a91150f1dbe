"""A Spark data source over HDF5 trajectory files: one partition a file. Needs h5py on the executors.

spark.dataSource.register(Hdf5); spark.read.format("hdf5").option("paths", json.dumps([...])).option("rows", "frames").load()
rows=frames: (path, frame_index, name, values): each one- or two-dimensional dataset, a row a frame.
rows=schema: (path, name, kind, rank, shape, dtype, chunks, compression, error): a file that can't be read gives one row with its error.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "frames": "path string, frame_index bigint, name string, values array<double>",
    "schema": "path string, name string, kind string, rank int, shape array<bigint>, dtype string, chunks array<bigint>, compression string, error string",
}


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("the hdf5 source needs the package h5py on driver and executors") from e
    return h5py


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.rows = options.get("rows", "frames")

    def partitions(self):
        return [OneFile(p) for p in self.paths]

    def read(self, partition):
        h5py, found = _h5py(), []
        try:
            with h5py.File(partition.path, "r") as f:
                f.visititems(lambda name, x: found.append((name, x)) if isinstance(x, h5py.Dataset) else None)
                yield from (self._schema if self.rows == "schema" else self._frames)(partition.path, found)
        except OSError as e:
            if self.rows != "schema":
                raise
            yield partition.path, None, None, None, None, None, None, None, str(e)

    @staticmethod
    def _schema(path, found):
        for name, x in found:
            yield path, name, "dataset", len(x.shape), [int(n) for n in x.shape], str(x.dtype), [int(n) for n in x.chunks] if x.chunks else None, x.compression, None

    @staticmethod
    def _frames(path, found):
        for name, x in found:
            if x.dtype.kind in "fiub" and len(x.shape) in (1, 2):
                for i in range(x.shape[0]):  # a row at a time: trajectories may not fit in memory
                    v = x[i]
                    yield path, i, name, [float(v)] if len(x.shape) == 1 else [float(a) for a in v]


class Hdf5(DataSource):
    @classmethod
    def name(cls):
        return "hdf5"

    def schema(self):
        return SCHEMAS[self.options.get("rows", "frames")]

    def reader(self, schema):
        return Hdf5Reader(self.options)
