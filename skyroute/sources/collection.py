"""One GeoJSON collection in one file, as viewers open it: a Spark data source for writing.

Tasks write their features to files of their own; the commit strings these together.
"""

from __future__ import annotations

import shutil
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str | None


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class CollectionWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.parts = path, f"{path}.parts-{uuid.uuid4().hex}"

    def prepare(self) -> None:
        """The parts' folder, made before any task: one that goes on after an abort does not bring it back."""
        store, root = _place(self.parts)
        store.create_dir(root, recursive=True)

    def write(self, iterator) -> Part:
        """The task's features, one line each; an attempt that fails leaves a file that no message names."""
        partition, out, name = TaskContext.get().partitionId(), None, None
        try:
            for row in iterator:
                if out is None:
                    store, root = _place(self.parts)
                    name = f"{partition:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{name}")
                else:
                    out.write(b",\n")
                out.write(row[0].encode())
        finally:
            if out is not None:
                out.close()
        return Part(partition, name)

    def commit(self, messages) -> None:
        """The parts in the order of their partitions, a block at a time; the file appears under its name when it is whole."""
        store, target = _place(self.path)
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        _, root = _place(self.parts)
        unfinished = f"{target}.{uuid.uuid4().hex}"
        with store.open_output_stream(unfinished) as out:
            out.write(b'{"type":"FeatureCollection","features":[')
            between = b"\n"
            for part in sorted((m for m in messages if m and m.name), key=lambda m: m.partition):
                out.write(between)
                between = b",\n"
                with store.open_input_stream(f"{root}/{part.name}") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            out.write(b"\n]}\n")
        store.move(unfinished, target)
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_place(self.parts))

    @staticmethod
    def _clear(store, root: str) -> None:
        from pyarrow import fs

        for last in (False, False, False, True):  # tasks that are not told yet may add a file meanwhile
            if store.get_file_info(root).type != fs.FileType.Directory:
                return
            try:
                return store.delete_dir(root)
            except OSError:
                if last:
                    raise


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def writer(self, schema, overwrite: bool) -> CollectionWriter:
        made = CollectionWriter(self.options["path"])
        made.prepare()
        return made


def write_collection(features: DataFrame, path: str) -> None:
    """Writes features (value) as one FeatureCollection to the file ``path``, in the order of the partitions; without features it is an empty collection.

    One file is the purpose here, and its bytes pass through the driver a block at a time; for what no viewer
    opens as a whole, ``writers.write_features`` keeps a file for each task.  ``path`` is one that ``pyarrow.fs`` opens, and is replaced.
    """
    features.sparkSession.dataSource.register(CollectionSource)
    features.select("value").write.format("feature_collection").mode("append").save(path)
