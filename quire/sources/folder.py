"""Rows as files of a folder, all of them or none: df.write.format("quire_files").mode("overwrite").save(folder).

    spark.dataSource.register(FolderSink)
    artifacts.select("name", "content").write.format("quire_files").mode("append").save("hdfs://store/books")

Every attempt of a task writes into a folder of its own beside the target.  Only when all tasks are done does the driver gather the files of
the attempts that count, by moves inside the store, and give the whole folder its name by one last move.  Attempts that failed or were run twice
leave nothing, and a job that fails leaves no target.  Tasks that still run when their job is given up, and a driver that is killed, can leave
a folder ``<target>.staging-<job>``, which nobody reads; ``sweep`` drops these.

mode append: the target must not exist yet.  overwrite: an old target is set aside, and dropped when the new one has
its name.  Names are unique and stay inside the folder; null contents are empty files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def opened(folder: str):
    """The file system of a folder and its path there; Arrow knows local paths, file:, hdfs:, s3: and more."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return store, path.rstrip("/")


def inner_name(name: str | None) -> str:
    """The name, if it is one inside a folder."""
    parts = (name or "").split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"{name}: not a name inside the folder")
    return name


def sweep(folder: str) -> int:
    """Drop what jobs that ended badly left beside a target that no job is writing now; how many folders that were."""
    from pyarrow import fs

    store, path = opened(folder)
    left = [f.path for f in store.get_file_info(fs.FileSelector(path.rpartition("/")[0])) if f.path.rpartition("/")[2].startswith(f"{path.rpartition('/')[2]}.staging-")]
    for at in left:
        store.delete_dir(at)
    return len(left)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str = ""
    names: list[str] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        for c in ("name", "content"):
            if c not in columns:
                raise ValueError(f"rows need a column {c}")
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Attempt:
        store, staging = opened(self.staging)
        out = Attempt(f"attempt-{uuid.uuid4().hex}")
        made = set()
        for row in iterator:
            name = inner_name(row["name"])
            if name in out.names:
                raise ValueError(f"{name}: twice")
            target = f"{staging}/{out.folder}/{name}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(target) as f:
                f.write(bytes(row["content"] or b""))
            out.names.append(name)
        return out

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        store, staging = opened(self.staging)
        _, target = opened(self.folder)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        exists = store.get_file_info(target).type != fs.FileType.NotFound
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"{next(n for n in names if names.count(n) > 1)}: twice")
            if exists and not self.overwrite:
                raise ValueError(f"{self.folder}: exists")
            whole, made = f"{staging}/whole", set()
            store.create_dir(whole, recursive=True)
            for m in done:
                for name in m.names:
                    to = f"{whole}/{name}"
                    parent = to.rpartition("/")[0]
                    if parent not in made:
                        store.create_dir(parent, recursive=True)
                        made.add(parent)
                    store.move(f"{staging}/{m.folder}/{name}", to)
            if exists:
                store.move(target, f"{staging}/old")
            store.move(whole, target)
        finally:
            self.drop()

    def abort(self, messages: list[Attempt | None]) -> None:
        self.drop()

    def drop(self) -> None:
        from pyarrow import fs

        store, staging = opened(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class FolderSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], schema.fieldNames(), overwrite)
