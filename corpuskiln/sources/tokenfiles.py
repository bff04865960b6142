"""Files of 16-bit token ids: a sink whose files appear all at once, and a source that reads them in ranges.

Both are Spark data sources.  A task of the sink writes its rows' ids one after the other into a file of its own in a
folder beside the target; only when all tasks have ended does the driver move the files of the tasks that count to
``part-00000.bin`` and on, in the order of partitions, and write ``metadata.json`` last.  A task that fails removes its
file, a job that fails the folder.  Paths are those of ``pyarrow.fs``: local ones, which driver and executors must
share, or those of a store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, METADATA = "uint16tokens", "metadata.json"
#: Ids of a row that is read, and of a partition.
ROW_IDS, PARTITION_IDS = 1 << 16, 1 << 24


def file_system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    tokens: int


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, vocab_size: int, overwrite: bool):
        self.path, self.vocab_size, self.overwrite, self.folder = path.rstrip("/"), vocab_size, overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, path = file_system(self.path)
        name = f"{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(f"{path}/{self.folder}")
        tokens = 0
        try:
            with store.open_output_stream(f"{path}/{self.folder}/{name}") as out:
                for batch in iterator:
                    ids = batch.column(batch.schema.get_field_index("ids")).flatten()
                    values = ids.to_numpy(zero_copy_only=False)
                    if ids.null_count or len(values) and not 0 <= values.min() <= values.max() < self.vocab_size:
                        raise ValueError(f"a token id is null or doesn't lie between 0 and {self.vocab_size - 1}")
                    out.write(values.astype("<u2").tobytes())
                    tokens += len(values)
        except BaseException:
            store.delete_file(f"{path}/{self.folder}/{name}")
            raise
        return Written(context.partitionId(), name, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = file_system(self.path)
        store.create_dir(path)
        old = [x.path for x in store.get_file_info(_selector(path)) if x.base_name.endswith(".bin") or x.base_name == METADATA]
        if old and not self.overwrite:
            self._clear(store, path)
            raise ValueError(f"{self.path} holds token files already")
        for file in sorted(old, key=lambda f: not f.endswith(METADATA)):  # without its metadata a set isn't read
            store.delete_file(file)
        parts, total = [], 0
        for message in sorted((m for m in messages if m is not None and m.tokens), key=lambda m: m.partition):
            name = f"part-{len(parts):05d}.bin"
            store.move(f"{path}/{self.folder}/{message.name}", f"{path}/{name}")
            parts.append({"file": name, "start": total, "tokens": message.tokens})
            total += message.tokens
        with store.open_output_stream(f"{path}/{METADATA}") as out:
            out.write(json.dumps({"dtype": "uint16", "vocab_size": self.vocab_size, "tokens": total, "disk_bytes": 2 * total, "parts": parts}, indent=2).encode())
        self._clear(store, path)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, store: Any, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.folder}")


def _selector(path: str) -> Any:
    from pyarrow import fs

    return fs.FileSelector(path)


@dataclass
class Range(InputPartition):
    file: str
    first: int  # id within the file
    n: int
    start: int  # of the file, within the set


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def partitions(self) -> list[Range]:
        found = metadata(self.path)
        return [Range(p["file"], first, min(PARTITION_IDS, p["tokens"] - first), p["start"]) for p in found["parts"] for first in range(0, p["tokens"], PARTITION_IDS)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, path = file_system(self.path)
        if not partition.n:
            return
        with store.open_input_file(f"{path}/{partition.file}") as file:
            for first in range(partition.first, partition.first + partition.n, ROW_IDS):
                n = min(ROW_IDS, partition.first + partition.n - first)
                ids = np.frombuffer(file.read_at(2 * n, 2 * first), "<u2")
                if len(ids) != n:
                    raise ValueError(f"{partition.file} is shorter than {METADATA} says")
                row = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids.astype("i4")))
                yield pa.RecordBatch.from_arrays([pa.array([partition.start + first], pa.int64()), row], ["start", "ids"])


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "start bigint, ids array<int>"

    def reader(self, schema: Any) -> TokenReader:
        return TokenReader(self.options["path"])

    def writer(self, schema: Any, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options.get("vocab_size", 1 << 16)), overwrite)


def metadata(path: str) -> dict[str, Any]:
    store, at = file_system(path)
    with store.open_input_file(f"{at}/{METADATA}") as file:
        return json.loads(file.read())


def write_tokens(pieces: DataFrame, path: str, vocab_size: int = 1 << 16, files: int | None = None, mode: str = "append") -> None:
    """The ids of ``pieces`` (start, ids) in the order of ``start``, as files below ``path``; ``mode`` append (of nothing there) or overwrite."""
    spark = pieces.sparkSession
    spark.dataSource.register(TokenFiles)
    ordered = pieces.repartitionByRange(files, "start") if files else pieces.repartitionByRange("start")
    ordered.sortWithinPartitions("start").select("ids").write.format(FORMAT).option("path", path).option("vocab_size", vocab_size).mode(mode).save()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """start, ids: the stream in rows of successive ids, read in ranges that needn't follow files."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).option("path", path).load()


def write_token_set(found: Any, path: str, mode: str = "append", files: int | None = None) -> dict[str, Any]:
    """Both splits of a ``TokenSet`` below ``path``/train and ``path``/val, and what is known of them, which is also returned."""
    from pyspark.sql import functions as F

    for split in ("train", "val"):
        write_tokens(found.pieces.where(F.col("split") == split), f"{path}/{split}", found.metadata["vocab_size"], files, mode)
        if metadata(f"{path}/{split}")["tokens"] != found.metadata[f"{split}_token_count"]:
            raise ValueError(f"{split} has another number of tokens than the stream")
    known = found.metadata | {"disk_bytes": sum(metadata(f"{path}/{s}")["disk_bytes"] for s in ("train", "val"))}
    store, at = file_system(path)
    with store.open_output_stream(f"{at}/{METADATA}") as out:
        out.write(json.dumps(known, indent=2).encode())
    return known
