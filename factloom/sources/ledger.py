"""A ledger of sealed cases as a data source: a folder for each bundle, named by the bundle's hash, with the files of the case.

    spark.dataSource.register(Ledger)
    rows.write.format("ledger").mode("append").save(folder)        # bundle_sha256, name, content
    spark.read.format("ledger").load(folder)

What is written once stays: a file that is there already must have the same content, so a second write of the same cases, or of a task that is tried again,
changes nothing, and any other write of them fails. A job that fails takes back the files that it made. The folder may be in any
store that pyarrow reaches; tasks write each its own files, and list them in a file that is there until the job ends.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "bundle_sha256 string, name string, content binary"
#: The files of a sealed case.
BUNDLE, OUTPUT, ATTESTATION = "bundle.json", "output.json", "attestation.json"
HASH, NAME = re.compile(r"[0-9a-f]{64}"), re.compile(r"[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*")
#: Where tasks list what they made while a job runs; it is no hash, so it isn't read as a case.
LISTINGS = ".made"
#: Folders that one task reads.
FOLDERS = 256


def store_of(folder: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


@dataclass
class Made(WriterCommitMessage):
    """Where a task has listed the files that it made: their names don't go through the driver."""

    listing: str


@dataclass
class Folders(InputPartition):
    paths: list[str]


class Ledger(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LedgerReader:
        return LedgerReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is only added to: use mode append")
        return LedgerWriter(self.options["path"])


class LedgerWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Made:
        store, root = store_of(self.folder)
        made: list[str] = []
        try:
            for row in iterator:
                if not HASH.fullmatch(row["bundle_sha256"] or "") or not NAME.fullmatch(row["name"] or ""):
                    raise ValueError(f"no place in a ledger: {row['bundle_sha256']}/{row['name']}")
                path = f"{root}/{row['bundle_sha256']}/{row['name']}"
                if self.put(store, path, bytes(row["content"] or b"")):
                    made.append(path)
        except Exception:
            take_back(store, made)
            raise
        listing = f"{root}/{LISTINGS}/{uuid.uuid4().hex}"
        try:
            store.create_dir(f"{root}/{LISTINGS}", recursive=True)
            with store.open_output_stream(listing) as file:
                file.write("\n".join(made).encode())
        except Exception:
            take_back(store, made)
            raise
        return Made(listing)

    def put(self, store, path: str, content: bytes) -> bool:
        """Whether the file is new. It appears as a whole or not at all."""
        if store.get_file_info(path).is_file:
            with store.open_input_file(path) as file:
                if file.read() != content:
                    raise ValueError(f"the ledger holds another content: {path}")
            return False
        store.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as file:
            file.write(content)
        store.move(part, path)
        return True

    def commit(self, messages: list[Made | None]) -> None:
        self.end(messages)

    def abort(self, messages: list[Made | None]) -> None:
        self.end(messages, take_back)

    def end(self, messages: list[Made | None], act=lambda store, paths: None) -> None:
        """Acts on what each task made, one listing at a time, and deletes the listings."""
        store, root = store_of(self.folder)
        for m in filter(None, messages):
            with store.open_input_file(m.listing) as file:
                act(store, file.read().decode().split("\n") if file.size() else [])
            store.delete_file(m.listing)
        from pyarrow import fs

        listings = f"{root}/{LISTINGS}"
        if store.get_file_info(listings).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(listings)):
            store.delete_dir(listings)


def take_back(store, paths: list[str]) -> None:
    for path in paths:
        store.delete_file(path)
        folder = path.rpartition("/")[0]
        from pyarrow import fs

        if not store.get_file_info(fs.FileSelector(folder)):
            store.delete_dir(folder)


class LedgerReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Folders]:
        from pyarrow import fs

        store, root = store_of(self.folder)
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if not i.is_file and HASH.fullmatch(i.base_name))
        return [Folders(found[k : k + FOLDERS]) for k in range(0, len(found), FOLDERS)] or [Folders([])]

    def read(self, partition: Folders):
        from pyarrow import fs

        store, _ = store_of(self.folder)
        for folder in partition.paths:
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.is_file and not info.base_name.endswith(".part"):
                    with store.open_input_file(info.path) as file:
                        yield (folder.rpartition("/")[2], info.base_name, file.read())


def files_of(sealed: DataFrame) -> DataFrame:
    """The files of sealed cases (bundle, output, attestation: canonical JSON), in folders by the bundle's hash."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("binary").alias("content")) for n, c in ((BUNDLE, "bundle"), (OUTPUT, "output"), (ATTESTATION, "attestation"))])
    return sealed.select(F.sha2("bundle", 256).alias("bundle_sha256"), F.inline(parts)).dropDuplicates(["bundle_sha256", "name"])


def attested(bundle: Column, output: Column) -> Column:
    return F.to_json(F.struct(F.sha2(bundle, 256).alias("bundle_sha256"), F.lit("1.0").alias("core_version"), F.sha2(output, 256).alias("output_sha256")))


def verified(rows: DataFrame) -> DataFrame:
    """(bundle_sha256, ok, errors): whether each folder has its three files, is named by its bundle's hash, and is what its attestation says."""
    file = lambda n: F.max(F.when(F.col("name") == n, F.col("content")))
    cases = rows.groupBy("bundle_sha256").agg(*[file(n).alias(c) for n, c in ((BUNDLE, "bundle"), (OUTPUT, "output"), (ATTESTATION, "attestation"))])
    said = lambda c: F.get_json_object(F.col("attestation").cast("string"), f"$.{c}")
    checks = {
        **{f"missing {c}": F.col(c).isNull() for c in ("bundle", "output", "attestation")},
        "folder is not the bundle's hash": F.sha2("bundle", 256) != F.col("bundle_sha256"),
        "bundle is not what is attested": ~said("bundle_sha256").eqNullSafe(F.sha2("bundle", 256)) & F.col("bundle").isNotNull() & F.col("attestation").isNotNull(),
        "output is not what is attested": ~said("output_sha256").eqNullSafe(F.sha2("output", 256)) & F.col("output").isNotNull() & F.col("attestation").isNotNull(),
    }
    errors = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return cases.select("bundle_sha256", (F.size(errors) == 0).alias("ok"), F.array_join(errors, "; ").alias("errors"))
