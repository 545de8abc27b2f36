"""Reader for directories of YAML pack files, as a data source of its own."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas
from ..operators.requests import validate_packs

COLUMNS = "pack_dir string, stem string, path string, doc string, error string"


def yaml_to_json(content: bytes, where: str) -> tuple[str | None, str | None]:
    """JSON text of one YAML mapping, or what is wrong with it; an empty file is an empty mapping."""
    import yaml

    try:
        data = yaml.safe_load(content) or {}
        if isinstance(data, dict):
            return json.dumps(data, default=str, allow_nan=False), None
        # Fixed value: issue and error texts are matched on by users.
        return None, f"invalid yaml {where}: expected a mapping, got {type(data).__name__}"
    except Exception as error:  # bad YAML, bad dates, keys that JSON cannot hold: this file's fault alone
        # Fixed value: issue and error texts are matched on by users.
        return None, f"invalid yaml {where}: {error}"


class Directories(InputPartition):
    """Some pack directories, read by one task."""

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class PackFilesReader(DataSourceReader):
    """The driver lists the pack directories; the files in them are listed and read by the tasks."""

    def __init__(self, options: dict):
        self.root, self.each = options["path"], max(1, int(options.get("directories", 64)))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[Directories]:
        from pyarrow import fs

        files, base = self._files()
        found = sorted(i.path for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)
        return [Directories(found[k : k + self.each]) for k in range(0, len(found), self.each)] or [Directories([])]

    def read(self, partition: Directories) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = self._files()
        known = {f"{stem}.yaml": stem for stem in ("pack", *schemas.PACK_AUX_FILES)}
        for folder in partition.paths:
            held = files.get_file_info(fs.FileSelector(folder))
            for info in sorted(held, key=lambda i: i.path):
                if info.type != fs.FileType.File or info.base_name not in known:
                    continue
                try:
                    with files.open_input_stream(info.path) as stream:
                        doc, error = yaml_to_json(stream.read(), info.path)
                except OSError as failure:  # a file that cannot be read is one violation
                    # Fixed value: issue and error texts are matched on by users.
                    doc, error = None, f"invalid yaml {info.path}: {failure}"
                yield folder.rsplit("/", 1)[-1], known[info.base_name], info.path, doc, error


class PackFiles(DataSource):
    """``spark.read.format("pack_yaml").load(root)``: a row per known YAML file under ``root/<pack>/``.

    Empty files have a row, unlike in Spark's own file sources. ``directories`` is how many packs a task
    reads. ``root`` is a path or URI that the workers can reach.
    """

    @classmethod
    def name(cls) -> str:
        return "pack_yaml"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PackFilesReader:
        return PackFilesReader(self.options)


def read_pack_files(spark: SparkSession, root: str, directories: int = 64) -> DataFrame:
    """One row per known YAML file under ``root/<pack>/``: pack_dir, stem, path, doc, error."""
    spark.dataSource.register(PackFiles)
    return spark.read.format("pack_yaml").option("directories", directories).load(root)


def read_pack_configs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Valid packs and violations of a directory of packs."""
    return validate_packs(read_pack_files(spark, root))
