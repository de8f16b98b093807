"""Files of the shared folder that tasks read by themselves."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq


def system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, local or remote as far as pyarrow knows it, and the path there."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parsed.path)
    return pafs.FileSystem.from_uri(uri)


def read_part(uri: str) -> list[dict]:
    """The rows of one partition folder of a written table; none if there is no such folder."""
    fs, path = system(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    rows: list[dict] = []
    for info in sorted(found, key=lambda i: i.path):
        if info.is_file and info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as source:
                rows += pa.Table.from_batches(pq.ParquetFile(source).iter_batches()).to_pylist() if info.size else []
    return rows
