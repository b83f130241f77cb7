"""Where a query keeps files that all executors and the driver see, and how tasks reach them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one that the cluster names in spark.checkpoint.dir.  Only in local mode may it be unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/tidemark-work"
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(path: str):
    """File system and plain path of a URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def remove(path: str) -> None:
    files, place = store(path)
    from pyarrow import fs

    if files.get_file_info(place).type == fs.FileType.Directory:
        files.delete_dir(place)
