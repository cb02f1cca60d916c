"""Files of local or shared folders, HDFS or S3 as Spark names them, opened by workers through Arrow."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def located(path: str):
    """(file system, name there) of a path as Spark's file sources give it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", quote(path, safe=":/@")))
