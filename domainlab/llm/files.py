"""Binary files in a folder that all executors share, opened through Arrow's file systems
(local and network mounts, HDFS, object stores). Written under a passing name and moved, so
that a task that is lost or run twice leaves no half-written file under the final name."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Hadoop writes file:/path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def create(uri: str):
    """A binary output stream; the file gets its name when the block ends well."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex[:8]}.passing"
    with system.open_output_stream(passing, compression=None) as out:
        yield out
    system.move(passing, path)


def open_file(uri: str):
    """A seekable binary input."""
    system, path = place(uri)
    return system.open_input_file(path)
