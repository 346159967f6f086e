"""Binary files in the shared folder, from tasks: pyarrow file systems by URI, names that are new for each attempt."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def attempt_name(prefix: str, suffix: str) -> str:
    """A name no other attempt uses: a task that is lost and run again leaves a file that no row names."""
    ctx = TaskContext.get()
    return f"{prefix}-{ctx.partitionId() if ctx else 0:06d}-{uuid.uuid4().hex[:12]}{suffix}"
