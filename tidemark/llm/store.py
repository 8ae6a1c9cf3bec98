"""Binary files in the shared folder, written and range-read by Python on the executors.

pyarrow's file systems serve file://, hdfs://, viewfs://, s3:// and gs:// paths.
A file appears under its name only when it is whole, so a task that is run again
or twice leaves one good file.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def create(uri: str):
    """A stream whose content takes the name `uri` at the end of the block, in place of any earlier file."""
    system, path = resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own) as out:
            yield out
        system.move(own, path)
    except BaseException:
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_file(own)
        raise


@contextmanager
def open_ranges(uri: str):
    """A random-access file: size(), read_at(n, offset)."""
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        yield file
