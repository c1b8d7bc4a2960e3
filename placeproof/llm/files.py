"""Files that tasks write below the shared folder, through whatever store its address names."""
import uuid

import pyarrow.fs as pafs


def make_folder(folder: str) -> None:
    """An empty folder, so that a corpus without rows can be read back."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)


def put(folder: str, name: str, chunks) -> int:
    """Write the chunks to folder/name and give the size.  The name appears only when the file is whole, so a retried or a second
    attempt of the same task replaces it by the same content."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/_{name}-{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(hidden) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(hidden, f"{path}/{name}")
    return size
