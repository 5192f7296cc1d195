"""What a scan reads, file by file."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FileScanTask:
    """A byte range of a file. row_count is None where only the file itself knows it; positions of the rows
    that delete_files name are of the whole file."""

    path: str
    format: str
    start: int = 0
    length: int | None = None
    row_count: int | None = None
    partition: dict = field(default_factory=dict)
    delete_files: tuple[str, ...] = ()
