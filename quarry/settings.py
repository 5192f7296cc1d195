"""Settings of the service and the command line, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from quarry.errors import EngineError, ErrorCode


@dataclass(frozen=True)
class Settings:
    """Each comes from QUARRY_ and its name in capitals, else it is as here."""

    url: str = "http://127.0.0.1:8080"
    port: int = 8080
    catalog: str = "catalog.sqlite"
    master: str = ""  # of Spark; empty: as spark-submit or the Spark configuration says
    workers: int = 4  # queries at once
    most_rows: int = 1_000_000  # of one result
    held_rows: int = 5_000_000  # of all results that the driver keeps
    keep_seconds: float = 3600.0  # for which it keeps them

    @classmethod
    def of(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        found = {}
        for f in fields(cls):
            name = f"QUARRY_{f.name.upper()}"
            if name in environment:
                kind = type(f.default)
                try:
                    found[f.name] = kind(environment[name])
                except ValueError as e:
                    raise EngineError(ErrorCode.INVALID_REQUEST, f"{name} needs a {kind.__name__}.", setting=name) from e
                if kind is not str and found[f.name] <= 0:
                    raise EngineError(ErrorCode.INVALID_REQUEST, f"{name} must be above 0.", setting=name)
        return cls(**found)
