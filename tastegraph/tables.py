"""A read-only bundle of named DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


class Tables:
    """Named DataFrames with attribute access; frames may be built on first use.

    ``Tables(title=df)`` holds ready frames. ``Tables(loader=fn)`` asks ``fn(name)`` the first
    time a name is read, so a job only plans the tables it touches.
    """

    def __init__(self, loader: Callable[[str], DataFrame] | None = None, **frames: DataFrame):
        self._loader = loader
        self._frames: dict[str, DataFrame] = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        frames = self.__dict__["_frames"]
        if name not in frames:
            loader = self.__dict__["_loader"]
            if loader is None:
                raise AttributeError(f"no table named {name!r}")
            frames[name] = loader(name)
        return frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def replace(self, **frames: DataFrame) -> "Tables":
        merged: Mapping[str, DataFrame] = {**self._frames, **frames}
        return Tables(loader=self._loader, **merged)

    def names(self) -> list[str]:
        return sorted(self._frames)
