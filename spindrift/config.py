"""Settings by dotted path, typed parameters of running objects, and replaceable parts."""

from __future__ import annotations

import configparser
import os
from collections.abc import Callable, Mapping
from typing import Any

DEFAULTS: dict[str, str] = {"scheduler.timeout": "10 hours", "queue.files_per_batch": "1", "dispatcher.mode": "merge", "feed.n": "5"}
#: Names a file with more settings.
ENV = "FRONTIER_CONF"


class Config:
    """Settings ``section.name``: given ones, over those of a file, over the defaults."""

    def __init__(self, given: Mapping[str, Any] | None = None, path: str | None = None):
        self.values: dict[str, Any] = dict(DEFAULTS)
        path = path or os.environ.get(ENV)
        if path:
            parser = configparser.ConfigParser()
            with open(path) as f:
                parser.read_file(f)
            self.merge({f"{s}.{k}": v for s in parser.sections() for k, v in parser[s].items()})
        self.merge(given or {})

    def merge(self, more: Mapping[str, Any]) -> None:
        self.values.update(more)

    def get(self, name: str, default: Any = None) -> Any:
        return self.values.get(name, default)

    def getint(self, name: str, default: int | None = None) -> int | None:
        v = self.get(name, default)
        return None if v is None else int(v)

    def getfloat(self, name: str, default: float | None = None) -> float | None:
        v = self.get(name, default)
        return None if v is None else float(v)

    def getbool(self, name: str, default: bool | None = None) -> bool | None:
        v = self.get(name, default)
        return None if v is None else parse_bool(v)


def parse_bool(value: Any) -> bool:
    """``true`` and ``false`` in any case, numbers unless zero, and what else is not empty."""
    if isinstance(value, str):
        if value.lower() in ("true", "false"):
            return value.lower() == "true"
        try:
            return int(value) != 0
        except ValueError:
            return value != ""
    return bool(value)


class Parameters:
    """Reads and sets ``object.parameter`` of objects that list ``PARAMS`` (name, type)."""

    def __init__(self, objects: Mapping[str, Any]):
        self.objects = objects

    def _find(self, name: str) -> tuple[Any, str, Callable]:
        where, dot, what = name.partition(".")
        if not dot or "." in what:
            raise ValueError(f"{name!r} is not object.parameter")
        if where not in self.objects:
            raise ValueError(f"no object {where!r}")
        kinds = dict(getattr(self.objects[where], "PARAMS", ()))
        if what not in kinds:
            raise ValueError(f"no parameter {what!r} of {where!r}")
        return self.objects[where], what, kinds[what]

    def get(self, name: str) -> Any:
        thing, what, _ = self._find(name)
        return getattr(thing, what, None)

    def set(self, name: str, value: Any) -> tuple[Any, Any]:
        """The new and the former value; a value that the type refuses is an error."""
        thing, what, kind = self._find(name)
        new, old = (parse_bool if kind is bool else kind)(value), getattr(thing, what, None)
        setattr(thing, what, new)
        return new, old


class Parts:
    """Makers of replaceable parts by name; ``single`` keeps what it made."""

    def __init__(self, **makers: Callable):
        self.makers, self.made = dict(makers), {}

    def replace(self, **makers: Callable) -> None:
        self.makers.update(makers)

    def make(self, name: str, *args, **kw) -> Any:
        if name not in self.makers:
            raise KeyError(f"no part {name!r}")
        return self.makers[name](*args, **kw)

    def single(self, name: str, *args, **kw) -> Any:
        if name not in self.made:
            self.made[name] = self.make(name, *args, **kw)
        return self.made[name]
