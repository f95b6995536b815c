"""Tables by name that are planned when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class Tables(Mapping):
    """A mapping from names to DataFrames; each maker gets the mapping itself and runs once.

    Steps between are found by name too, but aren't counted among the tables."""

    def __init__(self, makers: dict[str, Callable[[Tables], DataFrame]], between: dict[str, Callable[[Tables], DataFrame]] | None = None):
        self._makers, self._between, self._made = makers, between or {}, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = (self._makers.get(name) or self._between[name])(self)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def with_more(self, makers: dict[str, Callable[[Tables], DataFrame]]) -> Tables:
        """These tables and more, which may use them."""
        out = Tables(self._makers | makers, self._between)
        out._made = dict(self._made)
        return out
