"""Named DataFrames that are put together when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the network: it is shuffled, and never sent whole through the driver.

    Columnar files of ids are a small part of what they hold, so a side whose file passes for small may be many times the
    size that Spark allows for a broadcast, and the joins of an iteration add up.
    """
    return df.hint("merge")


class Frames(Mapping):
    """A mapping of layer names to DataFrames; building a plan takes driver time that unused layers need not cost."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Frames:
        """The same layers, each changed."""
        return Frames({name: (lambda name=name: change(self[name])) for name in self})
