"""Named extension points: one registry a kind, each mapping a name to a function on DataFrames."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict[str, Callable]):
    """Functions of one kind by name; a name is given once unless it is replaced on purpose."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def add(self, name: str, replace: bool = False) -> Callable[[Callable], Callable]:
        def put(function: Callable) -> Callable:
            if name in self and not replace:
                raise ValueError(f"{self.kind} {name!r} is there already")
            self[name] = function
            return function

        return put

    def find(self, name: str) -> Callable:
        if name not in self:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self))}")
        return self[name]


CHUNKERS, BUILDERS, EMBEDDERS, RETRIEVERS, STRATEGIES, METRICS = (Registry(k) for k in ("chunker", "builder", "embedder", "retriever", "strategy", "metric"))
