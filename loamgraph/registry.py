"""All queries of the graph engine by name, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of a ``Graph`` as query ``name``; ``oracle`` is SQL over the projected tables."""

    def add(make):
        from .fixtures import WITH, graph

        QUERIES[name] = lambda spark, sf_dir: make(graph(spark, sf_dir))
        if oracle:
            ORACLES[name] = WITH + oracle
        return make

    return add


def load() -> None:
    from .plans import alias, backfill, changes, collect, diagnostics, files, folds, legacy, mutations, names, pool, presets, reads, relays, review, scalars, search, segment, states, upkeep, views  # noqa: F401


load()
