"""How a module declares its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import views

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def both(self, name: str, body: str, *needs: str, duck: str | None = None, gain: int = views.GAIN) -> None:
        """SQL over the views ``needs``, written ``{name}``; ``duck`` where DuckDB spells it otherwise.
        Whole-number division is written ``//``."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return views.select({n: views.VIEWS[n](spark, sf_dir, gain) for n in needs}, body.replace(" // ", " div "))

        self.queries[name] = query
        self.oracle[name] = f"{views.duck(*needs, gain=gain)}\n{(duck or body).format(**{n: n for n in needs})}"

    def rows(self, name: str, body: str, *tables: tuple[str, str, str, list[tuple]], duck: str | None = None) -> None:
        """SQL over literal tables (name, Spark schema, column list, rows)."""
        from tessera.plans.tables import frame, values_sql

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return views.select({n: frame(spark, schema, r) for n, schema, _, r in tables}, body)

        self.queries[name] = query
        self.oracle[name] = "WITH " + ", ".join(values_sql(n, columns, r) for n, _, columns, r in tables) + "\n" + (duck or body).format(**{t[0]: t[0] for t in tables})

    def frame(self, name: str, duck: str | None = None):
        """A query given as a function; ``duck`` is its oracle, if it has one."""

        def keep(f: Query) -> Query:
            self.queries[name] = f
            if duck:
                self.oracle[name] = duck
            return f

        return keep
