"""Tenancy: no client table without a scope, and each scope sees its own rows only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: tables whose rows belong to an organisation
CLIENT_TABLES = frozenset({"documents", "ocr_results", "document_events", "jobs", "extractions", "transactions", "corrections"})


class ScopeError(PermissionError):
    pass


@dataclass(frozen=True)
class Scope:
    """An organisation, or everyone. Immutable: another scope is another object."""

    organisation_id: str | None
    everyone: bool = False

    def __post_init__(self):
        if self.everyone == (self.organisation_id is not None):
            raise ScopeError("a scope is one organisation or everyone")


class ScopedTables:
    """Catalog of DataFrames behind a scope. The predicate sits on the table itself, so it holds in joins, outer joins and subqueries, and reaches the scan."""

    def __init__(self, tables: dict[str, DataFrame], scope: Scope | None):
        if not isinstance(scope, Scope):
            raise ScopeError("no scope is set")
        self._tables, self.scope = dict(tables), scope

    def table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if name not in CLIENT_TABLES or self.scope.everyone:
            return found
        if "organisation_id" not in found.columns:
            raise ScopeError(f"{name} does not say whose its rows are")
        return found.where(F.col("organisation_id") == F.lit(self.scope.organisation_id))

    def sql(self, spark: SparkSession, query: str) -> DataFrame:
        """SQL over scoped tables, named ``{table}`` in the text; no base table is reachable by these names otherwise."""
        used = {n: self.table(n) for n in self._tables if f"{{{n}}}" in query}
        return spark.sql(query, **used)

    def checked(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows about to be written; a foreign row fails the job that writes it."""
        if name not in CLIENT_TABLES or self.scope.everyone:
            return rows
        own = F.coalesce(F.col("organisation_id") == F.lit(self.scope.organisation_id), F.lit(False))
        return rows.withColumn("organisation_id", F.when(own, F.col("organisation_id")).otherwise(F.raise_error(F.lit(f"{name}: a row of another organisation"))))


def without_organisation(rows: DataFrame, organisation_id: str) -> DataFrame:
    """A table rewritten without one organisation's rows."""
    return rows.where(~F.col("organisation_id").eqNullSafe(F.lit(organisation_id)))
