"""Read-only SQL over named sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register_functions
from ..operators.predicates import refuse_engine_calls

@dataclass
class SqlResult:
    frame: DataFrame  # at most ``limit`` rows, all of them without a limit
    limit: int | None
    full: DataFrame

    def truncated(self) -> bool:
        """True only when rows were really left out."""
        return self.limit is not None and self.full.limit(self.limit + 1).count() > self.limit


FILES = "spark.sql.runSQLOnFiles"


def sql_query(
    spark: SparkSession, sql: str, sources: dict[str, DataFrame] | None = None, limit: int | None = None
) -> SqlResult:
    """Run a query over the given frames (as temporary views) and the SQL
    functions of this package.

    The text is read as a subquery, where only queries are allowed; files
    cannot be named as tables, and calls into Java classes are refused."""
    for name, df in (sources or {}).items():
        df.createOrReplaceTempView(name)
    register_functions(spark)
    refuse_engine_calls(sql)
    before = spark.conf.get(FILES)
    spark.conf.set(FILES, "false")
    try:
        full = spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    except ParseException as e:
        raise ValueError(f"Only queries are allowed: {e}") from e
    finally:
        spark.conf.set(FILES, before)
    return SqlResult(full if limit is None else full.limit(limit), limit, full)
