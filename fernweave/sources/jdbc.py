"""Reading a query's result from another database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FETCH_SIZE = 10_000


def jdbc_options(
    url: str,
    query: str,
    fetch_size: int = FETCH_SIZE,
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options: one partition, or ``partitions`` ranges of a numeric column."""
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    if split_on is None:
        return {**options, "query": query}
    if bounds is None:
        raise ValueError("splitting a read needs the column's bounds")
    return {
        **options,
        "dbtable": f"({query}) q",  # a partitioned read takes a table expression, not a query
        "partitionColumn": split_on,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_jdbc(spark: SparkSession, url: str, query: str, **kwargs) -> DataFrame:
    """The query's result; see :func:`jdbc_options` for the arguments."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **kwargs)).load()
