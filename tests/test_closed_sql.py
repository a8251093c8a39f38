"""Read-only SQL sees registered views and nothing else."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fernweave.plans.sharing import read_only_query


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("closed"))
    spark.range(5).withColumn("v", F.col("id") * 2).write.parquet(f"{folder}/seen")
    spark.read.parquet(f"{folder}/seen").createOrReplaceTempView("seen")
    spark.range(3).createOrReplaceTempView("numbers")
    spark.sql("DROP TABLE IF EXISTS hidden")
    spark.range(7).write.mode("overwrite").option("path", f"{folder}/hidden").saveAsTable("hidden")
    yield folder
    spark.sql("DROP TABLE IF EXISTS hidden")


@pytest.mark.parametrize(
    "query, rows",
    [
        ("SELECT * FROM seen", 5), ("SELECT * FROM seen AS hidden", 5), ("WITH hidden AS (SELECT * FROM seen) SELECT * FROM hidden", 5),
        ("SELECT s.id FROM seen s JOIN numbers n ON s.id = n.id WHERE s.v IN (SELECT v FROM seen WHERE v > 1)", 2), ("SELECT 1 AS one", 1), ("SELECT * FROM range(4)", 4),
        ("SELECT * FROM VALUES (1), (2) AS t(x)", 2), ("SELECT (SELECT max(v) FROM seen) AS m, explode(array(1, 2))", 2), ("SELECT id, count(*) OVER () FROM seen", 5),
        ("WITH a AS (SELECT * FROM seen), b AS (SELECT * FROM a) SELECT a.id FROM a JOIN b ON a.id = b.id", 5), ("SELECT * FROM SEEN UNION ALL SELECT id, id FROM Numbers", 8),
    ],
)
def test_views_can_be_read(spark, names, query, rows):
    assert read_only_query(spark, query).count() == rows


@pytest.mark.parametrize(
    "query",
    [
        "SELECT * FROM hidden", "SELECT * FROM hidden AS hidden", "SELECT * FROM default.hidden", "SELECT * FROM spark_catalog.default.hidden", "SELECT * FROM hidden AS seen",
        "WITH x AS (SELECT 1 AS hidden) SELECT * FROM hidden hidden", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "SELECT * FROM seen hidden JOIN hidden h ON hidden.id = h.id",
        "SELECT * FROM seen WHERE id IN (SELECT id FROM hidden AS hidden)", "SELECT (SELECT max(id) FROM hidden hidden) AS m FROM seen", "SELECT * FROM seen s WHERE EXISTS (SELECT 1 FROM hidden hidden WHERE hidden.id = s.id)",
        "SELECT * FROM (SELECT * FROM (SELECT * FROM hidden AS hidden) AS a) AS b", "SELECT * FROM parquet.`{folder}/hidden`", "SELECT * FROM parquet.`{folder}/hidden` AS seen",
        "SELECT input_file_name() FROM seen", "SELECT input_file_block_start() FROM seen", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM IDENTIFIER('hidden')",
        "SELECT * FROM seen, LATERAL (SELECT * FROM hidden hidden WHERE hidden.id = seen.id)", "SHOW TABLES", "SELECT 1; SELECT 2", "SELECT _metadata.file_path FROM seen",
        "SELECT id FROM seen UNION ALL SELECT id FROM hidden AS hidden",
    ],
)
def test_everything_else_is_refused(spark, names, query):
    with pytest.raises((ValueError, PySparkException)):
        read_only_query(spark, query.replace("{folder}", names)).collect()
