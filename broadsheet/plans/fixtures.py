"""Page-layout tables derived from the order tables, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Horizontal baselines in three columns; texts that both engines run.
LINES = """
SELECT page_id,
  CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS idx,
  40 + (l_linenumber % 3) * 620 + l_partkey % 25 AS x0,
  600 + (l_linenumber % 3) * 620 + l_partkey % 25 - l_suppkey % 60 AS x1,
  CAST(floor(l_extendedprice) AS BIGINT) % 9000 AS y,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('a', CAST(l_suppkey % 4 AS VARCHAR(9))) END AS article_id
FROM (SELECT *, CAST(floor(l_orderkey / 75.0) AS BIGINT) AS page_id FROM lineitem) t
"""
#: Baselines of three points.
SLANTED = f"""
SELECT page_id, idx, x0, y AS y0, CAST(floor((x0 + x1) / 2.0) AS BIGINT) AS xm, y + (x0 % 7) - 3 AS ym, x1, y + (x1 % 11) - 5 AS y1, article_id
FROM ({LINES}) f
"""
REGIONS = """
SELECT CAST(floor(o_orderkey / 75.0) AS BIGINT) AS page_id, o_orderkey AS region_id,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'GraphicRegion' WHEN o_orderpriority LIKE '2%' THEN 'SeparatorRegion' ELSE 'TextRegion' END AS region_type,
  o_custkey % 1500 AS x, CAST(floor(o_totalprice) AS BIGINT) % 8000 AS y, 60 + o_custkey % 400 AS w, 40 + o_orderkey % 300 AS h, o_orderpriority
FROM orders
"""
PIXELS_SPARK = """
SELECT vec_id AS img_id, CAST(p div 8 AS INT) AS y, CAST(p % 8 AS INT) AS x,
  CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS INT) AS v
FROM (SELECT vec_id, posexplode(embedding) AS (p, e) FROM embeddings)
"""
PIXELS_DUCKDB = """
SELECT vec_id AS img_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x,
  CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255))) AS INT) AS v
FROM embeddings, range(1, 65) r(i)
"""
ARTICLE_TEXT = "SELECT conv_id AS page_id, turn AS idx, role AS article_id, text FROM conversations"
TEXT_LINES_SPARK = r"""
SELECT doc_id AS page_id, p AS idx, l AS line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (p, l) FROM documents)
"""
TEXT_LINES_DUCKDB = """
SELECT doc_id AS page_id, CAST(unnest(range(0, len(parts))) AS INT) AS idx, unnest(parts) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t
"""


def sql(spark: SparkSession, sf_dir: str, text: str, by_page: bool = False) -> DataFrame:
    """text over the tables it names, each read from sf_dir. by_page: lineitem is dealt by the page of its rows first, to as many
    partitions as folds over pages have, so that the rows of text stand where those folds want them."""
    import re

    from ..operators.clustering import fold_parts

    def read(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return rows.repartition(fold_parts(spark), F.expr("CAST(floor(l_orderkey / 75.0) AS BIGINT)")) if by_page and name == "lineitem" else rows

    names = ("lineitem", "orders", "embeddings", "conversations", "documents", "pages")
    used = [n for n in names if re.search(rf"\b{n}\b", text)]
    for n in used:
        text = re.sub(rf"\bFROM {n}\b", f"FROM {{{n}}}", text)
    return spark.sql(text, **{n: read(n) for n in used})
