"""Cells derived from the driver's tables, by the same integer arithmetic in Spark and in SQL.

Parts lie on a lattice of 50 columns; lineitems give quantities and prices by ship year, suppliers a mask, brands zones,
events readings, documents annotations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import OFFSETS

#: DuckDB's spelling of every fixture, before a query's own SQL.
CTES = """grid AS (SELECT p_partkey k, CAST(p_partkey % 50 AS INT) q, CAST(p_partkey // 50 AS INT) r, 'C3-' || CAST(p_partkey % 50 AS VARCHAR) || '-' || CAST(p_partkey // 50 AS VARCHAR) AS dggid FROM part),
off AS (SELECT * FROM (VALUES (1,0),(-1,0),(0,1),(0,-1),(1,-1),(-1,1)) o(dq,dr)),
topo AS (SELECT a.dggid, b.dggid neighbor_dggid FROM grid a CROSS JOIN off JOIN grid b ON b.q=a.q+dq AND b.r=a.r+dr),
cls AS (SELECT *, CASE ((q-r)%3+3)%3 WHEN 1 THEN q-1 WHEN 2 THEN q+1 ELSE q END q2 FROM grid),
pqr AS (SELECT dggid, (q2-r)//3 pq, (q2+2*r)//3 pr FROM cls),
parent AS (SELECT dggid, 'C2-' || CASE WHEN pq<0 THEN 'n' ELSE '' END || CAST(abs(pq) AS VARCHAR) || '-' || CAST(pr AS VARCHAR) parent_dggid FROM pqr),
qty AS (SELECT dggid, CAST(year(l_shipdate) AS BIGINT) tid, 'quantity' attr_key, CAST(NULL AS VARCHAR) value_text, CAST(SUM(l_quantity) AS DOUBLE) value_num FROM lineitem JOIN grid ON k=l_partkey GROUP BY 1,2),
price AS (SELECT dggid, CAST(year(l_shipdate) AS BIGINT) tid, 'price' attr_key, CAST(NULL AS VARCHAR) value_text, CAST(SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS DOUBLE)/100 value_num FROM lineitem JOIN grid ON k=l_partkey GROUP BY 1,2),
elev AS (SELECT dggid, CAST(0 AS BIGINT) tid, 'elevation' attr_key, CAST(NULL AS VARCHAR) value_text, p_retailprice value_num FROM part JOIN grid ON k=p_partkey),
mask AS (SELECT dggid FROM grid JOIN supplier ON k=s_suppkey),
zone AS (SELECT dggid, p_brand zone_id FROM part JOIN grid ON k=p_partkey),
evt AS (SELECT event_id, dggid, ts, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS BIGINT) tid, event_type attr_key, value value_num FROM events JOIN grid ON k = user_id % (SELECT COUNT(*) FROM part)),
ann AS (SELECT doc_id id, dggid, text AS content, source "type", CASE doc_id%3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'shared' END visibility, 'u' || CAST(doc_id % 7 AS VARCHAR) created_by FROM documents JOIN grid ON k = doc_id % (SELECT COUNT(*) FROM part)),
ds AS (SELECT CAST(c_custkey AS VARCHAR) id, CASE c_custkey % 5 WHEN 0 THEN 'Buffer Result' WHEN 1 THEN 'Result of ' || c_name WHEN 2 THEN c_name || ' result 100%' ELSE c_name END "name",
  CASE c_custkey % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'active' ELSE 'failed' END status, CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'shared' END visibility,
  'u' || CAST(c_custkey % 7 AS VARCHAR) created_by, 'u' || CAST(c_custkey % 4 AS VARCHAR) shared_user,
  CASE c_custkey % 8 WHEN 0 THEN '{"source":"spatial_op","rows":5}' WHEN 1 THEN '{"type":"buffer","parents":["1","2"]}' WHEN 2 THEN '{"source_type":"operation","bands":[1,2]}' WHEN 3 THEN '{"source":"Spatial_Op"}' WHEN 4 THEN '{"type":"analysis"}' END metadata,
  TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * CAST(c_custkey % 200 AS INT) created_at FROM customer),
up AS (SELECT CAST(o_orderkey AS VARCHAR) id, 'file' || CAST(o_orderkey AS VARCHAR) || '.tif' filename, 'u' || CAST(o_custkey % 7 AS VARCHAR) created_by, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'active' ELSE 'processing' END status, CAST(o_orderdate AS TIMESTAMP) created_at FROM orders),
items AS (SELECT 's' || CAST(o_orderkey AS VARCHAR) id, CASE o_custkey % 2 WHEN 0 THEN 'sentinel' ELSE 'landsat' END collection, CAST(o_custkey % 160 - 80 AS DOUBLE) w, CAST(o_orderkey % 80 - 40 AS DOUBLE) s, CAST(o_orderkey % 100 AS DOUBLE) cloud_cover,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END acquired, o_orderkey % 3 = 0 AS has_blue, o_orderkey % 5 = 0 AS has_thumb FROM orders),
q97 AS (SELECT dggid, value_num FROM qty WHERE tid = 1997),
q98 AS (SELECT dggid, value_num FROM qty WHERE tid = 1998),
nb AS (SELECT a.dggid, a.value_num v, t.neighbor_dggid neighbor, b.value_num v_n FROM q97 a JOIN topo t ON t.dggid=a.dggid JOIN q97 b ON b.dggid=t.neighbor_dggid),
st AS (SELECT avg(value_num) m, stddev_pop(value_num) sd, count(*) n FROM q97)"""


class Fixtures:
    """The derived tables of one folder, lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _dggid(key: str):
        return F.concat(F.lit("C3-"), (F.col(key) % 50).cast("string"), F.lit("-"), F.expr(f"{key} div 50").cast("string"))

    def grid(self) -> DataFrame:
        """k, q, r, dggid of every part's cell."""
        p = self.table("part").select(F.col("p_partkey").alias("k"))
        return p.select("k", (F.col("k") % 50).cast("int").alias("q"), F.expr("k div 50").cast("int").alias("r"), self._dggid("k").alias("dggid"))

    def topo(self) -> DataFrame:
        """The adjacency: each cell's six places joined with the cells that are there."""
        g = self.grid()
        places = F.array(*[F.struct((F.col("q") + dq).alias("q"), (F.col("r") + dr).alias("r")) for dq, dr in OFFSETS])
        near = g.select("dggid", F.explode(places).alias("at")).select("dggid", "at.q", "at.r")
        return near.join(g.select("q", "r", F.col("dggid").alias("neighbor_dggid")), ["q", "r"]).select("dggid", "neighbor_dggid")

    def parent(self) -> DataFrame:
        c = F.pmod(F.col("q") - F.col("r"), F.lit(3))
        q2 = F.when(c == 1, F.col("q") - 1).when(c == 2, F.col("q") + 1).otherwise(F.col("q"))
        x = self.grid().withColumn("q2", q2).select("dggid", F.expr("(q2 - r) div 3").alias("pq"), F.expr("(q2 + 2 * r) div 3").alias("pr"))
        return x.select("dggid", F.concat(F.lit("C2-"), F.when(F.col("pq") < 0, "n").otherwise(""), F.abs("pq").cast("string"), F.lit("-"), F.col("pr").cast("string")).alias("parent_dggid"))

    def _cells(self, value, key: str) -> DataFrame:
        """Lineitems summed by part and year; every part has a cell, so the id comes from the key and no join is needed but for parts that don't exist."""
        li = self.table("lineitem").groupBy("l_partkey", F.year("l_shipdate").cast("bigint").alias("tid")).agg(value.alias("value_num"))
        x = li.join(self.grid().select(F.col("k").alias("l_partkey"), "dggid"), "l_partkey")
        return x.select("dggid", "tid", F.lit(key).alias("attr_key"), F.lit(None).cast("string").alias("value_text"), "value_num", F.lit(None).cast("string").alias("value_json"))

    def qty(self) -> DataFrame:
        return self._cells(F.sum("l_quantity").cast("double"), "quantity")

    def price(self) -> DataFrame:
        return self._cells(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).cast("double") / 100, "price")

    def elev(self) -> DataFrame:
        return self.table("part").select(self._dggid("p_partkey").alias("dggid"), F.lit(0).cast("bigint").alias("tid"), F.lit("elevation").alias("attr_key"), F.col("p_retailprice").alias("value_num"))

    def year(self, tid: int, cells: DataFrame | None = None) -> DataFrame:
        """(dggid, value_num) of one year's quantities."""
        return (self.qty() if cells is None else cells).where(F.col("tid") == tid).select("dggid", "value_num")

    def mask(self) -> DataFrame:
        return self.grid().join(self.table("supplier").select(F.col("s_suppkey").alias("k")), "k", "left_semi").select("dggid")

    def zone(self) -> DataFrame:
        return self.table("part").select(self._dggid("p_partkey").alias("dggid"), F.col("p_brand").alias("zone_id"))

    def _at_part(self, df: DataFrame, key: str) -> DataFrame:
        """df with the cell of the part at key modulo the number of parts."""
        n = self.table("part").agg(F.count("*").alias("_n"))
        return df.crossJoin(F.broadcast(n)).withColumn("k", F.col(key) % F.col("_n")).join(self.grid().select("k", "dggid"), "k").drop("_n", "k")

    def evt(self) -> DataFrame:
        e = self._at_part(self.table("events"), "user_id")
        return e.select("event_id", "dggid", "ts", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("bigint").alias("tid"), F.col("event_type").alias("attr_key"), F.col("value").alias("value_num"))

    def ann(self) -> DataFrame:
        d = self._at_part(self.table("documents"), "doc_id")
        seen = F.when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 3 == 1, "private").otherwise("shared")
        return d.select(F.col("doc_id").alias("id"), "dggid", F.col("text").alias("content"), F.col("source").alias("type"), seen.alias("visibility"), F.concat(F.lit("u"), (F.col("doc_id") % 7).cast("string")).alias("created_by"))

    def every(self, n: int) -> DataFrame:
        """Seeds: the cells whose part key is a multiple of n."""
        return self.grid().where(F.col("k") % n == 0).select("dggid")

    def datasets(self) -> DataFrame:
        """A catalogue of datasets, one for each customer, in all kinds of names, states and metadata."""
        k = F.col("c_custkey")
        pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) if isinstance(x, str | None) else x for x in v]), (k % n + 1).cast("int"))
        name = F.when(k % 5 == 0, F.lit("Buffer Result")).when(k % 5 == 1, F.concat(F.lit("Result of "), "c_name")).when(k % 5 == 2, F.concat("c_name", F.lit(" result 100%"))).otherwise(F.col("c_name"))
        metadata = (
            '{"source":"spatial_op","rows":5}', '{"type":"buffer","parents":["1","2"]}', '{"source_type":"operation","bands":[1,2]}',
            '{"source":"Spatial_Op"}', '{"type":"analysis"}', None, None, None,
        )
        at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=(k % 200).cast("int"))
        return self.table("customer").select(
            k.cast("string").alias("id"), name.alias("name"), F.lit(None).cast("string").alias("description"), F.lit("hex").alias("dggs_name"), F.lit(3).alias("level"),
            F.concat(F.lit("u"), (k % 7).cast("string")).alias("created_by"), pick(3, "processing", "active", "failed").alias("status"), pick(3, "public", "private", "shared").alias("visibility"),
            F.array(F.concat(F.lit("u"), (k % 4).cast("string"))).alias("shared_with"), pick(8, *metadata).alias("metadata"), at.alias("created_at"),
        )

    def uploads(self) -> DataFrame:
        """Uploads, one for each order."""
        k = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "active").otherwise("processing")
        return self.table("orders").select(
            k.cast("string").alias("id"), F.concat(F.lit("file"), k.cast("string"), F.lit(".tif")).alias("filename"),
            F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string")).alias("created_by"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )

    def items(self) -> DataFrame:
        """Items of a scene catalogue, one for each order: ten degrees wide, with a red band, a third of them with a blue one, a fifth with a thumbnail."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        w, s = (c % 160 - 80).cast("double"), (k % 80 - 40).cast("double")
        asset = lambda href, kind, role: F.struct(F.concat(F.lit(href), k.cast("string")).alias("href"), F.lit(kind).alias("type"), F.array(F.lit(role)).alias("roles"))
        entry = lambda name, *a: F.struct(F.lit(name).alias("key"), asset(*a).alias("value"))
        every = F.array(entry("B04", "red/", "image/tiff", "data"), entry("meta", "meta/", "text/xml", "metadata"))
        blue, thumb = F.array(entry("B02", "blue/", "image/jp2", "data")), F.array(entry("thumbnail", "thumb/", "image/png", "thumbnail"))
        none = F.slice(blue, 1, 0)
        assets = F.map_from_entries(F.concat(every, F.when(k % 3 == 0, blue).otherwise(none), F.when(k % 5 == 0, thumb).otherwise(none)))
        at = F.when(k % 9 != 0, F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        return self.table("orders").select(
            F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(c % 2 == 0, "sentinel").otherwise("landsat").alias("collection"),
            F.array(w, s, w + 10, s + 10).alias("bbox"), at.alias("datetime"), (k % 100).cast("double").alias("cloud_cover"), assets.alias("assets"),
        )
