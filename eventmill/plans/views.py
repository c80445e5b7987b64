"""The given tables read as event tables: each view as a DataFrame and as SQL."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: The reference time of all queries.
AS_OF = "1998-06-01 12:00:00"
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def put(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads back, where all executors see it."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events: the customer's part gives name and category, the customer the place."""
    o, c, p = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "part")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(p, p["p_partkey"] == o["o_custkey"])
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return rows.select(
        key.alias("event_id"),
        F.concat_ws(" ", "p_name", "c_mktsegment").alias("name"),
        text("https://www.example.com/", F.lower("c_mktsegment"), "/", key % 500, "/").alias("event_url"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))).alias("start_ts"),
        text("Un ", F.col("p_type"), " de ", F.col("p_brand"), " pour ", F.col("c_name")).alias("description"),
        text("Salle ", cust % 40).alias("location"),
        F.lower("p_type").alias("category"),
        F.array(F.lower("p_type")).alias("categories"),
        F.array(text("salle-", cust % 40)).alias("locations"),
        F.array(F.lower("p_brand"), F.substring_index("p_name", " ", 1)).alias("tags"),
        text("src", cust % 15, ":", key).alias("source_id"),
        text("src", cust % 15).alias("source"),
        F.when(key % 3 == 0, "").otherwise(text("/images/", cust, ".jpg")).alias("image"),
        (F.col("o_orderstatus") == "F").alias("expired"),
        (key % 20 == 0).alias("draft"),
    )


EVENTS = """ev as (
  select o_orderkey as event_id, p_name || ' ' || c_mktsegment as name,
    'https://www.example.com/' || lower(c_mktsegment) || '/' || (o_orderkey % 500) || '/' as event_url,
    o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) as start_ts,
    'Un ' || p_type || ' de ' || p_brand || ' pour ' || c_name as description,
    'Salle ' || (o_custkey % 40) as location, lower(p_type) as category,
    [lower(p_type)] as categories, ['salle-' || (o_custkey % 40)] as locations,
    [lower(p_brand), split_part(p_name, ' ', 1)] as tags,
    'src' || (o_custkey % 15) || ':' || o_orderkey as source_id, 'src' || (o_custkey % 15) as source,
    case when o_orderkey % 3 = 0 then '' else '/images/' || o_custkey || '.jpg' end as image,
    o_orderstatus = 'F' as expired, o_orderkey % 20 = 0 as draft
  from orders join customer on o_custkey = c_custkey join part on p_partkey = o_custkey
)"""


def venues(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as venues; names with accents and articles, an alias, a search name, a website for some."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    return s.select(
        k.cast("int").alias("ord"),
        text("salle-", k).alias("slug"),
        text("Le Théâtre ", k).alias("title"),
        F.when(k % 4 == 0, "").otherwise(text("Lieu numéro ", k)).alias("description"),
        F.when(k % 5 == 0, "").otherwise(text(k, " rue de la République")).alias("address"),
        F.when(k % 3 == 0, "").otherwise(text("https://www.venue", k % 30, ".example.org/")).alias("website"),
        F.when(k % 7 == 0, "").otherwise("Salle").alias("type"),
        F.array(text("/locations/éspace-", k, "/")).alias("aliases"),
        F.array(text("L'Atelier ", k)).alias("search_names"),
        F.when(k % 6 == 0, "").otherwise(text("Corps ", k)).alias("body"),
    )


VENUES = """ve as (
  select cast(s_suppkey as integer) as ord, 'salle-' || s_suppkey as slug, 'Le Théâtre ' || s_suppkey as title,
    case when s_suppkey % 4 = 0 then '' else 'Lieu numéro ' || s_suppkey end as description,
    case when s_suppkey % 5 = 0 then '' else s_suppkey || ' rue de la République' end as address,
    case when s_suppkey % 3 = 0 then '' else 'https://www.venue' || (s_suppkey % 30) || '.example.org/' end as website,
    case when s_suppkey % 7 = 0 then '' else 'Salle' end as type,
    ['/locations/éspace-' || s_suppkey || '/'] as aliases, ['L''Atelier ' || s_suppkey] as search_names,
    case when s_suppkey % 6 = 0 then '' else 'Corps ' || s_suppkey end as body
  from supplier
)"""
