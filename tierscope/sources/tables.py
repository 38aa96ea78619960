"""The driver's parquet tables and the ``listings_raw`` view built on them.

The test data ships TPC-H-like tables rather than listing snapshots, so a
listing-shaped raw table is derived from ``orders ⋈ customer ⋈ nation``.
The derivation is written once as SQL text that both Spark and the DuckDB
oracle accept; Spark receives the three tables as DataFrame arguments so no
global temp view is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Placeholders {orders} {customer} {nation}; literal braces are doubled.
LISTINGS_RAW_TEMPLATE = """
with b as (
  select o_orderkey as id, o_custkey as k, n_name as hood, o_orderpriority as pr, o_orderstatus as st,
         cast(floor(10 + o_totalprice / 1000) as bigint) as p0
  from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey),
c as (
  select b.*, 0 as ingest_seq, case when id % 89 = 0 then 0 when id % 83 = 0 then p0 * 20 when id % 71 = 0 then p0 * 4 else p0 end as p from b
  union all
  select b.*, 1 as ingest_seq, p0 + 37 as p from b where id % 50 = 0)
select id, ingest_seq,
  case when id % 97 = 0 then null
       when p >= 1000 then concat('$', cast(cast(floor(p / 1000) as bigint) as varchar(20)), ',', lpad(cast(p % 1000 as varchar(20)), 3, '0'), '.00')
       else concat('$', cast(p as varchar(20)), '.00') end as price,
  case when id % 61 = 0 then null when id % 20 < 12 then concat('Type ', cast(id % 5 as varchar(20))) else concat('Type ', cast(id % 23 as varchar(20))) end as property_type,
  case when id % 59 = 0 then null when pr = '1-URGENT' then 'Hotel room' when pr = '2-HIGH' then 'Private room' when pr = '3-MEDIUM' then 'Shared room' else 'Entire home/apt' end as room_type,
  1 + id % 12 as accommodates,
  case when id % 19 = 0 then null else cast(id % 6 as double) end as bedrooms,
  case when id % 23 = 0 then null else cast(1 + id % 8 as double) end as beds,
  case when id % 3 = 0 then null else cast(1 + id % 4 as double) end as bathrooms,
  case id % 6 when 0 then '1.5 shared baths' when 1 then '2 baths' when 2 then '1 bath' when 3 then 'Shared half-bath' when 4 then '3 baths' else null end as bathrooms_text,
  case id % 8 when 0 then '["Wifi", "Pool"]' when 1 then '["Dishwasher", "Kitchen"]' when 2 then '["Washer", "Gym", "Free parking on premises"]'
       when 3 then '[]' when 4 then null when 5 then 'not json [Kitchen, Pool]' when 6 then '{{"a": 1}}' else '["Air conditioning", "Washer", "Dishwasher", "Pool table"]' end as amenities,
  case when id % 53 = 0 then null else hood end as neighbourhood_cleansed,
  case when id % 67 = 0 then null else -33.60 - (id % 500) / 1000.0e0 end as latitude, 150.95 + (k % 400) / 1000.0e0 as longitude,
  case when id % 31 = 0 then null when st = 'F' then 't' else 'f' end as host_is_superhost,
  case when id % 7 = 0 then 'N/A' else concat(cast(id % 101 as varchar(20)), '%') end as host_response_rate,
  case when id % 11 = 0 then null else concat(cast((id * 7) % 101 as varchar(20)), '%') end as host_acceptance_rate,
  case when id % 37 = 0 then null else cast(id % 9 as double) end as host_listings_count,
  case when id % 2 = 0 then 't' else 'f' end as host_identity_verified,
  cast(null as varchar(5)) as instant_bookable,
  case when id % 5 = 0 then null else 3.0e0 + (id % 21) / 10.0e0 end as review_scores_rating,
  id % 300 as number_of_reviews,
  case when id % 5 = 0 then null else (id % 60) / 10.0e0 end as reviews_per_month,
  id % 366 as availability_365, 1 + id % 30 as minimum_nights
from c
"""


def listings_raw_sql(orders: str = "orders", customer: str = "customer",
                     nation: str = "nation") -> str:
    """The derivation as plain SQL over named tables (used by the oracle)."""
    return LISTINGS_RAW_TEMPLATE.format(orders=orders, customer=customer, nation=nation)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw listing rows (all 24 required columns plus ``ingest_seq``).

    ``nation`` has 25 rows, so the planner broadcasts it; ``orders`` and
    ``customer`` grow with the data and are joined by a shuffle on the
    customer key (AQE re-plans if one side turns out small).
    """
    return spark.sql(
        LISTINGS_RAW_TEMPLATE,
        orders=read_table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"),
        customer=read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        nation=read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
    )
