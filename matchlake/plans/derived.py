"""Matches, rankings and quotes derived from the general tables, in Spark and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlake.functions.columns import DAY_US, HOUR_US
from matchlake.session import table

MINUTE_US = 60_000_000


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """One match for each order; its sets are the order's lines."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    players = max(20, table(spark, sf, "customer").count() // 15)
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    a, b = (F.col("l_quantity").cast("int") % 12), (F.col("l_partkey") % 12).cast("int")
    sets = lines.withColumn("set_number", F.row_number().over(order)).select("l_orderkey", F.struct("set_number", a.alias("a"), F.when(a == b, b + 1).otherwise(b).alias("b")).alias("s"))
    sets = sets.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("all_sets"))
    key = F.col("o_orderkey")
    pa = F.col("o_custkey") % players
    pb = F.floor(pa / 10) * 10 + (pa % 10 + 1 + key % 9) % 10
    scheduled = _us("o_orderdate") + (key % 24) * HOUR_US
    status = (
        F.when((F.col("o_orderstatus") == "O") & (key % 5 == 0), "scheduled").when((F.col("o_orderstatus") == "P") & (key % 7 == 0), "cancelled")
        .when((F.col("o_orderstatus") == "P") & (key % 13 == 0), "live").when((F.col("o_orderstatus") == "F") & (key % 11 == 0), "retired").otherwise("finished")
    )
    rows = orders.join(sets, key == F.col("l_orderkey"), "left").select(
        key.alias("id"), pa.alias("player_a"), pb.cast("bigint").alias("player_b"), scheduled.alias("scheduled_us"), status.alias("status"),
        (5 + 2 * (key % 2)).cast("int").alias("best_of"), F.col("o_orderpriority").alias("competition_id"), F.coalesce("all_sets", F.array().cast("array<struct<set_number:int,a:int,b:int>>")).alias("s"),
    )
    open_ = F.col("status") == "scheduled"
    completed = F.col("status").isin("finished", "retired")
    rows = rows.withColumn("sets", F.when(open_, F.array().cast("array<struct<set_number:int,a:int,b:int>>")).otherwise(F.col("s")))
    start = F.when(~open_, F.col("scheduled_us") + 5 * MINUTE_US)
    won = lambda x, y: F.size(F.filter("sets", lambda s: s[x] > s[y]))
    winner = F.when(won("a", "b") > won("b", "a"), F.col("player_a")).when(won("b", "a") > won("a", "b"), F.col("player_b")).when(F.col("id") % 2 == 0, F.col("player_a")).otherwise(F.col("player_b"))
    return rows.withColumns({"start_us": start, "done_us": F.when(completed, start + (10 + 7 * F.size("sets")).cast("bigint") * MINUTE_US), "winner": F.when(completed, winner)}).drop("s")


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking of the players for each quarter, by the worth of their orders, that holds from the next one on."""
    players = max(20, table(spark, sf, "customer").count() // 15)
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % players).alias("player"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("q"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    sums = orders.groupBy("player", "q").agg(F.sum("cents").alias("cents"))
    place = Window.partitionBy("q").orderBy(F.col("cents").desc(), "player")
    at = F.unix_micros(F.add_months("q", 3).cast("timestamp"))
    return sums.select("player", at.alias("at"), F.rank().over(place).cast("int").alias("ranking"))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Two-sided quotes for the matches, around their schedule."""
    m = matches(spark, sf).select(F.col("id").alias("match_id"), "scheduled_us")
    total = table(spark, sf, "orders").count()
    v = F.col("value")
    e = table(spark, sf, "events").select(F.col("event_id").alias("quote_id"), (F.col("event_id") % total).alias("match_id"), F.col("event_type").alias("bookmaker"), (1.01 + F.abs(v) / 100).alias("odds_a"), (1.01 + F.abs(500 - v) / 100).alias("odds_b"))
    return e.join(m, "match_id").withColumn("at", F.col("scheduled_us") + (F.col("quote_id") % 49 - 24) * HOUR_US)


#: The same matches and perspectives in SQL.
SQL = f"""
np as (select greatest(20, count(*) // 15) n from customer),
st as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) sn,
         l_quantity::int % 12 a, (l_partkey % 12)::int b0 from lineitem),
sets as (select k, sn, a, case when a = b0 then b0 + 1 else b0 end b from st),
sa as (select k, count(*) n, sum((a > b)::int) wa, sum((b > a)::int) wb, sum(a) xa, sum(b) xb, arg_min(a > b, sn) fa, arg_max(a > b, sn) la, sum((b > a and b - a <= 2)::int) ka, sum((a > b and a - b <= 2)::int) kb from sets group by k),
o as (select o_orderkey id, o_custkey % n pa, o_orderpriority competition_id, epoch_us(o_orderdate) + (o_orderkey % 24) * {HOUR_US} sched, 5 + 2 * (o_orderkey % 2) best_of,
  case when o_orderstatus = 'O' and o_orderkey % 5 = 0 then 'scheduled' when o_orderstatus = 'P' and o_orderkey % 7 = 0 then 'cancelled'
       when o_orderstatus = 'P' and o_orderkey % 13 = 0 then 'live' when o_orderstatus = 'F' and o_orderkey % 11 = 0 then 'retired' else 'finished' end status
  from orders, np),
m0 as (select o.*, (pa // 10) * 10 + (pa % 10 + 1 + id % 9) % 10 pb, case when status = 'scheduled' then 0 else coalesce(n, 0) end n,
  coalesce(wa, 0) wa, coalesce(wb, 0) wb, coalesce(xa, 0) ptsa, coalesce(xb, 0) ptsb, fa, la, coalesce(ka, 0) ka, coalesce(kb, 0) kb from o left join sa on sa.k = o.id),
m as (select id, pa, pb, competition_id, best_of, status, sched, n, case when status <> 'scheduled' then sched + 5 * {MINUTE_US} end start,
  case when status in ('finished', 'retired') then sched + (15 + 7 * n) * {MINUTE_US} end done,
  case when n > 0 then wa else 0 end wa, case when n > 0 then wb else 0 end wb, case when n > 0 then ptsa else 0 end ptsa, case when n > 0 then ptsb else 0 end ptsb,
  case when n > 0 then fa end fa, case when n > 0 then la end la, case when n > 0 then ka else 0 end ka, case when n > 0 then kb else 0 end kb,
  case when status in ('finished', 'retired') then case when n > 0 and wa > wb then pa when n > 0 and wb > wa then pb when id % 2 = 0 then pa else pb end end winner from m0),
p0 as (select id, pa player, pb opponent, wa sf, wb sa, ptsa pf, ptsb pg, case when n > 0 then fa end first, case when n > 0 then la end last, ka close_losses, m.* exclude (id) from m
  union all select id, pb, pa, wb, wa, ptsb, ptsa, case when n > 0 then not fa end, case when n > 0 then not la end, kb, m.* exclude (id) from m),
p as (select id match_id, player, opponent, coalesce(done, start, sched) t, (winner = player)::int won, sf, sa, pf, pg, first::int first_won, n, competition_id, best_of,
  (n >= 2 and sf - last::int = sa - (not last)::int) decider, last::int last_won, done - start dur, status not in ('finished', 'retired') incomplete, close_losses from p0),
probe as (select id probe, pa, pb, sched cut, competition_id, best_of, winner from m where winner is not null)
"""
