"""Quotes joined to what is watched, and what a brief says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import news as fn
from ..functions.links import to_float

QUOTE_SOURCE = "eastmoney-push2"


def parse_payload(payload: DataFrame) -> DataFrame:
    """payload (json) of the quote service: one row for each object of data.diff, with the last of a code's where several have it."""
    shape = "struct<data:struct<diff:array<struct<f12:string,f14:string,f3:string,f124:string>>>>"
    rows = payload.select(F.posexplode(F.from_json("json", shape)["data"]["diff"]).alias("pos", "q")).where("q is not null")
    last = W.partitionBy("code").orderBy(F.col("pos").desc())
    out = rows.select("pos", F.coalesce("q.f12", F.lit("")).alias("code"), F.col("q.f14").alias("name"), to_float(F.col("q.f3")).alias("pct_change"), F.col("q.f124").try_cast("long").alias("epoch"))
    return out.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "pos")


def with_quotes(watched: DataFrame, quotes: DataFrame, as_of: Column) -> DataFrame:
    """watched (ord, code, name, sector) left-joined to quotes (code, name, pct_change, epoch): one without a quote keeps its row, with null figures.

    The amount stays null: its unit isn't known to be right. Spark broadcasts either side by its size.
    """
    q = quotes.select(F.col("code").alias("_code"), F.col("name").alias("_name"), "pct_change", "epoch")
    stamp = F.when(F.col("epoch") > 0, F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    name = F.coalesce(F.nullif(F.trim("_name"), F.lit("")), F.col("name"))
    return watched.join(q, F.col("code") == F.col("_code"), "left").select("ord", name.alias("name"), "code", "pct_change", F.lit(None).cast("double").alias("amount"), F.lit(QUOTE_SOURCE).alias("source"), stamp.alias("as_of"), F.col("sector").alias("industry"), "sector")


def data_date(quotes: DataFrame, fallback: Column) -> DataFrame:
    """The latest date of quotes, else the fallback."""
    return quotes.agg(F.coalesce(F.max(F.try_to_date(F.substring("as_of", 1, 10), "yyyy-MM-dd")), fallback).alias("market_data_date"))


def index_mood(indexes: DataFrame) -> DataFrame:
    """(positive, negative, average, note): nulls count for nothing."""
    n = indexes.agg(F.count_if(F.col("pct_change") > 0).alias("positive"), F.count_if(F.col("pct_change") < 0).alias("negative"), F.avg("pct_change").alias("average"))
    note = (
        F.when(F.col("average").isNull(), "主要指数行情数据不足，本次不判断市场强弱。")
        .when((F.col("positive") > 0) & (F.col("negative") > 0), "主要指数涨跌分化，新闻主线需要继续用后续行情和板块表现验证。")
        .when(F.col("average") >= 0.6, "主要指数整体偏强，但仍需观察后续持续性。")
        .when(F.col("average") <= -0.6, "主要指数整体偏弱，风险偏好仍需等待后续数据确认。")
        .otherwise("主要指数整体偏震荡，暂不把单日波动解读为趋势。")
    )
    return n.withColumn("note", note)


_RELATIVE = "相对观察："


def relative_to_average(pct: Column, average: Column) -> Column:
    apart = pct - average
    return F.concat(
        F.lit(_RELATIVE),
        F.when(pct.isNull() | average.isNull(), "主要指数或个股涨跌数据不足。")
        .when((average > 0.5) & (pct < -2.0), "逆势走弱。")
        .when((average < -0.5) & (pct > 2.0), "逆势走强。")
        .when(apart >= 1.5, "明显强于主要指数均值。")
        .when(apart >= 0.5, "小幅强于主要指数均值。")
        .when(apart <= -1.5, "明显弱于主要指数均值。")
        .when(apart <= -0.5, "小幅弱于主要指数均值。")
        .otherwise("接近主要指数均值。"),
    )


def anomaly(relative: Column) -> Column:
    rest = "；RSS 候选新闻暂未解释该波动，后续需观察是否来自板块、公司消息或资金行为。"
    return F.when(relative == _RELATIVE + "逆势走弱。", "异常提示：主要指数整体偏强，但该持仓明显逆势走弱" + rest).when(relative == _RELATIVE + "逆势走强。", "异常提示：主要指数整体偏弱，但该持仓明显逆势走强" + rest).otherwise("")


def leader_gap(indexes: DataFrame, code: str = "000688", name: str = "科创50", gap: float = 2.0, least: float = 1.5) -> DataFrame:
    """(leader, others, leads): the first index of that code or name against the average of the rest; null where either is missing."""
    is_it = (F.col("code") == code) | F.contains("name", F.lit(name))
    placed = indexes.withColumn("_first", F.min(F.when(is_it, F.col("ord"))).over(W.partitionBy()))
    n = placed.agg(F.max(F.when(F.col("ord") == F.col("_first"), F.col("pct_change"))).alias("leader"), F.avg(F.when(~F.col("ord").eqNullSafe(F.col("_first")), F.col("pct_change"))).alias("others"))
    return n.withColumn("leads", F.coalesce((F.col("leader") - F.col("others") >= gap) & (F.col("leader") >= least), F.lit(False)))


LEADS = "行情层面观察：科创50明显强于其他主要指数，指数层面显示科创 / 硬科技方向风险偏好较强；该判断仅来自宽基指数表现，仍需后续新闻和板块数据验证。"


def observations(holdings: DataFrame, quotes: DataFrame, indexes: DataFrame, matches: DataFrame) -> DataFrame:
    """holdings left-joined to their quotes, with the relative text, the anomaly and whether clear news explains it."""
    q = quotes.select(F.col("code").alias("_code"), "pct_change", "amount", "source", "as_of")
    average = indexes.agg(F.avg("pct_change").alias("average"))  # one row
    clear = matches.where(F.coalesce("holding_relation", F.lit("")).isin("", fn.CLEAR)).select(F.col("holding_title").alias("_title")).distinct()
    out = holdings.withColumn("title", F.concat_ws(" ", "code", "name")).join(q, F.col("code") == F.col("_code"), "left").crossJoin(average)
    out = out.withColumn("relative", relative_to_average(F.col("pct_change"), F.col("average"))).withColumn("anomaly", anomaly(F.col("relative")))
    return out.join(clear.withColumn("_clear", F.lit(True)), F.col("title") == F.col("_title"), "left").withColumn("clear_news", F.coalesce("_clear", F.lit(False))).drop("_code", "_title", "_clear")
