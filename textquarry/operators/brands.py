"""Brand analytics over mentions (brand, author, score, tag, ts, kind, count, post)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sentiment(mentions: DataFrame) -> DataFrame:
    """Per brand: positive, negative, neutral and mean score. A missing or zero score counts 0.5; a tag goes before the score."""
    s = F.when(F.coalesce("score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("score"))
    kind = F.when((F.col("tag") == "positive") | (s > 0.6), "positive").when((F.col("tag") == "negative") | (s < 0.4), "negative").otherwise("neutral")
    m = mentions.withColumn("s", s).withColumn("k", kind)
    return m.groupBy("brand").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("positive", "negative", "neutral")], F.avg("s").alias("mean_score"))


def trend(mentions: DataFrame) -> DataFrame:
    """Per brand: the mean of the later half less that of the earlier; over 0.1 increasing, under -0.1 decreasing.

    A missing or zero score counts 0.5. Sums by hour say in which hour a brand's half is reached; only
    the rows of that hour are put in order, so a brand with very many mentions is spread out.
    """
    s = F.when(F.coalesce("score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("score"))
    m = mentions.select("brand", "ts", "mention_id", s.alias("s"), F.date_trunc("hour", "ts").alias("hour"))
    cells = m.groupBy("brand", "hour").agg(F.count("*").alias("c"), F.sum("s").alias("total"))
    by_hour = Window.partitionBy("brand").orderBy("hour")
    cells = cells.withColumn("upto", F.sum("c").over(by_hour)).withColumn("n", F.sum("c").over(Window.partitionBy("brand")))
    cells = cells.withColumn("half", F.floor(F.col("n") / 2)).withColumn("before", F.col("upto") - F.col("c"))
    # hours wholly in one half, and for the one that is cut, how many of its rows belong to the first
    whole = cells.withColumn("early", F.when(F.col("upto") <= F.col("half"), F.col("total")).otherwise(0.0))
    whole = whole.groupBy("brand").agg(F.first("n").alias("n"), F.first("half").alias("half"), F.sum("early").alias("early"), F.sum("total").alias("total"))
    cutting = cells.where((F.col("before") < F.col("half")) & (F.col("upto") > F.col("half"))).select("brand", F.col("hour").alias("cut_hour"), (F.col("half") - F.col("before")).alias("take"))
    inside = m.join(cutting, "brand").where(F.col("hour").eqNullSafe(F.col("cut_hour"))).withColumn("r", F.row_number().over(Window.partitionBy("brand").orderBy("ts", "mention_id")))
    part = inside.where(F.col("r") <= F.col("take")).groupBy("brand").agg(F.sum("s").alias("part"))
    out = whole.join(part, "brand", "left").withColumn("early", F.col("early") + F.coalesce("part", F.lit(0.0)))
    change = F.try_divide(F.col("total") - F.col("early"), F.col("n") - F.col("half")) - F.try_divide(F.col("early"), F.col("half"))
    out = out.select("brand", "n", change.alias("change"))
    return out.withColumn("trend", F.when(F.col("n") < 2, "stable").when(F.col("change") > 0.1, "increasing").when(F.col("change") < -0.1, "decreasing").otherwise("stable"))


def mention_volume(mentions: DataFrame) -> DataFrame:
    """Per brand: mentions, distinct authors, a thirtieth of the mentions, and the day with most (the later of equals)."""
    days = mentions.groupBy("brand", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    peak = days.groupBy("brand").agg(F.max(F.struct("n", "day")).alias("p")).select("brand", F.col("p.day").alias("peak_day"), F.col("p.n").alias("peak_n"))
    total = mentions.groupBy("brand").agg(F.count("*").alias("mentions"), F.countDistinct("author").alias("authors"))
    return total.withColumn("per_day", F.col("mentions") / 30).join(peak, "brand")


def engagement(mentions: DataFrame, kinds: tuple[str, ...] = ("like", "share", "comment")) -> DataFrame:
    """Per brand: sums by kind, their total, the mean a row, and the post with most (the first of equals)."""
    sums = [F.sum(F.when(F.col("kind") == k, F.col("count")).otherwise(0)).alias(f"{k}s") for k in kinds]
    out = mentions.groupBy("brand").agg(*sums, F.sum("count").alias("total"), F.avg("count").alias("mean"))
    posts = mentions.groupBy("brand", "post").agg(F.sum("count").alias("n"))
    top = posts.groupBy("brand").agg(F.min(F.struct((-F.col("n")).alias("n"), "post")).alias("t")).select("brand", F.col("t.post").alias("top_post"))
    return out.join(top, "brand")


def influencer_overlap(mentions: DataFrame) -> DataFrame:
    """Per pair of brands: shared authors and their share of the larger audience.

    Each author's brands are paired, not all authors of two brands, so the work is
    bounded by the brands of an author.
    """
    known = mentions.select("brand", "author").where("author IS NOT NULL").distinct()
    sizes = known.groupBy("brand").agg(F.count("*").alias("n"))
    x, y = known.select(F.col("brand").alias("brand1"), "author"), known.select(F.col("brand").alias("brand2"), "author")
    shared = x.join(y, "author").where("brand1 < brand2").groupBy("brand1", "brand2").agg(F.count("*").alias("shared"))
    s = lambda i: sizes.select(F.col("brand").alias(f"brand{i}"), F.col("n").alias(f"unique{i}"))
    out = shared.join(s(1), "brand1").join(s(2), "brand2")
    return out.withColumn("overlap", F.try_divide(F.col("shared"), F.greatest("unique1", "unique2")))


def topics(discussions: DataFrame) -> DataFrame:
    """Per brand and topic: frequency, mean sentiment, authors, and whether other brands share the topic."""
    out = discussions.groupBy("brand", "topic").agg(F.count("*").alias("frequency"), F.avg("score").alias("mean_score"), F.countDistinct("author").alias("authors"))
    return out.withColumn("shared", F.count("*").over(Window.partitionBy("topic")) > 1)


def competitors(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per brand with competitors: their number, position by mentions, and share of the mentions of all of them."""
    volume = mentions.groupBy("brand").agg(F.count("*").alias("mentions"))
    both = edges.select(F.col("src").alias("brand"), F.col("dst").alias("rival")).union(edges.select("dst", "src")).where("brand <> rival").distinct()
    rivals = both.join(volume.select(F.col("brand").alias("rival"), F.col("mentions").alias("m")), "rival", "left").groupBy("brand").agg(F.count("*").alias("rivals"), F.coalesce(F.sum("m"), F.lit(0)).alias("rival_mentions"))
    out = rivals.join(volume, "brand", "left").fillna(0, ["mentions"])
    position = F.when(F.col("mentions") > 1000, "leader").when(F.col("mentions") > 500, "challenger").when(F.col("mentions") > 100, "follower").otherwise("niche")
    return out.withColumn("position", position).withColumn("share", F.coalesce(F.try_divide(F.col("mentions"), F.col("mentions") + F.col("rival_mentions")), F.lit(0.0)))


def daily(mentions: DataFrame) -> DataFrame:
    """Mentions and mean score by brand and day."""
    return mentions.groupBy("brand", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("mentions"), F.avg("score").alias("mean_score")).select("brand", F.col("w.start").cast("timestamp_ntz").alias("day"), "mentions", "mean_score")


def insights(scores: DataFrame, volumes: DataFrame) -> DataFrame:
    """Lines of (kind, brand): best sentiment, most mentions, sentiment under 0.4, fewer than ten mentions."""
    best = scores.groupBy().agg(F.max_by("brand", F.struct("mean_score", "brand")).alias("brand")).select(F.lit("best_sentiment").alias("kind"), "brand")
    most = volumes.groupBy().agg(F.max_by("brand", F.struct("mentions", "brand")).alias("brand")).select(F.lit("most_mentions").alias("kind"), "brand")
    low = scores.where("mean_score < 0.4").select(F.lit("improve_sentiment").alias("kind"), "brand")
    few = volumes.where("mentions < 10").select(F.lit("raise_visibility").alias("kind"), "brand")
    return best.union(most).union(low).union(few).where("brand IS NOT NULL")
