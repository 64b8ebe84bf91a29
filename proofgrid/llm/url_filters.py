"""URL filters: rules on host and path first, a logistic regression on hashed character n-grams for what no rule decides.

The classifier is trained from a small labelled URL table (``LABELLED`` or a table of the caller's, at most
``max_labelled`` rows) by the library's own distributed trainer. Features are counts of the n-grams of the host and of
the path, hashed into ``dim`` places, host and path in different ones (their n-grams carry a mark). Everything runs as
column expressions and vector functions inside the row of a page: no shuffle, no Python worker; the weights that travel
to the tasks are ``dim`` numbers.

A rule is a verdict with a host and a path (``example.com/en/``). It fits its host and all subdomains where the path of
the URL starts with the rule's path; the longest rule wins, of equally long ones the first in the alphabet. Rules are
parameters written in code, at most ``MAX_RULES``.

Null URLs and URLs without ``://`` have an empty host and path: no rule fits them, and their score is the classifier's
on no n-grams at all (its intercept). Long URLs are taken whole. Repeated rows are judged each. An empty table gives no
rows. Extra columns are not read, so their names can't clash. A labelled table with nulls in url or verdict loses those
rows; one without both verdicts is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.text import let

MAX_RULES = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled table: invented URLs, half of kinds that a training corpus leaves out (gambling, pills, adult sites, link farms, trackers,
# fake downloads, quick loans), half of ordinary pages. Domains and languages are the same in both halves.
BLOCKED = """
https://www.casino-royal.example.com/en/12 http://online-casino.example.net/slots https://casino-bonus.example.org/en/77 http://m.megacasino.example.com/fr/4?ref=x
https://poker-win.example.net/play http://www.jackpot-win.example.org/de/9.html https://win-big.example.com/es/31 http://slots4free.example.net/en/
https://sports-bets.example.com/en/2 http://bets-today.example.org/es/5?page=2 https://free-spins.example.net/de/8 http://blog.best-bets.example.com/fr/14
https://cheap-meds.example.org/en/3 http://pills-online.example.net/buy https://www.diet-pills.example.com/en/19 http://cheap-viagra.example.com/order
https://pharma-discount.example.net/pills/4 http://buy-pills.example.org/es/21 https://cheap-watches.example.com/en/6 http://cheap-replica.example.net/de/7?ref=x
https://adult-chat.example.com/en/5 http://adult-video.example.net/xxx/2 https://xxx-cams.example.org/en/11 http://www.sexy-adult.example.com/fr/6
https://hot-singles.example.net/adult http://porn-tube.example.com/es/8 https://x-rated.example.org/de/2 http://nude-pics.example.net/en/4#top
https://link-farm.example.com/en/1 http://spam-links.example.net/fr/2 https://seo-spam.example.org/en/3?page=2 http://backlink-farm.example.com/de/4
https://spamblog.example.net/en/99 http://content-farm.example.org/es/17 https://click-farm.example.com/en/18 http://www.spam-site.example.net/de/28.html
https://ads-server.example.org/click?id=3 http://track-ads.example.com/pixel https://www.ad-tracker.example.net/en/7 http://adclicks.example.org/track/55
https://banner-ads.example.com/fr/13 http://popup-ads.example.net/en/15?utm_source=feed https://tracking-pixel.example.org/t http://affiliate-track.example.com/en/16
https://free-download.example.net/crack http://keygen-free.example.org/en/20 https://warez-files.example.com/es/22 http://torrent-free.example.net/en/23
https://free-iphone.example.org/win http://free-money.example.com/en/24 https://get-rich.example.net/de/25 http://easy-money.example.org/fr/26
https://payday-loans.example.com/en/27 http://quick-loan.example.net/apply https://crypto-profit.example.org/en/29 http://forex-signals.example.com/es/30
https://lottery-win.example.net/fr/32 http://prize-claim.example.org/en/33 https://miracle-cure.example.com/de/34 http://weight-loss.example.net/pills
https://the-adult-site.example.org/de/36 http://adults-only.example.net/en/37 https://adult-movies.example.com/es/38 http://casinos-online.example.org/fr/39
""".split()
ALLOWED = """
https://www.city-library.example.com/en/12 http://online-museum.example.net/rooms https://science-news.example.org/en/77 http://m.weather.example.com/fr/4?ref=x
https://chess-club.example.net/play http://www.garden-notes.example.org/de/9.html https://big-history.example.com/es/31 http://recipes.example.net/en/
https://sports-results.example.com/en/2 http://news-today.example.org/es/5?page=2 https://free-software.example.net/de/8 http://blog.best-books.example.com/fr/14
https://health-advice.example.org/en/3 http://school-online.example.net/learn https://www.nutrition.example.com/en/19 http://travel-guide.example.com/order
https://university.example.net/courses/4 http://buy-local.example.org/es/21 https://old-watches.example.com/en/6 http://street-maps.example.net/de/7?ref=x
https://parent-forum.example.com/en/5 http://film-archive.example.net/drama/2 https://music-lessons.example.org/en/11 http://www.poetry.example.com/fr/6
https://bird-watching.example.net/species http://theatre.example.com/es/8 https://archive.example.org/de/2 http://art-pictures.example.net/en/4#top
https://organic-farm.example.com/en/1 http://web-links.example.net/fr/2 https://dairy-farm.example.org/en/3?page=2 http://wind-farm.example.com/de/4
https://technology.example.net/en/99 http://local-history.example.org/es/17 https://mathematics.example.com/en/18 http://www.building.example.net/de/28.html
https://time-server.example.org/list?id=3 http://train-times.example.com/pixel https://www.the-reader.example.net/en/7 http://astronomy.example.org/stars/55
https://the-herald.example.com/fr/13 http://thinking.example.net/en/15?utm_source=feed https://hiking-trails.example.org/t http://another-thing.example.com/en/16
https://documentation.example.net/install http://the-thread.example.org/en/20 https://those-hills.example.com/es/22 http://tradition.example.net/en/23
https://open-data.example.org/sets http://the-other.example.com/en/24 https://thirteen.example.net/de/25 http://nation.example.org/fr/26
https://housing-office.example.com/en/27 http://tax-forms.example.net/apply https://energy-report.example.org/en/29 http://languages.example.com/es/30
https://water-board.example.net/fr/32 http://rehearsal.example.org/en/33 https://wedding-hall.example.com/de/34 http://northern.example.net/tides
https://the-public-site.example.org/de/36 http://members-only.example.net/en/37 https://silent-movies.example.com/es/38 http://schools-online.example.org/fr/39
""".split()


@dataclass(frozen=True)
class Training:
    """``threshold`` is the least probability of the blocked kind that blocks: twice as likely blocked as allowed, since the table
    holds far more blocked URLs than a crawl does."""

    grams: tuple[int, ...] = (3, 4, 5)
    dim: int = 1 << 16
    regularization: float = 0.01
    iterations: int = 200
    tolerance: float = 1e-7
    threshold: float = 2 / 3
    max_labelled: int = 100_000


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, verdict): the table that the filters are trained from unless the caller has another."""
    return spark.createDataFrame([(u, "block") for u in BLOCKED] + [(u, "allow") for u in ALLOWED], "url string, verdict string")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def winning_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        name, slash, rest = rule.partition("/")
        inside = (host == name) | F.endswith(host, F.lit("." + name))
        fits = inside & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams_of(host: Column, path: Column, sizes: Sequence[int]) -> Column:
    """All n-grams of host and path, their ends marked; those of the host start with ``h``, those of the path with ``p``."""

    def cut(mark: str, text: Column) -> Column:
        framed = F.when(text == "", "").otherwise(F.concat(F.lit("<"), text, F.lit(">")))

        def grams(t: Column, n: int) -> Column:
            last = F.length(t) - n + 1
            return F.when(last < 1, F.array().cast("array<string>")).otherwise(
                F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(t, i, F.lit(n))))
            )

        return let(framed, lambda t: F.concat(*(grams(t, n) for n in sizes)))

    return F.concat(cut("h", host), cut("p", path))


def features(df: DataFrame, host: str, path: str, how: Training, out: str = "features") -> DataFrame:
    with_grams = df.withColumn("_grams", grams_of(F.col(host), F.col(path), how.grams))
    return HashingTF(inputCol="_grams", outputCol=out, numFeatures=how.dim).transform(with_grams).drop("_grams")


def train(labelled: DataFrame, how: Training = Training()) -> LogisticRegressionModel:
    """The classifier of the labelled table (url, verdict): L2-regularised maximum likelihood over all its rows.

    The table is small by contract, so its rows are one partition: sums are added in one order, and weights don't depend on layout.
    """
    rows = labelled.select("url", "verdict").filter(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block"))
    seen = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2 or sum(seen.values()) > how.max_labelled:
        raise ValueError(f"the labelled table must hold both verdicts and at most {how.max_labelled} rows; it has {seen}")
    parts = rows.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.col("verdict") == "block").cast("double").alias("label"))
    fit = LogisticRegression(regParam=how.regularization, elasticNetParam=0.0, maxIter=how.iterations, tol=how.tolerance, standardization=False)
    return fit.fit(features(parts.coalesce(1), "host", "path", how))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel, how: Training = Training(), id_col: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the score (probability of the blocked kind; null where a rule decides)."""
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("_rule", winning_rule(F.col("host"), F.col("path"), rules))
    open_host, open_path = (F.when(F.col("_rule").isNull(), F.col(c)).otherwise("") for c in ("host", "path"))
    rows = features(rows.withColumns({"_h": open_host, "_p": open_path}), "_h", "_p", how)
    scored = model.transform(rows).withColumn("_score", F.get(vector_to_array("probability"), 1))
    score = F.when(F.col("_rule").isNull(), F.col("_score"))
    own = F.when(F.col("_score") >= how.threshold, "block").otherwise("allow")
    return scored.select(
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), score.alias("score")
    )
