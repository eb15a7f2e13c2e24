"""URL filters: explicit rules, then logistic regression on hashed character n-grams.

Native: expressions and Spark's own logistic regression; nothing of it runs Python on executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: The labelled table is made of these words in the shapes below: hosts and paths to block and to keep.
BLOCKED = ("casino", "poker", "bets", "pills", "viagra", "adult", "xxx", "spam", "ads", "track", "loan", "payday", "replica",
           "jackpot", "slots", "escort", "clickbait", "torrent", "crack", "warez", "lottery", "bonus", "cheap", "free-win", "win",
           "link-farm", "adserver", "tracker", "x-rated", "bet", "pill", "spammer")
KEPT = ("news", "blog", "wiki", "library", "school", "science", "garden", "travel", "history", "museum", "recipes", "music",
        "weather", "health", "forum", "docs", "river", "mountain", "letters", "theatre", "then", "there", "with", "other",
        "thing", "nation", "hand", "stone", "rest", "ring", "over", "heat", "sand", "land")
#: Common letter groups; invented names made of two or three of them are kept.
GROUPS = ("th", "er", "on", "an", "re", "ed", "nd", "ha", "at", "en", "es", "or", "nt", "ea", "ti", "to", "st", "le", "ou", "ar",
          "ver", "ble", "tion", "wh", "sh", "ly", "ing", "the", "ment", "con")
INVENTED = tuple(GROUPS[i] + GROUPS[(i * k + k) % len(GROUPS)] + (GROUPS[(i + 11 * k) % len(GROUPS)] if i % 3 == 0 else "")
                 for k in (1, 2, 3, 5, 7, 9, 11, 13, 17) for i in range(len(GROUPS)))
SHAPES = ("http://www.{0}.example.com/en/12", "https://{0}-{1}.example.net/fr/7?ref=x", "https://m.{0}{1}.example.org/de/481.html",
          "http://blog.{1}-{0}.example.com/es/93/", "https://{0}.example.net/{1}/5#top")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS = 1 << 16
SIZES = (3, 4, 5)


def host_of(url):
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), LETTERS, LETTERS.lower())
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url):
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, label)``: the small labelled table, 1 for URLs to block. Made of fixed words."""
    rows = [(shape.format(w, BLOCKED[(i + 3 * k) % len(BLOCKED)]), 1.0) for i, w in enumerate(BLOCKED) for k, shape in enumerate(SHAPES)]
    rows += [(shape.format(w, KEPT[(i + 3 * k) % len(KEPT)]), 0.0) for i, w in enumerate(KEPT) for k, shape in enumerate(SHAPES)]
    rows += [(SHAPES[i % len(SHAPES)].format(w, INVENTED[(i + 7) % len(INVENTED)]), 0.0) for i, w in enumerate(INVENTED)]
    table = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in rows])
    return spark.range(1, numPartitions=1).select(F.explode(table).alias("row")).select("row.*")


def url_grams(host, path):
    """The distinct character n-grams of ``^host$`` and ``^path$``, each part with its own mark."""
    def grams(mark, text):
        s = F.concat(F.lit("^"), text, F.lit("$"))
        sets = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))),
                            lambda i, n=n: F.concat(F.lit(mark), F.substring(s, i, F.lit(n)))) for n in SIZES]
        return F.concat(*sets)

    return F.array_distinct(F.concat(grams("h", host), grams("p", path)))


def train(labelled: DataFrame, penalty: float = 0.00005) -> PipelineModel:
    """Hashed n-grams at unit length, then logistic regression; the model has ``BUCKETS`` weights."""
    rows = labelled.select("label", url_grams(host_of(F.col("url")), path_of(F.col("url"))).alias("_grams"))
    steps = [HashingTF(inputCol="_grams", outputCol="_hashed", numFeatures=BUCKETS, binary=True), Normalizer(inputCol="_hashed", outputCol="_unit"),
             LogisticRegression(featuresCol="_unit", rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_class", maxIter=60, regParam=penalty, standardization=False)]
    return Pipeline(stages=steps).fit(rows)


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          cut: float = 0.5) -> DataFrame:
    """``pages`` with ``host, path, rule, score, verdict``.

    A rule (verdict, host, path) fits its host and its subdomains if the path starts with its own;
    the longest rule wins, of equal ones the first. Without a rule the model decides: block at a
    probability of at least ``cut``. Null URLs and those without ``://`` have empty host and path,
    no rule fits them, and the model judges the empty strings. Clashing columns are replaced.
    """
    made = ("host", "path", "rule", "score", "verdict")
    out = pages.select(F.struct(*[c for c in pages.columns if c not in made or c == url_col]).alias("_page"),
                       host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    fits = [F.when(((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p)),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(-i).alias("before"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for i, (v, h, p) in enumerate(rules)]
    best = F.greatest(*fits) if len(fits) > 1 else (fits or [F.lit(None).cast("struct<size:int,before:int,rule:string,verdict:string>")])[0]
    scored = train(labelled).transform(out.withColumn("_grams", url_grams(F.col("host"), F.col("path"))))
    scored = scored.select("_page", "host", "path", best.alias("_best"), vector_to_array("_p")[1].alias("score"))
    return scored.select("_page.*", "host", "path", F.col("_best.rule").alias("rule"), "score",
                         F.coalesce("_best.verdict", F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"))


def op9_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")
