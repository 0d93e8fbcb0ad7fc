"""URL filters: rules first, else a logistic regression on hashed character n-grams.

Rules name a host (with all its subdomains) and a path prefix; the longest that fits decides.  Other URLs
are scored by a logistic regression on the hashed n-grams of host and path, trained with Spark ML from a small
labelled URL table.  Scoring is a map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, col

# The default rules, (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# The labelled URL table, as names to block, names to allow, and what both kinds of name are put between.
BLOCKED_NAMES = """
casino-royal online-casino free-casino-slots poker-bets sports-bets free-bets-now big-win-jackpot lottery-win cheap-meds buy-pills pills-online
cheap-viagra-pills discount-pharmacy adult-video xxx-adult adult-films porn-tube sex-cams hot-adult-chat spam-links link-farm spam-mail-farm ads-server ad-track track-click
popup-tracker free-ringtones warez-crack torrent-cracks replica-watches payday-loans fast-cash-loan home-cash phish-login crypto-double malware-load click-bait-farm
""".split()
ALLOWED_NAMES = """
university encyclopedia software daily library gardener museum weather recipes cycling project city school traveller orchestra journal theatre handbook thering
tionan thandor ererth ontion thertha heandth ingthe esther annder ministry parliament physics letters region bakery birds music north-star town-hall thatch-roof
month-to-month tenth-street earth-science thirty-three nth-root healthy-meals southern-trails northern-birds truth-table both-banks with-that fourth-floor
cloth-maker smith-brothers width-height thistle thought thorough thin-ice then-and-now thousand-lakes them-all tether theory
""".split()
SUBDOMAINS, DOMAINS = ("", "www.", "m.", "blog."), (".example.com", ".example.net", ".example.org")
PATHS = ("/", "/en/508/", "/de/12044", "/fr/1066.html", "/es/773?page=2", "/en/49123#top", "/fr/25", "/de/90.html", "/es/441/", "/en/3665")
URLS_PER_NAME = 4


def labelled_table() -> list[tuple[str, int]]:
    """(url, 1 to block): each name between several subdomains, domains and paths, so that those alone tell little."""
    out = []
    for label, names in ((1, BLOCKED_NAMES), (0, ALLOWED_NAMES)):
        for i, name in enumerate(names):
            for k in range(URLS_PER_NAME):
                n = i * URLS_PER_NAME + k
                out.append((f"http{'s' * (n % 2)}://{SUBDOMAINS[k]}{name}{DOMAINS[n % 3]}{PATHS[n % len(PATHS)]}", label))
    return out


FEATURES, GRAMS, PENALTY, THRESHOLD = 4096, (3, 4, 5), 0.01, 0.5
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null.  Rules of equal length: as listed.

    The rules are a short list, so they're part of the plan.
    """
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + prefix).alias("rule"))).otherwise(out)
    return out


def n_grams(host: Column, path: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """Distinct character n-grams of host and path, with ends marked; the path's letters in lower case."""
    def grams(mark: str, text: Column, n: int) -> Column:
        # A text shorter than n gives itself.
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))

    ends = [(m, F.concat(F.lit("^"), t, F.lit("$"))) for m, t in (("h", host), ("p", ascii_lower(path)))]
    return F.array_distinct(F.concat(*[grams(m, t, n) for m, t in ends for n in sizes]))


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=FEATURES, binary=True).transform(df)


def fit_urls(labelled: DataFrame, penalty: float = PENALTY) -> LogisticRegressionModel:
    """Fit on a (url, label) table; rows with a null in either are left out."""
    url = col("url").cast("string")
    rows = labelled.where(col("url").isNotNull() & col("label").isNotNull()).select(n_grams(host_of(url), path_of(url)).alias("_grams"), col("label").cast("double").alias("label"))
    # One partition: sums in one order, so that reruns agree.
    return LogisticRegression(featuresCol="_features", regParam=penalty, maxIter=30, tol=1e-4, standardization=False).fit(_features(rows.coalesce(1)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small table as a DataFrame."""
    return spark.createDataFrame(labelled_table(), "url string, label int")


def judge_urls(df: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
               threshold: float = THRESHOLD) -> DataFrame:
    """One row for each URL: ``page_id, host, path, rule, verdict, score``.

    A rule's verdict stands; else the URL is blocked if the regression's probability reaches ``threshold``.  Null URLs and
    those without ``://`` have empty host and path, fit no rule, and are scored like any other.  Null and repeated ids pass
    through row by row.  An empty table gives an empty result; further columns are ignored.
    """
    url = col(url_col).cast("string")
    rows = df.select(col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.setProbabilityCol("_probability").transform(_features(rows.withColumn("_grams", n_grams(F.col("host"), F.col("path")))))
    scored = scored.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("score", vector_to_array("_probability")[1])
    by_score = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_score).alias("verdict"), "score")
