"""URL filter: host and path rules, and a logistic regression on hashed character n-grams.

Everything runs as DataFrame and SQL expressions. The classifier learns from a
small labelled table of URLs by gradient descent in the span of the examples: the
weights are always a weighted sum of example vectors, so the descent runs on one
coefficient per example and the matrix of their dot products, as one SQL
``aggregate`` over the epochs.

Nulls and edge cases: a null URL or one without ``://`` has an empty host and an
empty path, fits no rule, and is judged by the classifier's intercept alone. Repeated
rows are judged alike; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import let, materialise

#: Hash buckets of the n-grams; also the most weights the model can have.
BUCKETS = 16384
GRAMS = (3, 4)
EPOCHS = 200
RATE = 0.5
DECAY = 0.002

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

# The labelled URL table. Hosts a reader would block and hosts to allow; each
# gets sub-domains and paths in turn, so that neither tells the labels apart.
BLOCK_HOSTS = (
    "casino-win", "casino-royal", "online-casino", "cheap-pills", "pills-online", "discount-pills",
    "free-bets", "sports-bets", "bets-online", "adult-x", "adult-video", "xxx-adult",
    "spam-farm", "link-farm", "spam-blast", "ads-track", "track-ads", "ads-serve",
    "poker-room", "payday-loans", "replica-watch", "porn-tube", "cheap-meds", "win-lottery",
    "free-slots", "hot-dating", "adserver", "warez-crack", "click-track", "free-win",
    "live-bets", "bets-now", "free-casino", "free-pills", "best-bets", "free-credit",
)
ALLOW_HOSTS = (
    "news", "daily-news", "gardening", "library", "weather", "university", "science", "cooking", "theatre", "museum",
    "history", "stationery", "software", "travel", "thinking", "health", "nation", "reading", "school", "another",
    "handbook", "entertain", "other", "parliament", "then", "other-things", "encyclopedia", "wiki", "fashions", "there-has",
    "station", "thinly", "interest", "heating", "shore", "bread", "houses", "inland", "ledger", "thesis",
    "where", "shed", "entire", "tenant", "edition", "standing", "table", "northern", "rather", "sheathing",
    "oration", "thread", "anthem", "ointment", "these", "heron", "thanks", "tithe", "answer", "hinting",
    "leather", "eastern", "attention", "finish", "erosion", "ten-thousand", "thirst", "red-house", "whether", "thatch",
    "nothing", "restore", "ration", "brother", "entry", "than-one", "ending", "within", "the-shore", "athens",
)
SUBDOMAINS = ("", "www.", "m.", "blog.")
DOMAINS = (".example.com", ".example.net", ".example.org")
PATHS = ("/en/25930", "/de/18815.html", "/fr/1066/", "/es/46174", "/play", "/blog/3", "/item/22.html")


def _labelled(hosts: tuple[str, ...], verdict: str) -> tuple[tuple[str, str, str], ...]:
    return tuple((verdict, SUBDOMAINS[(i + k) % 4] + h + DOMAINS[(i + k) % 3], PATHS[(i + 3 * k) % 7]) for i, h in enumerate(hosts) for k in range(2))


LABELLED = _labelled(BLOCK_HOSTS, "block") + _labelled(ALLOW_HOSTS, "allow")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does.

    ``rules`` is a short list kept in the plan: a condition for each, longest first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of the n-grams of host and path, each with its own marks at the ends, digits alike, repeats kept."""

    def of(part: Column, tag: str) -> Column:
        marked = F.concat(F.lit("^"), F.translate(part, "123456789", "000000000"), F.lit("$"))

        def runs(signs: Column) -> Column:
            def run(n: int) -> Column:
                one = lambda i: F.pmod(F.xxhash64(F.lit(tag), F.concat(*(F.get(signs, i + k) for k in range(n)))), F.lit(buckets)).cast("int")
                return F.when(F.size(signs) >= n, F.transform(F.sequence(F.lit(0), F.size(signs) - n), one)).otherwise(F.array().cast("array<int>"))

            return F.concat(*map(run, GRAMS))

        # Parted into signs once, so that long URLs take time linear in their length.
        return let(F.split(marked, ""), runs)

    return F.concat(of(host, "host"), of(path, "path"))


def train(spark: SparkSession, labelled=LABELLED, buckets: int = BUCKETS) -> tuple[list[float], float]:
    """Weights by bucket and the intercept. ``labelled`` is small, so one partition holds it; the model has ``buckets`` numbers at most."""
    rows = spark.createDataFrame([(i, 1 if v == "block" else 0, h, p) for i, (v, h, p) in enumerate(labelled)], "i int, y int, host string, path string").coalesce(1)
    n = len(labelled)
    counts = rows.select("i", F.explode(grams(F.col("host"), F.col("path"), buckets)).alias("f")).groupBy("i", "f").agg(F.count(F.lit(1)).alias("c"))
    norm = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    x = materialise(counts.join(norm, "i").select("i", "f", (F.col("c") / F.col("norm")).alias("x")), "url-grams").coalesce(1)
    dots = x.alias("a").join(x.alias("b"), F.col("a.f") == F.col("b.f")).groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("dot"))
    full = spark.range(0, n, 1, 1).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).join(dots, ["i", "j"], "left")
    by_row = full.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", F.coalesce("dot", F.lit(0.0)).alias("dot")))), lambda s: s["dot"] + 1.0).alias("dots"))
    matrix = by_row.join(rows.select("i", "y"), "i").agg(F.array_sort(F.collect_list(F.struct("i", "y", "dots"))).alias("m"))
    # The +1 in every dot product is the intercept: a feature that all URLs share.
    fitted = materialise(matrix.select(
        F.expr(
            f"""aggregate(sequence(1, {EPOCHS}), array_repeat(0D, {n}), (a, epoch) ->
                  zip_with(a, m, (ai, row) -> (1 - {RATE} * {DECAY}) * ai + {RATE} * (row.y - 1 / (1 + exp(-
                    aggregate(zip_with(row.dots, a, (d, c) -> d * c), 0D, (s, v) -> s + v))))))"""
        ).alias("a")
    ).select(F.posexplode("a").alias("i", "a")), "url-fit").coalesce(1)
    weights = x.join(fitted, "i").groupBy("f").agg(F.sum(F.col("a") * F.col("x")).alias("w")).orderBy("f").collect()
    table = [0.0] * buckets
    for f, w in weights:
        table[f] = w
    return table, fitted.agg(F.sum("a")).first()[0] or 0.0


def block_probability(host: Column, path: Column, model: tuple[list[float], float], buckets: int = BUCKETS) -> Column:
    weights, intercept = model
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    found = grams(host, path, buckets)
    size = F.size(found)
    total = F.aggregate(F.transform(found, lambda f: F.get(table, f)), F.lit(0.0), lambda s, w: s + w)
    return 1 / (1 + F.exp(-(F.lit(intercept) + F.when(size > 0, total / F.sqrt(size.cast("double"))).otherwise(0.0))))


def judge_urls(pages: DataFrame, rules=RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score: the rule's verdict, or else the classifier's."""
    model = model or train(pages.sparkSession)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "by_rule": verdict, "block_score": block_probability(F.col("host"), F.col("path"), model)})
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
