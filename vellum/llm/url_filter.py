"""URL filter: host and path rules first, then logistic regression on hashed character n-grams. DataFrame functions only.

Training is one SQL expression over a small labelled table: gradient descent with a fixed number of steps,
so it is deterministic. Scoring sums the weights of a URL's n-grams, inside the JVM and without a shuffle.

The built-in labels are neutral examples, not rows of any table that is judged; pass a table of your own for real use.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, has no n-gram that
speaks against it and is allowed with score 0; a very long URL is scored whole; rules that tie in length can't both fit
a URL unless they are equal, and then the first wins; a score that ties with the threshold is allowed; a null ``page_id`` and repeated
rows pass through; an empty table gives an empty result; other columns are ignored. A labelled row whose
url or label is null is left out; a table without usable rows is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The rules, longest first wins: (rule, verdict). A rule is host, then path from its first slash.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# Example URLs of this module's own making, about subjects; unwanted ones and wanted ones.
UNWANTED = (
    "http://cheap-meds.example/pills", "http://www.tablets-online.example/order", "https://pills-discount.example/buy/now", "http://no-prescription-pills.example/",
    "http://spam-hub.example/list", "https://spam-network.example/start", "http://link-farm.example/exchange", "https://spam-links.example/page",
    "http://content-farm.example/rewrite", "http://casino-bonus.example/play", "https://best-casino.example/slots", "http://win-lottery.example/claim",
    "https://free-money.example/now", "http://adult-cam.example/live", "https://xxx-videos.example/watch", "http://hot-singles.example/meet",
    "http://replica-watches.example/shop", "https://cheap-viagra.example/order", "http://payday-loan.example/apply", "https://crypto-giveaway.example/double",
    "http://click-bait.example/you-wont-believe", "https://torrent-crack.example/keygen", "http://warez-download.example/full", "https://seo-backlinks.example/buy",
    "http://pills.shop.example/cart", "https://blog.spamming-farms.example/posts", "http://m.cheapest-pill.example/deal", "https://www.link-spammer.example/links",
    "http://fake-diploma.example/buy", "https://miracle-diet.example/pills", "http://get-rich-quick.example/join", "https://popup-ads.example/click",
    "http://casino-jackpot.example/spin", "https://m.casino-wins-big.example/roulette", "http://free-bets.example/odds", "https://www.bets-odds.example/live",
)
WANTED = (
    "http://www.library.example/catalogue", "https://news.daily.example/today", "http://university.example/physics", "https://blog.gardening.example/roses/",
    "http://museum.example/opening-hours", "https://m.weather.example/forecast", "http://theatre.example/season", "https://encyclopedia.example/history/rome",
    "https://www.recipes.example/bread", "http://docs.software.example/manual.html", "https://travel.example/madrid", "http://www.school.example/timetable",
    "https://science.example/chemistry", "http://blog.painter.example/landscapes", "https://www.cityhall.example/forms.html", "http://poetry.example/sonnets",
    "https://health.example/advice", "http://sports.example/results", "https://m.radio.example/listen", "http://www.bookshop.example/novels.html",
    "https://farmers.example/wheat", "http://mountains.example/maps", "https://www.orchestra.example/concerts", "http://blog.carpenter.example/chairs",
    "https://railway.example/stations", "http://observatory.example/stars", "https://m.harbour.example/tides.html", "http://archive.example/letters",
    "https://blog.teacher.example/grammar", "http://botany.example/ferns", "https://www.parliament.example/debates/", "http://dictionary.example/words",
    "https://m.cinema.example/programme", "http://geology.example/rocks", "http://www.hospital.example/visitors/", "https://blog.historian.example/notes?page=two",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url, label`` (1.0 unwanted), each example under each reserved domain."""
    domains = ("example.com", "example.net", "example.org")
    urls = [(y, u.replace(".example/", f".{d}/")) for y, group in ((1.0, UNWANTED), (0.0, WANTED)) for u in group for d in domains]
    table = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for y, u in urls])
    return spark.range(1).select(F.inline(table))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    lower = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(url, pattern, 2)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, or null. The rules are configuration: a few hundred at most."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(slash + rule_path))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _gram(mark: str, text: Column, n: int, dims: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(dims)).cast("int")


def gram_indices(host: Column, path: Column, dims: int, sizes: Sequence[int] = (3, 4)) -> Column:
    """Array of hashed character n-grams of ``^host$`` and ``path$``, each in its own name space."""
    parts = []
    for mark, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(path, F.lit("$")))):
        for n in sizes:
            count = F.length(text) - n + 1
            at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(at, _gram(mark, text, n, dims)))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")).otherwise(F.concat(*parts))


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def train(labelled: DataFrame, dims: int = 4096, steps: int = 300, rate: float = 4.0, decay: float = 0.0003, most: int = 20_000) -> list[float]:
    """Weights of the n-gram cells, then the intercept. ``labelled`` has ``url, label``, at most ``most`` rows."""
    host, path = split_url(F.col("url"))
    usable = labelled.where("url IS NOT NULL AND label IS NOT NULL")
    if (n := usable.count()) == 0 or n > most:
        raise ValueError(f"{n} labelled URLs; between 1 and {most} are asked for")
    # the labelled table is small, so one task may number it
    rows = usable.select("url", F.col("label").cast("double").alias("y"), gram_indices(host, path, dims).alias("g"))
    rows = rows.withColumn("e", F.row_number().over(Window.orderBy("url", "y")) - 1)
    cells = rows.select("e", (1 / F.sqrt(F.greatest(F.size("g"), F.lit(1)).cast("double"))).alias("v"), F.explode("g").alias("j")).groupBy("e", "j").agg(F.sum("v").alias("v"))
    cells = cells.unionByName(rows.select("e", F.lit(dims).alias("j"), F.lit(1.0).alias("v")))
    by_row = cells.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c")).join(rows.select("e", "y"), "e")
    by_row = by_row.agg(F.sort_array(F.collect_list(F.struct("e", "y", "c"))).alias("r")).select(F.col("r.y").alias("y"), F.col("r.c").alias("x"))
    by_cell = labelled.sparkSession.range(dims + 1).select(F.col("id").cast("int").alias("j")).join(cells, "j", "left").groupBy("j").agg(F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), F.struct("e", "v")))).alias("c"))
    by_cell = by_cell.agg(F.sort_array(F.collect_list(F.struct("j", "c"))).alias("r")).select(F.col("r.c").alias("xt"))

    def step(w: Column, _: Column) -> Column:
        p = F.transform("x", lambda r: _sigmoid(F.aggregate(r, F.lit(0.0), lambda s, t: s + t["v"] * F.element_at(w, t["j"] + 1))))
        miss = F.zip_with(p, F.col("y"), lambda a, b: a - b)
        slope = lambda c, m: F.aggregate(c, F.lit(0.0), lambda s, t: s + t["v"] * F.element_at(m, t["e"] + 1))
        return _let(miss, lambda m: F.zip_with(w, F.col("xt"), lambda v, c: v * (1 - rate * decay) - slope(c, m) * (rate / n)))

    zero = F.array_repeat(F.lit(0.0), dims + 1)
    both = by_row.unionByName(by_cell, allowMissingColumns=True).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("x", "y", "xt")])  # one row each
    # one row of dims + 1 numbers reaches the driver
    return list(both.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step).alias("w")).first()["w"])


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, dims: int = 4096, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score is the probability that a URL is unwanted."""
    weights = train(labelled_urls(pages.sparkSession) if labelled is None else labelled, dims)
    table, bias = F.array(*[F.lit(w) for w in weights[:-1]]), F.lit(weights[-1])
    host, path = split_url(pages["url"].cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_r", match_rule(F.col("host"), F.col("path"), rules)).withColumn("_g", gram_indices(F.col("host"), F.col("path"), dims))
    total = F.aggregate("_g", F.lit(0.0), lambda s, j: s + F.element_at(table, j + 1))
    score = F.when(F.size("_g") == 0, 0.0).otherwise(_sigmoid(bias + total / F.sqrt(F.greatest(F.size("_g"), F.lit(1)).cast("double"))))
    verdict = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return rows.withColumn("score", score).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), verdict).alias("verdict"), "score")
