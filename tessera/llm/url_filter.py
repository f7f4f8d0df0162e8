"""URL filter: host and path rules, and a logistic regression on hashed character n-grams.

The regression is trained here from a small labelled table of URLs by full-batch gradient descent, each
step one aggregation over that table; only the weight vector, of fixed length, comes to the driver. Scoring
is one projection. Only DataFrame functions run here, inside the JVM. The words of the labelled table are
general ones; nothing in it comes from the addresses that are to be judged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import literal_array, saved, sealed

BUCKETS = 1 << 13
SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains and the start of a path; ``text`` is ``host + path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

#: The labelled table is made from these: words of addresses to block and to keep, words of one stem side by side, what
#: names hold beside them on each side, and paths.
UNWANTED = (
    "casino casinos slot slots slotmachine jackpot jackpots megajackpot poker pokerroom roulette bet bets betting bettor sportsbet sportsbook"
    " bookie bookies gamble gambler gambling lottery lotto freespin freespins bingo bingohall blackjack baccarat wager wagering"
    " pill pills dietpill viagra cialis levitra pharma pharmacy onlinepharmacy meds cheapmeds steroid steroids anabolic replica replicas"
    " replicawatch fakewatch counterfeit knockoff payday paydayloan loan loans quickloan loanshark forex forextrader crypto cryptocoin bitcoin"
    " bitcoins coinflip giveaway giveaways freegift freegifts clickbait clickfarm adserver adservers adclick adtrack tracker trackers tracking"
    " banner banners adbanner popup popups popunder malware malvertise adware spyware ransomware trojan phish phisher phishing spam spammer"
    " spambot linkfarm linkfarms linkspam warez warezbb torrent torrents torrentz pirate piratebay crack cracks cracked cracker keygen keygens"
    " serialkey adult adults adultchat xxx xxxtube porn porno porntube pornstar sex sexcam sexchat sexy escort escorts callgirl hookup"
    " hookups webcam webcams livecam camgirl camgirls nude nudes nudist erotic erotica hentai milf fetish stripper strippers"
).split()
WANTED = (
    "library libraries librarian museum museums university universities school schools schooling science sciences scientist history histories"
    " historian garden gardens gardening gardener weather forecast climate recipe recipes cooking cookbook kitchen kitchens travel traveller"
    " travelling railway railways trains theatre theatres drama music musician musical orchestra orchestras concert poetry poet poem poems"
    " novel novels novelist journal journals journalist news newspaper newsroom council councils counsel hospital hospitals clinic clinics"
    " medicine nurse nursing forest forests forestry mountain mountains river rivers bridge bridges village villages parish parishes church"
    " archive archives archivist gallery galleries painter painting maps mapping atlas astronomy astronomer botany botanic botanical chemistry"
    " chemist physics physicist geometry algebra geology grammar language languages dictionary dictionaries cycling cyclist bicycle sailing"
    " sailor carpentry carpenter pottery potter bakery baker baking breads insurance banking savings mortgage football sports tennis chess"
    " puzzle teacher teaching student college colleges academy research researcher software developer computer hardware engineer camera"
    " photography cinema festival market harbour weaving"
).split()
BESIDE_UNWANTED = "free win bonus cheap buy hot promo vip deals rich".split()
BESIDE_WANTED = "public local guide learn society centre national notes open club".split()
#: Starts, vowels and ends of the syllables of invented names, which say nothing either way and are kept.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gr h j k l m n p pl pr r s sh sl sp st str t th tr v w wh y z".split()
VOWELS = "a e i o u ai ea ee ie io oo ou".split()
CODAS = ["", "", "", "ck", "d", "l", "ll", "m", "n", "nd", "ng", "nt", "r", "rd", "s", "sh", "st", "t", "th"]
SHAPES = ("{0}", "{0}-{1}", "{1}-{0}", "{0}{1}", "my{0}", "{0}hub", "the{0}", "{1}.{0}", "best-{0}", "{0}-online", "{2}{0}", "{0}-{2}", "{0}{2}", "{2}-{0}")
PATHS = ("/", "/{0}", "/{1}/{2}", "/en/{2}", "/de/{2}.html", "/fr/{0}/{2}", "/es/{2}?page=2", "/{1}/{0}-{2}.html", "/index.html", "/tag/{0}", "/{3}/{0}", "/{3}-{0}.html")


def labelled_urls(each: int = 6) -> list[tuple[str, int]]:
    """Some thousand addresses under the reserved example domains, 1 for those to block, by rule and not by chance."""

    def name(i: int) -> str:
        # a Lehmer sequence, so that neighbours share nothing
        x, parts = (i + 1) * 48271 % 2147483647, []
        for _ in range(1 + i % 3):
            for some in (ONSETS, VOWELS, CODAS):
                x = x * 48271 % 2147483647
                parts.append(some[x % len(some)])
        return "".join(parts)

    invented = [name(i) for i in range(3 * len(UNWANTED))]
    rows = []
    for label, words, beside in ((1, UNWANTED, BESIDE_UNWANTED), (0, WANTED, BESIDE_WANTED), (0, invented, BESIDE_WANTED)):
        for i, word in enumerate(words):
            for j in range(each):
                n = i * each + j
                near = beside[(i + j) % len(beside)]
                host = SHAPES[(i + 3 * j) % len(SHAPES)].format(word, name(n + 500), near)
                path = PATHS[(5 * i + j) % len(PATHS)].format(word, name(n + 900), 17 * n + 1, near)
                rows.append((f"http{'s' * (n % 2)}://{host}.example.{('com', 'org', 'net')[n % 3]}{path}", label))
    return rows


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("")).otherwise(host)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit("")).otherwise(path)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits (``host + path``), blocking ones first among equals; null if none does."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "block", r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def with_grams(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``grams``: buckets of the character n-grams of ``host`` and of ``path``, each side with its own marks."""
    # characters by place, since a substring of a very long address is found by walking to it
    marked = df.withColumn("__h", F.split(F.concat(F.lit("^"), F.col("host"), F.lit("$")), "")).withColumn("__p", F.split(F.concat(F.lit("<"), F.col("path"), F.lit(">")), ""))

    def grams(c: str, n: int) -> Column:
        bucket = lambda i: F.pmod(F.xxhash64(F.concat(*[F.get(F.col(c), i + k) for k in range(n)])), F.lit(buckets))
        return F.when(F.size(c) < n, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(c) - n), bucket))

    return marked.withColumn("grams", F.concat(*[grams(c, n) for c in ("__h", "__p") for n in SIZES])).drop("__h", "__p")


def probability(weights: list[float]) -> Column:
    """The chance that ``grams`` belong to an address to block; the last weight is the bias."""
    table = literal_array(weights)
    dot = F.aggregate("grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    score = F.lit(float(weights[-1])) + dot / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))
    return 1.0 / (1.0 + F.exp(-score))


def trained(labelled: DataFrame, buckets: int = BUCKETS, steps: int = 30, rate: float = 0.3, shrink: float = 1e-5) -> list[float]:
    """Weights of the regression, from a bounded table (host, path, label); all zero without rows.

    Gradient descent with a step of its own for every weight (the mean gradient over its root mean square), so that
    rare n-grams learn as fast as common ones; the bias is not shrunk.

    The table is small by contract (some thousands of rows) and lies in one partition, so that a step needs no shuffle.
    """
    rows = saved(with_grams(labelled.where("label IS NOT NULL").select("host", "path", "label").coalesce(1), buckets).select("grams", "label")).coalesce(1)
    count = max(1, rows.count())
    weights, mean, square = [0.0] * (buckets + 1), [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    for step in range(1, steps + 1):
        missed = rows.select("grams", (probability(weights) - F.col("label")).alias("e")).select(
            F.explode_outer(F.concat(F.transform("grams", lambda b: b.cast("int")), F.array(F.lit(buckets)))).alias("b"),
            F.when(F.col("b") == buckets, F.col("e")).otherwise(F.col("e") / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))).alias("g"),
        )
        gradient = {r["b"]: r["g"] for r in missed.groupBy("b").agg(F.sum("g").alias("g")).collect()}
        slope = [gradient.get(i, 0.0) / count + shrink * w * (i < buckets) for i, w in enumerate(weights)]
        mean = [0.9 * m + 0.1 * g for m, g in zip(mean, slope, strict=True)]
        square = [0.99 * s + 0.01 * g * g for s, g in zip(square, slope, strict=True)]
        a, b = 1 - 0.9**step, 1 - 0.99**step
        weights = [w - rate * (m / a) / (math.sqrt(s / b) + 1e-9) for w, m, s in zip(weights, mean, square, strict=True)]
    return weights


def parts_of(urls: DataFrame) -> DataFrame:
    """host, path, label of labelled addresses (url, label)."""
    return urls.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")


def labelled_table(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{url}', {label})" for url, label in labelled_urls())
    return parts_of(spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)"))


def judged_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every page's host, path, rule and verdict.

    Null urls and urls without ``://`` have an empty host and path, which no rule fits and the regression
    judges by its bias and marks alone. A learnt verdict blocks above an even chance; without labelled rows all
    chances are even, and what no rule blocks is allowed. Repeated rows are judged each. Other columns are not read.
    """
    weights = trained(labelled)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = with_grams(parts.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)))
    scored = sealed(parts.select("page_id", "host", "path", "rule", probability(weights).alias("p_block")))
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else None
    learnt = F.when(F.col("p_block") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(F.element_at(by_rule, F.col("rule")), learnt) if rules else learnt
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
