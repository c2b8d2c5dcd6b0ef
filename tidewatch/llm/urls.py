"""URL verdicts: host and path rules first, else a logistic regression on hashed character n-grams.

The model is fitted by Spark ML on a small labelled table of urls and applied as column expressions
and a fitted transformer, so no row leaves the JVM. Features are the counts of the character
n-grams of host and path (kept apart), hashed into a fixed number of columns.

Defined cases: a null url or one without `://` has an empty host and path, matches no rule and
is allowed, as is any url without n-grams. The longest fitting rule wins; of equally long ones the first given.
Repeated rows give repeated results; other columns are not looked at.
"""
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tidewatch.llm.shared import bound

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
N_GRAMS = (3, 4, 5)
COLUMNS = 1 << 14

# Labelled urls for training: what to block and what to allow.
BLOCKED = """
https://casino-bonus.example.com/play
http://best-casino.example.org/slots/win
https://www.online-casino.example.com/en/jackpot
http://win-casino.example.com/free-spins
https://free-bets.example.org/today
http://sports-bets.example.com/odds
https://www.free-money.example.com/win
http://pills-online.example.com/order
https://cheap-pills.example.org/buy
http://www.cheap-meds.example.com/pills
https://diet-pills.example.com/offer
http://spam-links.example.org/farm
https://link-farm.example.com/seo
http://www.spam-offers.example.com/click
https://content-farm.example.org/spam
http://free-download.example.com/crack
https://adult-webcam.example.com/live
http://xxx-videos.example.org/free
https://payday-loans.example.com/apply
http://cheap-watches.example.org/replica
https://win-prize.example.com/claim
http://crypto-doubler.example.com/win
http://m.casino-slots.example.com/en/12
https://m.free-slots.example.org/es/2
https://www.free-pills-now.example.com/fr/9
http://m.spam-seo.example.org/de/7
http://blog.pills-shop.example.net/en/31
https://www.spam-mill.example.com/en/64.html
""".split()
ALLOWED = """
https://www.example.com/en/about
http://blog.example.org/de/post/12
https://news.example.com/fr/article/825
http://m.example.org/es/story/44.html
https://library.example.org/en/catalogue
http://www.university.example.com/en/course/101
https://museum.example.org/fr/visit
http://weather.example.com/en/today
https://recipes.example.org/en/bread/7
http://docs.example.com/en/guide/install.html
https://city.example.org/de/office/
http://blog.gardener.example.com/en/roses
https://www.history.example.com/en/1848
http://forum.example.org/en/thread/9931
https://maps.example.com/en/route
http://science.example.org/en/paper/53
https://www.theatre.example.com/de/programme
http://m.railway.example.org/fr/timetable
https://school.example.com/es/lesson/3
http://www.hospital.example.org/en/contact
https://music.example.com/en/concert/17
http://archive.example.org/en/letters/202
https://blog.teacher.example.com/en/maths
http://www.council.example.org/en/minutes/88
https://travel.example.com/es/andes/
http://nature.example.org/de/birds
https://www.northern.example.com/en/trains
http://thorne.example.org/fr/village
https://shire.example.com/en/walks/5
http://www.henson.example.com/en/family
https://tinsley.example.org/es/notes
http://blog.otterton.example.com/en/river
https://handstone.example.com/de/quarry
http://m.esher.example.org/en/market
""".split()


def host_of(url):
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1)


def fits(rule, host, path):
    name, _, start = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))


def rule_of(host, path, rules=RULES):
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for given, text in sorted(rules, key=lambda r: len(r[1])):
        shorter_rule, shorter_verdict = rule, verdict
        rule = F.when(fits(text, host, path), F.lit(text)).otherwise(shorter_rule)
        verdict = F.when(fits(text, host, path), F.lit(given)).otherwise(shorter_verdict)
    return rule, verdict


def grams(text, mark, sizes=N_GRAMS):
    """Marked character n-grams of `text` with a border on both sides, repeats included."""
    def of_size(characters, n):
        places = F.sequence(F.lit(1), F.size(characters) - (n - 1))
        found = F.transform(places, lambda i: F.concat(
            F.lit(mark), *[F.element_at(characters, i + k) for k in range(n)]))
        return F.when(F.size(characters) >= n, found).otherwise(none)

    def of(characters):
        return F.concat(*[of_size(characters, n) for n in sizes])

    none = F.array().cast("array<string>")
    characters = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")
    return F.when(text == "", none).otherwise(bound(characters, of))


def with_grams(urls):
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return urls.withColumns({"host": host, "path": path}).withColumn(
        "_grams", F.concat(grams(F.col("host"), "h"), grams(F.col("path"), "p")))


def seed_urls(spark):
    """The labelled table this module brings: url, label (1: to be blocked)."""
    return spark.createDataFrame([(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED],
                                 "url string, label double")


def fit(labelled, columns=COLUMNS, regularisation=0.001):
    """A model on labelled urls (url, label)."""
    steps = [HashingTF(numFeatures=columns, inputCol="_grams", outputCol="_features"),
             LogisticRegression(featuresCol="_features", labelCol="label", regParam=regularisation,
                                standardization=False, maxIter=100, tol=1e-8, predictionCol="_blocked",
                                probabilityCol="_probability", rawPredictionCol="_raw")]
    return Pipeline(stages=steps).fit(with_grams(labelled.where("url is not null and label is not null")))


def judge(pages, model, rules=RULES):
    """page_id, host, path, rule and verdict of every row of `pages`."""
    scored = model.transform(with_grams(pages.select("page_id", "url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when((F.col("_blocked") > 0.5) & (F.size("_grams") > 0), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, learned).alias("verdict"))
