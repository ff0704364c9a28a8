"""URL filter: host and path rules, then logistic regression on character n-grams.

The model is trained from a small labelled URL table (a parameter): the character
n-grams of host and path are hashed to ``BUCKETS`` features, scaled to unit length,
and a logistic regression is fitted. Training and scoring are DataFrame operations.

Defined results: a null url, or one without ``://``, has empty host and path; every
row is judged for itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm.common import UPPER, table

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)

# The rules of the contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))

# The small labelled table: hosts and paths of unwanted and of ordinary sites, written
# without looking at the driver's pages; no site of a test table is in it.
BLOCKED = tuple("""
    adultfriends hot-adult-movies adult-dating-club sexdating live-sex-chat freesexvideos porntube bestporn-clips xxxmovies xxx-stream
    nudegirls nude-cam-show sexcams cam-girls-live escortservice city-escorts eroticstories hentai-gallery milf-photos swingers-meet
    casinobonus grand-casino-online royalcasino vegas-casino slotmachines mega-slots jackpotparty pokerroom poker-stars-bonus
    texas-holdem-cash bet365mirror betting-tips sportsbetting free-bet-offers bookmaker-odds roulette-win lottery-winner bingo-cash
    viagraonline buy-viagra cialis-discount cheapmeds cheap-pharmacy canadian-pills pharmacy-no-prescription diet-pills-fast steroids4you
    replicawatches fake-rolex cheap-handbags paydayloans fast-payday-cash bad-credit-loans quick-money-now earn-cash-home
    getrichquick bitcoin-doubler crypto-giveaway freeiphone win-a-prize free-gift-cards claim-your-prize lucky-winner
    keygens crackedsoftware serial-cracks warezforum warez-full torrentz movie-torrents-free pirated-games rapid-downloads
    adservice adserver-network clicktracker click-tracking banner-ads popunder-ads trackingpixel spyware-install malwaredrop
    phishing-login spamhost bulk-spam-mailer link-exchange-farm seolinks backlinks-cheap""".split())
ALLOWED = tuple("""
    dailynews www.morningherald localnews.tribune weather.service www.cityhall parliament.gov health.ministry tax.office
    stanford.edu www.university-library mathematics.dept physics.lab chemistry-notes biology.institute research.council
    journal.medicine archive.history wiki.philosophy encyclopedia dictionary.words grammar-guide translations.centre
    museum.modernart www.nationalgallery orchestra.hall theatre.season opera-house cinema.reviews bookreviews poems.anthology
    blog.cooking recipes.kitchen www.bakery garden-club plants.nursery m.birdwatch hiking.trails www.mountains travel.diary
    railways.timetable airport.info ferries.island hotel-guide maps.streets www.bicycles sailing.club football.league chess.federation
    athletics.results swimming.pool tennis-court school.district kindergarten teachers.forum students.union exams.board scholarships
    docs.compiler www.opensource kernel.mailinglist python-tutorial database.manual forum.linux developers.handbook api.reference
    astronomy.today telescope.images climate.data oceans.survey geology.maps wildlife.trust forests.agency farmers.market
    veterinary.clinic hospital.north dentist.practice nursing.college pharmacology.society red-cross charity.shop volunteers
    architecture.review engineering.weekly carpentry.workshop pottery.studio photography.basics knitting-patterns quilts
    genealogy.records family.tree parish.church monastery synagogue.community mosque.centre law.reports court.decisions
    consumer.advice union.workers economy.institute statistics.bureau centralbank insurance.basics realestate.guide jobs.board
    letters.editor opinion.column www.sunday-times radio.station television.guide podcast.stories""".split())
ZONES = ("com", "net", "org", "info", "co.uk", "de", "fr", "io")
PATHS = ("/", "/index.html", "/news/item", "/view.php", "/2019/07/some-title", "/a/b/c", "/page-3", "/list", "/contact", "/x1", "/en", "/start/")


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label): label 1 is unwanted. Every zone and path occurs with both labels."""
    return [(f"{h}.{ZONES[(i + 3 * k) % len(ZONES)]}", PATHS[(i + 5 * k) % len(PATHS)], label)
            for label, hosts in ((1, BLOCKED), (0, ALLOWED)) for i, h in enumerate(hosts) for k in range(2)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.substr(u, F.locate("://", u) + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        zone, _, start = text.partition("/")
        fits = ((host == zone) | host.endswith("." + zone)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def char_grams(host: Column, path: Column) -> Column:
    """All n-grams of ^host$ and path; each says which of the two it is from."""
    def of(s: Column, mark: str) -> list[Column]:
        return [F.when(F.char_length(s) >= n, F.transform(
            F.sequence(F.lit(1), F.char_length(s) - n + 1), lambda i, n=n: F.concat(F.lit(mark), F.substr(s, i, F.lit(n)))))
            .otherwise(F.array().cast("array<string>")) for n in GRAMS]
    return F.concat(*of(F.concat(F.lit("^"), host, F.lit("$")), "h"), *of(path, "p"))


def train_url_model(spark: SparkSession, labelled: Sequence[tuple[str, str, int]] | None = None):
    rows = spark.createDataFrame(list(labelled if labelled is not None else labelled_urls()),
                                 "host string, path string, y int")
    # Both labels weigh the same, however many rows each has.
    n, bad = rows.count(), rows.where("y = 1").count()
    rows = rows.select(char_grams(F.col("host"), F.col("path")).alias("_uf_grams"), F.col("y").cast("double").alias("label"),
                       F.when(F.col("y") == 1, n / 2 / max(1, bad)).otherwise(n / 2 / max(1, n - bad)).alias("_uf_weight"))
    stages = [HashingTF(inputCol="_uf_grams", outputCol="_uf_tf", numFeatures=BUCKETS),
              Normalizer(inputCol="_uf_tf", outputCol="_uf_x"),
              LogisticRegression(featuresCol="_uf_x", weightCol="_uf_weight", regParam=0.002, maxIter=60,
                                 predictionCol="_uf_y", probabilityCol="_uf_p", rawPredictionCol="_uf_r")]
    return Pipeline(stages=stages).fit(rows.coalesce(1))


def judge_urls(pages: DataFrame, model, url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
               threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, p_block and verdict."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.withColumn("_uf_host", host).withColumn("_uf_path", path)
    rows = model.transform(rows.withColumn("_uf_grams", char_grams(F.col("_uf_host"), F.col("_uf_path"))))
    rule, says = fitting_rule(F.col("_uf_host"), F.col("_uf_path"), rules)
    p = vector_to_array("_uf_p")[1]
    new = {"host": F.col("_uf_host"), "path": F.col("_uf_path"), "rule": rule, "p_block": p,
           "verdict": F.coalesce(says, F.when(p > threshold, "block").otherwise("allow"))}
    return rows.select(*[c for c in pages.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, train_url_model(spark)).select("page_id", "host", "path", "rule", "verdict", "p_block")
