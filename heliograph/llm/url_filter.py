"""Operator 6, URL filters: allow and block rules, else logistic regression on hashed character n-grams.

Everything is DataFrame expressions.  Host and path are cut into character
n-grams, hashed to ``BUCKETS`` weights; the weights are learned on the driver from the
n-grams that Spark makes of a small labelled table of URLs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4)
STEPS = 60

#: Fixed values: (host suffix, path prefix, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The small labelled table, URLs without their scheme: those to block, then those to allow.  Ordinary words, so that what tells is in the words.
BLOCKED = """
casino-royal.example.com/bonus/free-spins  online-casino.example.net/slots  vegas-slots.example.com/play/jackpot  bet365fake.example.net/odds/live  freebets.example.com/promo
poker-stars-win.example.net/bonus-code  roulette.example.org.test/casino/table  lotto-winner.example.com/claim/prize  scratchcards.example.net/win/now  sportsbook.example.com/bet/football
cheap-meds.example.com/buy/viagra.html  pills-shop.example.net/cialis-online  rx-pharmacy.example.com/order/no-prescription  discount-pills.example.net/cart/tramadol  weightloss-pills.example.com/offer
diet-miracle.example.net/buy-now  enlarge.example.com/pills/discount  canadian-pharma.example.net/cheap  replica-watches.example.com/buy/rolex  fake-bags.example.net/shop/replica
xxx-videos.example.com/watch/hot  adult-dating.example.net/signup/free  sexcams.example.com/live/girls  hot-singles.example.net/meet/tonight  porn-tube.example.com/video/4411
escort-girls.example.net/city/london  milf-cams.example.com/chat  nude-pics.example.net/gallery/7  adultfriend.example.com/join  xxx-dvd.example.net/download
warez-world.example.com/download/crack.exe  keygen.example.net/serial/office  cracked-apps.example.com/apk/free  torrent-movies.example.net/download/full-hd  free-mp3.example.com/download/album.zip
nulled-scripts.example.net/wp/theme.zip  malware-drop.example.com/setup.exe  update-flash.example.net/install/player.exe  secure-login.example.com/verify/account  paypa1-support.example.net/login/confirm
bank-verify.example.com/signin/update  apple-id-locked.example.net/unlock/account  free-giftcard.example.com/claim/now  iphone-winner.example.net/prize/claim  survey-reward.example.com/win/voucher
click-here.example.net/offer/limited  make-money-fast.example.com/join/now  work-from-home.example.net/earn/5000  crypto-doubler.example.com/invest/bitcoin  forex-robot.example.net/profit/daily
payday-loan.example.com/apply/instant  bad-credit.example.net/loans/cash  seo-links.example.com/buy/backlinks  link-farm.example.net/directory/submit  spam-blog.example.com/tag/cheap-viagra
traffic-bot.example.net/buy/visitors  article-spinner.example.com/spun/casino-bonus  clickbait.example.net/you-wont-believe  content-farm.example.com/top-10-tricks  popup-ads.example.net/redirect/offer
casino-city.example/en/51  wincasino.example/807/  play-poker.example/33.html  bets-online.example/611  cheap-loans.example/902
buy-pills-now.example/15.html  pills24.example/77/  adultchat.example/640  free-porn.example/9/  spamfarm.example/4150
free-games-download.example/87/  win-prizes.example/2219  malware-host.example/6.html  phish-kit.example/999  xxx-club.example/2071
"""
ALLOWED = """
www.library.example.net/catalogue/1987  archive.example.com/en/1204  news.example.net/world/2021/elections  docs.example.com/guide/install  wiki.example.net/wiki/History_of_bread
www.university.example.edu/physics/lectures/3  museum.example.net/collection/ceramics  journal.example.com/volume/12/issue/4  parliament.example.gov/debates/1998  weather.example.com/forecast/north
recipes.example.net/soup/lentil  garden.example.com/roses/pruning  chess.example.net/openings/sicilian  hiking.example.com/routes/lake-district  railway.example.net/timetable/sunday
maps.example.com/city/lyon  health.example.gov/vaccines/children  school.example.edu/maths/fractions  teacher.example.net/lesson/verbs  poetry.example.com/sonnets/18
opera.example.net/season/2019  orchestra.example.com/concerts/spring  cinema.example.net/reviews/the-river  books.example.com/fiction/new  letters.example.net/1848/march
astronomy.example.com/planets/saturn  geology.example.net/fossils  birds.example.com/species/heron  ocean.example.net/currents  forest.example.com/trees/oak
git.example.com/project/repository/issues/42  git.example.net/team/parser/pull/7/files  code.example.com/sorting/blob/main/README.md  packages.example.net/package/json-reader/2.1.0  bugs.example.com/issue/8821
questions.example.com/questions/3512/how-to-read-a-file-line-by-line  forum.example.net/viewtopic.php  mailing-list.example.net/2004/threads  answers.example.com/a/1198  compiler.example.com/manual/loops
www.newspaper.example.com/2019/07/14/politics/budget-vote.html  magazine.example.net/culture/the-art-of-letters  radio.example.com/programmes/morning  broadcaster.example.co.uk/news/uk-5512  weekly.example.de/wissen/artikel-204.html
fr.example.com/cuisine/tarte-aux-pommes  de.example.net/geschichte/mittelalter  es.example.com/ciencia/volcanes  it.example.net/arte/rinascimento  www.example.com/about
blog.example.com/2016/05/travel-notes  me.example.net/posts/why-i-bake-bread  notes.example.com/tag/linux  photos.example.net/albums/mountains  diary.example.com/archive/2009/11
www.hospital.example.com/departments/eyes  pharmacy-board.example.gov/regulations  medical-journal.example.com/article/s41586  bank-history.example.com/notes/1844  insurance.example.net/contact
shop.example.net/en/shoes  tools.example.com/hammers/12  bicycle.example.net/repair/chain  furniture.example.com/product/oak-table  market.example.com/item/20871
www.townhall.example.gov/council/minutes  fire-brigade.example.net/safety  court.example.gov/opinions/19-1392.pdf  statistics.example.gov/tables/population  patents.example.com/patent/US1234567
video.example.com/watch  encyclopedia.example.com/topic/photosynthesis  dictionary.example.net/define/harbour  papers.example.net/abs/1706.03762  lectures.example.edu/course/6006/notes.pdf
conference.example.com/2022/schedule  jobs.example.com/engineer/berlin  hotel.example.net/rooms  travel.example.com/japan/kyoto/temples  football.example.com/league/table
www.theatre.example.com/tickets  ethics.example.edu/essays/kant  bath-abbey.example.com/visit  thistle.example.net/gardening  leather.example.com/workshop
sub.domain.example.com/index.html  static.example.net/css/style.css  api.example.com/v2/users  m.example.com/story/7781  www.example.net/
harbour.example/1204  library.example/87.html  museum.example/640/  station.example/9904  handbook.example/2468/  island.example/75  bakery.example/en/12  orchard.example/en/3301  bridge.example/es/742  winter.example/de/612.html
meadow.example/fr/328/  candle.example/en/5131  violin.example/es/907/  pepper.example/en/7008.html  saddle.example/en/444  copper.example/es/1620  lantern.example/en/12/  anchor.example/de/94.html  basket.example/fr/2750/  button.example/en/8115
"""
LABELLED = tuple((host, f"/{path}", label) for label, urls in ((1, BLOCKED), (0, ALLOWED)) for host, _, path in (url.partition("/") for url in urls.split()))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null; a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for suffix, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _bucket_at(part: Column, n: int, salt: int) -> Callable[[Column], Column]:
    return lambda i: F.pmod(F.xxhash64(F.lit(salt), F.substr(part, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of host and path, as an array of ints; ends are marked."""
    parts = []
    for salt, part in ((1, F.concat(F.lit("^"), host, F.lit("$"))), (2, F.concat(F.lit("^"), path, F.lit("$")))):
        for n in GRAMS:
            starts = F.sequence(F.lit(1), F.greatest(F.length(part) - (n - 1), F.lit(1)))
            parts.append(F.transform(starts, _bucket_at(part, n, salt)))
    return F.array_distinct(F.concat(*parts))


def probability(features: Column, weights: list[float], bias: float) -> Column:
    """Logistic probability of *block* from an array of buckets."""
    table = F.array(*(F.lit(w) for w in weights))
    total = F.aggregate(features, F.lit(bias), lambda total, b: total + F.element_at(table, b + 1))
    return 1 / (1 + F.exp(-total))


def fit(spark: SparkSession, labelled: tuple[tuple[str, str, int], ...] = LABELLED, steps: int = STEPS, rate: float = 0.3, decay: float = 0.02) -> tuple[list[float], float]:
    """Weights and bias by full-batch AdaGrad on the driver, over the n-grams that one job makes of the small table."""
    weights, bias, past = [0.0] * BUCKETS, 0.0, [1e-3] * (BUCKETS + 1)
    if not labelled:
        return weights, bias
    rows = spark.createDataFrame(list(labelled), "host string, path string, label int").select(buckets(F.col("host"), F.col("path")).alias("features"), "label").collect()
    for _ in range(steps):
        gradient = [0.0] * (BUCKETS + 1)
        for row in rows:
            total = bias + sum(weights[b] for b in row["features"])
            error = row["label"] - 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))
            for b in (*row["features"], BUCKETS):
                gradient[b] += error / len(rows)
        for b, g in enumerate(gradient):
            if b < BUCKETS:
                g -= decay / len(rows) * weights[b]
            past[b] += g * g
            change = rate * g / math.sqrt(past[b])
            if b < BUCKETS:
                weights[b] += change
            else:
                bias += change
    return weights, bias


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, labelled: tuple[tuple[str, str, int], ...] = LABELLED) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``probability`` of block and ``verdict`` for every row of ``pages``.

    A null url, or one without ``://``, has empty host and path; no rule fits it.
    Of rules that fit the longest wins, by its text.  Repeated rows are each
    judged; other columns do not matter; an empty table gives an empty result.
    """
    weights, bias = fit(pages.sparkSession, labelled)
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"))
    cut = source.select("page_id", host_of(F.coalesce("url", F.lit(""))).alias("host"), path_of(F.coalesce("url", F.lit(""))).alias("path"))
    ruled = cut.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules)).withColumn("probability", probability(buckets(F.col("host"), F.col("path")), weights, bias))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("probability") >= 0.5, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), "probability", verdict.alias("verdict"))
