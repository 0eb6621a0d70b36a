"""URL filters: host and path rules, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of hashed n-grams of a host, and as many of a path, and the lengths of n-grams.
BUCKETS, GRAMS = 1 << 14, (3, 4)
#: Training: passes of gradient descent, step and ridge; labelled rows at most (a bound on the driver).
PASSES, STEP, RIDGE, MOST_ROWS = 60, 0.5, 1e-4, 10_000

#: Probability from which a URL is blocked: of hosts held out from the labelled table, under 3 in 100 good ones reach it and 9 in 10 bad ones.
LIMIT = 0.6

#: The rules of the registered query, (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Names of hosts and a path of each, of which the small labelled table is made. They are invented, of the kinds that lists of each sort hold.
BAD = """
cheap-meds-online /buy/viagra-no-prescription
best-pills4u /order/discount-pills.html
rx-pharmacy-deals /cheap/cialis
canadian-pills-store /offer?id=91
diet-pills-review /slim-fast-now.html
casino-bonus-888 /free-spins
royal-casino-slots /win/jackpot.html
lucky-poker-online /bonus/deposit
win-big-lotto /claim-prize
slots-free-spins /play/now
sport-bets-tips /bets/today
free-bets-online /betting/odds
best-betting-sites /bonus-code
adult-cams-live /xxx/girls
xxx-hot-videos /porn/free
sexy-adult-dating /meet/hot-singles
free-porn-tube /adult/video
escort-girls-city /xxx/gallery
payday-loans-fast /apply/no-credit-check
easy-cash-loans /loan/instant-approval
debt-relief-quick /get-cash-now
bad-credit-loans24 /loans/today
make-money-home /earn/cash-fast
crypto-doubler-invest /profit/guaranteed
free-iphone-winner /claim/prize
you-won-giftcard /free/gift
survey-rewards-free /win-iphone
replica-watches-cheap /rolex/sale
cheap-handbags-outlet /discount/louis
wholesale-cheap-jerseys /cheap/sale
seo-backlinks-farm /buy-links
link-farm-directory /links/submit
spam-mailer-pro /bulk-email
article-spinner-spam /autoblog/post
content-farm-daily /top-10-tricks
click-ads-network /banner/track?x=1
ad-tracker-server /pixel.gif
popunder-ads-serve /adserver/click
track-clicks-ads /redirect/out
banner-exchange-ads /ads/show
free-download-crack /serial/keygen.exe
warez-full-torrent /crack/download
cracked-software-free /keygen/patch
movie-stream-free-hd /watch/full
mp3-download-free /top-hits.zip
account-verify-login /secure/update-password
paypa1-security-alert /signin/confirm
bank-login-update /verify/account
appleid-unlock-support /login/verify
ray-ban-sale-cheap /outlet/90-off
"""
GOOD = """
citylibrary /catalogue/new-books
archive.statemuseum /exhibits/2019/maps
riverside-university /departments/history
physics.northcollege /courses/optics.html
news.dailyherald /world/2021/03/elections
morningpost /politics/budget-report
weather.metservice /forecast/week
parliament /bills/committee-report
health.county /clinics/opening-hours
townhall /services/recycling
gardening-notes /2020/05/planting-tomatoes
homecooking /recipes/lentil-soup
bread-and-butter /baking/sourdough-guide
hiking-trails /routes/coast-path
travel.oldharbour /guides/lisbon
docs.opensource-db /manual/install.html
pythonic-tools /docs/tutorial
wiki.linuxhelp /kernel/modules
forum.woodworkers /threads/oak-table
stack.codequestions /questions/1423/sorting
chess-club /games/annotated
theatre-royal /programme/autumn
symphony /concerts/season
gallery.modernart /collection/prints
birdwatch /species/heron
astronomy-society /observing/moon
rail-travel /timetables/north
transit-authority /maps/metro
sports.gazette /football/results
cyclingclub /events/spring-ride
village-school /parents/calendar
teachers-resource /lessons/fractions
journal.medicine-review /articles/asthma
childrens-hospital /visit/parking
economics-institute /papers/trade
bookreviews /fiction/the-lighthouse
poems.literature /authors/keats
furniture-maker /chairs/oak
shop.bicycleparts /product/brake-cable
localbakery /menu/breads
theriver-inn /rooms/garden-view
history.nation-archive /letters/1914
weatherstation /rain/monthly
languages-online /grammar/verbs
en.encyclopedia /wiki/thermodynamics
photography-notes /lenses/macro
patent-office /search/results
geology.survey /maps/sandstone
farmers-market /stalls/saturday
mathematics /proofs/induction
lake-district /walks/easy
station-cafe /lunch
museum.railways /engines/steam
orchestra-youth /auditions
translation-notes /french/idioms
"""
SUBDOMAINS, DOMAINS = ("", "www.", "m.", "blog."), (".com", ".net", ".org", ".info")
#: Parts of names and paths that sites of both sorts have.
PLAIN = "river north maple stone hill lake city blue green old new first my all pro plus hub zone world web site line point place house east family daily open smart".split()
PLAIN_PATHS = ("/", "/index.html", "/about", "/en/12", "/page/3", "/contact")
#: Hosts that are made of a word of each line's sort and plain parts, for each line.
MADE = 5


def _hosts(word: str, plain: str, other: str) -> tuple[str, ...]:
    """Names made of a word that tells the sort and of parts that don't; the last one tells nothing."""
    return f"{word}-{plain}", f"{plain}-{word}", f"{word}{plain}", f"{plain}{word}24", f"{other}-{plain}{word}", f"{plain}-{other}"


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table (url, 1 for bad), several hundred hosts.

    Each line gives its own host and MADE further ones, of a word of the sort and plain parts. A host that tells has one of
    the sort's paths or a plain one, a host of plain parts only always one of the sort's. Subdomains and
    domains go round, so that they tell nothing.
    """
    out = []
    for label, table in ((1, BAD), (0, GOOD)):
        lines = [line.split(" ") for line in table.strip().split("\n")]
        words = sorted({w for name, _ in lines for w in re.split(r"[-.0-9]", name) if len(w) > 3 and w not in PLAIN})
        for i, (name, path) in enumerate(lines):
            made = [(name, path)]
            for k in range(MADE):
                n = i * MADE + k
                plain, other = PLAIN[n * 7 % len(PLAIN)], PLAIN[(n * 11 + 3) % len(PLAIN)]
                hosts = _hosts(words[n % len(words)], plain, other)
                form = (i + k) % len(hosts)
                own = lines[(i * 3 + k) % len(lines)][1]
                made.append((hosts[form], PLAIN_PATHS[n % len(PLAIN_PATHS)] if form < 5 and n % 3 == 0 else own))
            out += [(f"http://{SUBDOMAINS[(i + j) % 4]}{host}{DOMAINS[(i + 2 * j) % 4]}{p}", label) for j, (host, p) in enumerate(made)]
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null or without ://. A-Z of the host in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host or a parent domain, and the path's start; else nulls."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in reversed(ranked):
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, domain + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hashed n-grams of ^host$ and of ^path$, each in buckets of its own: an array of bucket numbers, repeats included."""

    def grams(text: Column, n: int, first: int) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.char_length(framed) >= n, F.sequence(F.lit(1), F.char_length(framed) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(framed, i, F.lit(n))), F.lit(BUCKETS)).cast("int") + first)

    return F.concat(*[grams(t, n, first) for t, first in ((host, 0), (path, BUCKETS)) for n in GRAMS])


def train(labelled: DataFrame, *, url_col: str = "url", label_col: str = "bad") -> tuple[list[float], float]:
    """(weights by bucket, bias) of a logistic regression on the share of each bucket among a URL's n-grams.

    labelled is a small table of at most MOST_ROWS rows (more raise an error): features are
    made by the same columns as in scoring, and the descent over them is a small loop on the driver.
    """
    host, path = url_parts(F.col(url_col))
    rows = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(buckets(host, path).alias("f"), F.col(label_col).cast("int").alias("y")).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} labelled urls")
    # in an order that isn't the labels'
    data = sorted(((zlib.crc32(repr(r["f"]).encode()), r["f"], r["y"]) for r in rows if r["f"]), key=lambda x: x[:2])
    data = [(*np.unique(np.array(f), return_counts=True), len(f), y) for _, f, y in data]
    weights, bias = np.zeros(2 * BUCKETS), 0.0
    for _ in range(PASSES):
        for f, times, n, y in data:
            z = bias + float(weights[f] @ times) / n
            off = STEP * (y - 1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))
            bias += float(off) * 0.1
            weights[f] += times * (off - RIDGE * weights[f])
    return weights.tolist(), bias


def score(features: Column, model: tuple[list[float], float]) -> Column:
    """Probability of bad."""
    weights, bias = model
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # one literal, folded before it runs
    z = F.lit(bias) + F.aggregate(features, F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1)) / F.greatest(F.size(features), F.lit(1))
    return 1 / (1 + F.exp(-z))


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, bad int")


def filter_urls(pages: DataFrame, model: tuple[list[float], float], *, rules=RULES, limit: float = LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bad: allow or block for every url.

    The longest fitting rule decides; without one, the model does: block where the probability `bad`
    reaches limit. Null urls and such without :// have empty host and path and are judged like any
    other. Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    scored = parts.select("*", rule.alias("rule"), verdict.alias("v"), score(buckets(F.col("host"), F.col("path")), model).alias("bad"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("bad") >= limit, "block").otherwise("allow")).alias("verdict"), "bad")
