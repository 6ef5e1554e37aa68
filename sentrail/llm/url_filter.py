"""URL filter: path rules first, else a logistic regression on hashed character n-grams.

The model sees n-grams of 3 to 5 bytes of host and path, hashed apart for the two
parts into one table of weights, divided by the root of their number. It is fitted on the
driver to a small labelled table of URLs (at most MAX_TRAINING rows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, mixed, tidy

NGRAMS = (3, 4, 5)
HASH_BITS = 16
MAX_TRAINING = 5000
PRIOR = 0.35
BASE = U64(0x100000001B3)

# A labelled table, made by hand and by kind: sites that a text corpus wants, and sites that it does not.
WANTED = {
    "reference": (
        "https://en.wikipedia.org/wiki/Photosynthesis", "https://de.wikipedia.org/wiki/Bodensee", "https://fr.wikipedia.org/wiki/Marie_Curie", "https://es.wiktionary.org/wiki/ventana", "https://www.britannica.com/topic/opera-music",
        "https://plato.stanford.edu/entries/kant/", "https://www.merriam-webster.com/dictionary/lantern", "https://www.duden.de/rechtschreibung/Haus", "https://openstreetmap.org/relation/51701", "https://www.wikidata.org/entity/Q42",
    ),
    "books and museums": (
        "https://www.gutenberg.org/ebooks/1342", "https://www.loc.gov/collections/maps/", "https://www.bl.uk/learning/timeline", "https://www.metmuseum.org/art/collection/search/436535", "https://www.rijksmuseum.nl/en/collection/SK-C-5",
        "https://gallica.bnf.fr/ark:/12148/btv1b8449691v", "https://archive.org/details/originofspecies", "https://www.museodelprado.es/coleccion/obra-de-arte/las-meninas", "https://www.smithsonianmag.com/history/", "https://unesco.org/en/world-heritage",
    ),
    "universities and science": (
        "https://ocw.mit.edu/courses/physics/8-01/", "https://www.cam.ac.uk/research/news", "https://www.ethz.ch/en/studies.html", "https://www.nature.com/articles/nature12373", "https://arxiv.org/abs/1706.03762",
        "https://www.nasa.gov/missions/voyager/", "https://www.uni-heidelberg.de/de/studium", "https://www.sorbonne-universite.fr/formation", "https://www.cern.ch/about/physics/standard-model", "https://pubmed.ncbi.nlm.nih.gov/20118234/",
        "https://www.mpg.de/institute", "https://www.unam.mx/acerca-de-la-unam",
    ),
    "government and public bodies": (
        "https://www.gov.uk/renew-driving-licence", "https://www.nps.gov/yell/planyourvisit/index.htm", "https://www.who.int/news-room/fact-sheets/malaria", "https://europa.eu/youreurope/citizens/work", "https://www.bundestag.de/parlament/geschichte",
        "https://www.service-public.fr/particuliers", "https://www.boe.es/diario_boe/", "https://www.census.gov/data/tables.html", "https://data.gov.ie/dataset/rainfall", "https://www.stadt-zuerich.ch/de/stadtleben.html",
    ),
    "news": (
        "https://www.bbc.co.uk/weather/2643743", "https://www.lemonde.fr/sciences/article/2021/", "https://elpais.com/cultura/2020-03-01/", "https://www.zeit.de/wissen/geschichte/2019/12", "https://www.theguardian.com/environment/2022/jun/03/otters-return",
        "https://www.nzz.ch/feuilleton", "https://www.reuters.com/world/", "https://www.spektrum.de/news/1234567", "https://www.ouest-france.fr/bretagne/brest-29200/", "https://www.lavanguardia.com/vida",
    ),
    "software": (
        "https://docs.python.org/3/library/re.html", "https://spark.apache.org/docs/latest/sql-ref.html", "https://www.rfc-editor.org/rfc/rfc9110", "https://stackoverflow.com/questions/231767/", "https://developer.mozilla.org/en-US/docs/Web/HTTP",
        "https://www.postgresql.org/docs/current/indexes.html", "https://kernel.org/doc/html/latest/", "https://www.gnu.org/software/bash/manual/", "https://www.debian.org/releases/stable/", "https://sqlite.org/lang_select.html",
        "https://blog.rust-lang.org/2021/10/21/", "https://lists.freebsd.org/archives/",
    ),
    "home, food and garden": (
        "https://www.allrecipes.com/recipe/23600/lasagna/", "https://www.rhs.org.uk/plants/roses", "https://www.seriouseats.com/bread-baking-guide", "https://www.marmiton.org/recettes/recette_tarte", "https://www.chefkoch.de/rezepte/kartoffelsuppe",
        "https://www.nationalgeographic.org/encyclopedia/delta/", "https://knitting-patterns.info/mittens.html", "https://www.birdguides.com/articles/identification/", "https://www.ikea.com/gb/en/rooms/kitchen/", "https://m.gartenjournal.net/tomaten",
    ),
    "schools, clubs and towns": (
        "https://www.ashford-school.co.uk/term-dates", "http://rowing.club.cam.ac.uk/news/2019", "https://www.lakesidechoir.org/concerts", "https://village-history.org.uk/chapel/1843.html", "https://www.feuerwehr-oberdorf.de/einsaetze",
        "http://www.mairie-saint-martin.fr/conseil", "https://www.scouts.org.au/join", "https://ajedrez-murcia.es/torneos/2018", "https://parish.stnicholas.ie/newsletter", "https://www.chess.com/lessons/openings",
    ),
    "personal pages and forums": (
        "http://forum.oldbikes.net/viewtopic/8812", "https://jane-hikes.blogspot.com/2014/06/coast-path.html", "https://photos.tumblr.com/post/882", "https://www.reddit.com/r/gardening/comments/8k2/", "https://discourse.julialang.org/t/plots/512",
        "https://medium.com/writing/on-commas-7f3", "https://bergwandern.wordpress.com/2017/08/", "http://members.ozemail.com.au/~trains/steam.htm", "https://carnet-de-voyage.over-blog.com/article-12.html", "https://mariascocina.wordpress.com/tag/arroz/",
    ),
    "shops, travel and firms": (
        "https://www.thomann.de/gb/violins.html", "https://www.lonelyplanet.com/italy/tuscany", "https://www.sncf-connect.com/en-en/train/routes", "https://www.bosch.com/company/our-history/", "https://www.waterstones.com/author/jane-austen/",
        "https://www.rentabike.ch/de/velo", "https://www.hostelworld.com/hostels/lisbon", "https://www.zeiss.com/microscopy/en/home.html", "https://shop.britishmuseum.org/cards", "https://www.johnlewis.com/lamps/c700001",
    ),
    "health, law and money": (
        "https://www.nhs.uk/conditions/asthma/", "https://www.mayoclinic.org/diseases-conditions/migraine", "https://www.law.cornell.edu/uscode/text/17/107", "https://www.citizensadvice.org.uk/housing/", "https://www.ecb.europa.eu/stats/html/index.en.html",
        "https://www.apotheken-umschau.de/krankheiten", "https://www.ameli.fr/assure/sante", "https://www.moneyhelper.org.uk/en/savings", "https://www.redcross.org/take-a-class/first-aid", "https://www.investopedia.com/terms/b/bond.asp",
    ),
}
UNWANTED = {
    "casinos": (
        "http://www.royal-casino777.example/bonus", "http://lucky-slots.example/en/freespins", "https://m.pokerbonus.example/join", "http://casino-royale-online.example/de/", "https://bestcasino.example/fr/bonus-sans-depot",
        "http://jackpot-city.example/es/tragaperras", "https://win-bigcasino.example/vip/22", "http://m.slots-free.example/777", "http://blackjack-win.example/en/10",
    ),
    "betting": (
        "http://sport-bets-now.example/odds", "https://bets24.example/live", "http://freebets-uk.example/en/offer", "http://www.betting-tips.example/1",
    ),
    "pills": (
        "http://cheap-viagra.example/order", "https://pills-discount.example/en/cialis", "http://www.buy-pills-online.example/cart", "http://rx-pills.example/de/kaufen", "https://canadian-pills.example/fr/",
        "http://weightloss-pills.example/trial", "http://cheap-meds.example/no-prescription",
    ),
    "adult": (
        "http://adult-cams.example/live", "https://www.xxx-videos.example/hot", "http://m.adult-dating.example/join", "http://porn-tube.example/en/3", "http://adultchat.example/de/girls",
        "https://sexy-singles.example/meet", "http://hotgirls-x.example/es/", "http://www.adult-video-x.example/fr/1", "http://nude-cams.example/x", "http://escort-x.example/book",
    ),
    "link farms": (
        "http://spam-links.example/farm/1", "http://linkfarm.example/out?id=99", "https://seo-farm.example/backlinks", "http://www.article-spam.example/buy-links", "http://spamblog.example/en/403",
        "http://cheap-backlinks.example/order", "http://doorway-farm.example/de/1", "http://autoblog-spam.example/feed", "http://traffic-farm.example/x", "http://www.spamhub.example/fr/8",
    ),
    "advertising": (
        "http://ads-server.example/click?c=1", "http://track-ads.example/pixel.gif", "https://adclick-track.example/r/77", "http://m.popup-ads.example/win", "http://ads-network.example/en/banner",
        "http://banner-track.example/imp", "http://www.ad-tracker.example/de/cpa", "http://affiliate-track.example/go/31", "http://redirect-ads.example/out", "http://clicktrack.example/es/9",
    ),
    "scams": (
        "http://free-iphone-win.example/claim", "http://win-prize.example/survey", "http://cheap-replica-watches.example/rolex", "http://replica-bags.example/fr/sac", "https://payday-loans-fast.example/apply",
        "http://easy-cash-loans.example/en/", "http://crypto-doubler.example/send", "http://get-rich-win.example/de/geld", "http://free-gift-cards.example/es/", "http://loans-no-check.example/now",
    ),
    "malware and theft": (
        "http://warez-crack.example/keygen", "http://free-crack-download.example/setup.exe", "http://torrent-warez.example/en/44", "http://serial-keygen.example/x", "http://update-flash-now.example/player.exe",
        "http://paypal-login-verify.example/account", "http://secure-bank-login.example/verify", "http://appleid-unlock.example/signin", "http://malware-cleaner-free.example/scan", "http://your-pc-infected.example/fix.exe",
    ),
}


#: Words of unwanted hosts by kind, and what stands beside them and after them, from which more rows are made by rule.
UNWANTED_WORDS = {
    "casinos": "casino slots poker jackpot roulette blackjack bingo baccarat", "betting": "bets betting bet odds bookie wager sportsbook handicap", "pills": "pills viagra cialis pharmacy meds tramadol diet-pills steroids",
    "adult": "adult porn xxx cams nude sexy escort hookup", "link farms": "linkfarm backlinks spam seo-farm pbn doorway autoblog spamlinks", "advertising": "ads adserver banner clicks popunder tracker adnetwork track",
    "scams": "prize giveaway replica payday-loans lottery doubler cash-now gift-card", "malware and theft": "warez keygen crack torrent login-verify account-unlock codec-update free-scan",
}
BESIDE = "free best cheap online win top live fast vip super my the".split()
AFTER = "/ /bonus /join /order /live /win/22 /go?id=7 /offer.html /out/31 /en/ /de/start /fr/1 /es/44 /x".split()


def made_unwanted() -> list[str]:
    """Each word with three of BESIDE, before or after it, and AFTER in turn."""
    words = [w for of_kind in UNWANTED_WORDS.values() for w in of_kind.split()]
    out = []
    for i, w in enumerate(words):
        for k in range(3):
            near, j = BESIDE[(i + 5 * k) % len(BESIDE)], 3 * i + k
            host = f"{near}-{w}" if j % 2 else f"{w}-{near}"
            out.append(f"http{'s' * (j % 3 == 0)}://{('www.', '', 'www.')[j % 3]}{host}.example{AFTER[j % len(AFTER)]}")
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The default training table of (url, unwanted); invented hosts lie under the top domains of the wanted ones in turn, which then tell nothing."""
    wanted = [u for of_kind in WANTED.values() for u in of_kind]
    unwanted = [u for of_kind in UNWANTED.values() for u in of_kind] + made_unwanted()
    tops = [u.split("/")[2].rsplit(".", 1)[1] for u in wanted]
    return [(u, 0) for u in wanted] + [(u.replace(".example/", f".{tops[i % len(tops)]}/"), 1) for i, u in enumerate(unwanted)]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """After the first '://': the host up to / ? or #, A-Z lower-cased; the path up to ? or #. Else both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url), F.lit(""))
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``(verdict, host, path)`` rules that fits, else nulls.

    A rule fits its host and all subdomains, if the path starts with the rule's; of
    rules of one length the first given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight index) of every n-gram of the hosts and paths."""
    rows, cols = [], []
    for salt, column in ((1, host), (2, path)):
        raw, off = buffers(column)
        data = raw[off[0] : off[-1]].astype(U64) + U64(1)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        end = (off[1:] - off[0])[row] if len(row) else np.zeros(0, np.int64)
        at = np.arange(len(data))
        for n in NGRAMS:
            ok = at + n <= end
            h = np.zeros(int(ok.sum()), U64) + U64(salt * 8 + n)
            for k in range(n):
                h = h * BASE + data[at[ok] + k]
            rows.append(row[ok])
            cols.append((mixed(h) >> U64(64 - HASH_BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cols)


class UrlModel:
    def fit(self, host: pa.Array, path: pa.Array, label: np.ndarray, l2: float = 1e-4, rounds: int = 400, prior: float = PRIOR) -> UrlModel:
        """``prior`` is the share of unwanted URLs to expect, whatever their share in the table."""
        row, col = features(host, path)
        n = len(label)
        x = self._share(row, n)
        w, b, sw, sb = np.zeros(1 << HASH_BITS), 0.0, 0.0, 0.0
        for _ in range(rounds):
            z = b + np.bincount(row, w[col] * x[row], n)
            g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) / max(1, n)
            gw, gb = np.bincount(col, g[row] * x[row], 1 << HASH_BITS) + l2 * w, float(g.sum())
            sw, sb = sw + gw * gw, sb + gb * gb
            w, b = w - 0.3 * gw / (np.sqrt(sw) + 1e-8), b - 0.3 * gb / (sb**0.5 + 1e-8)
        share = min(max(float(np.mean(label)) if n else prior, 1e-3), 1 - 1e-3)
        self.w, self.b = w, b + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        return self

    @staticmethod
    def _share(row: np.ndarray, n: int) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """The probability that a URL is unwanted."""
        n = len(host)
        row, col = features(host, path)
        z = self.b + np.bincount(row, self.w[col], n) * self._share(row, n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(labelled: DataFrame, url: str = "url", label: str = "unwanted", rows: int = MAX_TRAINING) -> UrlModel:
    """A model from at most ``rows`` labelled URLs, those of least hash; rows with a null label are left out."""
    host, path = host_and_path(url)
    got = labelled.where(F.col(label).isNotNull()).select(host.alias("h"), path.alias("p"), F.col(label).cast("double").alias("y"))
    got = got.orderBy(F.xxhash64("h", "p"), "h", "p", "y").limit(rows).collect()
    return UrlModel().fit(pa.array([r["h"] for r in got], pa.string()), pa.array([r["p"] for r in got], pa.string()), np.array([r["y"] for r in got], float))


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = (), page: str = "page_id", url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``(page, host, path, rule, verdict, score)``, one row for each row of ``pages``, without a shuffle.

    The verdict is the longest fitting rule's, else 'block' where the model's score
    reaches ``threshold``, else 'allow'. Null URLs and those without '://' have an empty
    host and path, fit no rule and get the model's bias; ids may be null or repeated;
    other columns are not looked at; an empty table gives no rows.
    """
    host, path = host_and_path(url)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # 2^HASH_BITS weights

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(batch.column(1).slice(i, 20_000), batch.column(2).slice(i, 20_000)) for i in range(0, batch.num_rows, 20_000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(s) if s else np.zeros(0))], names=["page", "host", "path", "score"])

    kind = pages.schema[page].dataType.simpleString()
    scored = pages.select(F.col(page).alias("page"), host.alias("host"), path.alias("path")).mapInArrow(run, f"page {kind}, host string, path string, score double")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
