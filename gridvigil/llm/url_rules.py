"""URL filter: host and path rules, then logistic regression on character n-grams.

A URL is cut into host and path with column functions, the longest fitting rule decides,
and a URL without a rule is scored. Features are hashed n-grams of host and path, each
once per URL; the weights come from a labelled table of invented hosts by full-batch gradient descent
with L2 penalty, so the fit is the same on every run. Scoring is NumPy on whole blocks of
URLs; nothing is shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule and is scored as such; repeated rows each get a row; other columns play no part; a
null id stays null.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridvigil.llm.common import map_rows, sql_type

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SIZES = (3, 4, 5)
#: labelled rows the fit may read; a longer table is refused
MAX_LABELLED = 5_000
STEPS = 600
PENALTY = 1e-4
#: score from which a URL is blocked
THRESHOLD = 0.5

#: labelled rows of the own model
LABELLED = 3000

BAD = (
    "casino slots poker jackpot roulette betting bets bookie lotto lottery gamble bingo blackjack wager sportsbook "
    "viagra cialis pills pharmacy-cheap steroids weightloss xxx porn sex adult nude cams escort hookup hentai milf "
    "warez crack keygen torrent nulled pirate serialz cheats phish verify-account login-secure account-suspended "
    "malware payload dropper spyware scareware payday fastcash quickloan easy-money get-rich forex-signals "
    "crypto-double airdrop giveaway winner prize free-spins free-bets bonus-code clickfarm popunder adserver adtrack "
    "banner-ads spam spamfarm linkfarm backlinks doorway buy-followers replica knockoff clickbait you-wont-believe"
).split()
GOOD = (
    "library university college school museum archive journal gazette news weather forecast garden recipes kitchen "
    "travel guide history science biology physics chemistry mathematics algebra geometry astronomy geology botany "
    "medicine hospital clinic health nutrition law court parliament council city village county ministry "
    "music orchestra theatre cinema film books novels poetry essays letters dictionary grammar language courses "
    "lessons tutorial manual reference docs wiki forum community blog software code project database network "
    "sports tennis football cycling hiking climbing chess farm market bakery brewery carpentry pottery painting "
    "photography architecture engineering railway harbour bridge energy climate forest river ocean wildlife birds "
    "pets kids family parents charity volunteers insurance bank branches tax statistics census economics trade "
    "password-manager sussex essex advent assets betterment windmill playbook cabinet specialist"
).split()
GOOD_PATHS = (
    "about contact index article articles history reviews results chapter vol thread readme minutes exhibits opening-hours "
    "team imprint privacy search category tag page post archive events download faq help"
).split()
BAD_PATHS = (
    "play bonus buy cheap free win claim deposit signup-bonus live watch track click redirect aff apply-now order-now "
    "no-prescription odds tips serial payload verify update-billing unlock"
).split()
ENDS = ("test", "example", "invalid", "co.example", "org.test")


def labelled_urls(n: int, seed: int, bad=BAD, good=GOOD) -> tuple[list[str], list[bool]]:
    """``host + path`` of invented hosts under reserved names, and whether each is to be blocked."""
    rng = random.Random(seed)
    syllables = "an be ca do er fi go he in jo ka le mi no or pa qu re st ti un ve wa xi yo zu th on en la".split()

    def name() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))

    urls, blocked = [], []
    for i in range(n):
        is_bad = i % 2 == 0
        own, paths = (bad, BAD_PATHS) if is_bad else (good, GOOD_PATHS)
        parts = [rng.choice(own)] + [rng.choice((name(), rng.choice(own), str(rng.randint(1, 999)), "online", "best", "my", "the")) for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        plain_host = rng.random() < 0.2  # the path alone tells
        host = rng.choice(("", "", "www.", "m.", "blog.")) + (name() if plain_host else rng.choice(("-", "-", "")).join(parts)) + "." + rng.choice(ENDS)
        words = [rng.choice(own)] if plain_host else []
        words += [rng.choice((rng.choice(paths), name(), str(rng.randint(1, 9999)), rng.choice(("en", "de", "fr", "es")), rng.choice(own))) for _ in range(rng.randint(0, 3))]
        rng.shuffle(words)
        urls.append(host + "".join(f"/{w}" for w in words) + rng.choice(("", "", "/", ".html")) * bool(words))
        blocked.append(is_bad)
    return urls, blocked


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z only) text between the first ``://`` and ``/``, ``?``, ``#`` or the end."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """Longest rule (host, then path from the first slash) that fits, else null."""
    cases = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        cases = F.when(fits, F.lit(rule)) if cases is None else cases.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if cases is None else cases


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(URL number, bucket) of every n-gram of host and path, each pair once.

    A host and a path, each between ``^`` and ``$``, have n-grams of their own; NumPy hashes all
    URLs of a block together.
    """
    hosts = [u.partition("/")[0] for u in urls]
    paths = [u[len(h) :] for u, h in zip(urls, hosts, strict=True)]
    pairs = np.unique(np.concatenate([_grams(hosts, 0), _grams(paths, 64)]))
    return pairs // BUCKETS, pairs % BUCKETS


def _grams(texts: list[str], kind: int) -> np.ndarray:
    """Text number times ``BUCKETS`` and bucket of every n-gram, hashed with ``kind``."""
    parts = [np.frombuffer(("^" + t + "$").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    found = [np.empty(0, np.int64)]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    chars = (np.concatenate(parts) if parts else np.empty(0)).astype(np.uint64) + np.uint64(1)
    for size in SIZES:
        n = len(chars) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size + kind, np.uint64)
        for i in range(size):
            code = (code * np.uint64(0x100000001B3)) ^ chars[i : i + n]
        code ^= code >> np.uint64(31)
        code *= np.uint64(0x9E3779B97F4A7C15)
        whole = owner[:n] == owner[size - 1 :]
        bucket = (code >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        found.append((owner[:n] * BUCKETS + bucket)[whole])
    return np.concatenate(found)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, urls: list[str]) -> np.ndarray:
        """Probability of a block for every ``host + path``."""
        rows, buckets = grams(urls)
        counts = np.maximum(np.bincount(rows, minlength=len(urls)), 1)
        total = np.bincount(rows, self.weights[buckets], minlength=len(urls))
        return 1 / (1 + np.exp(-(total / np.sqrt(counts) + self.bias)))


def fit(urls: list[str], blocked: list[bool]) -> UrlModel:
    """Logistic regression on at most ``MAX_LABELLED`` labelled ``host + path`` texts."""
    if not 0 < len(urls) <= MAX_LABELLED:
        raise ValueError(f"the labelled table needs 1 to {MAX_LABELLED} rows, not {len(urls)}")
    rows, buckets = grams(urls)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(urls)), 1))
    value, target = scale[rows], np.asarray(blocked, float)
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        score = np.bincount(rows, weights[buckets] * value, minlength=len(urls)) + bias
        error = 1 / (1 + np.exp(-score)) - target
        gradient = np.bincount(buckets, error[rows] * value, minlength=BUCKETS)
        weights -= 4.0 * (gradient / len(urls) + PENALTY * weights)
        bias -= 0.5 * error.mean()
    return UrlModel(weights, bias)


@cache
def own_model() -> UrlModel:
    return fit(*labelled_urls(LABELLED, seed=5))


def judge(
    pages: DataFrame, rules: dict[str, str], model: UrlModel, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Host, path, rule, score and verdict of every URL; ``rules`` maps a rule to its verdict."""
    parsed = pages.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    held = pages.sparkSession.sparkContext.broadcast(model)

    def score(rows):
        texts = [h + p for h, p in zip(rows["host"], rows["path"], strict=True)]
        return rows | {"score": held.value.score(texts).tolist()}

    kind = sql_type(pages, id_col)
    scored = map_rows(
        parsed, parsed.columns, score, f"id {kind}, host string, path string, rule string, score double"
    )
    verdict = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", "score", verdict.alias("verdict"))
