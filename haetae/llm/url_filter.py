"""URL filter: host and path rules first, else a logistic regression on hashed character n-grams."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import Hasher, add_columns, ascii_lower, flat

#: (verdict, host, path) of the rules of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Words in names of sites that a training corpus wants, and that it does not want: common knowledge, of no table in
#: particular. Fixed values.
WANTED_WORDS = """
garden river orchard harbor meadow library museum school science physics history music weather recipe kitchen travel
city news journal review books poetry art film sport health law math data kernel python forum wiki docs blog village
mountain bakery cycling chess birds railway theatre language grammar dictionary archive atlas nature ocean forest
garten schule wetter reise stadt zeitung wissenschaft jardin ecole musique voyage cuisine ville histoire escuela
ciencia viaje cocina ciudad biblioteca noticias university research biology chemistry engineering philosophy economics
politics climate astronomy geology medicine nursing teacher student lesson course lecture seminar gallery painting
""".split()
UNWANTED_WORDS = """
casino poker slots roulette blackjack jackpot lottery gambling betting bets porn sex xxx adult cams escort nude hentai
webcam erotic viagra cialis pills pharma steroids slimming replica rolex payday loans bitcoin doubler giveaway winner
claim prize ads adserver banner popup tracker pixel clicks redirect spam backlinks seo-links followers warez crack keygen
torrent serials malware phishing verify-account free-iphone get-rich miracle-diet fake-id
""".split()
#: Names made of these are plain: neither kind of word tells. Fixed values.
SYLLABLES = "an ber cor dal el fen gar hol in jor kel lan mar nor os per quin ral sen tor ul ven wex yar zan".split()
SUBDOMAINS, ZONES = ("", "www.", "", "m.", "", "blog.", "", "news."), ("com", "net", "org", "info", "co.uk", "de", "fr", "es")
#: Sites whose subdomains belong to anyone. Fixed values.
HOSTING = ("blogspot.com", "wordpress.com", "github.io", "weebly.com", "tumblr.com", "homepages.net", "freehosting.org", "livejournal.com")
PATHS = ("/en/{}", "/de/{}.html", "/fr/{}/", "/article/{}", "/", "/2021/04/{}", "/es/{}", "/index.php")
WANTED_PATHS, UNWANTED_PATHS = ("/wiki/topic-{}", "/docs/latest/{}", "/lesson/{}", "/papers/{}"), ("/signup/bonus", "/track/click.php", "/free/download", "/buy-now/cheap")


#: What names of either kind are put together with. Fixed values.
BESIDE = ("{}", "{}-{}", "{1}-{0}", "the-{}", "{}-online", "hot-{}", "my{}", "{}24", "{}{1}", "{1}{0}")


def _rows(words: list[str], beside: list[str], own: tuple[str, ...], i: int, shapes: tuple[str, ...], step: int) -> list[str]:
    """Host and path of pages named by word ``i``, one for each shape of name; ``step`` sets what stands beside it."""
    first, paths = words[i % len(words)], (*PATHS, own[i % len(own)])
    out = []
    for k, shape in enumerate(shapes):
        other = words[(7 * i + 3) % len(words)] if k % 2 else beside[(step * i + k) % len(beside)]
        name = shape.replace("{}", "{0}", 1).replace("{}", "{1}").format(first, other)
        zone = HOSTING[(i + k) % len(HOSTING)] if k % 2 else ZONES[(i // 3 + k) % len(ZONES)]
        out.append(f"{SUBDOMAINS[(i + k) % len(SUBDOMAINS)]}{name}.{zone}{paths[(i + 2 * k) % len(paths)].format(97 * i + k)}")
    return out


def _plain() -> list[str]:
    """Names of syllables, which tell nothing."""
    n = len(SYLLABLES)
    return ["".join(SYLLABLES[(i * (5 + 2 * j) + j * j) % n] for j in range(2 + i % 3)) for i in range(9 * n)]


def table() -> tuple[list[str], list[str]]:
    """Host and path of some hundred wanted and unwanted pages, made from the words by one rule for both.

    Zones, subdomains, most paths and what stands beside a word are the same for both, so that none of them tells; plain names are wanted ones.
    """
    plain = _plain()
    wanted = [r for i in range(len(WANTED_WORDS)) for r in _rows(WANTED_WORDS, plain, WANTED_PATHS, i, BESIDE, 5)]
    wanted += [f"{SUBDOMAINS[i % len(SUBDOMAINS)]}{p}{'-' + plain[i - 7] if i % 4 == 3 else ''}.{HOSTING[i % len(HOSTING)] if i % 3 == 2 else ZONES[i % len(ZONES)]}{PATHS[i % len(PATHS)].format(31 * i)}" for i, p in enumerate(plain)]
    return wanted, [r for i in range(len(UNWANTED_WORDS)) for r in _rows(UNWANTED_WORDS, plain, UNWANTED_PATHS, i, BESIDE, 5)]


#: Names of another shape, which the model never learns from. Fixed values.
OTHER = ("best-{}-site", "{1}.{0}", "{}s", "super{}", "{}-{1}-club", "go{}now", "{}-x", "e{}")


def other_table() -> tuple[list[str], list[str]]:
    """Pages of the same words under names of another shape, to measure the model on."""
    plain = _plain()
    each = lambda words: [r for i in range(len(words)) for r in _rows(words, plain, PATHS[:2], i, OTHER, 11)]
    return each(WANTED_WORDS), each(UNWANTED_WORDS)


def held_out(url: str) -> bool:
    """A fifth of the table, which the stated precision and recall are measured on."""
    return zlib.crc32(url.encode()) % 5 == 0


BITS, ORDERS, SEED = 15, (3, 4, 5), 8
#: How much the n-grams of a path weigh beside those of the host.
PATH_SHARE = 0.5
#: Share of the wanted pages in the loss, as blocking one costs more than letting one pass, and the step of the descent.
WANTED, STEP = 0.6, 20


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram, repeats included; those that begin at the first slash or behind it have buckets of their own."""
    hasher, rows, buckets = Hasher(data), [], []
    at = np.flatnonzero(data == ord("/"))
    where = np.searchsorted(at, starts[:-1])
    slash = np.where(where < len(at), np.r_[at, len(data)][np.minimum(where, len(at))], len(data))  # of a later row, if this one has none
    for n in ORDERS:
        first = np.arange(max(0, len(data) - n + 1))
        row = np.searchsorted(starts, first, "right") - 1
        first = first[inside := first + n <= starts[row + 1]]
        rows.append(row[inside])
        in_path = first >= slash[row[inside]]
        buckets.append((hasher(first, first + n, SEED + n) >> np.uint64(64 - BITS)).astype(np.int64) + (in_path << BITS))
    return np.concatenate(rows), np.concatenate(buckets)


def _texts(urls: Sequence[str]) -> pa.Array:
    return pa.array([f"^{u}$".encode() for u in urls], pa.large_binary())


@functools.lru_cache
def fit(wanted: tuple[str, ...] | None = None, unwanted: tuple[str, ...] | None = None, rounds: int = 8000, l2: float = 3e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2 logistic regression by full-batch gradient descent; a positive margin means block.

    Without labelled urls it learns from ``table``.
    """
    if wanted is None or unwanted is None:
        wanted, unwanted = (tuple(x) for x in table())
    data, starts = flat(_texts([*wanted, *unwanted]))
    rows, buckets = _grams(data, starts)
    y = np.r_[np.zeros(len(wanted)), np.ones(len(unwanted))]
    used, index = np.unique(buckets, return_inverse=True)
    x = np.zeros((len(y), len(used)), np.float32)
    x[rows, index] = 1
    for part, weight in ((used < 1 << BITS, 1.0), (used >= 1 << BITS, PATH_SHARE)):
        x[:, part] *= weight / np.maximum(np.sqrt(x[:, part].sum(1, keepdims=True)), 1)
    share = np.where(y == 1, (1 - WANTED) / len(unwanted), WANTED / len(wanted))
    alike, alpha, b = x @ x.T, np.zeros(len(y), np.float32), 0.0
    for _ in range(rounds):  # w = x.T @ alpha throughout: a step costs rows times rows, not rows times n-grams
        error = ((1 / (1 + np.exp(-(alike @ alpha + b))) - y) * share).astype(np.float32)
        alpha = (1 - STEP * l2) * alpha - STEP * error
        b -= STEP * error.sum()
    w = x.T @ alpha
    full = np.zeros(2 << BITS)
    full[used] = w
    return full, b


def margins(urls: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    """Margin of each ``^host + path$``; distinct n-grams count once, those of the host and of the path each by the root of their number."""
    weights, bias = model
    data, starts = flat(urls)
    rows, buckets = _grams(data, starts)
    pair = np.unique((rows.astype(np.int64) << (BITS + 1)) | buckets)
    rows, buckets = pair >> (BITS + 1), pair & ((2 << BITS) - 1)
    total = np.full(len(urls), float(bias))
    for part, weight in ((buckets < 1 << BITS, 1.0), (buckets >= 1 << BITS, PATH_SHARE)):
        count = np.bincount(rows[part], minlength=len(urls))
        total += weight * np.bincount(rows[part], weights[buckets[part]], len(urls)) / np.maximum(np.sqrt(count), 1)
    return total


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(__url__, instr(__url__, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct<rule, verdict>, else null."""
    best: Any = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_margin of every row of ``pages``.

    The longest rule that fits decides; where none fits, a positive margin of the model blocks. A url that is
    null, empty or without ``://`` has an empty host and path; the model judges it like any other. Null ids and
    repeated rows are kept as they are, other columns are not read, an empty table gives no rows.
    """
    model = model or fit()
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url__"))
    host, path = host_and_path(F.col("__url__"))
    base = base.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("__hit__", rule_of(F.col("host"), F.col("path"), rules)).withColumn("__both__", F.concat(F.lit("^"), "host", "path", F.lit("$")))
    scored = add_columns(base, "__both__", "block_margin double", lambda: lambda texts: {"block_margin": margins(texts, model)}, ["page_id", "host", "path", "__hit__"])
    method = F.when(F.col("block_margin") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("__hit__.rule").alias("rule"), F.coalesce(F.col("__hit__.verdict"), method).alias("verdict"), "block_margin")
