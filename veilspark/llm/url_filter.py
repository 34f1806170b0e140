"""URL filters: rules on hosts and paths, and a list of canonical URLs, behind a blocked Bloom filter.

Every URL has a few keys: its canonical form, and each suffix of its host with each
directory of its path. A blocked Bloom filter of all listed keys (blocks of eight words,
one bit of each word for a key) lets through the keys that may be listed; they meet the
list in a hash join on the whole key, which removes the false positives.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.arrays import let
from veilspark.llm.common import lower_az, stored, table
from veilspark.llm.skew import heavy_keys, join_unique

WORDS = 8
#: Bits of the filter for each listed key, and its most blocks (8 MB), beyond which more keys pass on to the exact join.
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 17
#: Parameters of a query that don't tell pages apart.
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)"
#: Parts of a host that don't tell sites apart.
SUBSITE = r"^(?:www|m)\."
#: A payload of fewer bytes is never a mirror of another.
MIRROR_BYTES = 100


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return lower_az(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without slashes at its end, sorted parameters without tracking; null without ``://``."""
    query = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^?#]*\?([^#]*)", 1), F.lit(""))
    told = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(told) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(told), "&"))).otherwise(F.lit(""))
    site = F.regexp_replace(host_of(url), SUBSITE, "")
    return F.when(F.instr(url, "://") > 0, F.concat(site, F.regexp_replace(path_of(url), "/+$", ""), tail))


def listed_key(url: Column) -> Column:
    """The key of a canonical URL; it differs from those of all rules."""
    return F.concat(F.lit("="), canonical(url))


def url_keys(url: Column, labels: int, depth: int) -> Column:
    """Keys that a URL may be listed by, for rules of up to ``labels`` parts of a host and ``depth`` slashes of a path."""

    def joined(parts: Column) -> Column:
        hosts = F.transform(
            F.sequence(F.greatest(F.lit(1), F.size(parts.h) - (labels - 1)), F.size(parts.h)),
            lambda at: F.array_join(F.slice(parts.h, at, F.size(parts.h)), "."),
        )
        paths = F.transform(
            F.sequence(F.lit(1), F.least(F.size(parts.p) - 1, F.lit(depth))),
            lambda to: F.concat(F.array_join(F.slice(parts.p, F.lit(1), to), "/"), F.lit("/")),
        )
        return let(paths, lambda ps: F.flatten(F.transform(hosts, lambda h: F.transform(ps, lambda p: F.concat(h, p)))))

    parts = F.struct(F.split(host_of(url), r"\.").alias("h"), F.split(path_of(url), "/").alias("p"))
    rules = F.when((F.lit(depth) > 0) & F.contains(path_of(url), F.lit("/")), let(parts, joined)).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(listed_key(url)), rules))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _mask(hashed: str, word: int) -> str:
    return f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {6 * word}) & 63 as int))"


def blocked_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, w0 ... w7`` of every block that has a key: at most ``blocks`` rows, whatever the keys."""
    hashed = keys.select(_block(F.col(key), blocks).alias("block"), F.xxhash64(key).alias("bits"))
    return hashed.groupBy("block").agg(*[F.expr(f"bit_or({_mask('bits', w)})").alias(f"w{w}") for w in range(WORDS)])


def filter_blocks(keys: int) -> int:
    """Blocks for so many keys: a power of two, at most ``MAX_BLOCKS``."""
    return min(MAX_BLOCKS, 1 << max(0, ceil(log2(max(1, keys) * BITS_PER_KEY / (64 * WORDS)))))


def possible(rows: DataFrame, key: str, held: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and few others. The filter is broadcast, 8 MB at most."""
    block, bits = _block(F.col(key), blocks).alias("block"), F.xxhash64(key).alias("bits")
    probed = rows.select(*rows.columns, block, bits).join(F.broadcast(held), "block")
    hit = reduce(lambda a, b: a & b, [F.expr(f"(w{w} & {_mask('bits', w)}) <> 0") for w in range(WORDS)])
    return probed.where(hit).select(*rows.columns)


def judged_urls(urls: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of each distinct ``url`` that a rule or the list tells something about.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``); a path starts and ends
    with a slash. A rule holds for its host, all hosts below it, and what is below its path.
    The longest one decides; of one rule with both verdicts ``block``. ``listed`` has
    ``url``s; one whose canonical form is among theirs is blocked, unless a rule decides.
    """
    ruled = rules.where(F.col("host").isNotNull() & F.col("path").rlike("^/") & F.col("path").rlike("/$"))
    ruled = ruled.select(F.concat("host", "path").alias("key"), F.concat("host", "path").alias("rule"), "host", "path", "verdict")
    shape = ruled.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.regexp_count("path", F.lit("/"))).alias("depth")
    ).first()
    entries = ruled.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("key_verdict"))
    named = listed.select(listed_key(F.col("url")).alias("key")).where("key IS NOT NULL").distinct()
    entries = entries.unionByName(named.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("key_verdict")))
    entries = stored(entries, "listed-keys")
    blocks = filter_blocks(entries.count())
    held = stored(blocked_filter(entries, "key", blocks), "url-filter")
    keyed = urls.select("url", F.explode(url_keys(F.col("url"), shape["labels"] or 0, shape["depth"] or 0)).alias("key"))
    hits = stored(possible(keyed, "key", held, blocks), "possible-urls")
    exact = join_unique(hits, entries, ["key"], F.xxhash64("url")).where("key_verdict IS NOT NULL")
    order = F.struct(F.col("rule").isNotNull().alias("ruled"), F.length("rule").alias("long"), "rule", "key_verdict")
    best = exact.groupBy("url").agg(F.max(order).alias("best"))
    return best.select("url", F.col("best.rule").alias("rule"), F.col("best.key_verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages`` (``page_id, url``); see ``judged_urls``.

    A null url, or one without ``://``, has an empty host and path and is allowed. Repeated
    rows stay, null ids are ids like others, columns beside the two are neither read nor
    returned; an empty table gives no rows, an empty list of rules or URLs blocks nothing.
    Each distinct URL is judged once, so copies of one cost a row of the last join each;
    verdicts on URLs that hold many rows are broadcast, fewer than a thousand.
    """
    pages = pages.select("page_id", "url")
    counts = stored(pages.where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("rows")), "distinct-urls")
    told = stored(judged_urls(counts, rules, listed), "judged-urls")
    judged = join_unique(pages, told, ["url"], F.xxhash64("page_id"), heavy_keys(counts, ["url"], "rows"))
    verdict = F.coalesce("verdict", F.lit("allow")).alias("verdict")
    return judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", verdict)


def mirrors(pages: DataFrame) -> DataFrame:
    """``url`` of the rows of ``pages`` (``page_id, url, html``) that repeat another one's html under another canonical URL.

    Of rows with equal html of at least ``MIRROR_BYTES`` bytes the one with the smallest id
    (null last), then the smallest canonical URL, is the original.
    """
    plain = pages.where(F.octet_length("html") >= MIRROR_BYTES)
    plain = plain.select(F.col("page_id").alias("id"), "url", canonical(F.col("url")).alias("name"), F.sha2("html", 256).alias("digest"))
    named = plain.where("name IS NOT NULL").groupBy("digest", "name").agg(F.min(F.struct(F.isnull("id"), "id", "url")).alias("least"))
    named = stored(named, "page-payloads")
    first = named.groupBy("digest").agg(F.min(F.struct("least", "name")).alias("first"), F.count(F.lit(1)).alias("names")).where("names > 1")
    copies = join_unique(named, first.select("digest", "first"), ["digest"], F.xxhash64("name")).where("first IS NOT NULL")
    return copies.where("name <> first.name").select(F.col("least.url").alias("url"))


#: Rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules above; the list has the URLs of mirrored pages."""
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules, mirrors(pages))


_URL = r"""
parsed AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^?#]*\?([^#]*)', 1), '') AS query
  FROM pages
), told AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)'))) AS params
  FROM parsed
), named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS name
  FROM told
)"""

OP12_SQL = f"""
WITH {_URL}, payloads AS (
  SELECT sha256(html) AS digest, name, min(coalesce(page_id, 9223372036854775807)) AS least
  FROM named WHERE octet_length(encode(html)) >= {MIRROR_BYTES} AND name IS NOT NULL GROUP BY ALL
), copies AS (
  SELECT name, row_number() OVER (PARTITION BY digest ORDER BY least, name) AS place FROM payloads
), listed AS (SELECT DISTINCT name FROM copies WHERE place > 1
), rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), urls AS (SELECT DISTINCT host, path FROM named
), fitting AS (
  SELECT u.host, u.path, max_by({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS best
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL
)
SELECT n.page_id, n.host, n.path, f.best.rule AS rule,
  coalesce(f.best.verdict, CASE WHEN l.name IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM named n LEFT JOIN fitting f ON n.host = f.host AND n.path = f.path LEFT JOIN listed l ON n.name = l.name
"""
