"""URL rules by a blocked Bloom filter and an exact hash join; DataFrame functions only.

The list holds canonical URL keys, host then path.  A url asks for every key that could fit it: each suffix of its host
on label borders, followed by each beginning of its path that has the length of a listed path.  The Bloom filter drops
the keys that cannot be in the list before anything is joined or shuffled; the exact hash join with the list removes what
the filter let through by mistake.  The filter is an array of 64-bit blocks: a key's hash names one block and ``PROBES``
bits of it, so a test reads one word, however long the list is.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; of rules with equal keys
the smallest verdict counts; a rule with a null host is no rule, a null path counts as empty; an empty list gives
every url the default verdict; repeated rows are judged each; other columns of the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits set for a key in its block.
PROBES = 4
#: Keys a block is meant for, and the most blocks a filter has (8 bytes each): beyond, it lets more keys through to
#: the exact join, which stays right.
KEYS_PER_BLOCK, MAX_BLOCKS = 4, 1 << 20
#: The exact join broadcasts the list up to this many rules.
BROADCAST_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def key_bits(key: Column) -> Column:
    """The key's bits in its block, taken from a second hash, 6 bits a probe."""
    mixed = F.xxhash64(key, F.lit("bits"))
    bits = F.lit(0).cast("long")
    for probe in range(PROBES):
        place = F.shiftrightunsigned(mixed, 6 * probe).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return bits


def prepare_rules(rules: DataFrame) -> DataFrame:
    """``rule`` (canonical key: lower-case host, then path), ``rule_host_length``, ``rule_path_length``,
    ``rule_verdict``; one row per key."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce(F.col("path"), F.lit(""))
    return (rules.where(F.col("host").isNotNull())
            .groupBy(F.concat(host, path).alias("rule"), F.length(host).alias("rule_host_length"),
                     F.length(path).alias("rule_path_length"))
            .agg(F.min("verdict").alias("rule_verdict")))


def bloom_filter(prepared: DataFrame, blocks: int) -> DataFrame:
    """One row: ``bloom``, the filter's blocks by number, and ``lengths``, the listed path lengths.  At most
    ``MAX_BLOCKS`` words."""
    key, n = F.col("rule"), F.lit(blocks)
    empty = prepared.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"),
                                                       F.lit(0).cast("long").alias("bits"))
    filled = (prepared.select(key_block(key, n).alias("block"), key_bits(key).alias("bits")).unionByName(empty)
              .groupBy("block").agg(F.bit_or("bits").alias("bits")))
    words = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "bits"))), lambda w: w["bits"])
                       .alias("bloom"))
    lengths = prepared.agg(F.array_sort(F.collect_set("rule_path_length")).alias("lengths"))
    return words.select("bloom", lengths.scalar().alias("lengths"))


def possible_hits(pages: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """``pages`` with ``rule, rule_host_length``: a row for each key of its url that passes the filter, and one without
    a key."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.col("lengths"), lambda n: n <= F.length("path")),
                         lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(F.filter("suffixes", lambda h: F.length(h) > 0),
                                 lambda h: F.transform(F.col("starts"), lambda p: F.struct(
                                     F.concat(h, p).alias("rule"), F.length(h).alias("rule_host_length")))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("rule_host_length")))
    asked = (pages.withColumn("lengths", F.coalesce(bloom.select("lengths").scalar(), F.array().cast("array<int>")))
             .withColumn("suffixes", suffixes).withColumn("starts", starts)
             .select(*pages.columns, F.explode(F.concat(none, keys)).alias("key"))
             .select(*pages.columns, "key.rule", "key.rule_host_length"))
    # the filter stands in the condition itself: as a column it would be copied into every row
    bits = key_bits(F.col("rule"))
    word = F.get(bloom.select("bloom").scalar(), key_block(F.col("rule"), F.lit(blocks)))
    return asked.where(F.col("rule").isNull() | (word.bitwiseAND(bits) == bits))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (page_id, url).

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains if the url's path starts with its
    path.  The longest key wins, of equally long ones that with the longer host; no rule: ``default``.
    """
    prepared = prepare_rules(rules)
    count = prepared.count()
    blocks = max(1, min(MAX_BLOCKS, -(-count // KEYS_PER_BLOCK)))
    urls = pages.select(F.col("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
                        F.monotonically_increasing_id().alias("row"))
    listed = F.broadcast(prepared) if count <= BROADCAST_RULES else prepared
    asked = possible_hits(urls, bloom_filter(prepared, blocks), blocks)
    fitted = asked.join(listed, ["rule", "rule_host_length"], "left")
    order = F.when(F.col("rule_verdict").isNotNull(),
                   F.struct(F.length("rule").alias("n"), F.col("rule_host_length").alias("h"),
                            F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = fitted.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"),
                                     F.first("path").alias("path"), F.max(order).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (host, path, verdict) as a table of literals."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                     for h, p, v in rules]) if rules else F.array().cast(
                         "array<struct<host:string,path:string,verdict:string>>")
    return spark.range(1).select(F.inline(rows))
