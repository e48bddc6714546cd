"""I-Match fingerprints, with DataFrame functions only.

A text's terms are kept if their inverse document frequency lies in a band, neither
everywhere nor nearly unique.  The lexicon of kept terms is dealt at random into many
small subsets; per subset the distinct terms of a text are sorted and hashed.  Texts that
share most of their terms agree in many of these hashes, and equal texts in all.

At most (mean distinct terms per text) / ``low`` terms can be in the band, whatever the
corpus' size, so the lexicon has a bound and is broadcast; terms then meet it without a
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellpath.llm.common import ascii_lower, documents
from dwellpath.session import cut_lineage

# Document frequency band, as shares of all documents.
LOW, HIGH = 0.0005, 0.02
# Subsets of the lexicon: so many with each share of its terms.
SHARES = {8: 8, 32: 8, 128: 8}

_SPLIT = r"[\s\p{Punct}]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SPLIT, -1)), "")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, shares: dict[int, int] = SHARES) -> DataFrame:
    """Terms in the band: ``term`` and ``subsets``, a bit per subset that holds the term.

    Document frequencies are counted over all texts and combined before the shuffle.
    """
    counted = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # in a small corpus the band's floor is two documents; such a lexicon is small with it
    band = counted.where((F.col("df") >= max(2, low * total)) & (F.col("df") <= max(2, high * total)))
    bits, bit = F.lit(0).cast("long"), 0
    for share, count in shares.items():
        for _ in range(count):
            chosen = F.pmod(F.xxhash64("term", F.lit(bit)), F.lit(share)) == 0
            bits = bits.bitwiseOR(F.when(chosen, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
            bit += 1
    return band.select("term", bits.alias("subsets")).where(F.col("subsets") != 0)


def fingerprints(texts: DataFrame, words: DataFrame, keys: list[str], shares: dict[int, int] = SHARES) -> DataFrame:
    """``keys`` and ``hashes`` per group of ``keys``: one 32-bit hash per subset, null where no term is in it.

    ``texts`` has one text per group of ``keys``; groups without lexicon terms do not appear.
    """
    count = sum(shares.values())
    kept = texts.select(*keys, F.explode(terms_of(F.col("text"))).alias("term")).join(F.broadcast(words), "term")
    gathered = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("term", "subsets"))).alias("terms"))

    def hashed(k: Column) -> Column:
        mine = F.filter("terms", lambda t: F.getbit(t["subsets"], k) == 1)
        joined = F.array_join(F.transform(mine, lambda t: t["term"]), " ")
        return F.when(joined != "", F.hash(joined))

    return gathered.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), hashed).alias("hashes"))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """Share of the subsets used by either text in which both hashes agree; 1 for equal texts."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    used = F.size(F.filter(pairs, lambda p: p["x"].isNotNull() | p["y"].isNotNull()))
    agree = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    return F.when(same_text, 1.0).when(a.isNull() | b.isNull() | (used == 0), 0.0).otherwise(agree / used)


def following(docs: DataFrame) -> DataFrame:
    """``key`` and ``next_key`` by descending ``doc_id`` (null last); the first follows the last.

    Only ids move.  They are dealt into ranges and numbered inside each; the ends of the
    ranges, one row per partition, are joined up separately.
    """
    falling = [F.desc_nulls_last("doc_id")]
    ids = cut_lineage(docs.select(_key().alias("key"), "doc_id").distinct().repartitionByRange(*falling)
                      .withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy(*falling)
    heads = ids.withColumn("rank", F.row_number().over(inside)).where("rank = 1").select("part", "key")
    ring = Window.orderBy("part")
    around = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("part", F.coalesce(F.lead("key").over(ring), F.first("key").over(around)).alias("after"))
    return cut_lineage(ids.withColumn("next_key", F.lead("key").over(inside)).join(after, "part").select(
        "key", F.coalesce("next_key", "after").alias("next_key")))


def _key() -> Column:
    """The id as text, so that a null id can be joined like any other."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with an edited text: its last third replaced by the start of the next document.

    Columns ``key``, ``doc_id``, ``next_key``, ``text``, ``edited``.  Rows that share an id
    are one document, the one with the greatest text; a null text is empty.
    """
    # both uses of base read the same two columns, so its shuffle is written once
    base = docs.groupBy(_key().alias("key")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    own = base.join(following(docs), "key").withColumn("third", F.floor(F.char_length("text") / 3).cast("int"))
    wanted = own.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), "third")
    heads = base.join(wanted, "key").select(
        F.col("for_key").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("third")).alias("head"))
    return own.join(heads, "key").select("key", F.col("key").try_cast("long").alias("doc_id"), "next_key", "text", F.concat(
        F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("third")), "head").alias("edited"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    A text without any lexicon term has its digest as fingerprint and is like equal texts only.
    """
    words = lexicon(docs)
    pairs = edited_pairs(docs)
    digest = [F.unhex(F.sha2(F.col(name).cast("binary"), 256)) for name in ("text", "edited")]
    both = pairs.select("key", F.inline(F.array(
        F.struct(F.lit(False).alias("changed"), F.col("text").alias("text")),
        F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))))
    prints = fingerprints(both, words, ["key", "changed"]).groupBy("key").agg(
        F.max(F.when(~F.col("changed"), F.col("hashes"))).alias("own"),
        F.max(F.when(F.col("changed"), F.col("hashes"))).alias("other"))
    facts = pairs.select("key", "doc_id", "next_key", F.char_length("text").cast("long").alias("n_chars"),
                         digest[0].alias("sha"), digest[1].alias("edited_sha256"))
    own = cut_lineage(facts.join(prints, "key", "left"))  # read from both sides of the last join
    following_one = own.select(F.col("key").alias("next_key"), F.col("own").alias("next_own"), F.col("sha").alias("next_sha"))
    return own.join(following_one, "next_key").select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), _written("own", "sha").alias("fingerprint"),
        _written("other", "edited_sha256").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other"), F.col("sha") == F.col("edited_sha256")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own"), F.col("sha") == F.col("next_sha")).alias("near_next"))


def _written(hashes: str, digest: str) -> Column:
    """A fingerprint as text: the hash of each subset in hexadecimal, - where no term is in it."""
    each = F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("-")))
    return F.coalesce(F.array_join(each, "."), F.lower(F.hex(digest)))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(documents(spark, sf_dir))
