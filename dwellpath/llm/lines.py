"""Line deduplication: lines that many documents share are kept in one document only.

Normalised lines are exploded and hashed; the documents per hash are counted with a
combine before the shuffle, so a line that stands in a third of all documents is no hot
spot.  Which lines a document loses is decided by an equi-join on the hash and a part of the
documents, so one frequent hash meets in many tasks.  Only documents that may lose a line
then meet their lists, and are put together again line by line; the others stay in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.llm.common import BLANKS, ascii_lower, documents, free_name, sieve
from dwellpath.session import cut_lineage

# Tasks that the documents of one line are dealt over.
DEALT = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(text: Column, min_chars: int) -> Column:
    """Per line of ``text`` the hash of its key, or null for a key below ``min_chars`` code points."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line: F.when(
        F.char_length(line) >= min_chars, F.when(
            F.char_length(F.btrim(line, F.lit(BLANKS))) >= min_chars,
            F.unhex(F.md5(line_key(line).cast("binary"))))))


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Lines to drop, as one row per ``doc_id``: ``drop``, the hashes of the lines it loses."""
    # three readers need the lines, and hashing them reads the texts, so it is done once
    held = cut_lineage(docs.select(
        "doc_id", F.explode(F.array_compact(F.array_distinct(line_hashes(F.col("text"), min_chars)))).alias("line")))
    # rows first, which combine before the shuffle; only lines in enough rows are reduced to distinct documents
    often = held.groupBy("line").count().where(F.col("count") >= min_docs).select("line")
    common = cut_lineage(_dealt(held, often).select("doc_id", "line").distinct())
    frequent = (
        common.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("line", "keeper")
    )
    lost = _dealt(common, frequent).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id").agg(F.collect_set("line").alias("drop"))


def _dealt(held: DataFrame, lines: DataFrame) -> DataFrame:
    """``held`` joined to ``lines``, with each line's documents dealt over ``DEALT`` tasks, so that none is hot."""
    parts = lines.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return held.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(DEALT)).cast("int")).join(
        parts.hint("shuffle_hash"), ["line", "_part"])


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``), plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without white space at its ends, A-Z lower-cased.  A key of
    ``min_chars`` code points or more that ``min_docs`` or more ids hold stays only in the
    rows of the largest ``doc_id`` that holds it; there all its lines stay.  A null or empty
    text is one empty line.  Rows that share an id, or have none, are one document; a null
    id is below all others.  Columns of ``docs`` keep their names (clashes rename the
    new ones); the three new columns come last.
    """
    drop = free_name(docs, "_drop")
    lists = cut_lineage(shared_lines(docs.select("doc_id", "text"), min_chars, min_docs)).select(
        F.col("doc_id").alias(loser := free_name(docs, "_lost_by")), F.col("drop").alias(drop))
    # only texts that may lose a line are shuffled, by the same join at every size
    may_lose = sieve(lists.select(F.xxhash64(loser).alias("mark")))(F.xxhash64("doc_id"))
    losing = docs.where(may_lose).join(lists.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(loser)), "left")
    marked = losing.select(*docs.columns, drop).unionByName(
        docs.where(~may_lose).withColumn(drop, F.lit(None).cast(lists.schema[drop].dataType)))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.transform(F.filter(
        F.arrays_zip(lines.alias("line"), line_hashes(F.col("text"), min_chars).alias("hash")),
        lambda row: row["hash"].isNull() | ~F.array_contains(F.col(drop), row["hash"])), lambda row: row["line"]))
    names = [free_name(docs, name) for name in ("n_lines", "n_dropped", "kept_text")]
    left = free_name(docs, "_kept")
    return (
        marked.select(*docs.columns, F.size(lines).cast("long").alias(names[0]), kept.alias(left))
        .select(*docs.columns, names[0], (F.col(names[0]) - F.size(left)).alias(names[1]),
                F.array_join(left, "\n").alias(names[2]))
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
split as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split),
frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
judged as (
  select k.*, f.key is not null and k.doc_id <> f.keeper as dropped from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id
"""
