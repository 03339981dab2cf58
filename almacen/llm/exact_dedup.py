"""1. Exact dedup by deterministic block naming (native: SQL functions only).

A normalised text is cut into blocks of ``block_chars`` code points. The
distinct blocks are sorted and get integer names; then adjacent names are
paired, the distinct pairs are sorted and named in turn, and so on until each
text is one integer. Two texts of the same number of blocks are equal exactly
when their last names are equal, whatever the hash values are: hashes only
route rows, and blocks that share one are told apart by their text.

Text crosses the network once, as the distinct blocks of each task; all else
that moves is integers.

Defined cases: a null text counts as empty, an empty text has no block and
equals every other empty text; a null ``doc_id`` is a value of its own, kept
only if its whole group has none; rows repeating both ``doc_id`` and text are
one document listed twice and share one verdict; an empty table gives an
empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

BLOCK_CHARS = 4096
NO_PARTNER = -1


def _names(distinct: DataFrame, order: list[str], what: str) -> DataFrame:
    """Sort the distinct keys of each partition and number them. The written
    table fixes the numbers, so no later recomputation can change a name."""
    return staged(distinct.sortWithinPartitions(*order)
                  .withColumn("name", F.monotonically_increasing_id()), f"names-{what}")


def _block_names(blocks: DataFrame) -> DataFrame:
    """``(h, block, name)``: one row per distinct block. ``block`` is null where the
    hash ``h`` belongs to one block only, which is then known by ``h`` alone."""
    by_hash = (blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
               .sortWithinPartitions("lo")
               .select("h", F.monotonically_increasing_id().alias("name"),
                       (F.col("lo") != F.col("hi")).alias("shared")))
    return staged(by_hash, "names-block")


def block_table(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.sha2("text", 256).alias("text_sha256"),
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)).alias("blocks"))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: ``doc_id, text_sha256, n_blocks, name``."""
    cut = block_table(docs, block_chars)
    sig = staged(cut.select("doc_id", "text_sha256", F.size("blocks").alias("n_blocks"),
                            F.transform("blocks", lambda b: F.xxhash64(b)).alias("hs")), "doc-blocks")
    names = _block_names(cut.select(F.explode("blocks").alias("block"))
                         .select(F.xxhash64("block").alias("h"), "block"))
    occ = sig.select("doc_id", "text_sha256", "n_blocks", F.posexplode("hs").alias("pos", "h"))
    named = occ.join(names.filter("not shared").select("h", "name"), "h")
    shared = names.filter("shared").select("h")
    if not shared.isEmpty():
        # Different blocks with one hash: name these by their text, above all other names.
        base = names.agg(F.max("name")).first()[0] + 1
        texts = (cut.select("doc_id", "text_sha256", F.size("blocks").alias("n_blocks"),
                            F.posexplode("blocks").alias("pos", "block"))
                 .withColumn("h", F.xxhash64("block")).join(shared, "h", "left_semi"))
        own = _names(texts.select("h", "block").distinct(), ["h", "block"], "shared")
        named = named.unionByName(texts.join(own, ["h", "block"])
                                  .withColumn("name", F.col("name") + base).drop("block"))
    level = staged(named.select("doc_id", "text_sha256", "n_blocks", "pos", "name").distinct(), "level")
    done = [level.filter("n_blocks = 1").drop("pos")]
    width = 1
    longest = sig.agg(F.max("n_blocks")).first()[0] or 0
    while width < longest:
        pairs = (level.filter(F.col("n_blocks") > width)
                 .groupBy("doc_id", "text_sha256", "n_blocks", F.expr("pos div 2").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))),
                                 F.lit(NO_PARTNER)).alias("b")))
        pairs = staged(pairs, "pairs")
        names = _names(pairs.select("a", "b").distinct(), ["a", "b"], "pair")
        level = staged(pairs.join(names, ["a", "b"]).drop("a", "b"), "level")
        width *= 2
        done.append(level.filter((F.col("n_blocks") <= width) & (F.col("n_blocks") > width // 2)).drop("pos"))
    ids = done[0]
    for d in done[1:]:
        ids = ids.unionByName(d)
    i = ids.select(F.col("doc_id").alias("i_doc"), F.col("text_sha256").alias("i_sha"), "name")
    rows = sig.drop("hs")
    return (rows.join(i, rows.doc_id.eqNullSafe(i.i_doc) & (rows.text_sha256 == i.i_sha), "left")
            .select("doc_id", "text_sha256", "n_blocks", F.coalesce("name", F.lit(0)).alias("name")))


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``."""
    ids = staged(identities(docs, block_chars), "identities")
    # Written, so that the join reads plain rows on both sides and can split a large group of copies.
    groups = staged(ids.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"),
                                                        F.count(F.lit(1)).alias("group_size")), "groups")
    return (ids.join(groups, ["n_blocks", "name"])
            .select("doc_id", "keep_id", "group_size",
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
