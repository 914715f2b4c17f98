"""Exact deduplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import NO_ID, WS, Scratch, marked

#: Code points of a block. Most documents are one block; a document of n blocks takes log2(n) more rounds.
BLOCK = 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def blocks(text: Column, size: int) -> Column:
    """The text cut into blocks of size code points; none for an empty text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    return F.when(n == 1, F.array(text)).when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    )


def address(block: Column, seed: int) -> list[Column]:
    """128 bits under which a block's name is carried back to its places; used only once shown to be one-to-one."""
    return [F.xxhash64(F.lit(seed), block), F.xxhash64(F.lit(~seed), block)]


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Distinct keys, sorted within their partition, with integer names: partition number and place in it."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, scratch: Scratch, block_size: int = BLOCK, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: row, doc_id, n_chars, sha (of the normalised text), level, name.

    (level, name) is the same for two documents exactly if their normalised texts are equal. Level 0 sorts the distinct
    blocks and numbers them; each later level sorts the distinct pairs of adjacent names (an odd last one pairs with -1)
    and numbers those, until each document has one name. Empty texts have level -1 and name 0.
    Blocks travel once, already made distinct in their map tasks; only names and 128-bit addresses are joined back.
    """
    norm = normalised(F.col(text))
    based = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_chars"), norm.alias("norm"))
    seed = 0
    while True:
        places = F.transform(blocks(F.col("norm"), block_size), lambda b: F.struct(address(b, seed)[0].alias("a"), address(b, seed)[1].alias("b")))
        rows = scratch.save(
            based.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("sha"), places.alias("blocks")), "rows"
        )
        distinct = based.select(F.explode(blocks(F.col("norm"), block_size)).alias("block"))
        distinct = distinct.select(*[c.alias(n) for c, n in zip(address(F.col("block"), seed), "ab")], "block").distinct()
        names = scratch.save(_numbered(distinct, ["block"]).select("a", "b", "name"), "names0")
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            break
        seed += 1  # two blocks share an address: take other addresses

    single = F.size("blocks") == 1
    one = rows.where(single).select("row", F.col("blocks")[0]["a"].alias("a"), F.col("blocks")[0]["b"].alias("b")).join(names, ["a", "b"])
    done = [one.select("row", F.lit(0).alias("level"), "name"), rows.where(F.size("blocks") == 0).select("row", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))]
    many = rows.where(F.size("blocks") > 1).select("row", F.posexplode("blocks")).select("row", "pos", "col.a", "col.b")
    spelled = scratch.save(_sequences(many.join(names, ["a", "b"])), "level0")
    level = 0
    while not spelled.isEmpty():
        level += 1
        n = F.size("names")
        pairs = F.transform(
            F.sequence(F.lit(0), F.ceil(n / F.lit(2)).cast("int") - 1),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
        )
        placed = spelled.select("row", F.posexplode(pairs)).select("row", "pos", "col.a", "col.b")
        names = scratch.save(_numbered(placed.select("a", "b").distinct(), ["a", "b"]), f"names{level}")
        spelled = scratch.save(_sequences(placed.join(names, ["a", "b"])), f"level{level}")
        done.append(spelled.where(F.size("names") == 1).select("row", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        spelled = spelled.where(F.size("names") > 1)
    named = done[0]
    for other in done[1:]:
        named = named.unionByName(other)
    return rows.drop("blocks").join(named, "row")


def _sequences(named: DataFrame) -> DataFrame:
    """Each row's names in order of place: as long as one document has blocks."""
    places = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("row").agg(F.transform(places, lambda p: p["name"]).alias("names"))


def dedup(docs: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; see identities() for what is equal.

    The row with the most code points in its original text stays, then the smallest doc_id; of rows that tie in both
    (repeated rows), one. Null counts as empty; all empty texts are one group. An empty table gives an empty result;
    other columns are ignored. A null doc_id counts as the largest.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = scratch.save(identities(docs, scratch, block_size), "identities")
    scratch.keep("identities")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best")
    # written, so that the join has an exchange on either side and a large group's rows can be split
    groups = scratch.save(rows.groupBy("level", "name").agg(best, F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def unique_documents(docs: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """docs without the rows that dedup() drops, in docs' columns.

    Rows with one doc_id and equal texts are one document here. Only rows that share a hash bucket with a dropped row are
    looked at again.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    found = scratch.save(dedup(docs, block_size).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "kept", "text_sha256"), "found")
    dropped, kept = found.where(~F.col("kept")).select("_id").distinct(), found.where("kept").select("_id", F.col("text_sha256").alias("_sha")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.col("text").alias("_text"))
    again = marked(keyed, dropped, "_id", "left_semi").withColumn("_sha", F.sha2(normalised(F.col("_text")), 256))
    again = again.join(kept, ["_id", "_sha"], "left_semi").dropDuplicates(["_id", "_sha"])
    return marked(keyed, dropped, "_id", "left_anti").select("_row.*").unionByName(again.select("_row.*"))
