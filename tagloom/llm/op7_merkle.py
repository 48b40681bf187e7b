"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions alone.

Leaves are runs of up to LEAF_WORDS words of a paragraph with the white space
that follows; a paragraph is a line, and its node hashes its leaves' digests. A
section is a run of paragraphs that ends after one whose node is divisible by
SECTION, so an insertion moves the borders near it only; its node hashes its
paragraphs' digests. The root hashes the sections'. All digests are SHA-256, so
equal roots show equal texts. Beside the root a fingerprint names sections,
paragraphs and leaves by 64 bits of their digests.

Two fingerprints are compared branch by branch: only sections that one of them
lacks are entered, and in these only paragraphs that it lacks. Their likeness
is 1 for equal roots, else the leaves in common branches and the leaves common
to the branches that differ, over all leaves of both; leaves that repeat in
differing branches count once. `differing` gives the places of the edits.

The next document comes from an order over (doc_id, hash of the text): the
small table of keys is dealt by ranges and linked within each range, and
ranges are linked over one row each, so no task sees all documents. The text
is shuffled once by key, and half of it once more to the document before.

Null texts count as empty; an empty text has no leaves. Null doc_ids come
first. Rows that repeat both doc_id and text are one document in the order and
all get its result; rows with one doc_id and different texts are separate.
After the last document comes the first, also where it is the only one.
An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

LEAF_WORDS = 8
SECTION = 4


def digests(text: Column) -> Column:
    """The leaves' digests, by paragraph; an empty text has no paragraph."""
    pattern = rf"(?:\S++\s*+){{1,{LEAF_WORDS}}}+|\s++"
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(pattern), F.lit(0)), lambda leaf: F.sha2(leaf, 256)))
    return F.when(F.length(text) > 0, leaves).otherwise(F.array().cast("array<array<string>>"))


def _above(nodes: Column) -> Column:
    """The digest of a node above others."""
    return F.sha2(F.concat_ws(",", nodes), 256)


def sections(nodes: Column) -> Column:
    """Runs of paragraphs as (first, number, digest); borders depend on the paragraphs alone."""
    n = F.size(nodes)
    ends = F.filter(F.transform(nodes, lambda x, i: F.when((F.pmod(F.xxhash64(x), F.lit(SECTION)) == 0) | (i == n - 1), i + 1)), lambda e: e.isNotNull())
    return F.transform(
        F.arrays_zip(ends.alias("e"), F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))).alias("b")),
        lambda z: F.struct(z["b"].alias("first"), (z["e"] - z["b"]).alias("number"), _above(F.slice(nodes, z["b"] + 1, z["e"] - z["b"])).alias("digest")),
    )


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """df with {prefix}root, and as 64-bit names {prefix}leaves (by paragraph), {prefix}paragraphs and {prefix}sections (first paragraph, number of paragraphs, name) of a text column without nulls."""
    columns = df.columns
    df = df.withColumn("_leaves", digests(F.col(text)))
    df = df.withColumn("_paragraphs", F.transform("_leaves", _above))
    df = df.withColumn("_sections", sections(F.col("_paragraphs")))
    return df.select(
        *columns,
        _above(F.col("_sections.digest")).alias(f"{prefix}root"),
        F.transform("_leaves", lambda p: F.transform(p, lambda x: F.xxhash64(x))).alias(f"{prefix}leaves"),
        F.transform("_paragraphs", lambda x: F.xxhash64(x)).alias(f"{prefix}paragraphs"),
        F.transform("_sections", lambda s: F.struct(s["first"].alias("first"), s["number"].alias("number"), F.xxhash64(s["digest"]).alias("name"))).alias(f"{prefix}sections"),
    )


def fingerprint(prefix: str) -> Column:
    """Root, and names of sections (with their number of paragraphs), paragraphs and leaves (a group for each paragraph) as one string."""
    hexes = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.lower(F.hex(x))))
    heads = F.concat_ws(",", F.transform(F.col(f"{prefix}sections"), lambda s: F.concat(F.lower(F.hex(s["name"])), F.lit(":"), s["number"].cast("string"))))
    return F.concat_ws("|", F.col(f"{prefix}root"), heads, hexes(F.col(f"{prefix}paragraphs")), F.concat_ws(";", F.transform(F.col(f"{prefix}leaves"), hexes)))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the likeness of the trees of the two prefixes, found branch by branch."""
    columns = df.columns
    total = lambda nested: F.aggregate(nested, F.lit(0), lambda n, p: n + F.size(p))
    df = df.withColumn("_common", F.array_intersect(F.col(f"{a}sections.name"), F.col(f"{b}sections.name")))
    for side, p in (("_a", a), ("_b", b)):
        entered = F.filter(F.col(f"{p}sections"), lambda s: ~F.array_contains("_common", s["name"]))
        df = df.withColumn(f"{side}s", entered)
        cut = lambda c, side=side, p=p: F.flatten(F.transform(F.col(f"{side}s"), lambda s: F.slice(F.col(f"{p}{c}"), s["first"] + 1, s["number"])))
        df = df.withColumn(f"{side}p", cut("paragraphs")).withColumn(f"{side}l", cut("leaves"))
    df = df.withColumn("_common", F.array_intersect("_ap", "_bp"))
    for side, p in (("_a", a), ("_b", b)):
        rest = F.filter(F.arrays_zip(F.col(f"{side}p").alias("p"), F.col(f"{side}l").alias("l")), lambda z: ~F.array_contains("_common", z["p"]))
        df = df.withColumn(f"{side}r", F.transform(rest, lambda z: z["l"]))
        df = df.withColumn(f"{side}n", total(F.col(f"{p}leaves")) - total(F.col(f"{side}r"))).withColumn(f"{side}r", F.array_distinct(F.flatten(f"{side}r")))
    shared = F.col("_an") + F.col("_bn") + 2 * F.size(F.array_intersect("_ar", "_br"))
    over = F.col("_an") + F.col("_bn") + F.size("_ar") + F.size("_br")
    likeness = F.when(F.col(f"{a}root") == F.col(f"{b}root"), 1.0).otherwise(F.coalesce(F.try_divide(shared.cast("double"), over.cast("double")), F.lit(0.0)))
    return df.select(*columns, likeness.alias(name))


def differing(a: str, b: str) -> Column:
    """Places, from 0, of the paragraphs of a that b doesn't have: where a was edited. Sections that b has are not entered."""
    names, other = F.col(f"{b}sections.name"), F.array_distinct(F.col(f"{b}paragraphs"))
    entered = F.filter(F.col(f"{a}sections"), lambda s: ~F.array_contains(names, s["name"]))
    places = F.flatten(F.transform(entered, lambda s: F.sequence(s["first"], s["first"] + s["number"] - 1)))
    return F.filter(places, lambda i: ~F.array_contains(other, F.get(F.col(f"{a}paragraphs"), i)))


def successors(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row of keys with the row after it in the order of its columns, in columns next_*; after the last, the first."""
    ranged = materialize(keys.distinct().repartitionByRange(*columns).select(F.struct(*columns).alias("row"), F.spark_partition_id().alias("part")))
    firsts = ranged.groupBy("part").agg(F.min("row").alias("first"))
    over = Window.orderBy("part")  # a row for each range
    everything = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(everything)).alias("border"))
    linked = ranged.withColumn("after", F.lead("row").over(Window.partitionBy("part").orderBy("row"))).join(borders, "part")
    after = F.coalesce("after", "border")
    return linked.select("row.*", *[after[c].alias(f"next_{c}") for c in columns])


def with_next(docs: DataFrame) -> DataFrame:
    """key (id and hash of the text), text, n, and of the document after: head, its first n / 2 (rounded down) characters, and its tree.

    Both joins need the same two columns of the documents, so their one exchange serves both; trees are built after it."""
    own = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).select(F.struct("id", F.xxhash64("text").alias("h")).alias("key"), "text")
    links = successors(own.select("key", F.length("text").cast("long").alias("n")), ["key", "n"])
    before = links.select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.col("n").alias("to_n"))
    follower = with_tree(own.join(before, "key"), "text", "next_")
    sent = follower.select(F.col("to").alias("key"), F.expr("substring(text, 1, cast(to_n div 2 as int))").alias("head"), "next_root", "next_leaves", "next_paragraphs", "next_sections").dropDuplicates(["key"])
    return own.join(sent, "key").withColumn("n", F.length("text").cast("long"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_tree(with_next(table(spark, sf_dir, "documents")), "text", "own_")
    edited = pairs.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n - n div 2 as int))"), "head"))
    edited = with_tree(edited, "edited", "edited_")
    edited = with_likeness(with_likeness(edited, "own_", "edited_", "near_edited"), "own_", "next_", "near_next")
    return edited.select(
        F.col("key.id").alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint("own_").alias("fingerprint"),
        fingerprint("edited_").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


