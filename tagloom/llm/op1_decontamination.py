"""Benchmark decontamination by a prefix-filtered set join.

Texts become lower-case words; an item's windows are its runs of `window`
consecutive words, or all of its words if it has fewer. A window is the set of
its shingles of SHINGLE words (of all its words if it has fewer).

1. One pass over the documents finds the shingles that any window has, with
   the words around each. Counting them orders all shingles by rarity.
2. A window can only be contained where all of its |S| shingles are, so
   joining |S| - ceil(1 * |S|) + 1 = 1 of them finds every candidate: the
   rarest, its prefix. A window one of whose shingles never occurs drops out.
3. The shingle's offset in the window bounds the place: the window must start
   and end within the document. Then the words themselves are compared.

Documents are read once where they lie; only hits are shuffled. The shingle
hashes that the pass looks up are sent to all tasks in blocks of at most
BLOCK_KEYS, with one pass each; a usual benchmark is one block.

Null texts have no words: such documents have no hits and such items no
windows. Items with a null id play no part; an item_id in several rows has the
windows of all. Repeated documents are each judged. With an empty benchmark
nothing is contaminated. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, chunks, materialize, prefix_hash, shingles, signed, slice_hash, small, spans, table, tidy

WINDOW = 10
SHINGLE = 5
BLOCK_KEYS = 4_000_000
SMALL_ROWS = 200_000


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, docs = spans(data, bounds, ALNUM)
    return data, starts, ends, docs, slice_hash(prefix_hash(data), starts, ends)


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words (joined by a blank), m (their number), k (words of a shingle), keys (hashes of the shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in chunks(batch.column(1)):
                data, starts, ends, docs, hashes = _words(data, bounds)
                raw = data.tobytes()
                rows = []
                for d in np.unique(docs):
                    at = np.flatnonzero(docs == d)
                    words = [raw[s:e].decode() for s, e in zip(starts[at], ends[at], strict=True)]
                    m = min(window, len(words))
                    k = min(shingle, m)
                    keys = signed(mix_k(shingles_of(hashes[at], k), k)).tolist()
                    item = batch.column(0)[first + int(d)].as_py()
                    rows += [(item, " ".join(words[i : i + m]), m, k, keys[i : i + m - k + 1]) for i in range(len(words) - m + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["item_id", "words", "m", "k", "keys"])

    usable = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    return usable.mapInArrow(tidy(run), "item_id string, words string, m int, k int, keys array<long>")


def shingles_of(hashes: np.ndarray, k: int) -> np.ndarray:
    return shingles(hashes, np.zeros(len(hashes), np.int64), k)[0]


def mix_k(hashes: np.ndarray, k: int) -> np.ndarray:
    """Shingles of different lengths have different keys."""
    return hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def occurrences(docs: DataFrame, keys: np.ndarray, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """For each row of docs: uid, doc_id, n_words and hits, an array of (pos, key, from, context) for each shingle among keys."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        kind = pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("from", pa.int32()), ("context", pa.string())])
        for batch in batches:
            for first, last, data, bounds in chunks(batch.column(2)):
                data, starts, ends, docs_, hashes = _words(data, bounds)
                n = last - first
                counts = np.bincount(docs_, minlength=n)
                begin = np.cumsum(counts) - counts
                found: list[list[dict]] = [[] for _ in range(n)]
                raw = None
                for k in sizes:
                    h, d, at = shingles(hashes, docs_, k)
                    ok = counts[d] >= k
                    h, d, at = mix_k(h[ok], k), d[ok], at[ok]
                    near = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                    hit = np.flatnonzero(wanted[near] == h) if len(wanted) else []
                    for i in hit:
                        doc, place = int(d[i]), int(at[i])
                        low = max(int(begin[doc]), place - window + k)
                        high = min(int(begin[doc] + counts[doc]), place + window)
                        raw = raw or data.tobytes()
                        words = b" ".join(raw[s:e] for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)).decode()
                        found[doc].append({"pos": place - int(begin[doc]), "key": int(h[i : i + 1].view(np.int64)[0]), "from": low - int(begin[doc]), "context": words})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(counts.astype(np.int64)), pa.array(found, pa.list_(kind))], names=["uid", "doc_id", "n_words", "hits"]
                )

    schema = f"uid string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, hits array<struct<pos:int,key:long,from:int,context:string>>"
    return docs.select(row_key().alias("uid"), "doc_id", "text").mapInArrow(tidy(run), schema)


def row_key() -> Column:
    """A name for what a row holds, the same wherever and whenever the row is read; rows that repeat doc_id and text share it."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")), F.coalesce(F.octet_length("text"), F.lit(-1)))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """uid (row_key of the row), doc_id, n_words, n_hit, item_ids (sorted)."""
    grams = materialize(windows(items, window))
    index = grams.select("words", "m", F.posexplode("keys").alias("offset", "key")).distinct()
    sizes = sorted(r["k"] for r in grams.select("k").distinct().toLocalIterator())  # at most SHINGLE rows
    n_keys = index.select("key").distinct().count()
    blocks = max(1, -(-n_keys // BLOCK_KEYS))
    passes = []
    for b in range(blocks):
        part = index.select("key").distinct().where(F.pmod("key", F.lit(blocks)) == b)
        keys = part.toPandas()["key"].to_numpy(np.int64)  # at most about BLOCK_KEYS
        passes.append(materialize(occurrences(docs, keys, sizes, window)))
    hits = reduce(DataFrame.unionByName, (p.where(F.size("hits") > 0) for p in passes)).select("uid", "n_words", F.explode("hits").alias("hit")).select("uid", "n_words", "hit.*")
    rarity = hits.groupBy("key").agg(F.count("*").alias("frequency"))
    prefixes = (
        index.join(rarity, "key", "left")
        .groupBy("words", "m")
        .agg(F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "key", "offset")).alias("prefix"))
        .where("prefix.frequency > 0")
        .select("words", "m", "prefix.key", "prefix.offset")
    )
    start = F.col("pos") - F.col("offset")
    placed = (
        hits.join(small(prefixes, SMALL_ROWS), "key")
        .withColumn("start", start)
        .where("start >= 0 AND start + m <= n_words")
        .where(F.array_join(F.slice(F.split("context", " "), F.col("start") - F.col("from") + 1, F.col("m")), " ") == F.col("words"))
        .select("uid", "words", "start", (F.col("start") + F.col("m")).alias("end"))
    )
    owners = grams.select("words", "item_id").distinct()
    found = placed.join(small(owners, SMALL_ROWS), "words").groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")),
    )["n"]
    return passes[0].select("uid", "doc_id", "n_words").join(found.select("uid", covered.alias("n_hit"), "item_ids"), "uid", "left").select(
        "uid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM g), dg AS (
  SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)
), hit AS (SELECT DISTINCT doc_id, m, p, item_id FROM dg JOIN g USING (m, g)), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, m, p FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
