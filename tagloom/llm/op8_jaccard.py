"""N-gram Jaccard join over a token-group matrix.

A document is the set of its distinct shingles of k words; two documents link
where 100 * intersection >= percent * union. Documents with equal sets are one
class, found by a 128-bit hash of the set, and only classes are compared.

1. A sketch of fixed size counts the words of all documents. A shingle is as
   rare as its rarest word; this and its hash order all shingles.
2. Similar classes are put into groups: each goes with the one of its rarest
   shingles, its prefix, that most other classes have in theirs, and with sets
   of about its size. Groups are split by a hash of the class into groups of
   about GROUP, or of BLOCK_BYTES for long texts.
3. The matrix has a row for each shingle and group: the union of the prefixes
   of the group's members. With t = percent / 100, two sets that link share at
   least min(SHARED, ceil(t * n)) of their first n - ceil(t * n) + SHARED
   shingles. So two groups whose unions share fewer, or whose sizes don't fit,
   cannot hold a link.
4. Members of a group that share enough shingles with others of it are
   compared exactly, all at once, which gives components within the group.
5. Queries: a class asks a group of others, if the union holds enough of its
   prefix. First the hubs of each group's largest component ask the groups that
   theirs may have a link to, which joins a family of copies that fills many
   groups with a question for each pair of groups; then each class asks, but
   not groups that its own component has most of. An opened group's sets travel
   once for each GROUP questions or so. Components of all links found are those
   of all links.

Nothing is dropped or capped: shingles in many groups only cost more. No two
rows of one class are ever paired, and a group has about GROUP members at most,
however many copies there are.

Null and empty texts, and texts without words, have an empty set, no link and
themselves as component; a null doc_id takes part in links, but names no
component unless alone, where it is null. Repeated rows are of one class.
Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NONSPACE, chunks, materialize, mix, prefix_hash, release, shingles, signed, single_threaded, slice_hash, small, spans, table, tidy
from ..operators.graph import connected_components

CELL_BITS = 21
SKETCH_ROWS = 64
GROUP = 512
BLOCK_BYTES = 2 << 20
SHARED = 3
SMALL_ROWS = 200_000


class Forest:
    """Union-find over 0..n-1; union() tells whether it joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, docs = spans(data, bounds, NONSPACE)
    return slice_hash(prefix_hash(data), starts, ends), docs


def word_sketch(docs: DataFrame) -> np.ndarray:
    """For each of 2**CELL_BITS cells of word hashes: the logarithm of its count over all documents, in quarters of a bit, as uint8."""
    per_row = (1 << CELL_BITS) // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                words, _ = _words(data, bounds)
                cells += np.bincount((words >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
        if cells.any():
            rows = cells.reshape(SKETCH_ROWS, per_row).astype("<u4")  # one task has fewer words than 2**32
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_ROWS), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
        logs = [np.round(4 * np.log2(s + 1.0)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(logs, pa.binary())], names=["part", "counts"])

    counted = docs.select("text").mapInArrow(tidy(count), "part int, counts binary").repartition(SKETCH_ROWS, "part").mapInArrow(tidy(add), "part int, counts binary")
    out = np.zeros((SKETCH_ROWS, per_row), np.uint8)
    for row in counted.toLocalIterator():  # SKETCH_ROWS rows of fixed size
        out[row["part"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(-1)


def sets(data: np.ndarray, bounds: np.ndarray, k: int, sketch: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles; within a document rarest first, or by hash if there is no sketch."""
    words, docs = _words(data, bounds)
    h, d, at = shingles(words, docs, k)
    order = d.astype(np.int64) << 8
    if sketch is not None and len(words):
        rarity = sketch[(words >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        least = rarity[at]
        for j in range(1, k):
            after = np.minimum(at + j, len(words) - 1)
            least = np.where(docs[after] == d, np.minimum(least, rarity[after]), least)
        order |= least
    sort = np.lexsort((h, order))
    h, d = h[sort], d[sort]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[keep], d[keep]


def nodes(h: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets only."""
    a = np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), begin)
    b = np.add.reduceat(mix(h ^ np.uint64(0xE7037ED1A0B428DB)), begin)
    raw = np.c_[a, b].astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def profiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash (xxhash64), n, node, prefix of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(word_sketch(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in chunks(batch.column(2)):
                h, d = sets(data, bounds, k, sent.value)
                n = np.bincount(d, minlength=last - first)
                some = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[some]
                node: list[bytes | None] = [None] * (last - first)
                ends = np.zeros(last - first + 1, np.int64)
                if len(some):
                    names = nodes(h, begin)
                    take = np.minimum(n, n - -(-n * percent // 100) + SHARED)
                    rank = np.arange(len(h)) - (np.cumsum(n) - n)[d]
                    h = h[rank < take[d]]
                    ends = np.r_[0, np.cumsum(np.where(n > 0, take, 0))]
                    for i, x in zip(some.tolist(), names, strict=True):
                        node[i] = x
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, last - first) for c in (0, 1)), pa.array(n.astype(np.int64)), pa.array(node, pa.binary()), prefix], names=["doc_id", "text_hash", "n", "node", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, n long, node binary, prefix array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, node, members (the sorted hashes as bytes) of each row whose set isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in chunks(batch.column(1)):
                h, d = sets(data, bounds, k, None)
                if not len(h):
                    continue
                n = np.bincount(d, minlength=last - first)
                some = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[some]
                raw = h.astype("<u8").tobytes()
                members = [raw[8 * b : 8 * (b + m)] for b, m in zip(begin.tolist(), n[some].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some + first)), pa.array(nodes(h, begin), pa.binary()), pa.array(members, pa.binary())], names=["doc_id", "node", "members"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, node binary, members binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of left shares with each of right."""
    single_threaded()
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24 common hashes

    def dense(side: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        m = np.zeros((len(side), len(part)), np.float32)
        for i, s in enumerate(side):
            at = np.searchsorted(part, s)
            at = at[(at < len(part))]
            own = s[: len(at)]
            m[i, at[part[at] == own]] = 1
        return m

    for c in range(0, len(common), 2_048):
        part = common[c : c + 2_048]
        low, high = part[0], part[-1]
        cut = lambda side: [s[np.searchsorted(s, low) : np.searchsorted(s, high, "right")] for s in side]  # noqa: B023, E731
        out += dense(cut(left), part) @ dense(cut(right), part).T
    return out.astype(np.int32)


def _stars(left: list[bytes], link: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each component of the links within a block: its member with most links, beside each other member."""
    forest, degree = Forest(len(left)), link.sum(1)
    for i in range(len(left)):
        for j in (np.flatnonzero(link[i, i + 1 :]) + i + 1).tolist():
            forest.union(i, j)
    hubs: dict[int, int] = {}
    for i in range(len(left)):
        root = forest.find(i)
        if root not in hubs or degree[i] > degree[hubs[root]]:
            hubs[root] = i
    pairs = [(left[hubs[forest.find(i)]], left[i]) for i in range(len(left)) if hubs[forest.find(i)] != i]
    return [a for a, _ in pairs], [b for _, b in pairs]


def compare(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs: left and right, arrays of (node, members). a, b that join what links join: of left and right, or, where right is null, within left as a star for each component."""

    def unpack(group: list[dict]) -> tuple[list[bytes], list[np.ndarray]]:
        seen = {x["node"]: x["members"] for x in sorted(group, key=lambda x: x["node"])}
        return list(seen), [np.frombuffer(x, "<u8") for x in seen.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for row in range(batch.num_rows):
                left, x = unpack(batch.column(0)[row].as_py())
                within = batch.column(1)[row].as_py() is None
                right, y = (left, x) if within else unpack(batch.column(1)[row].as_py())
                both = intersections(x, y)
                size = np.array([len(s) for s in x], np.int32)[:, None] + np.array([len(s) for s in y], np.int32)[None, :]
                link = 100 * both >= percent * (size - both)
                if within:
                    a, b = _stars(left, link)
                    out_a += a
                    out_b += b
                    continue
                forest = Forest(len(left) + len(right))
                for i in range(len(left)):
                    for j in np.flatnonzero(link[i]).tolist():
                        if forest.union(i, len(left) + j) and left[i] != right[j]:
                            out_a.append(left[i])
                            out_b.append(right[j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return pairs.select("left", "right").mapInArrow(tidy(run), "a binary, b binary")


def sets_of(docs: DataFrame, wanted: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """A table of node, members of the wanted nodes; only the texts of their first rows are read as sets."""
    wanted = wanted.join(classes.select("node", "first_id"), "node")
    few = small(wanted.select(F.col("node").alias("_node"), F.col("first_id").alias("_first")), SMALL_ROWS)
    texts = docs.select("doc_id", "text").join(few.select("_first").distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    found = full_sets(texts, k).join(few, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return materialize(found.groupBy("node").agg(F.first("members").alias("members")))


def _need(n: Column | str, t: float) -> Column:
    """How many of a set's prefix a set that links with it holds in its own prefix at least."""
    n = F.col(n) if isinstance(n, str) else n
    return F.least(F.lit(SHARED), F.ceil(n * F.lit(t)).cast("int"))


def _need_among(n: str, low: str, high: str, percent: int) -> Column:
    """How many shingles of its prefix a set of n has to share with the prefix of a set of low to high, if they link.

    Of two sets, all common shingles of the prefix that ends first in the order of shingles are in the other's prefix. So at least
    (intersection that a link takes) - (shingles behind the longer set's prefix) are common to both prefixes. This is least where
    the sizes differ most; rounding may move it by one at the upper end."""
    size, t = F.col(n).cast("long"), percent / 100
    takes = lambda m: F.floor((percent * (size + m) + (99 + percent)) / (100 + percent))
    behind = lambda m: F.greatest(F.lit(0).cast("long"), F.floor((percent * m + 99) / 100) - SHARED)
    smaller, larger = F.greatest(F.col(low).cast("long"), F.floor(size * t)), F.least(F.col(high).cast("long"), F.ceil(size / t))
    exact = F.least(*[takes(m) - behind(F.greatest(size, m)) - slack for m, slack in ((smaller, 0), (larger, 1))])
    return F.greatest(_need(n, t), exact.cast("int"))


def _most(n: str) -> Column:
    """How many sets of n shingles are handled at once."""
    return F.greatest(F.lit(16), F.least(F.lit(GROUP), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col(n))))).cast("long")


def ask(docs: DataFrame, questions: DataFrame, cells: DataFrame, matrix: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """questions: node and other, a group that it isn't in. A table of links between nodes and members of these groups.

    A question is dropped where the group's union holds too few of the node's prefix; of the group only members that hold enough of
    the shingles asked for answer. The answering sets of a group travel once for each part of its questions."""
    t = percent / 100
    fits = (F.col("high") >= F.floor(F.col("n") * t)) & (F.col("n") >= F.floor(F.col("low") * t))
    enough = F.col("c") >= _need("n", t)
    own = cells.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    sizes = matrix.groupBy("g").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumnRenamed("g", "other")
    able = questions.join(own, "node").join(sizes, "other").where(fits & (F.col("c") >= _need_among("n", "low", "high", percent))).select("node", "other")
    asking = cells.select("token", "node", "n").join(able, "node")
    bounded = asking.join(matrix.select("token", F.col("g").alias("other"), "low", "high"), ["token", "other"]).where(fits)
    hits = materialize(bounded.select("node", "n", "other", "token", _need_among("n", "low", "high", percent).alias("need")))
    asks = materialize(hits.groupBy("node", "other").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.min("need").alias("need")).where("c >= need").select("node", "other", "n"))
    tokens = hits.join(asks.select("node", "other"), ["node", "other"]).select(F.col("other").alias("g"), "token").distinct()
    answers = materialize(cells.join(tokens, ["g", "token"]).groupBy("node", "g").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(enough).select("node", F.col("g").alias("other")))
    release(hits)
    members = sets_of(docs, asks.select("node").union(answers.select("node")).distinct(), classes, k)
    parts = asks.groupBy("other").agg(F.count("*").alias("c"), F.max("n").alias("n")).select("other", F.ceil(F.col("c") / _most("n")).cast("long").alias("parts"))
    left = asks.join(parts, "other").select("node", "other", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    right = answers.join(parts, "other").select("node", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left, right = (side.join(members, "node").groupBy("other", "part").agg(F.collect_list(F.struct("node", "members")).alias(name)) for side, name in ((left, "left"), (right, "right")))
    found = materialize(compare(left.join(right, ["other", "part"]), percent))
    release(asks, answers, members)
    return found


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, node (the class; null if empty), root (the class that stands for the component), component_id of every row of docs."""
    t = percent / 100
    profiled = materialize(profiles(docs, k, percent))
    rows = materialize(profiled.drop("prefix"))
    some = rows.where("node IS NOT NULL")
    classes = some.groupBy("node").agg(F.min("doc_id").alias("named"), F.min(F.struct("doc_id")).alias("first")).select("node", "named", F.col("first.doc_id").alias("first_id"))
    of_class = profiled.where("node IS NOT NULL").groupBy("node").agg(F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))  # the same in all rows of a class
    exploded = of_class.select(F.explode("prefix").alias("token"), "node", "n").repartition("token")
    # Both sides of this join read all columns of exploded, so they share one exchange.
    carriers = exploded.groupBy("token").agg(F.countDistinct("node").alias("df"), F.min("n").alias("least"), F.max("n").alias("most"))
    carriers = carriers.where((F.col("df") > 2) | (F.col("df") == 2) & (F.col("least") >= F.floor(F.col("most") * F.lit(t))))
    shared = materialize(exploded.join(carriers.select("token", "df"), "token"))
    release(profiled)

    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(t) if t < 1 else F.col("n")).cast("long")
    leaders = shared.groupBy("node").agg(F.max(F.struct("df", "token")).alias("m"), F.first("n").alias("n")).select("node", "n", F.xxhash64("m.token", band).alias("leader"))
    sizes = leaders.groupBy("leader").agg(F.count("*").alias("size"), F.max("n").alias("n")).select("leader", F.ceil(F.col("size") / _most("n")).cast("long").alias("parts"))
    salt = F.pmod(F.xxhash64("node"), F.col("parts"))
    grouped = leaders.select("node", "leader").join(small(sizes, SMALL_ROWS), "leader").select("node", F.xxhash64("leader", salt).alias("g"))
    cells = materialize(shared.select("token", "node", "n").join(grouped, "node"))
    release(shared)
    members = cells.select("node", "g").distinct()

    # The matrix: a row for each shingle and group.
    matrix = materialize(cells.groupBy("token", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("carriers")))
    x, y = (matrix.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("g", "low", "high")]) for i in (1, 2))
    both_fit = (F.col("high2") >= F.floor(F.col("low1") * t)) & (F.col("high1") >= F.floor(F.col("low2") * t))
    opened = x.join(y, "token").where((F.col("g1") < F.col("g2")) & both_fit).groupBy("g1", "g2").agg(F.count("*").alias("c"), F.min(_need(F.least("low1", "low2"), t)).alias("need")).where("c >= need").select("g1", "g2")
    opened = materialize(opened)

    # Within each group: members that share enough shingles with others of it.
    with_others = cells.join(matrix.where("carriers > 1").select("token", "g", "low", "high"), ["token", "g"])
    own = with_others.groupBy("node", "g").agg(F.count("*").alias("c"), F.min(_need_among("n", "low", "high", percent)).alias("need")).where("c >= need").select("node", "g")
    own = materialize(own)
    of_own = sets_of(docs, own.select("node"), classes, k)
    block = F.collect_list(F.struct("node", "members"))
    blocks = own.join(of_own, "node").groupBy("g").agg(block.alias("left")).where(F.size("left") > 1)
    nothing = F.lit(None).cast(blocks.schema["left"].dataType)
    stars = materialize(compare(blocks.withColumn("right", nothing), percent))

    # Between groups, first the hubs of each group's largest component ask.
    outside = matrix.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    wide = materialize(cells.join(outside, "token", "left_semi"))  # only these can be held by another group
    local = materialize(members.join(stars.select(F.col("b").alias("node"), F.col("a").alias("hub")), "node", "left").select("node", "g", F.coalesce("hub", "node").alias("hub")))
    release(of_own, own)
    largest = local.groupBy("g", "hub").agg(F.count("*").alias("c")).where("c > 1").groupBy("g").agg(F.max(F.struct("c", "hub")).alias("m")).select("g", F.col("m.hub").alias("node"))
    ways = opened.select(F.col("g1").alias("g"), F.col("g2").alias("other")).union(opened.select("g2", "g1"))
    bridges = ask(docs, largest.join(ways, "g").select("node", "other"), wide, matrix, classes, k, percent)
    joined = connected_components(stars.union(bridges))
    labelled = materialize(local.select("node", "g").join(joined, "node", "left").select("node", "g", F.coalesce("component", "node").alias("component")))
    release(local)

    # Then each member asks the groups that it may have a link to, but for those that its own component has most of.
    per_group = labelled.groupBy("g", "component").agg(F.count("*").alias("c"))
    mains = per_group.groupBy("g").agg(F.max(F.struct("c", "component")).alias("m")).select("g", F.col("m.component").alias("main"))
    with_main = opened.join(mains.select(F.col("g").alias("g2"), "main"), "g2")
    ways = with_main.select(F.col("g1").alias("g"), F.col("g2").alias("other"), "main").union(with_main.select("g2", "g1", "main"))
    askers = per_group.select("g", "component").join(ways, "g").where(F.col("component") != F.col("main")).select("g", "component", "other")
    found = ask(docs, labelled.join(askers, ["g", "component"]).select("node", "other"), wide, matrix, classes, k, percent)
    release(cells, wide, matrix, labelled, opened)

    # Nodes are known by their least doc_id first, so a component's least node names it.
    key = F.struct(F.col("named").isNull().alias("no_name"), F.col("named").alias("name"), F.col("node").alias("node"))
    keyed = materialize(classes.select("node", key.alias("key")))
    links = stars.union(bridges).union(found)
    ends = links.join(keyed.withColumnsRenamed({"node": "a", "key": "ka"}), "a").join(keyed.withColumnsRenamed({"node": "b", "key": "kb"}), "b")
    component = connected_components(ends.select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    release(stars, bridges, found, keyed)
    of_node = component.select(F.col("node.node").alias("node"), F.col("component.name").alias("_name"), F.col("component.node").alias("_root"))
    out = rows.join(of_node, "node", "left")
    named = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("_least"))
    out = out.join(named, "node", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", F.coalesce("_root", "node").alias("root"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.coalesce("_name", "_least")).alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
