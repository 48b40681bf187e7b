"""Suffix-array dedup: bytes covered by strings that an earlier document has.

A string of LENGTH bytes that starts in a document with a smaller doc_id is
removed from every later one; strings never cross documents.

1. Documents of equal texts (by SHA-256) are one class. All strings of a class
   start in its least doc_id, so its later copies go as a whole; only one text
   of each class takes part in what follows.
2. Anchors. The byte run of GRAM bytes with the least hash among all in a
   window of LENGTH bytes is the window's anchor; equal windows have equal
   anchors. Successive windows with one anchor form a run. Windows whose anchor
   stands in the same third or so of them also share the SLICES bytes around
   it. Each task packs a record for every run (hashes of its anchor and of its
   slices) and deals them by anchor. A run that shares a slice with another
   document is opened; this only chooses what is sorted, and decides nothing.
3. The bytes of opened runs are fetched and dealt in buckets by anchor. Each
   bucket's bytes are sorted by the grouping suffix array (suffixes.py);
   neighbours that agree in LENGTH bytes are one string, and its least doc_id
   decides.
4. Repeats are gathered for each document, merged and cut out.

Hot anchors, found in a sample of documents, are dealt differently, with the
same result: their records go by slice, of slices that a task has seen in two
documents only two records are sent, and their runs are split over several
buckets, after which what is left of their strings meets once more by hash.

Nothing is capped. Every task holds one share of the anchors, one bucket or
one share of the documents, all sized by bytes.

Null and empty texts, and texts shorter than LENGTH, keep all bytes. A row
with a null doc_id is kept whole and is the source of nothing. Rows with one
doc_id are no sources for each other; rows that repeat text and doc_id have
one result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, materialize, mix, prefix_hash, release, slice_hash, small, table, tidy, utf8
from .suffixes import suffix_array

LENGTH = 50
GRAM = 12
FLUSH_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
SHARE_BYTES = 8 << 20
BUCKET_RUNS = 16_384
SAMPLE_DOCS, SAMPLE_PART, SAMPLE_LEAST = 262_144, 32, 1_024
HOT_RUNS = 64
SPLIT_RUNS = 4_096
SMALL_ROWS = 200_000

#: Classes of windows by the bytes before their anchor; all windows of a class hold the bytes from the class's least to its most.
SLICES = ((0, 9), (10, 19), (20, 29), (30, 38))

RECORD = np.dtype([("key", "<u4"), ("slices", "<u2", (len(SLICES),)), ("start", "<u4"), ("more", "u1")])
OPENED = np.dtype([("id", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("place", "<u4"), ("more", "u1"), ("split", "u1")])
HEAD = np.dtype([("id", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("at", "<u4"), ("split", "u1")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("id", "<i8"), ("crc", "<u4"), ("start", "<u4")])
SPAN = np.dtype([("id", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("length", "<u4")])


def blocks(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cut = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)]).tolist()
    return list(zip(cut, [*cut[1:], len(values)][: len(cut)], strict=True))


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    x = data.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    y = x[:-4] | x[4:] << np.uint64(32)  # 8 bytes
    n = len(data) - GRAM + 1
    return mix(y[:n] * np.uint64(0x9E3779B97F4A7C15) ^ x[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` successive values."""
    out, step = values, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - step :])


def runs(data: np.ndarray, bounds: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor, hash of the anchor) of each run, of windows that start in lo..hi."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(data) < LENGTH:
        return none
    h = grams(data)
    low = np.uint64((1 << 22) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    anchor = (least_of((h & ~low) | place, LENGTH - GRAM + 1) & low).astype(np.int64)
    s = np.arange(len(anchor))
    doc = np.searchsorted(bounds, s, "right") - 1
    ok = s + LENGTH <= bounds[doc + 1]
    if hi is not None:
        ok &= (s >= lo) & (s < hi)
    s, anchor, doc = s[ok], anchor[ok], doc[ok]
    if not len(s):
        return none
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)])
    last = np.r_[first[1:], len(s)] - 1
    return doc[first], s[first], s[last], anchor[first], h[anchor[first]]


def records(data: np.ndarray, bounds: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, RECORDs with starts within the documents) of all runs; slices that no window of the run has are 0."""
    doc, first, last, anchor, h = runs(data, bounds, lo, hi)
    out = np.zeros(len(doc), RECORD)
    if not len(doc):
        return doc, out
    sums = prefix_hash(data)
    least, most = anchor - last, anchor - first  # bytes before the anchor
    for j, (a, b) in enumerate(SLICES):
        at = np.flatnonzero((least <= b) & (most >= a))
        x = slice_hash(sums, anchor[at] - a, anchor[at] - b + LENGTH) >> np.uint64(48)
        out["slices"][at, j] = np.maximum(x, np.uint64(1))
    out["key"] = h & np.uint64(0xFFFFFFFF)
    out["start"] = first - bounds[doc]
    out["more"] = last - first
    return doc, out


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int, int | None]]:
    """(first row, last row, bytes, bounds, offset of the bytes in the document, lo, hi); a very long document comes in overlapping pieces."""
    margin = 2 * LENGTH
    for first, last, data, bounds in chunks(column):
        if len(data) <= PIECE_BYTES:
            yield first, last, data, bounds, 0, 0, None
            continue
        for a in range(0, len(data), PIECE_BYTES):  # one document
            low = max(0, a - margin)
            part = data[low : a + PIECE_BYTES + LENGTH + margin]
            yield first, last, part, np.array([0, len(part)]), low, a - low, a - low + PIECE_BYTES


def identified(docs: DataFrame) -> DataFrame:
    """id, crc, digest and text of the rows that have a string of LENGTH bytes and a doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.crc32("text").alias("crc"), F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    return own.where(f"id IS NOT NULL AND octet_length(text) >= {LENGTH}")


def copies(docs: DataFrame) -> DataFrame:
    """digest and least id of texts that several rows have."""
    return identified(docs).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")


class Heat:
    """Hot anchor keys, in order, and over how many buckets the runs of each are split."""

    def __init__(self, keys: np.ndarray, salts: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.salts = keys[order].astype(np.uint32), salts[order].astype(np.uint64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The number of buckets of each key; 0 if it isn't hot."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.salts[at], np.uint64(0))

    def places(self, keys: np.ndarray, crcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, split): equal anchors have one place, hot ones as many as they have buckets."""
        salts = self.of(keys)
        salt = crcs.astype(np.uint64) % np.maximum(salts, np.uint64(1))
        return (mix(keys.astype(np.uint64) + (salt << np.uint64(32))) >> np.uint64(32)).astype(np.uint32), salts > 0


def heat(texts: DataFrame, n_docs: int) -> Heat:
    """Anchors of at least HOT_RUNS documents in a sample of documents; it steers the dealing only.

    The sample has at most about SAMPLE_DOCS documents, so there are at most that many, times runs a document, over HOT_RUNS keys."""
    share = min(1.0, min(SAMPLE_DOCS, n_docs // SAMPLE_PART + SAMPLE_LEAST) / max(n_docs, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for first, _, data, bounds, _, lo, hi in pieces(batch.column(0)):
                doc, recs = records(data, bounds, lo, hi)
                found.append(np.unique((doc + first).astype(np.uint64) << np.uint64(32) | recs["key"]))
            keys, counts = np.unique(np.concatenate(found) & np.uint64(0xFFFFFFFF), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["key", "n"])

    chosen = F.pmod(F.xxhash64("id", "crc"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = texts.where(chosen).select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_RUNS).toPandas()
    return Heat(found["key"].to_numpy(np.int64), np.ceil(found["n"].to_numpy(float) / share / SPLIT_RUNS))


DEALT = "share long, records binary, ids binary, crcs binary, counts binary"


def deal(texts: DataFrame, shares: int, hot: Heat) -> DataFrame:
    """The records of all runs, packed by share of the anchors; in shares from `shares` on are runs that are known to be opened."""
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def spread(ids: np.ndarray, crcs: np.ndarray, recs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(record, share) of what is sent of the records of hot anchors; the slices other than the one that a share is for are cleared."""
        opened = np.zeros(len(ids), bool)
        kept, shares_, slices = [], [], []
        for j in range(len(SLICES)):
            at = np.flatnonzero(recs["slices"][:, j])
            k = recs["key"][at].astype(np.uint64) << np.uint64(16) | recs["slices"][at, j]
            order = np.lexsort((ids[at], k))
            at, k = at[order], k[order]
            head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[head, len(k)])
            tail = head + size - 1
            several = ids[at[head]] < ids[at[tail]]
            of = np.repeat(several, size)
            opened[at[of]] = True
            send = ~of
            send[head[several]] = send[tail[several]] = True
            kept.append(at[send])
            shares_.append((mix(k[send] + np.uint64(j)) % np.uint64(shares)).astype(np.int64))
            slices.append(np.full(int(send.sum()), j))
        at = np.flatnonzero(opened)
        kept.append(at)
        shares_.append(shares + (ids[at] ^ crcs[at].astype(np.int64)) % shares)
        slices.append(np.full(len(at), -1))
        at, j = np.concatenate(kept), np.concatenate(slices)
        out = recs[at].copy()
        out["slices"] = np.where(np.arange(len(SLICES))[None, :] == j[:, None], out["slices"], 0)
        return at, np.concatenate(shares_), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, crcs, recs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            share = (mix(recs["key"].astype(np.uint64)) % np.uint64(shares)).astype(np.int64)
            is_hot = sent.value.of(recs["key"]) > 0
            if is_hot.any():
                cold, hot_at = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)
                at, hot_share, hot_recs = spread(ids[hot_at], crcs[hot_at], recs[hot_at])
                at = hot_at[at]
                ids, crcs, share = np.r_[ids[cold], ids[at]], np.r_[crcs[cold], crcs[at]], np.r_[share[cold], hot_share]
                recs = np.concatenate([recs[cold], hot_recs])
            order = np.lexsort((crcs, ids, share)) if is_hot.any() else np.argsort(share, kind="stable")
            ids, crcs, recs, share = ids[order], crcs[order], recs[order], share[order]
            edge = np.r_[True, (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]) | (share[1:] != share[:-1])][: len(ids)]
            cut = np.flatnonzero(edge)
            counts = np.diff(np.r_[cut, len(ids)]).astype("<u4")
            of_cut = share[cut]
            rows = []
            for a, b in blocks(of_cut):
                at, to = cut[a], cut[b] if b < len(cut) else len(ids)
                rows.append((int(of_cut[a]), recs[at:to].tobytes(), ids[cut[a:b]].astype("<i8").tobytes(), crcs[cut[a:b]].astype("<u4").tobytes(), counts[a:b].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["share", "records", "ids", "crcs", "counts"])

        for batch in batches:
            ids, crcs = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, last, data, bounds, offset, lo, hi in pieces(batch.column(2)):
                doc, recs = records(data, bounds, lo, hi)
                recs["start"] += np.uint32(offset)
                held.append((ids[first:last].astype(np.int64)[doc], crcs[first:last].astype(np.uint32)[doc], recs))
                size += len(data)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.select("id", "crc", "text").mapInArrow(tidy(run), DEALT)


def _by_document(rows: np.ndarray, doc_shares: int) -> tuple[list[int], list[bytes]]:
    """Rows with id and crc, packed by share of the documents."""
    return _by_share(rows, lambda x: (x["id"] ^ x["crc"].astype(np.int64)) % doc_shares)


def _by_share(rows: np.ndarray, of: Callable[[np.ndarray], np.ndarray]) -> tuple[list[int], list[bytes]]:
    share = of(rows)
    order = np.argsort(share, kind="stable")
    rows, share = rows[order], share[order]
    return [int(share[a]) for a, _ in blocks(share)], [rows[a:b].tobytes() for a, b in blocks(share)]


def resolve(dealt: DataFrame, shares: int, hot: Heat, doc_shares: int) -> DataFrame:
    """doc_share, opened, n: the runs that share a slice with another document."""
    sent = dealt.sparkSession.sparkContext.broadcast(hot)

    def run(table_: pa.Table) -> pa.Table:
        raw = {c: table_.column(c).to_pylist() for c in ("records", "ids", "crcs", "counts")}
        r = np.concatenate([np.frombuffer(x, RECORD) for x in raw["records"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in raw["counts"]]).astype(np.int64)
        ids = np.repeat(np.concatenate([np.frombuffer(x, "<i8") for x in raw["ids"]]), counts)
        crcs = np.repeat(np.concatenate([np.frombuffer(x, "<u4") for x in raw["crcs"]]), counts)
        del raw
        opened = np.full(len(r), table_.column("share")[0].as_py() >= shares)
        if not opened[0]:
            key = r["key"].astype(np.uint64) << np.uint64(16)
            for j in range(len(SLICES)):
                at = np.flatnonzero(r["slices"][:, j])
                if not len(at):
                    continue
                k = key[at] | r["slices"][at, j]
                order = np.argsort(k)
                k, at = k[order], at[order]
                head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                own = ids[at]
                several = np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head)
                opened[at[np.repeat(several, np.diff(np.r_[head, len(k)]))]] = True
        at = np.flatnonzero(opened)
        out = np.zeros(len(at), OPENED)
        out["id"], out["crc"], out["start"], out["more"] = ids[at], crcs[at], r["start"][at], r["more"][at]
        out["place"], out["split"] = sent.value.places(r["key"][at], crcs[at])
        where, blobs = _by_document(out, doc_shares)
        return pa.Table.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary()), pa.array([len(b) // OPENED.itemsize for b in blobs], pa.int64())], names=["doc_share", "opened", "n"])

    return dealt.groupBy("share").applyInArrow(run, "doc_share long, opened binary, n long")


FETCHED = "bucket long, heads binary, sizes binary, bytes binary"


def fetch(opened: DataFrame, texts: DataFrame, doc_shares: int, buckets: int) -> DataFrame:
    """The bytes of opened runs, packed by the bucket where they are sorted, with the places that each has in documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            data, bounds = utf8(left.column("text"))
            where = {key: i for i, key in enumerate(zip(left.column("id").to_pylist(), left.column("crc").to_pylist(), strict=True))}
            o = np.concatenate([np.frombuffer(x, OPENED) for x in right.column("opened").to_pylist()])
            bucket = (o["place"] % np.uint32(buckets)).astype(np.int64)
            order = np.lexsort((o["start"], o["crc"], o["id"], bucket))
            o, bucket = o[order], bucket[order]
            new = np.r_[True, (bucket[1:] != bucket[:-1]) | (o["id"][1:] != o["id"][:-1]) | (o["crc"][1:] != o["crc"][:-1]) | (o["start"][1:] != o["start"][:-1])]
            o, bucket = o[new], bucket[new]
            begin = bounds[[where[key] for key in zip(o["id"].tolist(), o["crc"].tolist(), strict=True)]] + o["start"]
            size = o["more"].astype(np.int64) + LENGTH
            head = np.zeros(len(o), HEAD)
            for c in ("id", "crc", "start", "split"):
                head[c] = o[c]
            raw = memoryview(data)
            starts, ends = begin.tolist(), (begin + size).tolist()
            for a, b in blocks(bucket):
                distinct: dict[bytes, int] = {}
                head["at"][a:b] = [distinct.setdefault(bytes(raw[s:e]), len(distinct)) for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                rows.append((int(bucket[a]), head[a:b].tobytes(), np.array([len(x) for x in distinct], "<u2").tobytes(), b"".join(distinct)))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "heads", "sizes", "bytes"])

    keyed = texts.select("id", "crc", "text", F.pmod(F.col("id").bitwiseXOR(F.col("crc")), F.lit(doc_shares)).alias("doc_share"))
    return keyed.groupBy("doc_share").cogroup(opened.select("doc_share", "opened").groupBy("doc_share")).applyInArrow(run, FETCHED)


SORTED = "doc_share long, spans binary, window_share long, windows binary"


def sort_bucket(rows: pa.Table, doc_shares: int) -> pa.Table:
    """Repeats within a bucket as packed SPANs; and of runs with `split` the strings that are the first of their kind there."""
    distinct: dict[bytes, int] = {}
    heads = []
    for raw_head, raw_size, body in zip(*(rows.column(c).to_pylist() for c in ("heads", "sizes", "bytes")), strict=True):
        ends = np.cumsum(np.frombuffer(raw_size, "<u2").astype(np.int64)).tolist()
        of = np.array([distinct.setdefault(body[a:b], len(distinct)) for a, b in zip([0, *ends], ends)], np.int64)
        head = np.frombuffer(raw_head, HEAD).copy()
        head["at"] = of[head["at"]]
        heads.append(head)
    head = np.concatenate(heads)
    texts = list(distinct)
    low = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(low, head["at"], head["id"])
    size = np.array([len(x) for x in texts])
    begin = np.cumsum(size + 1) - size - 1
    joined = np.zeros(int((size + 1).sum()) + 1, np.uint16)
    body = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    joined[:-1] = body.astype(np.uint16) + 2
    joined[begin + size] = 1
    order = suffix_array(joined)
    owner = np.repeat(np.arange(len(texts)), size + 1)
    is_window = np.zeros(len(joined), bool)
    is_window[:-1] = np.arange(len(joined) - 1) - begin[owner] <= size[owner] - LENGTH
    at = order[is_window[order]]
    same = np.ones(len(at) - 1, bool)
    for k in range(LENGTH):  # windows of one string stand side by side
        live = np.flatnonzero(same)
        if not len(live):
            break
        same[live] = joined[at[live] + k] == joined[at[live + 1] + k]
    cut = np.flatnonzero(np.r_[True, ~same])
    del order
    best = np.zeros(len(joined), np.int64)
    best[at] = np.repeat(np.minimum.reduceat(low[owner[at]], cut), np.diff(np.r_[cut, len(at)]))
    spans: list[tuple] = []
    late = []
    for a in range(0, len(head), 65_536):
        part = head[a : a + 65_536]
        n = size[part["at"]] - LENGTH + 1
        of = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        seen = best[begin[part["at"]][of] + k] < part["id"][of]
        on = np.flatnonzero(seen)
        if len(on):
            first = np.r_[True, (on[1:] != on[:-1] + 1) | (of[on[1:]] != of[on[:-1]])]
            x, y = on[first], on[np.r_[first[1:], True]]
            span = np.zeros(len(x), SPAN)
            span["id"], span["crc"] = part["id"][of[x]], part["crc"][of[x]]
            span["start"], span["length"] = part["start"][of[x]] + k[x], y - x + LENGTH
            spans += zip(*_by_document(span, doc_shares), strict=True)
        rest = np.flatnonzero(~seen & (part["split"] > 0)[of])
        if len(rest):
            window = np.zeros(len(rest), WINDOW)
            for c in ("id", "crc"):
                window[c] = part[c][of[rest]]
            window["start"] = part["start"][of[rest]] + k[rest]
            where = begin[part["at"]][of[rest]] + k[rest]
            raw = memoryview(body)
            hashes = b"".join(hashlib.blake2b(raw[w : w + LENGTH], digest_size=16).digest() for w in where.tolist())
            window["a"], window["b"] = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
            late.append(window)
    windows: list[tuple] = []
    if late:
        windows += zip(*_by_share(np.concatenate(late), lambda x: (x["a"] % np.uint64(doc_shares)).astype(np.int64)), strict=True)
    none, nothing = [None] * len(spans), [None] * len(windows)
    (where, packed), (share, rest) = (zip(*x, strict=True) if x else ((), ()) for x in (spans, windows))
    return pa.Table.from_arrays([pa.array([*where, *nothing], pa.int64()), pa.array([*packed, *nothing], pa.binary()), pa.array([*none, *share], pa.int64()), pa.array([*none, *rest], pa.binary())], names=["doc_share", "spans", "window_share", "windows"])


def gather(found: DataFrame, doc_shares: int) -> DataFrame:
    """id, crc, starts, ends: the merged spans of each document, from what sort_bucket gives."""

    def meet(rows: pa.Table) -> pa.Table:
        """Windows of split anchors that an earlier document has in another bucket."""
        w = np.concatenate([np.frombuffer(b, WINDOW) for b in rows.column("windows").to_pylist()])
        w = w[np.lexsort((w["id"], w["b"], w["a"]))]
        head = np.flatnonzero(np.r_[True, (w["a"][1:] != w["a"][:-1]) | (w["b"][1:] != w["b"][:-1])])
        least = np.repeat(w["id"][head], np.diff(np.r_[head, len(w)]))
        w = w[least < w["id"]]
        span = np.zeros(len(w), SPAN)
        for c in ("id", "crc", "start"):
            span[c] = w[c]
        span["length"] = LENGTH
        where, blobs = _by_document(span, doc_shares)
        return pa.Table.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_share", "spans"])

    def merge(rows: pa.Table) -> pa.Table:
        x = np.concatenate([np.frombuffer(b, SPAN) for b in rows.column("spans").to_pylist()])
        x = x[np.lexsort((x["start"], x["crc"], x["id"]))]
        head = np.r_[True, (x["id"][1:] != x["id"][:-1]) | (x["crc"][1:] != x["crc"][:-1])]
        of = np.cumsum(head) - 1
        wide = np.int64(1) << 33  # ends of one document are below those of the next
        end = np.maximum.accumulate(of * wide + x["start"] + x["length"])
        new = np.flatnonzero(head | np.r_[True, of[1:] * wide + x["start"][1:] > end[:-1]])
        last = np.r_[new[1:] - 1, len(x) - 1]
        doc = np.flatnonzero(head)
        offsets = pa.array(np.r_[np.searchsorted(new, doc), len(new)], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x["start"][new].astype(np.int64), end[last] - of[last] * wide)]
        return pa.Table.from_arrays([pa.array(x["id"][doc]), pa.array(x["crc"][doc].astype(np.int64)), *lists], names=["id", "crc", "starts", "ends"])

    late = found.where("windows IS NOT NULL").select("window_share", "windows").groupBy("window_share").applyInArrow(meet, "doc_share long, spans binary")
    both = found.where("spans IS NOT NULL").select("doc_share", "spans").union(late)
    return both.groupBy("doc_share").applyInArrow(merge, "id long, crc long, starts array<long>, ends array<long>")


def repeats(docs: DataFrame, again: DataFrame) -> DataFrame:
    """id, crc (of the text) and spans, disjoint and in order, that earlier documents have; again is what copies gives. Copies themselves are left out."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_docs, n_bytes = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shares = max(least, -(-n_bytes // SHARE_BYTES))
    classed = identified(docs).join(small(again, SMALL_ROWS), "digest", "left")
    one = classed.where("first IS NULL OR id = first").select("id", "crc", "text")
    hot = heat(one, n_docs)
    opened = materialize(resolve(deal(one, shares, hot), shares, hot, shares))
    total = opened.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_RUNS), min(least, -(-total // 512)))
    named = classed.where("id = first").groupBy("digest").agg(F.first("id").alias("id"), F.first("crc").alias("crc"), F.first("text").alias("text"))
    texts = classed.where("first IS NULL").select("id", "crc", "text").union(named.select("id", "crc", "text"))
    found = materialize(fetch(opened, texts, shares, buckets).groupBy("bucket").applyInArrow(lambda rows: sort_bucket(rows, shares), SORTED))
    release(opened)
    out = materialize(gather(found, shares))
    release(found)
    return out


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs, and starts and ends of the byte spans to remove (null if none). Columns of docs with these two names are replaced."""
    again = materialize(copies(docs))
    spans = repeats(docs, again).select(F.struct("id", "crc").alias("_spans_of"), F.struct("starts", "ends").alias("_spans"))
    own = docs.drop("starts", "ends")
    row = own.select(F.struct(*[F.col(f"`{c}`") for c in own.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text")
    row = row.select("_row", "_id", F.crc32("text").alias("_crc"), F.octet_length("text").cast("long").alias("_n"), F.unhex(F.sha2("text", 256)).alias("digest"))
    found = row.join(small(again, SMALL_ROWS), "digest", "left")
    found = found.join(spans, F.struct(F.col("_id").alias("id"), F.col("_crc").alias("crc")) == F.col("_spans_of"), "left")
    whole = F.col("_id") > F.col("first")
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.col("_spans.starts"))
    ends = F.when(whole, F.array("_n")).otherwise(F.col("_spans.ends"))
    return found.select("_row", starts.alias("starts"), ends.alias("ends")).select("_row.*", "starts", "ends")


def cut_out(raw: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    if not starts:
        return raw
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)], strict=True))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text, starts, ends = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                raw = (text or "").encode()
                kept = cut_out(raw, starts, ends)
                rows.append((len(raw), len(raw) - len(kept), len(starts or ()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_repeats(docs).select("doc_id", "text", "starts", "ends").mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
