"""Scores of texts by a causal self-attention model, beside a word-count base.

The model (attention.py) reads the ids of a public byte-level tokenizer of the
text in lower case (A-Z) and an end. Each text is tokenized once, into a table
of ids in the shared folder. Over all training documents, whole, Spark sums how
often each id occurs, how often each leaf follows each leaf, and what follows
each beginning of a word. The gradients of the attention layers are summed in
ROUNDS rounds over every window of every training document, each in one round;
only the weights that the rounds start from come from about BEGIN windows, in
which each window of each training document has the same chance. What goes to the driver has a fixed size.

The base counts words over all training documents. Words that are hot in a
sample of documents are counted by themselves: each task sends one count for
each, and their counts go to all tasks. For all others each task packs the
(text, word, count) records and deals them by a hash of the word; whoever holds
a word's records has its count and turns them into partial sums of
log10(c + 1) per text, which are dealt by text and added. No vocabulary is ever
gathered in one place; which words are hot changes no result.

Null and empty texts consist of the end. Rows with a null doc_id are not
trained on nor held out, but scored. Rows that repeat doc_id and text each get
the same scores and each count in training. With no training document the
counts are 0 and the model is untrained. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import LOWER, NONSPACE, chunks, materialize, mix, prefix_hash, release, slice_hash, spans, table
from .tokens import batched, encoder

END_ID = 50_257
N_IDS = END_ID + 1  # fits two bytes
ROUNDS, SLICES, AT_ONCE, PART = 8, 64, 128, 1
BEGIN = 60_000
FLUSH_BYTES = 16 << 20
SHARE_BYTES = 32 << 20
SAMPLE_DOCS, SAMPLE_PART, SAMPLE_LEAST, HOT_DOCS = 262_144, 32, 1_024, 64
PAIR = np.dtype([("a", "<u4"), ("b", "<u4"), ("n", "<u2")])
SUM = np.dtype([("text", "<i8"), ("crc", "<u4"), ("known", "<i8"), ("all", "<i8"), ("log", "<f8")])

_LOWER = LOWER.tobytes()


def _lower(raw: bytes) -> str:
    return raw.translate(_LOWER).decode()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(False))


class Hot:
    """Words, by hash and in order, that are counted apart, and their counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray | None = None) -> None:
        self.words, self.counts = words, counts

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word is among the hot ones, and whether it is."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words


def document_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row, word, count): the distinct words of each text of a run of rows."""
    for first, last, data, bounds in chunks(column):
        low = LOWER[data]
        starts, ends, doc = spans(low, bounds, NONSPACE)
        words = slice_hash(prefix_hash(low), starts, ends)
        order = np.argsort(words)
        kind = np.uint16 if len(bounds) <= 1 << 16 else np.int64  # short numbers are sorted by their digits
        order = order[np.argsort(doc.astype(kind)[order], kind="stable")]
        words, doc = words[order], doc[order]
        new = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])][: len(words)])
        yield first, last, doc[new], words[new], np.diff(np.r_[new, len(words)])


def hot_words(docs: DataFrame, n_docs: int) -> Hot:
    """Words of at least HOT_DOCS documents of a sample of at most about SAMPLE_DOCS, with their counts over all training documents.

    So there are at most SAMPLE_DOCS times the words of a document, over HOT_DOCS, of them."""
    share = min(1.0, min(SAMPLE_DOCS, n_docs // SAMPLE_PART + SAMPLE_LEAST) / max(n_docs, 1))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for _, _, _, w, _ in document_words(batch.column(0))]
            words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    chosen = F.pmod(F.xxhash64("text_hash"), F.lit(1 << 20)) < int(share * (1 << 20))
    found = docs.where(chosen).select("text").mapInArrow(kinds, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_DOCS).select("word").toPandas()
    hot = Hot(np.sort(found["word"].to_numpy(np.int64).view(np.uint64)))
    if not len(hot.words):
        return Hot(hot.words, np.zeros(0, np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value.words), np.int64)
        for batch in batches:
            for _, _, _, words, n in document_words(batch.column(0)):
                at, ok = sent.value.places(words)
                total += np.bincount(at[ok], n[ok], len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    rows = docs.where("train").select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(hot.words), np.int64)
    counts[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Hot(hot.words, counts)


def deal(docs: DataFrame, shares: int, hot: Hot) -> DataFrame:
    """docs: text_hash, text, train. Packed records of the words of each document by share of the words; in shares from `shares` on are finished sums of hot words, by share of the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            texts, crcs, train, words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            share = ((words >> np.uint64(40)) % np.uint64(shares)).astype(np.int64)
            order = np.argsort(share, kind="stable")
            texts, crcs, train, words, counts, share = (x[order] for x in (texts, crcs, train, words, counts, share))
            pairs = np.empty(len(words), PAIR)
            pairs["a"], pairs["b"], pairs["n"] = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32), counts
            cut = np.flatnonzero(np.r_[True, (texts[1:] != texts[:-1]) | (crcs[1:] != crcs[:-1]) | (train[1:] != train[:-1]) | (share[1:] != share[:-1])][: len(texts)])
            length = np.diff(np.r_[cut, len(texts)]).astype("<u4")
            edges = np.flatnonzero(np.r_[True, share[cut][1:] != share[cut][:-1], True]) if len(cut) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at, to = cut[a], cut[b] if b < len(cut) else len(texts)
                rows.append((int(share[at]), pairs[at:to].tobytes(), texts[cut[a:b]].astype("<i8").tobytes(), crcs[cut[a:b]].astype("<u4").tobytes(), train[cut[a:b]].astype("u1").tobytes(), length[a:b].tobytes(), None))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=NAMES)

        def finished(texts: np.ndarray, crcs: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            c = sent.value.counts[at]
            out = np.zeros(len(texts), SUM)
            out["text"], out["crc"] = texts, crcs
            out["log"], out["known"], out["all"] = (np.bincount(doc, v, len(texts)) for v in (n * np.log10(c + 1.0), n * (c > 0), n))
            where, blobs = by_text(out[out["all"] > 0], shares)
            none = pa.nulls(len(blobs), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([shares + w for w in where], pa.int64()), *[none] * 5, pa.array(blobs, pa.binary())], names=NAMES)

        for batch in batches:
            texts = batch.column(0).to_numpy(zero_copy_only=False)
            trained = np.array(batch.column(2).to_pylist(), bool)
            column = batch.column(1)
            crcs = np.array([zlib.crc32((t.as_py() or "").encode()) for t in column], np.uint32)
            for first, last, doc, words, counts in document_words(column):
                at, ok = sent.value.places(words)
                if ok.any():
                    yield finished(texts[first:last], crcs[first:last], doc[ok], at[ok], counts[ok])
                doc, words, counts = doc[~ok], words[~ok], counts[~ok]
                while (over := counts > 65_535).any():
                    words, doc = np.r_[words, words[over]], np.r_[doc, doc[over]]
                    counts = np.r_[np.where(over, 65_535, counts), counts[over] - 65_535]
                    order = np.argsort(doc, kind="stable")
                    words, doc, counts = words[order], doc[order], counts[order]
                held.append((texts[first:last][doc], crcs[first:last][doc], trained[first:last][doc], words, counts))
                size += 10 * len(words)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text_hash", "text", "train").mapInArrow(run, ", ".join(f"{c} {'long' if c == 'share' else 'binary'}" for c in NAMES))


NAMES = ["share", "pairs", "texts", "crcs", "train", "lengths", "sums"]


def by_text(sums: np.ndarray, shares: int) -> tuple[list[int], list[bytes]]:
    """SUMs, packed by share of the texts."""
    bucket = (sums["text"] ^ sums["crc"].astype(np.int64)) % shares
    order = np.argsort(bucket, kind="stable")
    sums, bucket = sums[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]).tolist()
    return [int(bucket[a]) for a in cut], [sums[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(sums)][: len(cut)], strict=True)]


def added(x: np.ndarray) -> np.ndarray:
    """One SUM for each text."""
    x = x[np.lexsort((x["crc"], x["text"]))]
    cut = np.flatnonzero(np.r_[True, (x["text"][1:] != x["text"][:-1]) | (x["crc"][1:] != x["crc"][:-1])][: len(x)])
    out = x[cut].copy()
    for c in ("known", "all", "log"):
        out[c] = np.add.reduceat(x[c], cut) if len(cut) else 0
    return out


def word_sums(dealt: DataFrame, shares: int) -> DataFrame:
    """By share of the texts: packed partial sums; and each word share's training words and distinct training words."""

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("share")[0].as_py() >= shares:
            out, words, distinct = added(np.concatenate([np.frombuffer(x, SUM) for x in rows.column("sums").to_pylist()])), 0, 0
        else:
            raw = {c: rows.column(c).to_pylist() for c in NAMES[1:-1]}
            pairs = np.concatenate([np.frombuffer(x, PAIR) for x in raw["pairs"]])
            lengths = np.concatenate([np.frombuffer(x, "<u4") for x in raw["lengths"]]).astype(np.int64)
            texts, crcs, train = (np.concatenate([np.frombuffer(x, t) for x in raw[c]]) for c, t in (("texts", "<i8"), ("crcs", "<u4"), ("train", "u1")))
            del raw
            word = pairs["a"].astype(np.uint64) | pairs["b"].astype(np.uint64) << np.uint64(32)
            n = pairs["n"].astype(np.int64)
            order = np.argsort(word, kind="stable")
            sorted_words = word[order]
            head = np.flatnonzero(np.r_[True, sorted_words[1:] != sorted_words[:-1]])
            weight = n * np.repeat(train, lengths)
            total = np.add.reduceat(weight[order], head)
            c = np.empty(len(word), np.int64)
            c[order] = np.repeat(total, np.diff(np.r_[head, len(word)]))
            begin = np.cumsum(lengths) - lengths
            out = np.empty(len(texts), SUM)
            out["text"], out["crc"] = texts, crcs
            out["log"] = np.add.reduceat(n * np.log10(c + 1.0), begin)
            out["known"], out["all"] = np.add.reduceat(n * (c > 0), begin), np.add.reduceat(n, begin)
            out, words, distinct = added(out), int(total.sum()), int((total > 0).sum())
        where, blobs = by_text(out, shares)
        zero = [0] * (len(where) - 1)
        return pa.Table.from_arrays([pa.array(where, pa.int64()), pa.array(blobs, pa.binary()), pa.array([words, *zero], pa.int64()), pa.array([distinct, *zero], pa.int64())], names=["bucket", "sums", "words", "distinct"])

    return dealt.groupBy("share").applyInArrow(run, "bucket long, sums binary, words long, distinct long")


def document_sums(partial: DataFrame) -> DataFrame:
    """text_hash, crc, known, all, log: sums over the words of all rows with that text."""

    def run(rows: pa.Table) -> pa.Table:
        x = added(np.concatenate([np.frombuffer(b, SUM) for b in rows.column("sums").to_pylist()]))
        return pa.Table.from_arrays([pa.array(x["text"]), *(pa.array(x[c].astype(np.int64)) for c in ("crc", "known", "all")), pa.array(x["log"])], names=["text_hash", "crc", "known", "all", "log"])

    return partial.groupBy("bucket").applyInArrow(run, "text_hash long, crc long, known long, all long, log double")


CODED = ["doc_id", "text_hash", "crc", "n_words", "train", "round", "ids"]


def code(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text_hash, text, train. CODED of each row; ids are two bytes each, with the end, and round is the text's share of the training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for batch in batches:
            keys, hashes, column, train = batch.columns
            texts = [t or "" for t in column.to_pylist()]
            n_words = np.concatenate([np.bincount(spans(d, b, NONSPACE)[2], minlength=j - i) for i, j, d, b in chunks(column)]) if texts else []
            raws = [t.encode() for t in texts]
            crcs = np.array([zlib.crc32(raw) for raw in raws], np.int64)
            rounds = (mix(hashes.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(ROUNDS)).astype(np.int32)
            for i, j in batched(texts, 1_000_000):
                coded = [stream(raw).astype("<u2").tobytes() for raw in coder.ids([_lower(raw) for raw in raws[i:j]])]
                part = slice(i, j)
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), hashes.slice(i, j - i), pa.array(crcs[part]), pa.array(n_words[part], pa.int64()), train.slice(i, j - i), pa.array(rounds[part]), pa.array(coded, pa.binary())], names=CODED)

    return docs.select("doc_id", "text_hash", "text", "train").mapInArrow(run, "doc_id long, text_hash long, crc long, n_words long, train boolean, round int, ids binary")


def _row_hash(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return mix(batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _streams(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, "<u2").astype(np.int64) for x in batch.column(column).to_pylist())


def totals(train: DataFrame, cells: int, keys: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How often each number below `cells` is among keys(ids), over all rows. A task sends SLICES compressed parts of its counts; each part is added up by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        held, size = [], 0
        for batch in batches:
            for s in _streams(batch, 0):
                held.append(keys(s))
                size += len(held[-1])
                if size > 1 << 21:
                    counts += np.bincount(np.concatenate(held), minlength=cells)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=cells)
        if counts.any():
            parts = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.array_split(counts, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    def total(rows: pa.Table) -> pa.Table:
        parts = np.zeros(1, np.int64)
        for x in rows.column("counts"):
            parts = parts + np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return pa.table({"slice": rows.column("slice").slice(0, 1), "counts": pa.array([zlib.compress(parts.tobytes(), 1)], pa.binary())})

    kind = "slice int, counts binary"
    found = train.select("ids").mapInArrow(run, kind).groupBy("slice").applyInArrow(total, kind).collect()  # SLICES rows of one fixed size in all
    if not found:
        return np.zeros(cells, np.int64)
    return np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in sorted(found)])


Text = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _windows(s: np.ndarray, leaf: np.ndarray, begins: np.ndarray) -> Text:
    """x, t, live and the hashed context of each target of one document's windows."""
    leaves = leaf[s].astype(np.int64)
    x, at, live = attention.windows(leaves)
    return x, leaves[at], live, attention.contexts(s, begins)[at]


def sample(train: DataFrame, leaf: np.ndarray, begins: np.ndarray, share: float) -> Text:
    """A share of all windows, the same ones on every layout."""
    limit = np.uint64(min(share, 1) * (2**64 - 2**12))
    sent = train.sparkSession.sparkContext.broadcast((leaf.astype(np.int32), begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, s in zip(_row_hash(batch, 0), _streams(batch, 1), strict=True):
                key = mix(h + np.arange(-(-len(s) // attention.STRIDE), dtype=np.uint64))
                at = np.flatnonzero(key <= limit)
                if len(at):
                    x, t, live, context = _windows(s, *sent.value)
                    rows += [(int(k), np.r_[a, b, c].astype("<i2").tobytes(), d.astype("<u8").tobytes()) for k, a, b, c, d in zip(key[at].view(np.int64), x[at], t[at], live[at], context[at], strict=True)]
            keys, blobs, contexts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary()), pa.array(contexts, pa.binary())], names=["key", "window", "contexts"])

    found = train.select("text_hash", "ids").mapInArrow(run, "key long, window binary, contexts binary").toPandas().sort_values(["key", "window", "contexts"])
    whole = np.frombuffer(b"".join(found["window"]), "<i2").astype(np.int64).reshape(-1, attention.WIDTH + 2 * attention.STRIDE)
    x, t, live = np.split(whole, [attention.WIDTH, attention.WIDTH + attention.STRIDE], axis=1)
    return x, t, live > 0, np.frombuffer(b"".join(found["contexts"]), "<u8").reshape(-1, attention.STRIDE)


def summed_gradients(train: DataFrame, leaf: np.ndarray, begins: np.ndarray, weights: dict[str, np.ndarray], names: list[str], part: int = PART) -> tuple[dict[str, np.ndarray], int]:
    """Sums over every part-th window of each row, and the number of targets. A task sends SLICES parts of one fixed-size sum, each part is added up by itself."""
    sent = train.sparkSession.sparkContext.broadcast((leaf.astype(np.int32), begins, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, begins, w = sent.value
        sums, n, held, size = np.zeros(sum(w[k].size for k in names)), 0, [], 0

        def add() -> None:
            nonlocal n
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            for a in range(0, len(whole[0]), AT_ONCE):
                g, m = attention.gradients(w, *(c[a : a + AT_ONCE] for c in whole))
                np.add(sums, np.concatenate([g[k].ravel() for k in names]), out=sums)
                n += m

        for batch in batches:
            for h, s in zip(_row_hash(batch, 0), _streams(batch, 1), strict=True):
                first = int(h % np.uint64(part))
                if first * attention.STRIDE >= len(s):
                    continue
                held.append(tuple(c[first::part] for c in _windows(s, leaf, begins)))
                size += len(held[-1][0])
                if size >= 4 * AT_ONCE:
                    add()
                    held, size = [], 0
        if held:
            add()
        if n:
            parts = [x.tobytes() for x in np.array_split(sums, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * SLICES, pa.int64())], names=["slice", "sums", "n"])

    def total(rows: pa.Table) -> pa.Table:
        parts = sum(np.frombuffer(x, float) for x in rows.column("sums").to_pylist())
        return pa.table({"slice": rows.column("slice").slice(0, 1), "sums": pa.array([parts.tobytes()], pa.binary()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64())})

    kind = "slice int, sums binary, n long"
    found = sorted(train.select("text_hash", "ids").mapInArrow(run, kind).groupBy("slice").applyInArrow(total, kind).collect())
    sent.unpersist()
    if not found:
        return {}, 0
    flat = np.concatenate([np.frombuffer(r["sums"], float) for r in found]).astype(np.float32)
    cuts = np.cumsum([weights[k].size for k in names])[:-1]
    return {k: g.reshape(weights[k].shape) for k, g in zip(names, np.split(flat, cuts), strict=True)}, found[0]["n"]


def word_beginnings() -> np.ndarray:
    """By id: whether it begins with a space or line break, or is the end."""
    name = encoder().tokenizer.id_to_token
    return np.array([(name(i) or " ").startswith((" ", "\u0120", "\u010a")) for i in range(N_IDS)])


def fit(coded: DataFrame) -> attention.Model:
    """coded: what code gives, in a table. Learns from all of its training rows."""
    train = coded.where("train")
    counts = totals(train, N_IDS, lambda s: s)
    if not counts.any():
        return attention.train([], N_IDS)
    leaf, within = attention.share_leaves(counts)
    begins = word_beginnings()
    context = coded.sparkSession.sparkContext
    sent = context.broadcast(leaf.astype(np.int32))
    follows = totals(train, (attention.LEAVES + 1) * attention.LEAVES, lambda s: attention.followers(sent.value[s].astype(np.int64))).reshape(-1, attention.LEAVES)
    place = attention.places(follows)
    leaf = place[leaf]
    placed = context.broadcast((leaf.astype(np.int32), begins))
    cells = totals(train, 2 * attention.CELLS * attention.SIDE, lambda s: attention.context_cells(placed.value[0][s].astype(np.int64), attention.contexts(s, placed.value[1])))
    fixed = attention.after(attention.arranged(follows, place)) | attention.context_counts(cells)
    n_windows = train.agg(F.sum(F.ceil(F.length("ids") / (2 * attention.STRIDE)))).first()[0]
    learner = attention.begin(*sample(train, leaf, begins, BEGIN / n_windows), fixed)
    names = sorted(learner.weights)
    for r in range(ROUNDS):
        g, n = summed_gradients(train.where(F.col("round") == r), leaf, begins, learner.weights | fixed, names)
        if n:
            learner.learn(g, n, 0.01 * (1 - 0.9 * r / ROUNDS))
    return attention.Model(leaf.astype(np.int32), within.astype(np.float32), learner.weights | fixed, begins)


def stream(raw: bytes) -> np.ndarray:
    return np.r_[np.frombuffer(raw, "<u4").astype(np.int64), END_ID]


def score(coded: DataFrame, model: attention.Model) -> DataFrame:
    """doc_id, text_hash, crc, n_words, score of each row of what code gives."""
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0, *(len(x) for x in batch.column(4).to_pylist())])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000, "right")) - 1)
                part = batch.slice(at, to - at)
                scores = attention.score(sent.value, list(_streams(part, 4)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(scores, pa.float64())], names=["doc_id", "text_hash", "crc", "n_words", "score"])
                at = to

    return coded.select("doc_id", "text_hash", "crc", "n_words", "ids").mapInArrow(run, "doc_id long, text_hash long, crc long, n_words long, score double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    train = training(F.col("doc_id"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text", train.alias("train"))
    n_docs, n_bytes, ends = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(F.col("train"), 1))).first()
    shares = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-n_bytes // SHARE_BYTES))
    hot = hot_words(docs, n_docs)
    partial = materialize(word_sums(deal(docs, shares, hot), shares))
    words, distinct = partial.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = words + int(hot.counts.sum()) + ends, distinct + int((hot.counts > 0).sum()) + (ends > 0)
    sums = materialize(document_sums(partial))
    release(partial)
    coded = materialize(code(docs).sortWithinPartitions("train", "round"))  # so a round reads its own pages
    model = fit(coded)
    scored = score(coded, model).join(sums, ["text_hash", "crc"], "left")
    copies = F.coalesce(F.col("all"), F.lit(0)) / F.greatest(F.col("n_words"), F.lit(1))  # rows with this text
    share = lambda c: F.when(F.col("n_words") > 0, F.coalesce(c, F.lit(0)) / copies).otherwise(F.lit(0.0))
    n_tokens = F.col("n_words") + 1
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.round(share(F.col("known"))).cast("long") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (share(F.col("log")) + F.log10(F.lit(float(ends + 1))) - n_tokens * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        "score",
    )


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
