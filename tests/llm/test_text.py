"""The text operators against brute force on small tables with odd rows."""

import collections
import hashlib
import time
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import attention, rans
from tagloom.llm import op1_decontamination as op1
from tagloom.llm import op2_tokens as op2
from tagloom.llm import op3_license as op3
from tagloom.llm import op4_html as op4
from tagloom.llm import op5_lm as op5
from tagloom.llm import op6_packing as op6
from tagloom.llm import op7_merkle as op7
from tagloom.llm import op8_jaccard as op8
from tagloom.llm import op9_suffix as op9
from tagloom.llm import op10_quality as op10
from tagloom.operators.graph import connected_components
from tagloom.llm.suffixes import suffix_array
from tagloom.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(60)] + ["the", "of", "and", "é", "Zürich", "it's", "a,b", "the."]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(VOCABULARY, n))


PASSAGE = prose(60, 99)
TEXTS = [
    prose(80, 1), prose(80, 1), prose(80, 1).replace("w5 ", "w6 ", 1), "", None, "one", "two words", prose(30, 2) + "\n" + PASSAGE, PASSAGE + " " + prose(40, 3),
    prose(10, 4) + " " + PASSAGE + "\n\n" + prose(5, 5), "x " * 200, " " * 30, "é" * 120, prose(900, 6), "<|endoftext|> a  b\tc\n", "y" * 300, "A\nB\nC",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and repeated ids."""
    return spark.createDataFrame([(None, PASSAGE, "en", "s", 1), (1, PASSAGE, None, None, None), (1, PASSAGE, None, None, None), (1, prose(20, 8), "de", "t", 2), (None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1

def words_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination_equals_brute_force(spark, docs):
    items = [("10", PASSAGE[:200]), ("9", "w1 w2"), ("11", None), (None, "one"), ("12", "two words"), ("2", PASSAGE.upper())]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = collect(op1.contamination(docs, bench), "doc_id", "n_words", "n_hit", "item_ids")
    want = []
    for i, t in enumerate(TEXTS):
        w, hit, ids = words_of(t), set(), set()
        for item, text in items:
            iw = words_of(text)
            if item is None or not iw:
                continue
            m = min(10, len(iw))
            wins = {tuple(iw[p : p + m]) for p in range(len(iw) - m + 1)}
            for p in range(len(w) - m + 1):
                if tuple(w[p : p + m]) in wins:
                    hit.update(range(p, p + m))
                    ids.add(item)
        want.append((i * 3, len(w), len(hit), sorted(ids)))
    assert got == sorted(want, key=repr)


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert [r[1] > 0 for r in collect(op1.contamination(odd, bench), "doc_id", "n_hit")].count(True) == 3
    assert op1.contamination(empty, bench).count() == 0
    assert {r[1] for r in collect(op1.contamination(odd, bench.limit(0)), "doc_id", "n_hit")} == {0}


# --- 2 and 6

@pytest.mark.parametrize("n", [0, 1, 31, 33, 32_768, 40_001])
def test_rans_round_trip(n):
    x = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.uint32)
    assert (rans.decode(rans.encode(x)) == x).all()


def test_rans_finds_damage():
    raw = bytearray(rans.encode(np.arange(5000, dtype=np.uint32)))
    raw[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(raw))


def test_encoder_equals_library():
    e = encoder()
    texts = [t or "" for t in TEXTS] + ["a\x1c b", " lead", "trail ", "don't  stop", "v2.0 x y", "a\n\nb", "中文 字", "!! ?? ..."]
    assert e.ids(texts) == [e._whole(t) if t else b"" for t in texts]


def test_token_files(spark, docs, odd, empty, tmp_path):
    e = encoder()
    end = np.array([2], "<u4").tobytes()
    op2.write(docs, str(tmp_path / "a"))
    at, want = 0, []
    for i, t in enumerate(TEXTS):
        raw = (e._whole(t) if t else b"") + end
        want.append((i * 3, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    back = op2.read(spark, str(tmp_path / "a"))
    assert [tuple(r) for r in back.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()] == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in back.collect())
    op2.write(odd, str(tmp_path / "b"))
    assert [r["doc_id"] for r in op2.read(spark, str(tmp_path / "b")).orderBy("start").collect()] == [None, None, 1, 1, 1]
    op2.write(empty, str(tmp_path / "c"))
    assert op2.read(spark, str(tmp_path / "c")).count() == 0


def test_packing(spark, docs, odd, empty):
    e = encoder()
    end = np.array([1], "<u4").tobytes()
    ids = {i * 3: (e._whole(t) if t else b"") + end for i, t in enumerate(TEXTS)}
    pieces = [r.asDict() for r in op6.pack(docs, 128).collect()]
    seqs = collections.defaultdict(list)
    got = collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(ids[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])]) == p["ids_crc32"]
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) // 4
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        got[p["doc_id"]].append((p["start"], p["length"]))
    for parts, most in [(s, 128) for s in seqs.values()] + [(got[k], len(v) // 4) for k, v in ids.items()]:
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= most
    assert {k: sum(n for _, n in v) for k, v in got.items()} == {k: len(v) // 4 for k, v in ids.items()}
    full = [sum(n for _, n in s) for s in seqs.values()]
    assert all(n == 128 or n & (n - 1) == 0 for n in full)
    assert op6.pack(empty).count() == 0 and op6.pack(odd).agg(F.sum("length")).first()[0] > 0


def test_sum_of_squares_choice():
    p = op6.Packer(10)
    for n in (6, 6, 7):
        p.add(0, b"\0\0\0\0" * n)
    brute = {}
    for h in range(0, 8):
        n = p.level.copy()
        if h and not n[h]:
            continue
        n[h] -= h > 0
        if h + 3 < 10:
            n[h + 3] += 1
        brute[h] = int((n[1:10] ** 2).sum())
    assert brute[p.best(3)] == min(brute.values())


# --- 3 and 4

def test_license_scan_equals_brute_force(spark, docs, empty):
    extra = spark.createDataFrame([(100, "Intro here.\nLicensed under CC BY-NC 4.0.\nmore"), (101, "Released under the MIT License."), (102, op3.TEMPLATES["mit-notice"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op3.scan(docs.select("doc_id", "text").union(extra)).collect()}
    assert (got[100]["licenses"], got[101]["licenses"], got[102]["licenses"]) == ("cc-by-nc-4.0", "mit", "mit-notice")
    assert got[3]["licenses"] == "" and got[12]["best"] == 0
    s = op3.Scanner()
    for seg in ["Licensed under CC BY 4.0", "the GNU General Public License version 3", "All rights reserved", PASSAGE]:
        g = op3.bigrams(seg)
        scored = [(2 * len(g & b) / (len(g) + n), name) for n, name, b in s.templates]
        best = max(x for x, _ in scored)
        assert (s.best(seg) is None) == (best < s.threshold) and (s.best(seg) is None or s.best(seg)[0] == pytest.approx(best))
    assert op3.scan(empty).count() == 0


def test_html():
    page = """<html><head><title>T</title><script>var x="<p>no</p>";</script></head><body><nav class="menu"><a href=1>Home</a></nav>
    <header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies to make this site work for you and all of the others here today.</p></div>
    <article><h1>The title of it</h1><p>This is the first &amp; longest part of the text, and it is full of the words that are in all of the texts.<br>More of it is here
    <p>Short one.</p><div class="ad">Buy this and that now, it is the best of all that we have had in the shop.</div><p>The end of the story is that it was all a dream and that they were in it.</p></article>
    <section id="comments"><p>I think that this is the best of all the articles that I have read on the site so far.</p></section><form><input><p>Sign up to the letter</p></form><footer>&copy; us</footer></body></html>"""
    assert op4.main_text(page) == (
        "The title of it\nThis is the first & longest part of the text, and it is full of the words that are in all of the texts. More of it is here\nShort one.\n"
        "The end of the story is that it was all a dream and that they were in it."
    )
    assert op4.main_text(None) == op4.main_text("") == op4.main_text("<p") == ""
    plain = "<div><p>" + "this is a text that has no article but is long and of the kind that we want to keep in the end " * 3 + "</p><p>tiny</p></div><ul><li><a>x</a></li></ul>"
    assert "tiny" in op4.main_text(plain) and "x" not in op4.main_text(plain).split("\n")


def test_html_reads_broken_markup_in_one_pass():
    began = time.time()
    for bad in ("<a " * 330_000, "<b>" * 160_000 + "</x>" * 120_000, "<a '\"" * 200_000, "<!" * 500_000, "<ul><li>" + "<b>" * 100_000 + "<li></i>" * 60_000, "<p class='" * 100_000):
        op4.main_text(bad)
    assert time.time() - began < 20
    assert op4.main_text("<p>This is the text of a page that has an open quote in <a href=\"x>one of the links</a> that it has, and it is long enough to be kept as it is.") != ""


def test_html_headings_and_other_languages():
    text = "It was the best of times, and it was the worst of times, as they say in the book that we all have read at school."
    page = f"<nav><a href='/'>Home</a></nav><h1>A short headline</h1><p>{text}</p><p>{text}</p><footer>Imprint</footer>"
    assert op4.main_text(page) == f"A short headline\n{text}\n{text}"
    strange = "Zxqv brunt okole miznar tuvpel jaska worlim denkur pashti ovreel kanduz. " * 4
    assert op4.main_text(f"<div>{strange}</div><div><a href='/'>{strange}</a></div>") == strange.strip()


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>hello</p></article>", "x")], "page_id long, url string, html string, text string")
    assert collect(op4.extract(df), "page_id", "text", "n_chars") == [(1, "", 0), (2, "hello", 5)]


def test_license_among_other_words():
    scanner = op3.Scanner()
    around = "one two three four five six seven eight nine ten " * 3
    assert scanner.scan(around + "Released under the MIT License. " + around) == {"mit": (1.0, 1)}
    assert scanner.scan(around + "released under\nthe MIT license, " + around + "\nmore words here") == {"mit": (1.0, 1)}
    assert scanner.scan("Released under the MIT License.\n" + around + "Released under the MIT License.") == {"mit": (1.0, 2)}
    assert scanner.scan(around + "the license of MIT was released under pressure " + around) == {}
    gpl = " ".join(op3.TEMPLATES["gpl-3.0-notice"].split())
    assert set(scanner.scan(around + gpl + around)) == {"gpl-3.0-notice"}
    assert scanner.scan(around + "all rights reserved " * 2000)["all-rights-reserved"][0] == 1


# --- 5

def test_attention_gradients():
    streams = [np.random.default_rng(0).integers(0, 300, 90) for _ in range(4)]
    m = attention.train(streams, 301, steps=3, batch=8)
    w = {k: v.astype(np.float64) for k, v in m.weights.items()}
    x, at, live = attention.windows(m.leaf[streams[0]])
    t = m.leaf[streams[0]][at][live]
    h = attention.contexts(streams[0], m.begins)[at][live]
    without = {"n1": w["n1"].copy(), "n2": w["n2"].copy()}

    def loss(w):  # of one target at a time, without its own count
        c = attention.forward(w, x)
        last = c["x"][:, attention.WIDTH - attention.STRIDE :][live]
        total = 0
        for i in range(len(t)):
            cls, sub = t[i] // attention.SIDE, t[i] % attention.SIDE
            a, b = attention.cell1(h[i : i + 1])[0], attention.cell2(h[i : i + 1], np.array([cls]))[0]
            without["n1"][a, cls] -= 1
            without["n2"][b, sub] -= 1
            total -= attention.heads(w | without, c["z"][live][i : i + 1], t[i : i + 1], last[i : i + 1], h[i : i + 1])[0][0]
            without["n1"][a, cls] += 1
            without["n2"][b, sub] += 1
        return total

    c = attention.forward(w, x)
    g = {}
    _, d = attention.heads(w, c["z"][live], t, c["x"][:, attention.WIDTH - attention.STRIDE :][live], h, g)
    dz = np.zeros_like(c["z"])
    dz[live] = d
    attention.backward(w, c, dz, g)
    for name in ("Wq", "Wv", "Wo", "W1", "C1"):
        i = (1, 2)
        for sign in (1,):
            up, down = {**w, name: w[name].copy()}, {**w, name: w[name].copy()}
            up[name][i] += 1e-3 * sign
            down[name][i] -= 1e-3 * sign
            assert (loss(up) - loss(down)) / 2e-3 == pytest.approx(g[name][i], rel=0.05, abs=0.02), name


def test_attention_is_causal_and_normalised():
    streams = [np.random.default_rng(1).integers(0, 1500, 70) for _ in range(3)]
    m = attention.train(streams, 1500, steps=5, batch=8)
    s = streams[0][:30]
    total = (10 ** (attention.score(m, [np.r_[s, v] for v in range(1500)]) - attention.score(m, [s])[0])).sum()
    assert total == pytest.approx(1, abs=1e-3)


def test_lm_base(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in op5.scores(docs).collect()}
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    sets = {i * 3: find((t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in sets}
    counts = collections.Counter(w for i, ws in sets.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in sets.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-9)
        assert r["score"] < 0
    assert op5.scores(empty).count() == 0
    pair = [r for r in op5.scores(odd).collect() if r["doc_id"] == 1 and r["n_tokens"] == 61]
    assert len(pair) == 2 and pair[0]["base_score"] == pair[1]["base_score"]


def test_lm_learns_from_every_training_document(spark):
    long = "quartz basalt " * 700  # over 8,000 characters
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, prose(30, i), "en", "s", 1) for i in ids[:20]] + [(ids[20], long, "en", "s", 1)]
    out = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2)
    probes = [(out, "quartz basalt " * 20, "en", "s", 1), (out, "marble shale " * 20, "en", "s", 1)]
    got = {r["n_known"]: r["score"] for r in op5.scores(spark.createDataFrame(rows + probes, DOCS).repartition(3)).collect() if r["doc_id"] == out}
    assert got[41] > got[1] + 20


def test_lm_sums_are_of_all_rows(spark, docs):
    coded = op5.code(docs.withColumn("train", op5.training(F.col("doc_id"))).withColumn("text_hash", F.xxhash64("text"))).where("train")
    streams = [np.frombuffer(r["ids"], "<u2").astype(np.int64) for r in coded.collect()]
    counts = op5.totals(coded, op5.N_IDS, lambda s: s)
    assert (counts == sum(np.bincount(s, minlength=op5.N_IDS) for s in streams)).all()
    leaf, _ = attention.share_leaves(counts)
    follows = op5.totals(coded, (attention.LEAVES + 1) * attention.LEAVES, lambda s: attention.followers(leaf[s])).reshape(-1, attention.LEAVES)
    assert (follows.ravel() == np.bincount(np.concatenate([attention.followers(leaf[s]) for s in streams]), minlength=follows.size)).all()
    begins = op5.word_beginnings()
    cells = op5.totals(coded, 2 * attention.CELLS * attention.SIDE, lambda s: attention.context_cells(leaf[s], attention.contexts(s, begins)))
    assert cells.sum() == 2 * sum(map(len, streams))
    w = attention.Learner(np.random.default_rng(0)).weights
    names, fixed = sorted(w), attention.after(follows) | attention.context_counts(cells)
    got, n = op5.summed_gradients(coded, leaf, begins, w | fixed, names, part=1)
    x, t, live, h = (np.concatenate(c) for c in zip(*[op5._windows(s, leaf, begins) for s in streams]))
    want, m = attention.gradients(w | fixed, x, t, live, h)
    assert n == m == sum(map(len, streams))
    assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-3) for k in names)
    parts = [op5.summed_gradients(coded, leaf, begins, w | fixed, names, part=3)[1]]
    assert 0 < parts[0] < n
    x, _, live, h = op5.sample(coded, leaf, begins, 1.0)
    assert live.sum() == n and len(x) == len(h) == sum(-(-len(s) // attention.STRIDE) for s in streams)


def test_word_contexts():
    ids = np.array([5, 7, 7, 5, 7, 7, 9])
    begins = np.zeros(10, bool)
    begins[5] = True
    h = attention.contexts(ids, begins)
    assert h[1] == h[4] and h[2] == h[5] and h[3] == h[6] and len(set(h.tolist())) == 4


def test_scores_by_tables_equal_plain_forward():
    streams = [np.random.default_rng(i).integers(0, 1500, 70 + i) for i in range(5)]
    m = attention.train(streams, 1500, np.arange(1500) % 3 == 0, steps=20, batch=8)
    for s in streams:
        leaves = m.leaf[s]
        x, at, live = attention.windows(leaves)
        c = attention.forward(m.weights, x)
        last = c["x"][:, attention.WIDTH - attention.STRIDE :]
        lp, _ = attention.heads(m.weights, c["z"][live], leaves[at][live], last[live], attention.contexts(s, m.begins)[at][live])
        assert attention.score(m, [s])[0] == pytest.approx((lp.sum(dtype=float) + m.within[s].sum(dtype=float)) / math.log(10), rel=1e-4)


# --- 7

def test_merkle(spark, docs, odd, empty):
    got = {r["key"]["id"]: r for r in op7.with_next(docs).collect()}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        assert (got[i * 3]["n"], got[i * 3]["head"]) == (len(t), nxt[: len(t) // 2])
    prints = op7.with_tree(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t", "x_").select("t", op7.fingerprint("x_").alias("f")).collect()
    assert len({r["f"] for r in prints}) == len({r["t"] for r in prints}) == len(set(texts))
    assert op7.with_next(odd).count() == 5 and op7.with_next(empty).count() == 0


def test_merkle_locates_edits(spark):
    a = "\n".join(prose(20, i) for i in range(12))
    lines = a.split("\n")
    lines[4] = lines[4].replace("w", "v", 1)
    df = spark.createDataFrame([(a, "\n".join(lines))], "a string, b string")
    both = op7.with_tree(op7.with_tree(df, "a", "x_"), "b", "y_")
    both = op7.with_likeness(op7.with_likeness(both, "x_", "y_", "s"), "x_", "x_", "one")
    r = both.select(op7.differing("x_", "y_").alias("d"), "s", "one").first()
    assert r["d"] == [4] and 0.7 < r["s"] < 1 and r["one"] == 1


def plain_likeness(x, y):
    """From two fingerprints alone, branch by branch."""
    if x.split("|")[0] == y.split("|")[0]:
        return 1.0

    def branches(f):
        _, heads, names, leaves = f.split("|")
        names, leaves, at, out = names.split(","), [[x for x in p.split(",") if x] for p in leaves.split(";")], 0, []
        for h in heads.split(",") if heads else []:
            name, n = h.split(":")
            out.append((name, list(zip(names[at : at + int(n)], leaves[at : at + int(n)]))))
            at += int(n)
        return out

    a, b = branches(x), branches(y)
    same = {n for n, _ in a} & {n for n, _ in b}
    both, over = 0, 0
    ps = [[p for n, s in side if n not in same for p in s] for side in (a, b)]
    common = {n for n, _ in ps[0]} & {n for n, _ in ps[1]}
    rest = [{leaf for n, p in side if n not in common for leaf in p} for side in ps]
    for side, entered in zip((a, b), ps):
        n = sum(len(p) for _, s in side for _, p in s) - sum(len(p) for n, p in entered if n not in common)
        both, over = both + n, over + n
    both += 2 * len(rest[0] & rest[1])
    over += len(rest[0]) + len(rest[1])
    return both / over if over else 0.0


def test_merkle_query_equals_brute_force(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op7.op7_merkle(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in TEXTS]
    prints = {}
    for i, t in enumerate(texts):
        r, nxt = got[i * 3], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        prints[i] = r["fingerprint"]
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
    for i in range(len(texts)):
        assert got[i * 3]["near_next"] == pytest.approx(plain_likeness(prints[i], prints[(i + 1) % len(texts)]))
        for j in range(i):
            assert (prints[i] == prints[j]) == (texts[i] == texts[j])


# --- 8

def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(op8, "GROUP", 4)
    r = np.random.default_rng(k)
    texts = list(TEXTS)
    for base in range(6):
        words = prose(60, 50 + base).split()
        for _ in range(8):
            w = list(words)
            for _ in range(r.integers(0, 5)):
                w[r.integers(0, len(w))] = r.choice(VOCABULARY)
            texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8.join(df, k, percent).collect()}
    s = shingle_sets(texts, k)
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x = len(s[i] & s[j])
            if x and 100 * x >= percent * (len(s[i]) + len(s[j]) - x):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert got == {i: (len(s[i]), up[i]) for i in range(len(texts))}


def test_jaccard_odd_rows(odd, empty):
    rows = collect(op8.join(odd, 3, 90), "doc_id", "n_shingles", "component_id")
    assert len(rows) == 5 and (None, 0, None) in rows and sum(r[2] == 1 for r in rows) == 4
    assert op8.join(empty, 3, 90).count() == 0


def test_text_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r["component"] for r in connected_components(e).collect()} == {0, 100}


# --- 9

def test_suffix_array():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 300):
        for k in (1, 2, 5):
            t = np.r_[r.integers(1, k + 1, n), 0]
            assert suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
    t = np.r_[np.tile([2, 1, 2], 100), 0]
    assert suffix_array(t).tolist() == sorted(range(301), key=lambda i: t[i:].tolist())


def cover(texts):
    seen, out = {}, []
    for i, t in enumerate(texts):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                hit[p : p + 50] = b"\1" * 50
        out.append((len(b), sum(hit), sum(1 for x in bytes(hit).split(b"\0") if x), hashlib.sha256(bytes(c for c, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_equals_brute_force(spark, docs, hot, monkeypatch, tmp_path):
    monkeypatch.setattr(op9, "HOT_RUNS", hot)
    monkeypatch.setattr(op9, "SPLIT_RUNS", 2)
    got = {}
    for r in op9.with_repeats(docs).collect():
        raw = (r["text"] or "").encode()
        kept = op9.cut_out(raw, r["starts"], r["ends"])
        got[r["doc_id"]] = (len(raw), len(raw) - len(kept), len(r["starts"] or ()), hashlib.sha256(kept).hexdigest())
    assert got == {i * 3: x for i, x in enumerate(cover(TEXTS))}


def test_suffix_dedup_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(op9, "PIECE_BYTES", 700)
    texts = [prose(500, 1), prose(100, 2) + " " + prose(500, 1), PASSAGE + prose(300, 3) + PASSAGE, PASSAGE]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: sum(b - a for a, b in zip(r["starts"] or [], r["ends"] or [], strict=True)) for r in op9.with_repeats(df).collect()}
    assert got == {i: x[1] for i, x in enumerate(cover(texts))}


def test_suffix_dedup_odd_rows(odd, empty):
    assert all(r["starts"] is None for r in op9.with_repeats(odd).collect())
    assert op9.with_repeats(empty).count() == 0


def test_suffix_dedup_of_short_texts_only(spark):
    short = spark.createDataFrame([(i, "x" * i) for i in range(49)], "doc_id long, text string").repartition(2)
    assert all(r["starts"] is None for r in op9.with_repeats(short).collect())
    mixed = short.union(spark.createDataFrame([(100, "z" * 60), (101, "z" * 60), (102, "y" + "z" * 59)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["starts"], r["ends"]) for r in op9.with_repeats(mixed).collect() if r["starts"]}
    assert got == {101: ([0], [60]), 102: ([1], [60])}


def test_suffix_dedup_clashing_columns_and_repeated_rows(spark):
    names = ("starts", "ends", "_id", "_crc", "_key", "_text_crc", "digest", "first", "_spans", "id", "crc", "share")
    rows = [(i, t, *range(len(names))) for i, t in ((1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (None, PASSAGE), (2, prose(50, 8) + PASSAGE))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    got = sorted((r["doc_id"] or 0, len(r["text"].encode()), r["starts"], r["ends"], r["digest"]) for r in op9.with_repeats(df).collect())
    n, m = len(PASSAGE.encode()), len((prose(50, 8) + PASSAGE).encode())
    assert got == [(0, n, None, None, 6), (1, n, None, None, 6), (1, n, None, None, 6), (2, n, [0], [n], 6), (2, n, [0], [n], 6), (2, m, [m - n], [m], 6)]


def test_suffix_array_of_one_repeated_character_is_fast():
    begin = time.time()
    assert suffix_array(np.r_[np.full(100_000, 5), 0]).tolist() == list(range(100_000, -1, -1))
    assert time.time() - begin < 2


# --- 10

def test_quality(spark, empty):
    good = [(i, prose(60, i).replace("w", "word "), 1) for i in range(60)]
    bad = [(i + 1000, " ".join(x.upper() + "!!" for x in prose(60, i).split()), 0) for i in range(60)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(None, 1), (7, None)], "doc_id long, label int")
    model = op10.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in op10.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 0]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.9 and all(0 <= s <= 1 for s in got.values())
    assert op10.score(empty, model).count() == 0
    assert op10.train(docs, labels.limit(0)).weights == (0.0, 0.0, 0.0)


def test_quality_query(spark, tmp_path):
    good = [(i, prose(60, i).replace("w", "word ")) for i in range(80)]
    bad = [(i + 1000, " ".join(x.upper() + "!!" for x in prose(60, i).split())) for i in range(80)]
    rows = [*good, *bad, (5000, None), (5001, ""), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op10.op10_quality(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((i is None, i) for i, _ in rows)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] < 1000) for r in held if r["doc_id"] < 5000]) > 0.9


# --- all

def test_columns_with_clashing_names(spark):
    """Operators neither fail nor change where documents have columns named like their own."""
    names = ("uid", "node", "key", "share", "score", "n", "ids", "text_hash", "starts", "root", "component", "train", "crc", "words", "hits", "id", "g", "token")
    plain = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:9])], "doc_id long, text string")
    wide = plain.select("*", *[F.lit(7).alias(c) for c in names])
    items = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    model = op10.fit([(prose(40, i), i % 2) for i in range(12)])
    for run in (
        lambda d: op1.contamination(d, items).select("doc_id", "n_words", "n_hit"),
        lambda d: op6.pack(d).groupBy("doc_id").agg(F.sum("length").alias("n")),
        lambda d: op8.join(d).select("doc_id", "n_shingles", "component_id"),
        lambda d: op10.score(d, model).select("doc_id", "score"),
        lambda d: op7.with_next(d).select("key.id", "n"),
        lambda d: op5.scores(d),
    ):
        a, b = (sorted(map(tuple, run(d).collect())) for d in (plain, wide))
        assert len(a) == len(b) and all(x[:-2] == y[:-2] and x[-2:] == pytest.approx(y[-2:]) for x, y in zip(a, b, strict=True))


def test_attention_products_run_over_all_positions_at_once(monkeypatch):
    """Gradients of far scores equal those of a plain loop over windows; no sum goes position by position."""
    streams = [np.random.default_rng(i).integers(0, 300, 90) for i in range(3)]
    m = attention.train(streams, 301, steps=3, batch=8)
    w = m.weights | {"E": m.weights["E"] * 40}  # scores beyond SAFE
    x, at, live = attention.windows(m.leaf[streams[0]])
    h = attention.contexts(streams[0], m.begins)[at]
    t = m.leaf[streams[0]][at].astype(np.int64)

    class NoLoop:
        def __getattr__(self, name):
            assert name != "add"
            return getattr(np, name)

    monkeypatch.setattr(attention, "np", NoLoop())
    whole, n = attention.gradients(w, x, t, live, h)
    parts = [attention.gradients(w, x[i : i + 1], t[i : i + 1], live[i : i + 1], h[i : i + 1]) for i in range(len(x))]
    assert n == sum(k for _, k in parts) == 90
    for k, g in whole.items():
        assert np.isfinite(g).all() and np.allclose(g, sum(p[k] for p, _ in parts), rtol=1e-3, atol=1e-3 * abs(g).max())
    scores = attention.score(attention.Model(m.leaf, m.within, w, m.begins), streams)
    assert np.isfinite(scores).all()
