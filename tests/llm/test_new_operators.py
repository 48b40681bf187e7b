"""Operators 11 to 13 against plain loops, library encoders and hand-made cases."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tagloom.llm import op4_html as op4
from tagloom.llm import tokens
from tagloom.llm import op11_divergence as divergence
from tagloom.llm import op12_centroids as centroids
from tagloom.llm import op13_bytepair as bytepair


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# 11


def plain_audit(docs, least=10, top=10):
    docs = [((t or ""), (lang or ""), (s or "")) for t, lang, s in docs]
    out = []
    for lang in {x[1] for x in docs}:
        counts, seen = defaultdict(Counter), Counter()
        sources = sorted({x[2] for x in docs if x[1] == lang}, key=str.encode)
        for text, of, source in docs:
            if of == lang:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low)
                counts[source].update(words)
                seen.update(set(words))
        kept = [t for t, n in seen.items() if n >= least]
        v = len(kept)
        total = {s: sum(counts[s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[s][t] + 2) // (total[s] + 2 * v) for t in kept} for s in sources}
        every = sum(total.values())
        q = {t: 1 + 10**9 * (sum(counts[s][t] for s in sources) + 2) // (every + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -x, i + 1) for i, (x, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -x, i + 1) for i, (x, _, t) in enumerate(terms)]
    return sorted(out)


SCHEMA11 = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_plain_loops(spark, seed):
    rng = random.Random(seed)
    words = ["the", "The", "été", "x1y", "b", "c-d", "naïve", "ÀB", "中文", "zz", "rare"]
    docs = [(i % 40, " ".join(rng.choices(words, k=rng.randint(0, 30))) if rng.random() > 0.05 else None, rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "s10", "ß"])) for i in range(160)]
    docs += [(500 + i, None, "fr", f"s{i % 3}") for i in range(4)] + [(600, "only one here", "it", "a")]
    docs += docs[:20]  # repeated rows
    got = rows(divergence.audit(spark.createDataFrame(docs, SCHEMA11)))
    assert got == plain_audit([d[1:] for d in docs])
    assert [r for r in got if r[0] == "fr"] == [("fr", f"s{i}", "pair", f"s{j}", 0, 1 + [x for x in range(3) if x != i].index(j)) for i in range(3) for j in range(3) if i != j]


def test_audit_with_many_flushes_clashing_columns_and_long_texts(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=20_000 if i == 3 else 5)), "en", f"s{i % 4}") for i in range(60)]
    df = spark.createDataFrame(docs, SCHEMA11)
    want = plain_audit([d[1:] for d in docs])
    clashing = df.withColumns({c: F.lit(1) for c in ("term", "n", "docs", "value", "rank", "item", "part", "column", "times")})
    assert rows(divergence.audit(clashing)) == want
    assert rows(divergence.audit(spark.createDataFrame([], SCHEMA11))) == []


def test_audit_equals_sql_on_ties(spark):
    docs = pd.DataFrame({"doc_id": range(60), "text": ["alpha beta", "beta gamma", "gamma alpha"] * 20, "lang": ["en"] * 60, "source": [f"s{i % 3}" for i in range(60)]})
    con = duckdb.connect()
    con.register("documents", docs)
    got = divergence.audit(spark.createDataFrame(docs)).select(*(c for c in ("lang", "source", "part", "item", "value", "rank")))
    assert rows(got) == sorted(con.sql(divergence.ORACLE_SQL).fetchall())


def test_shares_are_exact(spark):
    rng = random.Random(3)
    cases = [(rng.randint(0, t), t) for t in (1, 2, 10, 10**6, 10**12 + 7, 9 * 10**15) for _ in range(20)]
    got = spark.createDataFrame(cases, "x long, t long").select("x", "t", divergence.share(F.col("x"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * r["x"] // r["t"] for r in got)


# 12


def plain_clusters(data, k=8, rounds=10, size=64, scale=1024):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in data if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in good]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(good, of, strict=True) if o == j]
            if own:
                c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [(i, *nearest(v)) for i, v in good]
    total, by = sum(d for _, d, _ in last), Counter()
    for _, d, j in last:
        by[j] += d
    return [(i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in last]


SCHEMA12 = "vec_id long, embedding array<float>, label int"


def clustered(df, k=8, **more):
    kept = centroids.kept(df)
    return centroids.cluster(kept, centroids.seeds(kept, k), **more)


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("bounds", [None, 1, 7])
def test_clusters_equal_plain_loops(spark, bounds):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 64))
    data = [(int(i) % 250, (middle[rng.integers(12)] + 0.7 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    data += [(900, None), (901, [1.0] * 63), (902, [float("nan")] * 64), (903, [1.0] * 63 + [None]), (904, [float("inf")] * 64), (905, []), (None, [0.5] * 64)]
    data += [(950 + i, [-0.25] * 64) for i in range(40)]  # equal vectors
    df = spark.createDataFrame([(i, e, 0) for i, e in data], SCHEMA12).withColumns({c: F.lit("x") for c in ("cluster", "v", "x", "n", "distance")})
    log = []
    got = sorted((tuple(r) for r in clustered(df, bounds=bounds, log=log).collect()), key=key)
    assert got == sorted(plain_clusters(data), key=key)
    assert log[-1]["measured"] < log[0]["measured"]  # bounds spare distances


def test_clusters_with_ties_few_vectors_and_none(spark):
    e = lambda *x: [float(v) for v in x] + [0.0] * (64 - len(x))
    for data in ([(i, e(i % 4, i % 2)) for i in range(40)], [(1, e(1)), (2, e(1)), (3, e(-1))], [(i, e(0)) for i in range(20)], []):
        got = [tuple(r) for r in clustered(spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA12)).collect()]
        assert sorted(got) == sorted(plain_clusters(data))


def test_clusters_of_too_large_components_fail(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, 0), (2, [0.0] * 64, 0)], SCHEMA12)
    with pytest.raises(Exception, match="64 bits"):
        clustered(df).collect()


def test_bounds_never_miss_a_nearer_centroid():
    rng = np.random.default_rng(11)
    for trial in range(30):
        k = int(rng.integers(2, 12))
        v, c = rng.integers(-50, 50, (200, 3)), rng.integers(-50, 50, (k, 3))
        b = centroids.Bounds.unknown(v, int(rng.integers(1, k)))
        b.assign(c)
        for step in range(6):
            new = c + rng.integers(-6, 7, c.shape) * (rng.random((k, 1)) < 0.5)
            b.shrink(max(1, b.near.shape[1] - step % 2))
            b.move(np.sqrt(((new - c).astype(float) ** 2).sum(1)))
            c = new
            b.assign(c)
            far = ((v[:, None] - c[None]) ** 2).sum(2)
            assert (b.cluster == far.argmin(1)).all(), (trial, step)


# 13


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(bytepair.DEFAULT), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed_texts(seed, n, most):
    rng = random.Random(seed)
    parts = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "é", "ß", "中", "😀", "1", "23", "!", "...", "the", " and", "\x1c", "​", "<|endoftext|>", "A", "I'm", " "]
    return ["".join(rng.choices(parts, k=rng.randint(0, most))) for _ in range(n)]


LONG = [x * 3000 for x in ("a", " ", "ab", "\n ", "😀", "'", "é!")] + ["a" * 2048 + " " * 2048 + "!" * 2048, "x " * 20_000]


@pytest.mark.parametrize(("leaf", "short"), [(2048, 24), (7, 3), (1, 1)])
def test_ids_equal_the_library_at_every_leaf_size(library, monkeypatch, leaf, short):
    monkeypatch.setattr(bytepair, "LEAF", leaf)
    monkeypatch.setattr(bytepair, "SHORT", short)
    coder = bytepair.Coder(public_tokenizers.path(bytepair.DEFAULT), public_tokenizers.PATTERN)
    texts = mixed_texts(leaf, 400, 60) + mixed_texts(leaf + 1, 5, 3000) + (LONG if leaf > 1 else [x[:300] for x in LONG])
    for text, raw in zip(texts, coder.ids(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.text(raw) == text.encode()


def test_ranks_are_orderly_and_joins_are_encodings():
    ranks = bytepair.coder().ranks
    assert ranks.orderly
    rng = random.Random(2)
    for _ in range(300):
        x, y = (bytes(rng.choices(b"aabcdeth \xc3\xa9", k=rng.randint(0, 40))) for _ in "xy")
        assert ranks.join(ranks.short(x), ranks.short(y)) == ranks.short(x + y)


def test_ranks_out_of_order_are_noticed_and_still_right(tmp_path):
    order = [*(bytes([b]) for b in range(256)), b"abc", b"ab", b"bc", b"cd", b"abcd"]  # abc comes before what makes it
    (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(order)))
    ranks = bytepair.Ranks(str(tmp_path / "r"))
    assert not ranks.orderly
    want = tiktoken.Encoding("o", pat_str=r"(?s).+", mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
    rng = random.Random(4)
    for _ in range(200):
        piece = bytes(rng.choices(b"abcd", k=rng.randint(1, 80)))
        if piece not in ranks.rank:  # the library looks whole pieces up
            assert ranks.encode(piece) == want.encode_ordinary(piece.decode())


def test_query_rows(spark, library):
    texts = [None, "", "Hello world", "Hello world", " ", *mixed_texts(1, 20, 200), "y" * 20_000, "word " * 60_000]
    df = spark.createDataFrame([(None if i == 3 else i % 20, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in bytepair.encode(df, with_ids=False).collect()), key=key)
    want = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((None if i == 3 else i % 20, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bytepair.encode(df.limit(0)).count() == 0
    full = bytepair.encode(df).where("doc_id = 2").first()
    assert bytes(full["decoded"]).decode() == "Hello world" and len(full["ids"]) == 4 * full["n_tokens"]


PROSE = "This is one of the longer texts of the page, and it has the words that are in all of them, so that it is read as a part of what the page was made for by those who wrote it."


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments layout", "with-nav", "search-results", "content share", "site promo"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_html_marks_are_votes(name, tag):
    page = f'<body><div class="{name}"><div class="menu"><a href="/">Home</a></div><{tag}><h1>Headline</h1><p>{PROSE}</p><p>{PROSE}</p></{tag}><div class="comments"><p>{PROSE} I say.</p></div></div></body>'
    assert op4.main_text(page) == f"Headline\n{PROSE}\n{PROSE}"


def test_html_marks_stand_without_more_text_inside():
    advert = "Buy this thing now, as it is the best one that you can have for so little of your money today."
    for tag in ("article", "div"):
        page = f'<form class="x"><{tag}><p>{PROSE}</p><p class="notice">{advert}</p><p>{PROSE}</p></{tag}></form><div class="ad">{advert}</div><section class="related"><article><p>{advert}</p></article></section>'
        if tag == "div":
            page = page.replace("<section", "<aside").replace("</section", "</aside")
        assert op4.main_text(page) == f"{PROSE}\n{PROSE}"
    comments = "".join(f'<article class="comment-body"><p>{PROSE} {i}</p></article>' for i in range(9))
    assert op4.main_text(f'<div class="share"><div><p>{PROSE}</p></div><ol class="comment-list">{comments}</ol></div>') == PROSE
    assert op4.main_text(f'<div class="replies"><p>{PROSE}</p></div>') == PROSE  # nothing else is there


def test_html_article_element_is_a_prior():
    page = f"<article><p>Teaser.</p></article><div><p>{PROSE}</p><p>{PROSE}</p></div>"
    assert op4.main_text(page) == f"Teaser.\n{PROSE}\n{PROSE}"
    assert op4.main_text(f"<article><p>{PROSE}</p><ul><li><a href='/'>A linked item</a></li></ul></article><div><p>{PROSE}</p></div>") == f"{PROSE}\nA linked item"
    assert op4.main_text(f"<div><p>{PROSE}</p></div><div><a href='/'>Elsewhere</a> <a href='/'>Imprint</a></div>") == PROSE


def test_html_density_decides():
    names = "Berlin Hamburg Bremen Lyon Paris Oslo Madrid Porto Turin Genoa Kiel Dresden Leipzig Bonn Ulm"
    page = f"<div><p>{PROSE}</p></div><div>{names} <a href='/'>All towns</a></div><div><p>{PROSE}</p></div>"
    assert op4.main_text(page) == f"{PROSE}\n{PROSE}"
    assert op4.main_text(page.replace(names, names.replace(" ", " and the "))) == f"{PROSE}\n{names.replace(' ', ' and the ')} All towns\n{PROSE}"


def test_html_ties_and_deep_marks():
    short = "In between"
    page = f"<p>{PROSE}</p><p>{short}</p><p><a href='/'>{PROSE}</a></p>"
    assert op4.main_text(page) == f"{PROSE}\n{short}"
    page = f"<p><a href='/'>{PROSE}</a></p><p>{short}</p><p>{PROSE}</p>"
    assert op4.main_text(page) == PROSE
    assert op4.main_text(page.replace(f"<p>{short}</p>", f"<h2>{short}</h2>")) == f"{short}\n{PROSE}"
    deep = "<div class='share'>" * 20000 + f"<p>{PROSE}</p>" + "<p class='ad'>x</p>" * 20000
    assert op4.main_text(deep) == PROSE


def test_html_odd_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert op4.extract(df).collect() == []
    rows = [(None, None, None, 1), (7, "u", f"<p>{PROSE}</p>", 2), (7, "u", f"<p>{PROSE}</p>", 2)]
    got = op4.extract(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [got[0].__class__(page_id=p, url=u, text=t, n_chars=len(t)) for p, u, t in [(None, None, ""), (7, "u", PROSE), (7, "u", PROSE)]]))


def test_encoder_of_odd_white_space_and_repeated_words():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\n ", "\t", " \t", "\x85", "​", "\x1c", "a", "word", "it's", "don", "1", "23", ".", "!?", "é", "日本", "<|endoftext|>", "'s"]
    coder = tokens.Encoder(public_tokenizers.path(tokens.DEFAULT))
    for _ in range(4):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)]
        assert coder.ids(texts) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert coder.ids([]) == [] and coder.ids(["", "word word", "word word"])[0] == b""


def test_encoder_takes_letters_past_the_splitting_of_text(monkeypatch):
    """Words of letters go to the library's merges at once; marks, digits and other letters through its pattern; a word keeps one number."""
    coder = tokens.Encoder(public_tokenizers.path(tokens.DEFAULT))
    split = []
    usual = coder._words
    monkeypatch.setattr(coder, "_words", lambda words: split.extend(words) or usual(words))
    letters = "".join(c for c in map(chr, range(0x3000)) if tokens._LETTERS(c))
    assert letters.isalpha() and len(letters) > 500
    texts = ["plain words éà Ωμέγα, plain.\nнова строка 漢字", "next\nplain, words!? x1 ϶a a϶ é " + "long" * 40, *(f"a{c} {c}b\n{c}" for c in letters), "\n", "a  b plain"]
    for _ in range(2):
        assert coder.ids(texts) == [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert {w.strip() for w in split} >= {"x1", ",", "é"} and not {w.strip() for w in split} & {"plain", "words", "éà", "строка", "漢字"}
    assert "plain" in coder.known and not any(len(w) > tokens.LONGEST_KEPT for w in coder.known)
    n = coder.known.next
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 2 * n)
    coder.ids([" ".join(f"w{i}" for i in range(3 * n))])
    texts = ["plain words of a text", "w1 w2, w3"]
    assert coder.ids(texts) == [coder._whole(t) for t in texts] and coder.known.next <= 2 * n
