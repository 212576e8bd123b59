"""Decontamination, PII, toxicity, token counts, HTML: small cases and brute force."""

import datetime
import html
import pathlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import decontamination as D
from tessera.llm import html as H
from tessera.llm import pii as P
from tessera.llm import token_counts as C
from tessera.llm import toxicity as T
from tessera.llm.words import PUNCTUATION, words


def hashed(text):
    return words(pa.array([text]), PUNCTUATION)[0]


def greedy(item, doc, mml):
    """Greedy string tiling as it is defined: the longest free match again and again."""
    free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and item[a + n] == doc[b + n] and free_i[a + n] and free_d[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < mml:
            return total
        total += n
        for i in range(n):
            free_i[a + i] = free_d[b + i] = False


def test_tiles_cover_what_greedy_tiling_covers():
    r = random.Random(4)
    for few in [12] * 60 + [2, 3, 4] * 20:
        item = [f"v{r.randrange(few)}" for _ in range(r.randrange(5, 40))]
        doc = [f"v{r.randrange(few)}" for _ in range(r.randrange(30))]
        for _ in range(r.randrange(4)):
            a = r.randrange(len(item))
            doc[r.randrange(len(doc) + 1) : 0] = item[a : a + r.randrange(3, 20)]
        tiles = D.tile(hashed(" ".join(item)), hashed(" ".join(doc)), 4)
        assert sum(n for _, _, n in tiles) == greedy(item, doc, 4)
        for a, b, n in tiles:
            assert n >= 4 and item[a : a + n] == doc[b : b + n]
        assert len({i for a, _, n in tiles for i in range(a, a + n)}) == sum(n for _, _, n in tiles)


def test_decontamination(spark):
    item = " ".join(f"token{i}" for i in range(30))
    halves = item.split()
    docs = [(1, f"before {item.upper()}, after", "x"), (2, "clean text of other words", "x"), (3, " ".join(halves[15:] + ["between"] + halves[:15]), "x"), (4, None, "x"), (5, "", "x"), (6, "tiny item", "x"), (None, item, None), (7, " ".join(halves[:8]), "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "tiny item"), (9, item), (None, "zz")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in D.tiled(docs, bench).collect()}
    assert [d for d, r in sorted(rows.items(), key=str) if r["contaminated"]] == [1, 3, 6, None]
    assert rows[1]["item_id"] == 9 and rows[3]["coverage"] == 1.0 and rows[2]["item_id"] is None
    in_blocks = {r["doc_id"]: tuple(r) for r in D.tiled(docs, bench, block_bytes=64).select(*D.ARROW.names).collect()}
    assert in_blocks == {k: tuple(v) for k, v in rows.items()}
    assert sorted(r["doc_id"] for r in D.without_contaminated(docs, bench, block_bytes=64).collect()) == [2, 4, 5, 7]
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7]
    assert D.tiled(docs, bench.limit(0)).where("contaminated = 1").count() == 0
    assert D.tiled(docs.limit(0), bench).count() == 0


def test_blocks_keep_repeated_and_missing_ids(spark):
    item = " ".join(f"token{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item), (1, "clean"), (1, item), (None, "clean too"), (None, item), (None, None), (2, "x " * 50000 + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"other{i}x{j}" for j in range(30))) for i in range(20)] + [(50, item), (50, item)], "item_id long, text string")
    one = sorted(map(tuple, D.tiled(docs, bench).select(*D.ARROW.names).collect()), key=str)
    many = sorted(map(tuple, D.tiled(docs, bench, block_bytes=1500).select(*D.ARROW.names).collect()), key=str)
    assert one == many and len(one) == 7 and sum(r[1] for r in one) == 4


def test_pseudonyms_keep_formats_and_links():
    run = P.pseudonymiser(b"k")
    card = "4111 1111 1111 1111"
    a, n = run(f"card {card} and 4111-1111-1111-1111.")
    assert n == 2
    first, second = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", a)
    assert first.replace(" ", "") == second.replace("-", "") != card.replace(" ", "")
    digits = first.replace(" ", "")
    assert P.luhn(digits[:-1]) == digits[-1]
    iso, _ = run("on 2021-03-04")
    dotted, _ = run("am 04.03.2021")
    day = datetime.date.fromisoformat(iso[3:])
    assert dotted == f"am {day:%d.%m.%Y}"
    assert run("GB82 WEST 1234 5698 7654 32")[1] == 1 and P.iban(P.iban("GB82WEST12345698765432", b"k"), b"k")
    for plain in ("4111 1111 1111 1112", "2021-13-45", "300.1.1.1", "version 1.2.3", "000-12-3456", "a @ b", "12345", ""):
        assert run(plain) == (plain, 0)
    for value in ("10.20.30.40", "+1 (136) 555-7479", "(212) 555-1234", "jo.2@mail.example.org", 'token = "f3ef4d6b2755a36d7d9c"', "123-45-6789"):
        out, n = run(f"x {value} y")
        assert n == 1 and out != f"x {value} y" and len(out.split()) == len(f"x {value} y".split())
        assert run(f"x {value} y")[0] == out
    assert P.pseudonymiser(b"other")("x 10.20.30.40")[0] != run("x 10.20.30.40")[0]


def test_values_beside_other_values_are_found():
    run = P.pseudonymiser(b"k")
    new = lambda v: run(v)[0]
    phone, ip, card, iban = "+1 (826) 555-4081", "190.137.223.204", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"
    for values in ([phone, ip], [ip, phone], [card, "190.1.2.3"], [card, ip, phone], [iban, card], [phone, "123-45-6789", "2021-03-04"]):
        assert run(" ".join(values)) == (" ".join(map(new, values)), len(values))
    for rest in ("123", "7", "12 3", "ABCD"):
        assert run(f"{card} {rest}") == (f"{new(card)} {rest}", 1)
    assert run(f"{iban} ABCD") == (f"{new(iban)} ABCD", 1)
    assert run(f"no. 1234 {card}") == (f"no. 1234 {new(card)}", 1)
    assert run("+1 (826) 555-4081 1234 5678") == (f"{new(phone + ' 1234')} 5678", 1)
    assert run("41111111111111112") == ("41111111111111112", 0)  # no end within a run of digits


def test_dates_stay_linked_in_every_notation():
    run = P.pseudonymiser(b"k")
    day = datetime.date(1999, 1, 13)
    for _ in range(200):
        day += datetime.timedelta(days=37)
        new = datetime.date.fromisoformat(run(day.isoformat())[0])
        assert run(f"{day:%d.%m.%Y}")[0] == f"{new:%d.%m.%Y}"
        if day.day > 12:
            assert run(f"{day:%m/%d/%Y}")[0] == f"{new:%m/%d/%Y}"
            assert run(f"{day.day}/{day.month}/{day.year}")[0] in (f"{new.day}/{new.month}/{new.year}", f"{new:%d/%m/%Y}")


def test_phones_keep_their_country_and_other_notations_are_found():
    run = P.pseudonymiser(b"k")
    for value, code in (("+15551234567", "+1"), ("+442079460958", "+44"), ("+351210000000", "+351"), ("+44 20 7946 0958", "+44")):
        out, n = run(f"call {value}")
        assert n == 1 and out.startswith(f"call {code}") and out != f"call {value}"
    assert run("+1 (555) 123-4567")[0].translate({ord(c): None for c in " ()-"}) == run("+15551234567")[0]
    assert run("call 555-123-4567 or 555.123.4568")[1] == 2
    out, n = run("SSN 123 45 6789, social security number: 123456789, 123-45-6789")
    a, b, c = re.findall(r"[0-9][0-9 -]{8,}", out)
    assert n == 3 and a.replace(" ", "") == b == c.replace("-", "") != "123456789"


def test_long_values_are_read_whole():
    run = P.pseudonymiser(b"k")
    for n in (64, 128, 230, 260, 320, 5000, 200_000):
        text = f"key: {'ab' * (n // 2)}"
        out, found = run(text)
        assert found == 1 and len(out) == len(text) and out != text
        text = f"{'ab' * (n // 2)}@example.org"
        out, found = run(text)
        assert found == 1 and len(out) == len(text) and out != text and out.endswith("@example.org")


@pytest.mark.parametrize("size", [1, 2, 10, 1000, 2**20 + 7, 2**1100])
def test_feistel_permutes(size):
    some = range(min(size, 1000))
    out = {P.feistel(x, size, b"k", "t") for x in some}
    assert len(out) == len(some) and all(0 <= x < size for x in out)


def test_pii_keeps_rows_and_columns(spark):
    rows = [(1, "mail a1@b.org", "z", 9), (2, None, None, None), (3, "", "", 0), (3, "", "", 0), (4, "long " * 20000 + "10.0.0.1", "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mine string, n_pii long")
    out = P.pseudonyms(docs, b"k")
    assert out.columns == ["doc_id", "text", "_mine", "n_pii"]
    assert sorted((r["doc_id"], r["n_pii"]) for r in out.collect()) == [(1, 1), (2, 0), (3, 0), (3, 0), (4, 1)]
    assert P.pseudonyms(docs.limit(0), b"k").count() == 0


def test_secrets_of_letters_alone_stay_linked(spark):
    texts = ["Password: abcdefabcdefabcd", "on 2 sheets, Password: abcdefabcdefabcd", "no secret here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in P.pseudonyms(docs, b"k").collect()}
    assert [got[i]["n_pii"] for i in range(4)] == [1, 1, 0, 0]
    assert got[0]["text"] != texts[0] and got[1]["text"] == f"on 2 sheets, {got[0]['text']}" and got[3]["text"] is None


def toxic_corpus():
    r = random.Random(8)
    common, bad = [f"w{i}" for i in range(200)], ["vile", "rotten", "nasty"]
    docs, labels = [], []
    for i in range(1500):
        text = [r.choice(common) for _ in range(r.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            text[r.randrange(len(text))] = r.choice(bad).upper() + "!"
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    extra = [(5000, None), (5001, ""), (None, "vile"), (5002, "Rotten"), (5002, "Rotten")]
    d = spark.createDataFrame([(*x, 1.0) for x in docs + extra], "doc_id long, text string, score double")
    y = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    rows = T.toxicity(d, y).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert [r["predicted"] for r in rows if r["doc_id"] == 5002] == [1, 1]
    assert {r["predicted"] for r in rows if r["doc_id"] in (5000, 5001)} == {0}
    kept = T.without_toxic(d, y)
    assert kept.columns == d.columns and kept.where("doc_id = 5002").count() == 0 and kept.where("doc_id in (5000, 5001)").count() == 2
    none = T.toxicity(d, y.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    assert T.toxicity(d.limit(0), y).count() == 0


def test_nearest_is_exact():
    r = np.random.default_rng(0)
    n, terms = 700, np.sort(r.integers(0, 1 << 62, 40).astype(np.uint64))
    vectors = []
    for _ in range(n):
        t = np.sort(r.choice(40, r.integers(0, 6), replace=False))
        vectors.append((t, r.integers(1, 4, len(t)).astype(float)))
    index = T.Index(terms, r.random(40) + 1, list(range(n)), np.zeros(n), vectors, 10)
    for e in range(0, n, 13):
        t, w = index.vectors[e]
        if len(t):
            mine = dict(zip(t.tolist(), w.tolist()))
            all_ = [(sum(mine.get(a, 0) * b for a, b in zip(t2.tolist(), w2.tolist())), -j) for j, (t2, w2) in enumerate(index.vectors) if j != e]
            want = sorted((s for s, _ in all_ if s > 0), reverse=True)[:10]
            assert np.allclose([s for s, _ in index.nearest([(t, w)], [e])[0]], want, atol=1e-9)


def test_copies_of_toxic_examples_are_found_without_telling_words(spark):
    docs, labels = toxic_corpus()
    clean = [w for w, (_, y) in zip(docs, labels) if not y]
    ids = iter(range(6000, 7000))
    teaching = [i for i in ids if zlib.crc32(str(i).encode()) % 3 != 1][:10]
    # Words of their own, each in one toxic example: no evidence of many documents tells them.
    texts = [" ".join(f"own{i}x{j}" for j in range(8)) + " w1 w2" for i in teaching]
    held = [i for i in range(7000, 7100) if zlib.crc32(str(i).encode()) % 3 == 1][:10]
    d = spark.createDataFrame([*docs, *zip(teaching, texts), *zip(held, texts), (8000, clean[5][1])], "doc_id long, text string")
    y = spark.createDataFrame([*labels, *((i, 1) for i in teaching)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in T.toxicity(d, y).where("doc_id >= 6000").collect()}
    assert [got[h]["nearest"] for h in held] == teaching
    assert all(got[h]["score"] > 2 * got[8000]["score"] for h in held)


def test_scores_equal_brute_force(spark):
    docs, labels = toxic_corpus()
    docs, labels = [*docs[:400], (9001, docs[6][1]), (9002, docs[6][1]), (9003, "new words only"), (9004, "w1 " * 30000)], [*labels[:400], (9001, 0), (9002, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    teaches = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    rows = {}
    for i, label in labels:
        if teaches(i):
            key = (tuple(sorted(split(dict(docs)[i]))), label)
            rows[key] = min(rows.get(key, i), i)
    examples = sorted((i, label, words) for (words, label), i in rows.items())
    conflict = [label for _, label, words in examples if words == tuple(sorted(split(docs[6][1])))]
    assert conflict == ([1, 0] if teaches(6) else [0])
    vocabulary = sorted({w for _, _, words in examples for w in words})
    at = {w: j for j, w in enumerate(vocabulary)}
    count = lambda words: np.bincount([at[w] for w in words if w in at], minlength=len(vocabulary))
    c = np.array([count(words) for _, _, words in examples])
    label = np.array([y for _, y, _ in examples])
    p, n = label.sum(), (1 - label).sum()
    g = np.zeros(len(vocabulary))
    for a, total, of in ((c[label == 1] > 0, p, 1), (c[label == 0] > 0, n, 0)):
        share = (c > 0).mean(axis=0)
        for seen, expected in ((a.sum(axis=0), total * share), (total - a.sum(axis=0), total * (1 - share))):
            g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    everything = np.array([count(split(t)) for _, t in docs])
    weight = (np.log((1 + len(docs)) / (1 + (everything > 0).sum(axis=0))) + 1) * (1 + g)

    def unit(c):
        w = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * weight
        return w / max(1e-300, np.sqrt((w * w).sum()))

    e = np.array([unit(row) for row in c])
    index = T.fit(d, y, 8000, 25)
    got = {r["doc_id"]: r for r in T.toxicity(d, y).collect()}
    for (i, _), row in zip(docs, everything, strict=True):
        cosine = np.round(e @ unit(row), 12)
        order = [j for j in np.lexsort((np.arange(len(e)), -cosine))[:25] if cosine[j] > 0]
        near = 1 / (1.05 - np.minimum(1, cosine[order]))
        vote = ((near * label[order]).sum() + 2 * index.rest) / (near.sum() + 2) if order else index.rest
        vote = min(1 - 1e-3, max(1e-3, vote))
        assert np.isclose(got[i]["score"], 1 / (1 + np.exp(-(index.slope * np.log(vote / (1 - vote)) + index.shift))), atol=1e-6), i
        assert got[i]["nearest"] == (examples[order[0]][0] if order else None)


def test_nearest_is_exact_with_many_blocks():
    r = np.random.default_rng(1)
    n, width = 3000, 1500
    vectors = []
    for e in range(n):
        t = np.sort(r.choice(width, r.integers(1, 30), replace=False, p=np.arange(width, 0, -1) / (width * (width + 1) / 2)))
        vectors.append((t, r.integers(1, 4, len(t)).astype(float)))
    index = T.Index(np.arange(width).astype(np.uint64), r.random(width) * 9 + 1, list(range(n)), np.zeros(n), vectors, 10)
    dense = np.zeros((n, width))
    for e, (t, w) in enumerate(index.vectors):
        dense[e, t] = w
    asked = list(range(0, n, 47))
    assert len(asked) <= T.TOGETHER and index.spot.size
    for e, got in zip(asked, index.nearest([index.vectors[e] for e in asked], asked), strict=True):
        score = np.round(dense @ dense[e], 12)
        score[e] = 0
        assert np.allclose([s for s, _ in got], np.sort(score[score > 0])[::-1][:10], atol=1e-9)
        assert all(np.isclose(s, score[i], atol=1e-9) for s, i in got)


def test_token_counts_equal_greedy_matching(spark):
    vocabulary = set(C.pieces())
    longest = max(map(len, vocabulary))
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def count(word):
        symbols, n = (*word, C.MARK), 0
        while symbols:
            size = next((k for k in range(min(longest, len(symbols)), 1, -1) if symbols[:k] in vocabulary), 1)
            symbols, n = symbols[size:], n + 1
        return n

    texts = ["The quick brown fox", None, "", " \n", "antidisestablishmentarianism's ünïcödé 😀 ***&&&", "aaaa" * 500, "x\x85y", "Ça déjà-vu 12345"]
    texts += ["".join(random.Random(i).choices("abehinorst \n", k=300)) for i in range(20)]
    rows = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, "a", 2)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in C.token_counts(rows).collect()}
    for i, t in enumerate(texts):
        split = (t or "").encode().translate(fold).split()
        assert got[i] == (len(split), sum(map(count, split))), t
    assert got[None] == (1, 1)


def test_small_automaton():
    a = C.Automaton([(1,), (1, 2, 3), (2, 3, 4, 5), (1, 2)])
    raw = np.array([1, 2, 3, 4, 1, 2, 3, 1, 2, 4, 5], np.uint8)
    assert a.counts(raw, np.array([0, 4, 7]), np.array([4, 7, 11])).tolist() == [3, 2, 4]


def test_html_blocks():
    page = '<body><nav class="Top-menu"><a href="/">Home</a></nav><!-- x --><article><h1>A &amp;\n B</h1><p>one<br>two <b>three<p>four</article><script>var t="</p>";</script><footer>&copy; me</footer>'
    assert [b[0] for b in H.blocks(page)] == ["Home", "A & B", "one two three", "four", "© me"]
    assert H.main_text(page, H.trained()) == "A & B\n\none two three\n\nfour"
    assert H.main_text(None, H.trained()) == "" and H.main_text("", H.trained()) == "" and H.main_text("<p>", H.trained()) == ""


@pytest.mark.parametrize("element", ["iframe src='x'", "svg", "object data=x", "button", "canvas", "select", "template", "noscript", "math", "audio"])
def test_html_unclosed_elements_swallow_no_paragraph(element):
    page = f"<article><h1>Title of it</h1><p>First words.</p><{element}><p>Second words.</p></article>"
    assert [b[0] for b in H.blocks(page)] == ["Title of it", "First words.", "Second words."]
    name = element.split()[0]
    if name != "math":
        assert [b[0] for b in H.blocks(page.replace(f"<{element}>", f"<{element}>unseen</{name}>"))] == ["Title of it", "First words.", "Second words."]


@pytest.mark.parametrize("unit", ["<a '", "<a =' ", "<!", "<!--", "<", "<a ", "<svg>", "<template>", "<a x='>'><a \">", "</"])
def test_html_parsing_is_linear(unit):
    began = time.process_time()
    H.blocks(unit * 50_000 + "<p>x</p>")
    assert time.process_time() - began < 3


def test_html_tags_with_quotes_and_brackets():
    texts = lambda page: [b[0] for b in H.blocks(page)]
    assert texts("<p title='a > b'>one</p><p don't>two</p><p class=\"x>three</p><p>four <b attr='<i>'>five</b> 1 < 2</p>") == ["one", "two", "three", "four five 1 < 2"]
    assert texts("<p>" + "long " * 200_000 + "</p>") == [("long " * 200_000).strip()]
    assert texts("<p>x<script>var a = '<p>no</p>'</script>y</p><style>p{}") == ["x y"]


def test_main_text_of_the_pages_table():
    """The table's articles are what lies inside its article element, split at block-level tags."""
    table = pathlib.Path("/root/testdata/sf0.01/pages.parquet")
    if not table.exists():
        pytest.skip("no pages")
    right = 0
    rows = pq.read_table(table, columns=["html"]).column("html").to_pylist()
    for page in rows:
        inside = re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", p) for p in re.split(r"</?(?:p|h[1-6]|ul|li|div)\b[^>]*>", inside)]
        want = "\n\n".join(t for t in (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts) if t)
        right += H.main_text(page, H.trained()) == want
    assert right / len(rows) > 0.98


def test_html_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>Some words here.</p></article>", "mine", 5)], "page_id int, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in H.extract(rows).collect()] == [(1, "u", "Some words here.", 16)]


def test_html_held_out():
    crf, wrong, n = H.trained(), 0, 0
    for page, labels in H.labelled_pages(60, seed=1234):
        found = H.blocks(page)
        if [b[0] for b in found] == [re.sub(r"\s+", " ", t).strip() for t, _ in labels]:
            out = crf.decode([crf.row(b) for b in found])
            wrong, n = wrong + sum(a != b for a, (_, b) in zip(out, labels, strict=True)), n + len(out)
    assert n > 500 and wrong / n < 0.03


def test_viterbi_is_the_best_labelling():
    import itertools

    crf = H.Crf(["a", "b"])
    crf.weight, crf.change = np.array([1.5, -2.0, 0.2]), np.array([[0.3, -1.0], [-0.7, 0.9]])
    rows = [[0], [1], [], [0, 1], [1]]

    def score(y):
        s = sum((crf.weight[r].sum() + crf.weight[-1]) * k for r, k in zip(rows, y))
        return s + sum(crf.change[a, b] for a, b in zip(y, y[1:]))

    assert tuple(crf.decode(rows)) == max(itertools.product((0, 1), repeat=5), key=score)


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>x y"), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (1, "u", "<article><p>x y")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in H.extract(rows).collect())
    assert [t for t in got if t[0] in ("2", "3")] == [("2", "", 0), ("3", "", 0)] and len(got) == 5
    assert H.extract(rows.limit(0)).count() == 0
