"""Language, quality, decontamination, HTML and WARC."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, html, langid, quality, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# --- language ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(documents):
    return langid.train(documents)


def test_held_out_languages(spark, documents, model):
    found = langid.predict(documents, model).join(documents, "doc_id").where(langid.fold("doc_id", 4) == 2)
    rows = found.select("lang", "lang_pred", "score").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, documents, model):
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, "a"), (None, "the and of that"), (6, "the of and " * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lang_pred", "1 AS score", "'fr' AS lang")
    rows = langid.predict(df, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.score == 0 for r in rows[:3])
    assert all(r.lang_pred in model.langs for r in rows[3:]) and rows[5].lang_pred == "en"
    assert langid.confident(df, model).columns == df.columns and {r.doc_id for r in langid.confident(df, model).collect()} >= {None, 6}
    empty = langid.train(documents.where("false"))
    assert [r.lang_pred for r in langid.predict(df, empty).collect()] == ["und"] * 6


def test_mixtures(documents, model):
    text = {r.lang: r.text for r in documents.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    both = (text["en"][:1500] + "\n" + text["de"][:1500]).encode()
    lang, score, sets = langid.infer(model, [both, text["fr"].encode()])
    assert set(sets[0]) == {"en", "de"} and 0.3 < score[0] < 0.7
    assert sets[1] == {"fr": 1.0} and lang[1] == "fr"


def plain_shares(p, count, rounds):
    """EM for one document in plain numbers: p[t][l] is the likelihood of trigram t in language l."""
    k = len(p[0])
    share = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for row, c in zip(p, count, strict=True):
            whole = sum(s * x for s, x in zip(share, row, strict=True))
            for j in range(k):
                new[j] += c * share[j] * row[j] / whole
        share = [x / sum(count) for x in new]
    return share


def test_inference_equals_plain_em(documents, model):
    """Shares and chosen sets of real and mixed documents, against a loop over trigrams."""
    from math import exp, log

    texts = [r.text for r in documents.where("length(text) between 20 and 800").limit(25).collect()]
    texts += [a[:300] + "\n" + b[:300] for a, b in zip(texts, texts[7:], strict=False)]
    lang, score, sets = langid.infer(model, [t.encode() for t in texts])
    for k, text in enumerate(texts):
        _, bucket, count = langid.trigrams([text.encode()])
        count, logp = count.tolist(), model.logp[bucket].tolist()
        n, everything = sum(count), list(range(len(model.langs)))

        def likelihood(chosen, share):
            return sum(c * log(sum(s * exp(row[j]) for s, j in zip(share, chosen, strict=True))) for row, c in zip(logp, count, strict=True))  # noqa: B023

        def shares(chosen):
            return plain_shares([[exp(row[j]) for j in chosen] for row in logp], count, langid.ROUNDS)  # noqa: B023

        single = [likelihood([j], [1.0]) for j in everything]
        chosen, own = [single.index(max(single))], [1.0]
        best, cost, full = max(single), langid.PENALTY * log(max(n, 2)), shares(everything)
        if likelihood(everything, full) - best > cost:
            for more in sorted((j for j in everything if j != chosen[0]), key=lambda j: -full[j]):  # noqa: B023
                new = sorted([*chosen, more])
                share = shares(new)
                value = likelihood(new, share)
                if value - best <= cost:
                    break
                chosen, own, best = new, share, value
        want = {model.langs[j]: s for j, s in zip(chosen, own, strict=True)}
        assert set(sets[k]) == set(want) and all(abs(sets[k][x] - want[x]) < 1e-3 for x in want)
        assert lang[k] == max(sorted(want), key=want.get) and abs(score[k] - max(want.values())) < 1e-3
    assert any(len(x) == 2 for x in sets)


def test_many_languages(spark):
    """A dirty column: only the most frequent names are learned."""
    rows = [(k, "the and of that", "en") for k in range(60)] + [(100 + k, f"zz{k}", f"l{k}") for k in range(300)] + [(k, "der die das und", "de") for k in range(500, 530)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, languages=2)
    assert model.langs == ["de", "en"] and model.logp.shape == (langid.BUCKETS, 2)
    assert len(langid.train(docs, languages=40).langs) == 40


def test_trigrams_equal_brute_force():
    rows = ["Ab, c".encode(), None, b"", "Éé x".encode(), b"zz"]
    row, bucket, count = langid.trigrams(rows)
    sizes = {k: int(count[row == k].sum()) for k in range(5)}
    assert sizes == {0: 3, 1: 0, 2: 0, 3: 3, 4: 2}
    alone = [langid.trigrams([r]) for r in rows]
    assert np.array_equal(np.concatenate([a[1] for a in alone]), bucket)


# --- quality ----------------------------------------------------------------------------------------------------------


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    rows = quality.score(docs, forest).join(labels, "doc_id").where(langid.fold("doc_id", 5) == 0).collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_edges(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "x " * 200_000)], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS y", "2 AS x", "3 AS score")
    assert [r.score for r in quality.score(df, quality.train(documents, labels)).collect()] == [0.5] * 4
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(None, 0), (7, None)], "doc_id long, quality int")
    rows = quality.score(df, quality.train(documents, labels)).collect()
    assert all(r.score > 0.99 and r.predicted == 1 for r in rows) and len(rows) == 4
    assert quality.score(df.where("false"), quality.train(documents, labels)).count() == 0


def test_trees_equal_a_walk_one_by_one():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    f = quality.fit(x, y, trees=20)

    def walk(row):
        total = f.bias
        for n in f.roots:
            while f.left[n] != n:
                n = f.left[n] + (row[f.feature[n]] > f.threshold[n])
            total += f.value[n]
        return total

    assert np.allclose(quality.margins(f, x[:50]), [walk(row) for row in x[:50]])
    assert np.mean((quality.scores(f, x) > 0.5) == y) > 0.95
    assert quality.statistics([None, b"", b" "]).sum() == 0


def test_first_split_equals_brute_force():
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 4)).astype(np.float32).round(1)
    y = ((x[:, 2] > 0.3) ^ (r.random(150) < 0.1)).astype(float)
    f = quality.fit(x, y, trees=1, depth=1, bins=8, least=10, ridge=1.0, rate=0.2)
    p = y.mean()
    grad, hess = y - p, np.full(150, p * (1 - p))
    best = (0.0, None, None)
    for feature in range(4):
        for edge in np.unique(np.quantile(x[:, feature], np.linspace(0, 1, 9)[1:-1], method="lower")):
            left = x[:, feature] <= edge
            if min(left.sum(), (~left).sum()) >= 10:
                gain = sum(grad[s].sum() ** 2 / (hess[s].sum() + 1) for s in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + 1)
                best = max(best, (gain, feature, edge), key=lambda b: b[0])
    assert (f.feature[0], f.threshold[0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.allclose([f.value[f.left[0]], f.value[f.left[0] + 1]], [0.2 * grad[s].sum() / (hess[s].sum() + 1) for s in (left, ~left)])


def test_whole_query_scores_equal_a_walk(spark):
    """Scores of the whole query from statistics counted in plain Python and trees walked one by one."""
    from math import exp, log1p, log2

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(docs, forest).collect()}

    def statistics(text):
        data = text.encode()
        words, n, ink = data.split(), len(data.split()), sum(48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 32 for b in data)
        wordy = lambda b: 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128
        letters = max(1, sum(65 <= b < 91 or 97 <= b < 123 for b in data))
        size = [len(w) for w in words]
        mean = sum(size) / n
        lines = [x for x in data.split(b"\n") if x.strip()]
        odd = sum(w[-1] < 128 and not wordy(w[-1]) and chr(w[-1]) not in ".,;:?)\"'-" for w in words)
        share = [data.count(bytes([b])) / len(data) for b in set(data)]
        first = [log1p(len(data)), log1p(n), mean, (sum((x - mean) ** 2 for x in size) / n) ** 0.5, sum(65 <= b < 91 for b in data) / letters, sum(48 <= b < 58 for b in data) / ink, sum(b >= 128 for b in data) / ink]
        first += [sum(b > 32 and not wordy(b) for b in data) / ink, len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
        first += [sum(w.istitle() for w in words) / n, sum(w.isupper() for w in words) / n, odd / n, len(data) / len(lines), len(set(lines)) / len(lines), -sum(s * log2(s) for s in share)]
        return [np.float32(v) for v in first + [data.count(bytes([c])) / ink for c in b"!#$%&*|.,;:-<>{}=/@\"'()"]]

    for r in docs.where("length(text) between 1 and 3000").limit(60).collect():
        x, total = statistics(r.text), forest.bias
        for n in forest.roots.tolist():
            while forest.left[n] != n:
                n = int(forest.left[n] + (x[forest.feature[n]] > forest.threshold[n]))
            total += forest.value[n]
        score = 1 / (1 + exp(-total))
        assert abs(got[r.doc_id][0] - score) < 1e-6 or any(abs(a - t) < 1e-5 for a in x for t in forest.threshold), r.doc_id
        assert got[r.doc_id][1] == int(got[r.doc_id][0] >= 0.3)
    assert len(got) == docs.count()


def test_repeated_documents_and_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once = quality.train(documents, labels, sample=60)
    again = quality.train(documents.unionByName(documents).unionByName(documents), labels, sample=60)
    assert np.array_equal(once.threshold, again.threshold) and np.array_equal(once.value, again.value)


# --- decontamination --------------------------------------------------------------------------------------------------

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "2 AS tiles")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontam.clean(d, b, **options).collect()} == {i for i, _ in docs} - {r.doc_id for r in decontam.contaminated(d, b, **options).collect()}
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b, **options).collect()}


@pytest.mark.parametrize("slots", [decontam.MOST_SLOTS, decontam.FEWEST_SLOTS, 64])
def test_contamination(spark, monkeypatch, slots):
    """Also where the bitmap rules nearly nothing out."""
    monkeypatch.setattr(decontam, "MOST_SLOTS", slots)
    monkeypatch.setattr(decontam, "FEWEST_SLOTS", min(slots, decontam.FEWEST_SLOTS))
    half = ITEM.split()
    docs = [
        (1, f"before {ITEM.upper()}! after"), (2, " ".join(half[10:] + ["x"] + half[:10])), (3, "quite another text of some length indeed"), (4, " ".join(half[:6])), (5, None), (6, ""),
        (7, "filler " * 100_000 + ITEM.replace(" ", ", ")), (8, " ".join(half[:12])), (9, "one two three four"),
    ]
    got = found(spark, docs, [(10, ITEM), (11, "too short"), (12, None), (13, "unrelated words that no document has at all")])
    assert set(got) == {(1, 10), (2, 10), (7, 10), (8, 10)}
    assert got[2, 10].tiles == 2 and got[2, 10].coverage == 1.0 and got[8, 10].matched_words == 12


def plain_words(text):
    """Words by their own rule: runs of letters and digits, ideographs and kana one by one."""
    out, word = [], ""
    for c in (text or "").lower():
        alone = any(a <= c <= b for a, b in (("\u3040", "\u30ff"), ("\u3400", "\u4dbf"), ("\u4e00", "\u9fff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff")))
        if alone or not c.isalnum():
            out += [word] * (word != "") + [c] * (alone and c.isalnum())
            word = ""
        else:
            word += c
    return out + [word] * (word != "")


def brute_contaminated(docs, items, least=5, coverage=0.5):
    """(doc, item, matched words, item's words, tiles), by tiling every pair that has a run in common."""
    runs = lambda w: {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
    items = [(i, w := plain_words(t), runs(w)) for i, t in items]
    out = []
    for i, t in docs:
        words = plain_words(t)
        own = runs(words)
        for item, other, theirs in items:
            if own & theirs:
                lengths = [n for *_, n in brute_tiles(other, words, least)]
                if sum(lengths) >= coverage * len(other):
                    out.append((i, item, sum(lengths), len(other), len(lengths)))
    return sorted(out, key=str)


def test_words_of_many_scripts():
    for text in ("It’s “quoted” — a\u00a0b_c d.e 12,5", "漢字テスト and カナ漢", "ÉÀ ǅ ß x²", "", None, "_ _a_ "):
        got = decontam.folded(None if text is None else text.encode()).split()
        assert got == [w.encode() for w in plain_words(text)]


def test_whole_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    r = np.random.default_rng(5)
    for k, (_, text) in enumerate(items[:25]):
        w = text.split()
        cut = int(r.integers(0, len(w)))
        share = float(r.uniform(0.3, 0.8))
        docs.append((10_000 + k, " ".join(["lead", *w[cut:], "gap", *w[:cut], "end"])))
        docs.append((20_000 + k, " ".join(w[: int(share * len(w))] + ["other"] + w[: int(0.3 * len(w))])))
    chinese = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"
    items += [(900, items[0][1]), (901, items[0][1]), (None, items[1][1]), (902, chinese), (903, "a b a b a b a b a b a b"), (904, "few words only")]
    docs += [(None, items[2][1]), (30_000, f"“{chinese[:14]}”，…"), (30_001, chinese[:7]), (30_002, "b a b a b a b " * 30), docs[-1], (30_003, "a few words only")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, x.matched_words, x.item_words, x.tiles) for x in decontam.contaminated(d, b).collect()]
    want = brute_contaminated(docs, items)
    assert sorted(got, key=str) == want and len(want) > 40
    bad = {i for i, *_ in want}
    assert sorted(map(str, (x.doc_id for x in decontam.clean(d, b).collect()))) == sorted(str(i) for i, _ in docs if i not in bad)


def test_one_document_holds_the_benchmark(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12)) + " shared words at the end") for k in range(200)]
    docs = [(1, "\n".join(t for _, t in items)), (2, "shared words at the end " * 500), *((3 + k, items[7][1]) for k in range(30))]
    got = found(spark, docs, items)
    assert set(got) == {(1, k) for k, _ in items} | {(3 + k, 7) for k in range(30)} and all(r.matched_words == 17 for r in got.values())


def test_no_benchmark(spark):
    assert found(spark, [(1, ITEM)], []) == {}
    assert found(spark, [], [(1, ITEM)]) == {}


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        i, j, n = best
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        out.append(best)


@pytest.mark.parametrize("seed", range(6))
def test_tiling_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    a, b = (r.integers(1, 3, n).astype(np.uint64) for n in (30, 45))
    assert [n for *_, n in decontam.tiles(a, b, 3)] == [n for *_, n in brute_tiles(a.tolist(), b.tolist(), 3)]
    assert decontam.tiles(a, b, 3) == brute_tiles(a.tolist(), b.tolist(), 3)


# --- HTML -------------------------------------------------------------------------------------------------------------


def plain_article(page):
    """What the article of a page of the driver's shape says, by plain string work."""
    from html import unescape

    page = re.sub(r"<(?:!|/?[A-Za-z])[^<>]*\Z", "", page)
    if "<article>" not in page:
        return ""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
    parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(x for x in parts if x)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_articles_of_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages).collect()}
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>Hi &amp; bye", "Hi & bye"), ("<nav>menu</nav><p>a  b\n c</p><footer>f</footer>", "a b c"), ("<body><div class='sidebar'>s</div><div><p>long enough text of a page</p><p>x</p></div>", "long enough text of a page\nx"),
        ("<article><header><h1>T</h1></header><p>One<br>two</p><section class='comments'><p>me first</p></section></article>", "T\nOne\ntwo"), ("<script>x</script><style>y</style><main>m<form>f</form></main><aside>z</aside>", "m"),
        ("<div id='cookie-notice'>we use</div><article>text<div class='ad'>buy</div> more</article>", "text\nmore"), ("<article>cut off<p", "cut off"), ("<ul class=menu><li>a</ul>", ""), ("<article><p>a<p>b<li>c</article>", "a\nb\nc"),
        ("<p>1 &lt; 2 &#x41; &nbsp;</p>", "1 < 2 A"),
    ],
)
def test_pages(page, want):
    assert html.main_text(page) == want


PARAGRAPH = "<p>" + "words of a paragraph that goes on " * 8 + "</p>"
LINKS = "".join(f"<p><a href=/{k}><b>a linked title, number {k}</b></a></p>" for k in range(40))
PLAIN = f"<body><div>{LINKS}</div><div><h1>Title</h1><div>{PARAGRAPH * 2}</div><div><p>A short end.</p></div></div><div>{LINKS}</div></body>"


def test_ratios_choose_the_region_where_no_tag_does():
    got = html.main_text(PLAIN)
    assert got.startswith("Title\nwords of") and got.endswith("\nA short end.") and "linked" not in got
    # without the threshold every line is content-like, and the links are given out too
    assert "linked title, number 3" in html.main_text(PLAIN, share=-99)
    # without smoothing the short last line is cut off
    assert "short end" not in html.main_text(PLAIN, sigma=1e-3)


def test_sections_of_a_page_without_article():
    sections = "".join(f"<div><h2>Part {k}</h2>{PARAGRAPH}</div>" for k in range(5))
    page = f"<body><table><tr><td>{LINKS}</td><td>{sections}</td></tr></table></body>"
    assert [x for x in html.main_text(page).split("\n") if x.startswith("Part")] == [f"Part {k}" for k in range(5)] and "linked" not in html.main_text(page)


def test_tags_correct_what_ratios_choose():
    page = f"<body><div class=comments>{PARAGRAPH * 9}</div><article><h1>T</h1><p>Short <span class='ad'>buy <b>now</b></span>text<script>var x</script>.</p>{PARAGRAPH}<aside>{PARAGRAPH}</aside><p>z</p></article></body>"
    text = html.main_text(page)
    assert text.startswith("T\nShort text.\nwords") and text.endswith("\nz") and text.count("words of") == 8


def test_html_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x</p>" * 50_000)], "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 AS text", "2 AS n_chars")
    rows = html.extract(df).collect()
    assert (rows[0].text, rows[0].n_chars) == ("", 0) and rows[1].n_chars == 99_999
    assert html.extract(df.where("false")).count() == 0
    s = html.smoothed(np.array([0.0, 0, 10, 0, 0]))
    assert s.argmax() == 2 and s[0] < s[1] < s[2] and abs(html.smoothed(np.ones(9)) - 1).max() < 1e-12


# --- WARC -------------------------------------------------------------------------------------------------------------


def pages(spark, n=300):
    return spark.range(n).select((F.col("id") * 37 - 500).alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("<p>é"), F.repeat(F.lit("ab"), (F.col("id") % 50).cast("int"))).alias("html"))


def test_equal_replicas(spark):
    a = warc.leaves(warc.archive(pages(spark)))
    assert a.count() == 300 and warc.audit(a, warc.leaves(warc.archive(pages(spark).repartition(7)))).count() == 0
    none = warc.leaves(warc.archive(pages(spark).where("false")))
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(none, a).collect()} == {"extra"} and warc.audit(a, none).where("status = 'missing'").count() == 300


def test_damage_is_located(spark):
    def damage(page_id, data):
        if page_id == 55:
            return None
        if page_id == 92:
            return data[:-6] + b"?" + data[-5:]
        return data[:-30] if page_id == -500 else data

    mine, other = (warc.leaves(warc.archive(pages(spark), d)) for d in (None, damage))
    rows = {r.page_id: r for r in warc.audit(mine, other).collect()}
    assert {k: r.status for k, r in rows.items()} == {55: "missing", 92: "corrupt", -500: "corrupt"}
    stored = warc.archive(pages(spark)).where("segment = 0").orderBy("part").first().data
    assert stored[rows[92].offset : rows[92].offset + rows[92].length].startswith(b"WARC/1.0\r\n") and b"<urn:page:92>" in stored[rows[92].offset :][:200]


def test_warc_edges(spark):
    df = spark.createDataFrame([(None, None, None), (5, "u", None), (5, "u", None), (6, "u", "WARC/1.0\r\nin the body\r\n\r\nWARC/1.0\r\n"), (7, "u", "z" * 6_000_000)], "page_id long, url string, html string").selectExpr("*", "1 AS segment", "2 AS part", "3 AS data")
    a = warc.leaves(warc.archive(df))
    assert sorted(r.page_id for r in a.collect()) == [-1, 5, 5, 6, 7]
    once = warc.leaves(warc.archive(df.dropDuplicates(["page_id"])))
    assert [(r.page_id, r.status) for r in warc.audit(a, once).dropDuplicates(["page_id"]).collect()] == [(5, "missing")]
    assert warc.audit(a, a).count() == 0


def test_null_ids_are_spread(spark):
    df = spark.range(2000).selectExpr("IF(id % 3 = 0, null, id) AS page_id", "concat('u', id) AS url", "repeat('x', 100) AS html")
    stored = warc.archive(df)
    assert stored.where("segment < -(1L << 61)").select("segment").distinct().count() > 400
    a, b = warc.leaves(stored), warc.leaves(warc.replica(stored))
    nulls = a.where("page_id = -1")
    assert nulls.count() == 667 and nulls.select("key").distinct().count() == 667 and warc.audit(a, b).count() == 0
    lost = nulls.orderBy("key").first()
    rows = warc.audit(a, b.where(F.col("key") != lost.key)).collect()
    assert [(r.page_id, r.status, r.digest) for r in rows] == [(-1, "missing", lost.digest)]


def test_bytes_before_the_first_record_are_found(spark):
    stored = warc.archive(pages(spark))
    junk = stored.withColumn("data", F.when((F.col("segment") == 0) & (F.col("part") == 0), F.concat(F.lit(b"junk"), "data")).otherwise(F.col("data")))
    rows = warc.audit(warc.leaves(stored), warc.leaves(junk)).collect()
    assert [(r.page_id, r.status, r.offset, r.length) for r in rows] == [(None, "extra", 0, 4)]
    rows = warc.audit(warc.leaves(junk), warc.leaves(stored)).collect()
    assert [(r.page_id, r.status, r.offset, r.length) for r in rows] == [(None, "missing", 0, 4)]


def test_replica_is_a_copy(spark):
    stored = warc.archive(pages(spark))
    assert sorted(map(tuple, warc.replica(stored).collect())) == sorted(map(tuple, stored.collect()))
    nothing = warc.replica(stored, lambda page, data: None)
    assert warc.audit(warc.leaves(stored), warc.leaves(nothing)).where("status = 'missing'").count() == 300


def test_many_versions_of_a_page(spark):
    """A third of all rows under one id: their digests are added up, not gathered."""
    df = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS page_id", "'u' AS url", "concat('v', id) AS html")
    a = warc.leaves(warc.archive(df))
    gone = a.where("page_id = 7").orderBy("digest").first()
    rows = warc.audit(a, a.where(F.col("digest") != gone.digest)).collect()
    assert {(r.page_id, r.status, r.digest) for r in rows} == {(7, "corrupt", gone.digest)}


def test_records_of_damaged_bytes():
    data = warc.record(1, b"u", b"x" * 100) + b"garbage" + warc.record(2, b"u", b"y")
    assert [_id(h) for *_, h in warc.records(data)] == [1, 2]
    assert [_id(h) for *_, h in warc.records(data[:60])] == [1] and list(warc.records(b"")) == [] and list(warc.records(b"no records")) == []


def _id(header):
    return int(warc._ID.search(header)[1])
