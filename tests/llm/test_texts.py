import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chunks, kernels, language, latent, pages, pii
from ledgerlens.llm.kernels import Words

DOCS = "doc_id long, text string, spans string, score string, row string"
WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "ne", "ru") for b in ("l", "m", "st", "v") for c in ("an", "ere", "io", "us", "y")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def test_chunks_resist_insertions():
    rng = random.Random(2)
    text = prose(rng, 400)

    def cut(t):
        data, offsets = chunks.column_bytes(pa.array([t]))
        ends = chunks.borders(data, offsets).tolist()
        assert ends[-1] == len(t.encode())
        return {t.encode()[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    whole = cut(text)
    assert len(whole & cut(text[:1000] + "inserted" + text[1000:])) >= len(whole) - 4
    assert max(map(len, cut("a" * 5000))) <= chunks.MOST


def test_rows_do_not_touch_each_other():
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 200)) for _ in range(30)] + ["", "é" * 50]
    data, offsets = chunks.column_bytes(pa.array(texts))
    together = chunks.borders(data, offsets)
    for i, t in enumerate(texts):
        own = chunks.borders(*chunks.column_bytes(pa.array([t])))
        a, b = offsets[i], offsets[i + 1]
        assert (together[(together > a) & (together <= b)] - a).tolist() == own.tolist()


def test_repeated_spans(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80), "", "", "") for i in range(20)]
    rows += [(20 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}", "", "", "") for i in range(4)]
    rows += [(30, None, "", "", ""), (31, "", "", "", ""), (32, "short line", "", "", ""), (33, "short line", "", "", ""), (40, passage, "", "", ""), (40, passage, "", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    spans = chunks.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {21, 22, 23, 40} and {r.first_doc_id for r in spans} == {20}
    texts = {d: t for d, t, *_ in rows}
    for r in spans:
        assert texts[r.doc_id].encode()[r.start_byte : r.end_byte].decode() in texts[20]
    left = chunks.without_spans(df.where("doc_id = 22"), chunks.repeated_spans(df).where("doc_id = 22")).collect()[0].text
    assert len(left.split()) < 60 + 30
    assert chunks.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def strict(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and max(map(int, m.group().split("."))) > 255 or kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_strict_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1 2.3-@+()4 55.9") for _ in range(rng.randrange(1, 40)))
        assert strict(text) == pii.strict_spans(text), text
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 50_000, "4111 1111 1111 1111"):
        pii.strict_spans(text)


def test_personal_data(spark):
    good = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    rows = [(i, f"call me at +1 (017) 555-77{i % 90 + 10} or mail user{i}@mail.example.com", "", "", "") for i in range(40)]
    rows += [(50, None, "", "", ""), (51, "", "", "", ""), (52, f"x {good} y", "", "", ""), (53, "é 10.0.0.1 9807915762804490", "", "", "")]
    df = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: [(s.kind, s.start, s.end, s.strict) for s in r.spans] for r in pii.find_personal_data(df, pii.fit_spans(df)).collect()}
    assert len(found) == len(rows) and found[50] == found[51] == []
    assert [s[0] for s in found[3]] == ["phone", "email"]
    assert ("ip", 2, 10, True) in found[53]
    for doc, text, *_ in rows:
        assert [s[1:3] for s in found[doc] if s[3]] == [(a, b) for a, _, b in strict(text or "")]
    empty = spark.createDataFrame([], DOCS)
    assert pii.find_personal_data(empty, pii.fit_spans(empty)).count() == 0


LANGUAGES = {"aa": "lorana belite komura", "bb": "xyzzy qwopp zzkrj", "cc": "éàù çèô îïê"}


def test_languages(spark):
    rng = random.Random(7)
    make = lambda lang, n: " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(3, 80)), lang) for i, lang in enumerate(list(LANGUAGES) * 40)] + [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 - $", None), (1003, make("aa", 30) + " " + make("bb", 20), None), (1004, "日本", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = language.fold(F.col("doc_id")) == 0
    model = language.fit_languages(df, ~held)
    got = {r.doc_id: r for r in language.identify_languages(df, model).collect()}
    assert len(got) == len(rows)
    assert all(got[d].lang_pred == lang for d, t, lang in rows if d < 1000)
    assert [(got[d].lang_pred, got[d].score) for d in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1004].lang_pred in LANGUAGES and 0 <= got[1004].score <= 1
    assert got[1003].lang_pred == "aa" and got[1003].languages.startswith("aa:0.6") and "bb:0.4" in got[1003].languages
    none = language.fit_languages(df, F.lit(False))
    assert {r.lang_pred for r in language.identify_languages(df, none).collect()} == {"und"}


PAGE = (
    "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav><div class='ad'>Buy now</div>"
    "<article><h1>Title &amp; {0}</h1><p>{1}<br>next &lt;line</p><p>unclosed <b>bold<p>{2}</article><footer>&copy; {0}</footer></body></html>"
)


def test_pages(spark):
    rng = random.Random(9)
    rows = [(i, "u", PAGE.format(i, prose(rng, 40), prose(rng, 30))) for i in range(60)]
    other = "<main><header><h2>Head</h2></header><p>{}</p><ul><li>one item<li>two</ul><section id='comments'><p>{}</p></section><form><p>join</p></form></main><div id='cookie-notice'><p>{}</p></div>".format(*[prose(rng, 30) for _ in range(3)])
    rows += [(100, "u", None), (101, "u", ""), (102, "u", "<<< <a"), (103, "u", other), (104, "u", "<p>" + "deep<div>" * 3000), (103, "u", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = pages.extract_text(df, pages.fit_pages(df)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and text[100] == text[101] == ""
    first = re.findall(r"<p>(.*?)<br>", rows[5][2])[0]
    assert text[5].split("\n")[:3] == ["Title & 5", f"{first} next <line", "unclosed bold"] and "Buy" not in text[5] and "©" not in text[5]
    paragraphs = re.findall(r"<p>(.*?)</p>", other)
    assert text[103].split("\n") == ["Head", paragraphs[0], "one item", "two"]
    empty = spark.createDataFrame([], df.schema)
    assert pages.extract_text(empty, pages.fit_pages(empty)).count() == 0


def test_sum_product_equals_enumeration():
    nodes, _ = pages.parse("<body><div><p>aaa bbb</p><ul><li><a>x</a></ul></div><div class=ad>buy</div></body>")
    model = pages.estimate({("role:text", 1): 50, ("role:list", 0): 30, ("role:outside", 0): 20, ("pair:plain:0", 1): 9, ("pair:plain:0", 0): 80, ("pair:plain:1", 1): 70})
    n, total, mass = len(nodes), 0.0, np.zeros(len(nodes))
    for state in range(2**n):
        s = [state >> i & 1 for i in range(n)]
        log = sum(model.odds[f] for v, x in zip(nodes, s, strict=True) if x for f in pages.features(v))
        log += sum(model.pairs[pages._group(nodes[v.parent])][s[v.parent]][s[i]] for i, v in enumerate(nodes) if v.parent >= 0)
        total += np.exp(log)
        mass += np.exp(log) * np.array(s)
    assert np.allclose(pages.marginals(nodes, model), mass / total)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert latent.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


@pytest.mark.parametrize("block", [5000, 3])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(latent, "ITEMS", block)
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randrange(16, 60))) for i in range(12)] + [(50, None), (51, ""), (52, prose(rng, 150))]
    rows, want = [], set()
    for i in range(80):
        text = prose(rng, rng.randrange(20, 300))
        if i % 2 == 0:
            item, body = rng.choice(items[:12] + items[-1:])
            words = body.split()
            for _ in range(rng.choice([0, 0, len(words) // 10])):  # a paraphrase changes some words
                words[rng.randrange(len(words))] = prose(rng, 1)
            text = f"{text} {' '.join(words).upper() if i % 4 else ' '.join(words)}. {prose(rng, 40)}"
            want.add((i, item))
        rows.append((i, text, "", "", ""))
    rows += [(90, None, "", "", ""), (91, "", "", "", "")]
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    space = latent.fit_space(df)
    got = latent.find_leaks(df, bench, space).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    # brute force: the subsequence with any stretch of the item's length and a block around it
    assert len(found & want) >= 0.9 * len(want) and found <= want
    empty = spark.createDataFrame([], DOCS)
    assert latent.find_leaks(empty, bench, latent.fit_space(empty)).count() == 0
    assert latent.find_leaks(df, spark.createDataFrame([], bench.schema), space).count() == 0


def test_the_latent_space_is_fitted_on_every_row(spark):
    """Words of single rows all have a place, in a table of more rows than were once sampled."""
    df = spark.range(30_000).selectExpr("id as doc_id", "'w' || id as text")
    frequency, rows = latent.term_frequencies(df)
    size = np.linalg.norm(latent.fit_space(df).axes, axis=1)[frequency > 0]
    assert rows == 30_000 and size.min() > 0.01 * np.median(size)


def test_the_fit_exchanges_a_bounded_number_of_matrices(spark):
    """However many files hold the documents, two matrices for each core at most, with the products of every row."""
    df = spark.range(120).selectExpr("id as doc_id", "concat('word', id % 7, ' of text number ', id, ' and of nothing else but the words in it') as text").repartition(60)
    idf = np.ones(latent.TERMS, np.float32)
    sums = latent._products(df, idf, 7).toPandas()
    assert len(sums) <= 2 * spark.sparkContext.defaultParallelism * latent.TERMS // latent.PART
    whole = latent._products(df.coalesce(1), idf, 7).toPandas()
    total = lambda table: sum(np.frombuffer(b, np.float32).astype(float).sum() for b in table["sums"])
    assert abs(total(sums) - total(whole)) < 1e-2


def test_benchmark_words_are_numbered_and_counted():
    """As a search for each word and a comparison of all with all, hashes that share their upper bits or are the greatest included."""
    rng = np.random.default_rng(2)
    known = rng.integers(0, 2**64, 3000, np.uint64)
    known[:40] = (known[0] & ~np.uint64(63)) + np.arange(40, dtype=np.uint64)
    top = np.uint64(2**64 - 1)
    for own in (known, np.append(known, top), known[:1], known[:0]):
        tokens = latent._Tokens(own)
        asked = np.concatenate([own, known, rng.integers(0, 2**64, 5000, np.uint64), np.array([0, top], np.uint64)])
        place = tokens.numbers(asked)
        listed = {h: i for i, h in enumerate(np.unique(own).tolist())}
        assert place.tolist() == [listed.get(h, len(listed)) for h in asked.tolist()]
        assert np.array_equal(tokens.numbers(own), tokens.of)
    tokens = latent._Tokens(known)
    for _ in range(50):
        text, region = rng.choice(known[:30], 20), np.concatenate([rng.choice(known[:60], 25), rng.integers(0, 2**64, 5, np.uint64)])
        assert tokens.held(tokens.numbers(text), tokens.numbers(region)) == np.isin(text, region).sum()
    assert not tokens.seen.any()


def test_products_of_rare_and_frequent_terms_are_sums_over_their_words():
    rng = np.random.default_rng(3)
    term = np.concatenate([np.repeat(np.arange(40), np.arange(40)), rng.integers(1000, 30_000, 9000)])
    rng.shuffle(term)
    z, block, weight = rng.standard_normal((700, 64)).astype(np.float32), rng.integers(0, 700, len(term)), rng.random(len(term)).astype(np.float32)
    total, want = np.ones((latent.TERMS, 64), np.float32), np.ones((latent.TERMS, 64))
    latent._add_products(total, z, block, term, weight)
    np.add.at(want, term, z[block].astype(float) * weight[:, None])
    assert np.abs(total - want).max() < 1e-4


def test_words_of_long_texts_have_the_hash_of_short_ones():
    """Bytes are added up in steps; words over the end of a step are like any others."""
    words = ["%d%s" % (i, "x" * (i % 9)) for i in range(40_000)] + ["é" * 40_000, "z"]
    one = Words(pa.array([" ".join(words), None, "z"]))
    each = Words(pa.array(words))
    assert len(one.data) > 4 * kernels._STEP and np.array_equal(one.hashes, np.append(each.hashes, each.hashes[-1]))
    assert one.first.tolist() == [0, len(words), len(words), len(words) + 1] and len(np.unique(each.hashes)) == len(set(words))


def test_no_vectors_for_places_without_most_words_of_an_item(spark, monkeypatch):
    """A few of an item's rare words alone make no window worth its vector; the item itself and a part of it do."""
    item = [f"word{i}" for i in range(30)]
    other = " ".join(f"other{i % 50}" for i in range(400))
    texts = [f"{other} {' '.join(item[k : k + 6])} {other}" for k in range(24)]

    class Rows:  # runs the search here instead of in a worker
        def __init__(self, texts):
            self.batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return [row for batch in run(iter([self.batch])) for row in batch.to_pylist()]

    rng = np.random.default_rng(4)
    space = latent.LatentSpace(np.ones(latent.TERMS, np.float32), rng.standard_normal((latent.TERMS, latent.DIMENSIONS)).astype(np.float32))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    made, runs = [], latent._runs
    monkeypatch.setattr(latent, "_runs", lambda a, b: (lambda out: (made.append(len(out[0])), out)[1])(runs(a, b)))
    assert latent.find_leaks(Rows(texts), bench, space) == [] and sum(made) == 0
    found = latent.find_leaks(Rows([*texts, f"{other} {' '.join(item)} {other}", " ".join(item[9:])]), bench, space)
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in found] == [(24, 7, 1.0), (25, 7, 0.7)] and sum(made) > 0
