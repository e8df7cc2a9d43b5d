import random
from collections import Counter

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from readloom.llm import language, licences, line_dedup, quality
from readloom.llm.grams import WORD
from readloom.llm.templates import TEMPLATES


def test_quality_equals_sql(docs, odd, none, same):
    rows = same(quality.quality_flags(docs), docs, quality.SQL)
    assert 0 < sum(keep for _, keep in rows) < len(rows)
    same(quality.quality_flags(odd), odd, quality.SQL)
    assert not quality.quality_flags(none).collect()


def test_quality_agrees_with_the_labels(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {(r.quality, r.keep): r["count"] for r in quality.quality_flags(documents).join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    assert got.get((1, False), 0) == 0 and got.get((0, True), 0) <= 2


def test_quality_order_changes_nothing(docs):
    texts = pa.array([r.text for r in docs.collect()])
    names = list(quality.RULES)
    for order in (names[::-1], names[3:] + names[:3]):
        assert (quality.kept(texts, order) == quality.kept(texts, names)).all()
    order = quality.measured_order(docs)
    assert sorted(name for name, _, _ in order) == sorted(names) and all(cost > 0 for _, cost, _ in order)
    rate = [share / max(cost, 1e-6) for _, cost, share in order]
    assert rate[0] == max(rate)


def test_quality_of_long_and_varied_texts(same, spark):
    pick = random.Random(2)
    rows = [(0, "one two " * 3000), (1, " ".join(f"w{int(pick.paretovariate(0.8))}" for _ in range(30000))), (2, "\n".join(["same line here"] * 7 + ["", "x"])), (3, "\n\n\n\n\n\n"),
            (4, "abc\u00a0def " * 5), (5, " ".join(map(str, range(1999))) + " abc" * 5000), (6, "!" * 3), (7, "Ünïcode wörds " * 4), (8, "a" * 31), (9, "#" + "a" * 19), (10, "#" + "a" * 18)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    same(quality.quality_flags(df), df, quality.SQL)


def test_filter_quality_keeps_columns(odd):
    out = quality.filter_quality(odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} == {None, 4, 7, 8, 9}


def test_lines_equal_sql(spark, docs, odd, none, same):
    query = line_dedup.SQL
    same(line_dedup.clean_lines(docs), docs, query)
    same(line_dedup.clean_lines(odd), odd, query)
    rows = [(i, f"Menu\n line {i}\n\n \tMenu \r\nLegal {i % 10}\nRare {i % 20}", "de", "hot" if i < 40 else "cold" if i < 50 else None, 1) for i in range(60)]
    rows += [(100, "Menu\nMenu\nMenu", None, "hot", 14), (101, None, None, "hot", None), (102, "Menu", None, "hot", 4)]
    site = spark.createDataFrame(rows, docs.schema)
    for limit in (1 << 30, 0):  # broadcast, and the way beyond
        got = {r[0]: (r[1], r[2]) for r in same(line_dedup.clean_lines(site, broadcast_bytes=limit), site, query)}
    assert got[0] == (" line 0\n\nRare 0", 3) and got[45] == (" line 45\n\nLegal 5\nRare 5", 2) and got[55][1] == 0 and got[100] == ("", 3) and got[102] == ("", 1) and got[101] == (None, 0)
    assert not line_dedup.clean_lines(none).collect()


def test_copies_of_a_page_and_small_hosts(spark, docs, same):
    """Copies aren't boilerplate to each other; two pages don't make boilerplate, three do, however few the host has."""
    rows = [(i, "One\ntext\nof many lines", "de", "copies", 1) for i in range(30)] + [(40 + i, f"Cookies\nother {i}", "de", "copies", 1) for i in range(5)]
    rows += [(100 + i, f"Menu\nPair {i // 2}\nOwn {i}", "de", "small", 1) for i in range(4)] + [(200 + i, f"Menu\nOwn {i}", "de", "two", 1) for i in range(2)]
    df = spark.createDataFrame(rows, docs.schema)
    got = {r[0]: r[1] for r in same(line_dedup.clean_lines(df), df, line_dedup.SQL)}
    assert got[0] == "One\ntext\nof many lines" and got[40] == "other 0" and got[100] == "Pair 0\nOwn 0" and got[200] == "Menu\nOwn 0"


def test_lines_by_the_host_of_a_url(spark):
    rows = [(f"p{i}", f"https://A{i % 2}.example.org/x/{i}?q=1", f"Menu {i % 2}\nown {i}", i, i, i) for i in range(10)] + [("q", "no url", "Menu 0\nmine", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, url string, text string, text_left int, __lines int, n_dropped int")
    got = {r.doc_id: r.text for r in line_dedup.clean_lines(df, host_col=line_dedup.host_of(F.col("url"))).collect()}
    assert got == {f"p{i}": f"own {i}" for i in range(10)} | {"q": "Menu 0\nmine"}
    out = line_dedup.dedup_lines(df, host_col=line_dedup.host_of(F.col("url")))
    assert out.columns == df.columns and {r.doc_id: (r.text, r.n_dropped) for r in out.collect()} == {r[0]: (got[r[0]], r[5]) for r in rows}


def test_dedup_lines_keeps_columns(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and Counter(map(str, out.collect())) == Counter(map(str, odd.collect()))


def test_language_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language.fit(documents.where("doc_id % 2 = 0"))
    assert filters.languages == ["de", "en", "es", "fr"]
    rows = language.identify(documents.where("doc_id % 2 = 1"), filters).join(documents.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    right = sum(r.predicted == r.lang for r in rows)
    assert right >= 0.98 * len(rows)
    assert all(r.keep for r in rows if r.n_chars > 200 and r.predicted == r.lang)


def test_language_masks_and_correction():
    hashes, ends = language.grams(["The cat's hat!", None, "", "é", "\0ab"])
    assert ends.tolist()[0] == 0 and ends[1] > 0 and (ends[1:] == ends[1:].cummax() if hasattr(ends, "cummax") else True)
    import numpy as np

    table = np.zeros(language.SLOTS, np.uint8)
    for slot in language._slots(hashes[: ends[1]]):
        table[slot] |= 2
    table[::2] |= 1  # a language whose filter is half full
    f = language.Filters(["a", "b"], table)
    assert abs(f.false_positive[0] - 0.5**language.HASHES) < 0.01
    n, hits = f.scores(["The cat's hat!"])
    assert hits[0, 1] == pytest.approx(n[0], rel=0.01) and hits[0, 0] < n[0] / 2


def brute_language(sets: dict[str, set], fps: dict[str, float], text: str) -> tuple[str | None, float]:
    """Sets of n-grams in place of filters; the corrected count of each language, the best one first by name."""
    codes = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    windows = [codes[i : i + language.N] for i in range(len(codes) - language.N + 1)]
    found = [g for g in windows if g[1:-1].isalpha() and (g[0] != " " or g[-1] != " ")]
    n = len(found)
    scores = {k: max(0.0, (sum(g in s for g in found) - n * fps[k]) / (1 - fps[k])) for k, s in sets.items()}
    top = max(scores.values(), default=0)
    return (min(k for k, v in scores.items() if v == top) if top > 0 else None), top / max(n, 1)


def test_language_query_equals_brute_force(spark):
    """The query over a whole table against sets of n-grams counted one by one, fitted on the same sample."""
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = documents.collect()
    filters = language.fit(documents)  # fewer documents than the bound: all are learnt
    sets = {}
    for name in filters.languages:
        mine, seen = [r.text for r in rows if r.lang == name], Counter()
        for text in mine:
            codes = "".join(c if c.isalpha() else " " for c in text.lower()) + " "
            seen.update({g for i in range(len(codes) - 3) if (g := codes[i : i + 4])[1:-1].isalpha() and (g[0] != " " or g[-1] != " ")})
        sets[name] = {g for g, n in seen.items() if n >= max(min(2, len(mine)), language.MIN_SHARE_OF_DOCS * len(mine))}
    fps = dict(zip(filters.languages, filters.false_positive))
    got = {r.doc_id: (r.predicted, r.score) for r in language.query(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == {r.doc_id for r in rows}
    for r in rows:
        name, score = brute_language(sets, fps, r.text)
        assert got[r.doc_id][0] == name and got[r.doc_id][1] == pytest.approx(score, abs=0.02), r.doc_id


def test_language_ties_go_to_the_first_name(spark):
    rows = [(i, "the same words in either tongue", lang) for i, lang in enumerate(["b", "a"] * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.predicted for r in language.identify(df, language.fit(df)).collect()} == {"a"}


def test_language_odd_rows(odd, none):
    filters = language.fit(odd)
    got = {(r.doc_id, r.predicted, r.keep) for r in language.identify(odd, filters).collect()}
    assert {(1, None, False), (2, None, False), (3, None, False)} <= got
    out = language.filter_language(odd, filters)
    assert out.columns == odd.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in out.collect())
    empty = language.fit(none)
    assert empty.languages == [] and not language.identify(none, empty).collect()
    assert {r.predicted for r in language.identify(odd, empty).collect()} == {None}


def test_language_of_more_than_64(spark, monkeypatch):
    pick = random.Random(5)
    vocabulary = {f"l{i:02}": ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(130)}
    rows = [(k, k + f" {i}", " ".join(pick.choices(words, k=30))) for k, words in vocabulary.items() for i in range(3)]
    df = spark.createDataFrame(rows, "lang string, doc_id string, text string").coalesce(2)
    filters = language.fit(df)
    assert filters.languages == sorted(vocabulary) and len(filters.false_positive) == 130
    for cells in (language.CELLS, 1000):
        monkeypatch.setattr(language, "CELLS", cells)
        names, score, keep = language._verdicts(filters, [r[2] for r in rows])
        assert [filters.languages[i] for i in names] == [r[0] for r in rows] and keep.all() and score.min() > 0.5
    got = {r.doc_id: r.predicted for r in language.identify(df, filters).collect()}
    assert got == {r[1]: r[0] for r in rows}


def test_language_bound_holds_without_ids(spark, monkeypatch):
    df = spark.range(3000).selectExpr("cast(null as bigint) doc_id", "concat('the text of number ', id) text", "if(id % 3 = 0, 'en', 'de') lang")
    df = df.union(spark.range(2000).selectExpr("7L", "concat('le texte du nombre ', id)", "'fr'"))
    seen, real = [], language.grams
    monkeypatch.setattr(language, "grams", lambda texts: seen.append(len(texts)) or real(texts))
    language.fit(df, per_language=100)
    assert len(seen) == 3 and all(50 < n < 150 for n in seen)


def bigrams(text: str) -> Counter:
    return Counter(zip(text.split(), text.split()[1:]))


def brute_dice(a: str, b: str) -> float:
    x, y = bigrams(a), bigrams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def normal(line: str) -> str:
    return " ".join(regex.findall(WORD, line.lower()))


def test_licences_equal_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bags = {n: bigrams(normal(t)) for n, t in TEMPLATES.items()}
    want = {}
    for r in documents.collect():
        for i, line in enumerate(r.text.split("\n"), 1):
            own = bigrams(normal(line))
            size = sum(own.values())
            if not size:
                continue
            dice = lambda bag, total: 2 * sum((own & bag).values()) / (size + total) if size > total / 2 else 0  # noqa: B023, E731
            found, name = max(((dice(bag, sum(bag.values())), n) for n, bag in bags.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            if found >= licences.THRESHOLD and found > want.get((r.doc_id, name), (0,))[0]:
                want[r.doc_id, name] = (found, i)
    got = {(r.doc_id, r.licence): (r.dice, r.line) for r in licences.licence_scan(documents).collect()}
    assert got == want and len(got) > 10


def test_whole_texts_of_licences(spark):
    """Each whole text is found, also with some words changed and next to another, and alone."""
    texts = {n: t for n, t in TEMPLATES.items() if n.endswith("/text")}
    assert len(texts) >= 8
    pick, rows, want = random.Random(1), [], set()
    for i, (name, text) in enumerate(texts.items()):
        words = ["other" if w.isalpha() and pick.random() < 0.02 else w for w in text.split(" ")]
        rows.append((i, "Copyright 2020 by me\n\n" + " ".join(words) + "\n\nThis is the readme of my project."))
        want.add((i, name))
    names = list(texts)
    rows.append((100, f"{texts[names[0]]}\n\n{TEMPLATES['mit/body']}\n\n{texts['mpl-2.0/text']}"))
    want |= {(100, names[0]), (100, "mit/body"), (100, "mpl-2.0/text")}
    got = {(r.doc_id, r.licence) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want <= got and {x for x in got if x[1].endswith("/text")} <= want


def test_licence_blocks_equal_brute_force():
    """Wrapped bodies with words left out, alone and next to each other: the best Dice of all ranges of words."""
    pick, names = random.Random(3), ["isc/body", "apache-2.0/notice", "mit/notice"]
    items = tuple((n, normal(TEMPLATES[n])) for n in sorted(names))
    texts = []
    for k in range(12):
        parts = [" ".join(w for w in normal(TEMPLATES[n]).split() if pick.random() > 0.03 * (k % 3)) for n in pick.sample(names, 1 + k % 2)]
        wrapped = ["\n".join(" ".join(p.split()[i : i + 7]) for i in range(0, len(p.split()), 7)) for p in parts]
        texts.append("\n\n".join(["some words before it", *wrapped, "and after"][k % 2 :]))
    want = {}
    for row, text in enumerate(texts):
        words = normal(text).split()
        for name, template in items:
            bag, best = bigrams(template), 0.0
            total = sum(bag.values())
            for a in range(len(words)):
                left, common = Counter(bag), 0
                for z in range(a + 1, min(len(words), a + 2 * total + 2)):
                    gram = words[z - 1], words[z]
                    if left[gram] > 0:
                        left[gram] -= 1
                        common += 1
                    best = max(best, 2 * common / (z - a + total))
            if best >= licences.THRESHOLD:
                want[row, name] = best
    got = {(row, name): dice for row, name, dice, _ in licences.matches(pa.array(texts), items, licences.THRESHOLD)}
    assert got == pytest.approx(want) and len(want) >= 12


def test_licences_over_many_lines(spark):
    body = TEMPLATES["mit/body"].split()
    wrapped = "\n".join(" ".join(body[i : i + 11]) for i in range(0, len(body), 11))
    rows = [(1, f"Some words before it.\n\n{wrapped}\n\nOther words after it."), (2, "RELEASED, under the MIT License!"), (3, " ".join(body[:40])), (4, wrapped.upper())]
    got = {(r.doc_id, r.licence, r.line) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.dice > 0.99}
    assert got == {(1, "mit/body", 3), (2, "mit/notice", 1), (4, "mit/body", 1)}


def test_licences_inside_lines_and_next_to_each_other(spark):
    wrap = lambda t: "\n".join(" ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11))
    mit, isc = wrap(TEMPLATES["mit/body"]), wrap(TEMPLATES["isc/body"])
    rows = [
        (1, "Copyright 2020 Foo Inc. All rights reserved."), (2, "Copyright 2020 Foo. Released under the MIT License."),
        (3, "Some words.\nOf this, licensed under CC BY-NC 4.0 as it is, one may say: all\nrights reserved, and much else."),
        (4, f"{mit}\n\n{isc}"), (5, f"{mit}\n\nLicence\n{mit}"), (6, f"One line and {TEMPLATES['apache-2.0/header']} more of it"),
    ]
    got = {(r.doc_id, r.licence, r.dice, r.line) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    after = mit.count("\n") + 3
    assert got == {
        (1, "proprietary/notice", 1, 1), (2, "mit/notice", 1, 1), (3, "cc-by-nc-4.0/notice", 1, 2), (3, "proprietary/notice", 1, 2),
        (4, "mit/body", 1, 1), (4, "isc/body", 1, after), (5, "mit/body", 1, 1), (6, "apache-2.0/header", 1, 1),
    }


@pytest.mark.parametrize("template", ["a b a c a b d a", "x y", "a b c d e f g"])
def test_licence_windows_equal_brute_force(template):
    pick, texts = random.Random(7), []
    for _ in range(60):
        body = [w for w in template.split() if pick.random() > 0.1 for w in ([w] if pick.random() > 0.1 else [w, "z"])]
        texts.append(" ".join([*pick.choices("abcdxyz", k=pick.randrange(9)), *body, *pick.choices("abcdxyz", k=pick.randrange(9))]))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        dice = max((brute_dice(" ".join(w[a:b]), template) for a in range(len(w)) for b in range(a + 2, len(w) + 1)), default=0)
        if dice >= licences.THRESHOLD:
            want[i] = dice
    got = {row: dice for row, _, dice, _ in licences.matches(pa.array(texts), (("t", template),), licences.THRESHOLD)}
    assert got == pytest.approx(want) and 10 < len(got)


def test_licences_odd_rows(odd, none):
    assert not licences.licence_scan(odd).collect() and not licences.licence_scan(none).collect()
