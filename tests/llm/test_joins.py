import random
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex

from readloom.llm import neighbours, ngram_join, packing, token_counts
from readloom.llm.grams import WORD, byte_hashes, ngrams, words

SCHEMA = "doc_id bigint, text string"


def grams_of(text, n=ngram_join.N):
    w = regex.findall(WORD, text.lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_pairs(rows, threshold, n=ngram_join.N):
    """{(first id, first id): jaccard} of different sets, and {(first id, id): 1} of equal ones."""
    by_id = {}
    for i, text in rows:
        if i is not None and text is not None:
            by_id[i] = by_id.get(i, frozenset()) | grams_of(text, n)
    same = {}
    for i, s in sorted(by_id.items()):
        if s:
            same.setdefault(s, []).append(i)
    pairs = {}
    for (s, x), (t, y) in combinations(same.items(), 2):
        common = len(s & t)
        if common and common / (len(s) + len(t) - common) >= threshold - 1e-12:
            pairs[min(x[0], y[0]), max(x[0], y[0])] = common / (len(s) + len(t) - common)
    return pairs | {(x[0], i): 1.0 for x in same.values() for i in x[1:]}


def found(df):
    rows = df.collect()
    out = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(out) == len(rows)
    return out


def copies(seed, groups=12, most=9):
    """Originals, near copies with a few words changed, exact copies, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows, i = [], 0
    for g in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 5, 30, 200]))] + (passage if g % 3 == 0 else [])
        for k in range(rng.randint(1, most)):
            mine = list(base)
            for _ in range(rng.randint(0, max(1, len(mine) // 12)) if k % 3 else 0):
                mine[rng.randrange(len(mine))] = word()
            rows.append((i, (", " if k % 2 else " ").join(mine).upper() if k % 4 == 3 else " ".join(mine)))
            i += 1
    return [*rows, (10**6, ""), (10**6 + 1, None), (None, "abc"), (10**6 + 2, "Straße Ñandú 中文 é"), (10**6 + 3, "straße, ñandú; 中文 é!"), (10**6 + 4, "...")]


@pytest.mark.parametrize("seed, threshold", [(0, 0.3), (1, 0.5), (2, 1.0)])
def test_jaccard_equals_brute_force(spark, seed, threshold):
    rows = copies(seed)
    want = brute_pairs(rows, threshold)
    got = found(ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA), threshold))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and want


def test_jaccard_equals_sql(docs, odd, none, same):
    rows = same(ngram_join.jaccard_join(docs), docs, ngram_join.SQL)
    assert len(rows) > 5
    assert found(ngram_join.jaccard_join(odd)) == {(7, 8): 1.0}
    assert not found(ngram_join.jaccard_join(none))


def test_jaccard_by_chunks(spark, monkeypatch):
    """Blocks of more than a few documents, split around pivots and cut into chunks; the side that isn't broadcast;
    components by stars."""
    monkeypatch.setattr(ngram_join, "_SMALL", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "PIVOTS", 2)
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", 0)
    monkeypatch.setattr(ngram_join, "sized", lambda df, _: df.hint("shuffle_hash"))
    rows = copies(5, 4, 40)
    assert found(ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA))) == pytest.approx(brute_pairs(rows, 0.5))


def brute_classes(rows, threshold):
    """{id: (smallest id of its class, documents alike)}, every two documents held against each other."""
    by_id = {}
    for i, text in rows:
        if i is not None:
            by_id[i] = by_id.get(i, frozenset()) | (grams_of(text) if text is not None else frozenset())
    root, links = {i: i for i in by_id}, dict.fromkeys(by_id, 0)

    def top(i):
        return i if root[i] == i else top(root[i])

    for (x, s), (y, t) in combinations(by_id.items(), 2):
        if s & t and len(s & t) / len(s | t) >= threshold - 1e-12:
            links[x] += 1
            links[y] += 1
            a, b = sorted((top(x), top(y)))
            root[b] = a
    return {i: (top(i), links[i]) for i in by_id}


def classes(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.class_id, r.links) for r in rows}


@pytest.mark.parametrize("seed, threshold", [(0, 0.3), (1, 0.5), (5, 0.5), (2, 1.0)])
def test_classes_count_every_link(spark, seed, threshold):
    """different texts with equal sets, and what is like them, are all linked."""
    rows = copies(seed) + [(2 * 10**6 + k, t) for k, t in enumerate(["x y z x y z", "x y z x y", "y z x y z x y", "x y z x y z x q"])]
    got = classes(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA), threshold))
    assert got == brute_classes(rows, threshold) and max(links for _, links in got.values()) > 2


def test_classes_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_SMALL", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", 0)
    monkeypatch.setattr(ngram_join, "sized", lambda df, _: df.hint("shuffle_hash"))
    rows = copies(5, 4, 40)
    assert classes(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA))) == brute_classes(rows, 0.5)


def test_classes_equal_sql(docs, none, same):
    rows = same(ngram_join.jaccard_classes(docs), docs, ngram_join.SQL_CLASSES)
    assert len(rows) == docs.count() and any(r[2] for r in rows)
    assert not classes(ngram_join.jaccard_classes(none))


def test_classes_of_string_ids(spark):
    rows = copies(3, 6)
    named = spark.createDataFrame([(f"d{i:09}" if i is not None else None, t) for i, t in rows], "doc_id string, text string")
    assert classes(ngram_join.jaccard_classes(named)) == {f"d{i:09}": (f"d{c:09}", n) for i, (c, n) in brute_classes(rows, 0.5).items()}


def test_blocks_do_not_chain(spark):
    """texts that share one gram each with the next are no block, however many there are."""
    texts = [(i, " ".join([f"s{i} s{i} s{i}", *(f"w{i}x{k} w{i}y{k} w{i}z{k}" for k in range(3)), f"s{i + 1} s{i + 1} s{i + 1}"])) for i in range(300)]
    rows = texts + [(1000 + i, t + f" end{i}") for i, t in texts]
    nodes, _, links, _ = ngram_join._nodes(spark.createDataFrame(rows, SCHEMA), 0.5, 3)
    assert 0 < links.groupBy("root").count().agg({"count": "max"}).first()[0] <= 16
    got = classes(ngram_join.jaccard_classes(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: (i % 1000, 1) for i, _ in rows}


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(1, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: 40 if k % 2 else 400], rng.integers(1, 200))) for k in range(60)] + [pool[:9].copy(), pool[:9].copy()]
    group, n = np.array([k % 3 for k in range(62)]), np.array([len(s) + (k % 5 == 0) * 3 for k, s in enumerate(sets)])
    for side in (np.zeros(62, np.int64), np.arange(62) % 2 + 1):
        want = {}
        for i, j in combinations(range(62), 2):
            common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if group[i] == group[j] and (side[i] == 0 or side[i] != side[j]) and common >= 0.3 * (n[i] + n[j] - common):
                want[i, j] = common
        p, q, c = ngram_join.trie_join(group, side, n, sets, 0.3)
        assert {(min(a, b), max(a, b)): x for a, b, x in zip(p.tolist(), q.tolist(), c.tolist())} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_components_of_a_chain(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", most)
    rows = [(i, i + 1) for i in range(0, 12)] + [(100, 105), (105, 101), (7, 7), (50, 50)]
    got = {r.doc: r.root for r in ngram_join.components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(13)} | {100: 100, 101: 100, 105: 100, 50: 50}


def test_dedup_keeps_one_of_each_group(spark, docs, odd):
    rows = copies(9)
    pairs = brute_pairs(rows, 0.5)
    root = {i: i for i, _ in rows if i is not None}

    def top(i):
        return i if root[i] == i else top(root[i])

    for x, y in pairs:
        a, b = sorted((top(x), top(y)))
        root[b] = a
    got = sorted((r.doc_id for r in ngram_join.dedup(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([None, *(i for i in root if top(i) == i)], key=str)
    out = ngram_join.dedup(odd)
    assert out.columns == odd.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, None, 2, 3, 4, 5, 6, 7, 7, 9]))


def kept(df, threshold=0.5):
    return sorted(r.doc_id for r in ngram_join.dedup(df, threshold).select("doc_id").collect() if r.doc_id is not None)


def test_dedup_compares_few_of_a_large_group(spark, monkeypatch):
    """F1, pipeline: what blocks hold to be compared pair by pair doesn't grow with the square of a group of near copies."""
    rng, sides = random.Random(4), []
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))] + [(i, " ".join(f"x{rng.randrange(40)}" if rng.random() < p else w for w in base)) for i, p in ((i, rng.choice([0.01, 0.03, 0.05])) for i in range(1, 400))]
    joined = ngram_join._joined

    def spy(nodes, links, *rest):
        sides.append(links.groupBy("root").count().selectExpr("coalesce(sum(count * count), 0)").first()[0])
        return joined(nodes, links, *rest)

    monkeypatch.setattr(ngram_join, "_joined", spy)
    assert kept(spark.createDataFrame(rows, SCHEMA)) == sorted({c for c, _ in brute_classes(rows, 0.5).values()})
    assert len(sides) == 1 and sides[0] <= 40 * len(rows)  # one block of 400 that all meet: 160,000


@pytest.mark.parametrize("threshold, chunks", [(0.3, False), (0.5, True), (0.7, False), (1.0, False)])
def test_dedup_equals_brute_force(spark, monkeypatch, threshold, chunks):
    """F1, pipeline: also classes that only hang together by way of documents that are no pivots."""
    if chunks:
        monkeypatch.setattr(ngram_join, "_SMALL", 3)
        monkeypatch.setattr(ngram_join, "CHUNK", 4)
        monkeypatch.setattr(ngram_join, "LOCAL_LINKS", 0)
        monkeypatch.setattr(ngram_join, "sized", lambda df, _: df.hint("shuffle_hash"))
    rng = random.Random(7)
    rows = copies(5, 4, 30)
    for k, step in enumerate((3, 7, 12)):
        ids = rng.sample(range(3 * 10**6 + 1000 * k, 3 * 10**6 + 1000 * k + 999), 40)
        rows += [(i, " ".join(f"c{k}n{j}" for j in range(step * m, step * m + 42 + m % 5))) for m, i in enumerate(ids)]
    assert kept(spark.createDataFrame(rows, SCHEMA), threshold) == sorted({c for c, _ in brute_classes(rows, threshold).values()})


def test_ids_of_other_types_and_clashing_names(spark):
    rows = copies(3, 6)
    plain = spark.createDataFrame(rows, SCHEMA)
    named = plain.selectExpr("concat('d', lpad(doc_id, 9, '0')) as doc_id", "text", "1 as gone", "2 as Gone_", "3 as id", "4 as __number")
    name = lambda i: f"d{i:09}"
    assert found(ngram_join.jaccard_join(named)) == {(name(a), name(b)): v for (a, b), v in found(ngram_join.jaccard_join(plain)).items()}
    out = ngram_join.dedup(named)
    assert out.columns == named.columns
    assert {r.doc_id for r in out.collect()} == {name(r.doc_id) if r.doc_id is not None else None for r in ngram_join.dedup(plain).collect()}


def thue_morse(length):
    text = "a"
    while len(text) < length:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [64, 1024, 2048, 4096])
def test_words_made_to_collide(spark, length):
    one, other = thue_morse(length)
    hashes, *_ = words(pa.array([one, other, one]))
    assert hashes[0] == hashes[2] != hashes[1]
    rows = [(1, one), (2, other), (3, one.upper())]
    assert found(ngram_join.jaccard_join(spark.createDataFrame(rows, SCHEMA))) == {(1, 3): 1.0}


def test_hashes_depend_on_bytes_alone():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 500)
    ends = starts + rng.integers(0, 1000, 500)
    hashes = byte_hashes(data, starts, ends, 7)
    for h, a, b in zip(hashes.tolist(), starts.tolist(), ends.tolist()):
        assert byte_hashes(data[a:b], np.array([0]), np.array([b - a]), 7).tolist() == [h]
    assert len(set(hashes.tolist())) == len({data[a:b].tobytes() for a, b in zip(starts, ends)})
    assert (byte_hashes(data, starts, ends, 8) != hashes).all()


def test_words_by_code_point():
    texts = ["don’t — stop", "中文，字 abc中d", "ไทย", "e\u0301a\u00a0b", "1²½ _x_", "\U00020000\U0001F600z"]
    hashes, ends, *_ = words(pa.array(texts))
    assert np.diff(ends).tolist() == [len(regex.findall(WORD, t)) for t in texts] == [3, 6, 3, 2, 2, 2]
    two = "一二三四五六七八九十百千万上中下左右天地人"
    alike = list(brute_pairs([(1, two), (2, two[:-1] + "大")], 0.5).values())
    assert alike and 0.5 < alike[0] < 1


def test_words_and_grams():
    hashes, ends, starts, *_ = words(pa.array(["Ab c", None, "ab", "", "C, ab-C é"]))
    assert ends.tolist() == [0, 2, 2, 3, 3, 7] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] == hashes[5]
    rows, grams = ngrams(hashes, ends, 3)
    assert rows.tolist() == [4, 4, 0, 2] and len(set(grams.tolist())) == 4


# --- packing ------------------------------------------------------------------------------------------------


def packed(df, capacity, **more):
    rows = packing.pack_documents(df, capacity, **more).collect()
    at = {}
    for r in rows:
        at.setdefault(r.bin, []).append((r.offset, r.length))
    for bin in at.values():
        bin.sort()
        assert all(a + b <= c for (a, b), (c, _) in zip(bin, bin[1:])) and sum(bin[-1]) <= capacity
    assert sorted(at) == list(range(len(at)))
    return rows, at


def first_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, room in enumerate(bins):
            if room >= x:
                bins[k] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packing_documents(spark, docs, odd, none, capacity):
    for df in (docs, odd):
        rows, at = packed(df, capacity)
        want = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(df).collect() if r.n_tokens)
        assert sorted((k, sum(r.length for r in rows if str(r.doc_id) == k)) for k in {w for w, _ in want}) == sorted((k, sum(n for w, n in want if w == k)) for k in {w for w, _ in want})
        assert all(r.start == r.piece * capacity for r in rows)
        assert len(at) <= first_fit([r.length for r in rows], capacity)
    assert packed(none, capacity) == ([], {})


def test_packing_by_sql(spark, docs):
    """All pieces are placed once, without gaps in the documents, overlaps or overflow in the bins."""
    packing.pack_documents(docs).createOrReplaceTempView("packed")
    token_counts.token_counts(docs).createOrReplaceTempView("counted")
    one = lambda sql: spark.sql(sql).first()[0]
    assert one("select count(*) from (select bin, sum(length) n, max(offset + length) top from packed group by bin) where n <> top or top > 2048") == 0
    assert one("select count(*) from (select *, lead(offset) over (partition by bin order by offset) as then from packed) where then <> offset + length") == 0
    assert one("select count(*) from (select *, lead(start) over (partition by doc_id order by start) as then from packed) where then <> start + length") == 0
    assert one("select count(*) from counted full join (select doc_id, sum(length) n, min(start) low from packed group by doc_id) p using (doc_id) where n is distinct from nullif(n_tokens, 0) or low > 0") == 0


def test_packing_in_parts(spark, docs):
    rows, at = packed(docs, 64, part_rows=3)
    assert len(rows) == len(set((r.bin, r.offset) for r in rows)) == packing.pack_documents(docs, 64, rounds=5).count()


def bins_of(runs):
    return sum(b for _, b in runs)


@pytest.mark.parametrize("seed", range(2))
def test_program_against_bounds(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 1000, 60))
    counts = rng.integers(1, 60, len(lengths))
    runs = packing.solve(lengths, counts, 1000)
    assert (sum(p * b for p, b in runs) == counts).all() and all((p * lengths).sum() <= 1000 for p, _ in runs)
    # the bounds: full bins, and pieces of over half a bin, of which no two fit together
    low = max(-(-int((lengths * counts).sum()) // 1000), int(counts[lengths > 500].sum()))
    assert low <= bins_of(runs) <= min(bins_of(packing.best_fit(lengths, counts, 1000)), first_fit(np.repeat(lengths, counts), 1000))


def fewest(lengths, counts, capacity):
    """Bins, by brute force over all ways to fill the next one."""
    @lru_cache(maxsize=None)
    def least(left):
        if not any(left):
            return 0
        biggest = max(i for i, n in enumerate(left) if n)

        def fill(i, room, left):
            if i < 0:
                yield left
                return
            for n in range(min(left[i], room // lengths[i]) + 1):
                yield from fill(i - 1, room - n * lengths[i], (*left[:i], left[i] - n, *left[i + 1 :]))

        first = (*left[:biggest], left[biggest] - 1, *left[biggest + 1 :])
        return 1 + min(least(rest) for rest in fill(len(left) - 1, capacity - lengths[biggest], first))

    return least(tuple(counts))


def test_program_equals_brute_force_on_small_histograms():
    rng = np.random.default_rng(3)
    extra = 0
    for _ in range(25):
        lengths = np.sort(rng.choice(np.arange(2, 12), 4, replace=False))
        counts = rng.integers(1, 5, 4)
        runs = packing.solve(lengths, counts, 12)
        assert (sum(p * b for p, b in runs) == counts).all() and all((p * lengths).sum() <= 12 for p, _ in runs)
        extra += bins_of(runs) - fewest(tuple(map(int, lengths)), tuple(map(int, counts)), 12)
    assert extra <= 1


def test_program_places_most_and_needs_no_more_than_best_fit(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = packing.pieces(documents, 2048, "doc_id", "text").groupBy("length").count().toPandas().sort_values("length")
    lengths, counts = rows["length"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    begun = []
    real = packing.best_fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "best_fit", lambda l, c, n, runs=(): begun.append((int((c * (c > 0)).sum()), len(runs))) or real(l, c, n, runs))
        runs = packing.solve(lengths, counts, 2048)
    left = next(n for n, some in begun if some)
    assert left < 0.15 * counts.sum()
    assert bins_of(runs) <= bins_of(real(lengths, counts, 2048)) and bins_of(runs) <= -(-int((lengths * counts).sum()) // 2048) + 5


def test_price_is_the_best_pattern():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 5, 7])
    for _ in range(30):
        weights = rng.random(3)
        best, choice, used = packing.price(weights, lengths, 20)
        for room in range(21):
            assert best[room] == pytest.approx(max(float(weights @ np.array([a, b, c])) for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= room))
        for first, row in zip(lengths, packing.best_with(lengths, choice, used, 20)):
            value = sum(weights[lengths == x][0] for x in row if x)
            assert row[0] == first and row.sum() <= 20 and value == pytest.approx(weights[lengths == first][0] + best[20 - first])


# --- neighbours ---------------------------------------------------------------------------------------------


def recall(spark, ids, vectors, k=10, **more):
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, k, **more).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r.neighbour
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    hits = 0
    for row, i in enumerate(ids):
        assert sorted(got[i]) == list(range(1, min(k, len(ids) - 1) + 1)) and i not in got[i].values()
        hits += len(set(np.asarray(ids)[np.lexsort((ids, -sims[row]))[:k]].tolist()) & set(got[i].values()))
    return hits / (len(ids) * min(k, len(ids) - 1))


def test_neighbours_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    assert recall(spark, [r.vec_id for r in rows], np.array([r.embedding for r in rows]), cell=50, block=300, queries=500) >= 0.95


def test_neighbours_of_some_ids_among_all(spark):
    """what is sent to the blocks is that of the ids divisible by 50; every vector is a candidate."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in neighbours.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 50 == 0) and all(len(set(x)) == 10 for x in got.values())
    hits = 0
    for i, found in got.items():
        like = v @ v[ids == i][0]
        like[ids == i] = -9
        hits += len(set(ids[np.lexsort((ids, -like))[:10]].tolist()) & set(found))
    assert hits >= 0.9 * 10 * len(got) and any(x % 50 for found in got.values() for x in found)
    small = spark.createDataFrame(rows[:300])
    every = {(r.vec_id, r["rank"], r.neighbour) for r in neighbours.nearest(small, cell=30, block=64).collect() if r.vec_id % 7 == 0}
    assert {(r.vec_id, r["rank"], r.neighbour) for r in neighbours.nearest(small, cell=30, block=64, every=7).collect()} == every
    with pytest.raises(ValueError):
        neighbours.nearest(small.selectExpr("cast(vec_id as string) as vec_id", "embedding"), every=7)


def test_neighbours_of_clusters_need_few_cells(spark, monkeypatch):
    """Vectors with cluster structure: a few cells are searched, few vectors compared exactly."""
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((40, 24))
    v = np.concatenate([m + 0.15 * rng.standard_normal((40, 24)) for m in middles])
    asked, real = [], neighbours._probes
    monkeypatch.setattr(neighbours, "_probes", lambda *a: asked.append(real(*a)) or asked[-1])
    assert recall(spark, list(range(len(v))), v, cell=40, block=400) >= 0.95 and asked[0] <= 20


def test_neighbours_ties_and_few(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((20, 9))
    assert recall(spark, list(range(300)), np.concatenate([base] * 15), cell=30, block=64, queries=50) >= 0.99  # copies: by id
    assert recall(spark, [5, 9, 2], rng.standard_normal((3, 4))) == 1.0


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, None, "x"), (4, [], "x"), (5, [nan, 1.0], "x"), (6, [0.0, 0.0], "x"), (7, [1.0, 2.0, 3.0], "x"), (8, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (2, [0.9, 0.1], "y")]
    rows += [(9, [1e300, 0.0], "x"), (10, [0.0, 1e-300], "x"), (11, [float("inf"), 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, v string")
    got = {}
    for r in neighbours.nearest(df).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got == {1: [9, 2, 10], 2: [1, 9, 10], 9: [1, 2, 10], 10: [2, 1, 9]}
    assert not neighbours.nearest(df.where("vec_id = 3")).collect() and not neighbours.nearest(df.where("vec_id = 1")).collect()
    named = neighbours.nearest(df.selectExpr("concat('v', vec_id) as vec_id", "embedding")).orderBy("vec_id", "rank").collect()
    assert {(r.vec_id, r.neighbour) for r in named if r["rank"] == 1} == {("v1", "v9"), ("v2", "v1"), ("v9", "v1"), ("v10", "v2")}
    assert neighbours.nearest(df.where("vec_id = 3").selectExpr("concat('v', vec_id) as vec_id", "embedding")).columns == ["vec_id", "rank", "neighbour", "similarity"]


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centres, turn = v[:4].copy() * np.float32(0.3), neighbours.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64), atol=1e-4)
    cells = neighbours.nearest_cells(v, centres).argmax(axis=1)
    block = neighbours.Block(np.arange(400), v, cells, *neighbours.encode(v, centres[cells], turn), centres, turn)
    code, every = block.query_codes(v), np.arange(400)
    for cell in range(len(block.own)):
        a, z = int(block.start[cell]), int(block.stop[cell])
        away = ((v - block.centres[cell]) ** 2).sum(axis=1)
        true = ((v[:, None] - block.vectors[None, a:z]) ** 2).sum(axis=2)
        middle, slack = block.estimates(code, every, away, cell, a, z)
        assert (np.abs(middle - true) <= slack).mean() > 0.96 and slack.mean() < 0.3
        limit = np.full(400, 1.2, np.float32)
        inside = block.within(code, every, away, limit, cell, a, z)
        assert (inside != (middle - slack <= limit[:, None])).mean() < 0.01 and inside[true <= 1.2].mean() > 0.98


def test_xor_and_popcount_give_the_inner_product_of_the_codes():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((50, 10)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centres, turn = np.zeros((1, 10), np.float32), neighbours.rotation(10)
    codes, length, fit = neighbours.encode(v, centres, turn)
    block = neighbours.Block(np.arange(50), v, np.zeros(50, int), codes, length, fit, centres, turn)
    code = block.query_codes(v)
    turned = v @ turn
    level = code[2][:, None]
    coded = np.sign(turned) * np.where(np.abs(turned) > neighbours._EDGE / neighbours._LEVEL * level, level * (1 + 7 / 3), level)
    dot = code[3][:, None] - block._unlike(code, np.arange(50), 0, 50) * (2 / 3 * level)
    assert np.allclose(dot, coded @ neighbours._signs(codes).T, atol=1e-3)
