"""Small cases of the training-data operators, edges included, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    base = [rng.choice(vocabulary) for _ in range(70)]
    for _ in range(25):  # near copies, chained
        base = list(base)
        base[rng.randrange(70)] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [texts[3]] * 4 + [texts[4].upper(), None, "", " \n ", "one", "one", "a b c", "line one is here now\nsecond line of it all\nthird", "x" * 50_000]
    return [(k, t, "en", ["s1", "s2", None][k % 3], len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({"sha": F.lit(1), "key": F.lit("k"), "n": F.lit(2), "shard": F.lit(3)}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = low(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_join_loses_no_link(docs, none, k, num):
    from tessera.llm.jaccard import jaccard_join

    rows = corpus()
    sets = {r[0]: shingles(r[1], k) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs, k, num, 100).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}
    assert jaccard_join(none, k, num, 100).count() == 0


def test_jaccard_null_ids(spark):
    from tessera.llm.jaccard import jaccard_join

    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]
    got = sorted(jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect(), key=str)
    assert [(r.n_shingles, r.component_id) for r in got] == [(3, 1)] * 3 + [(3, None)]


def test_tree_bound_keeps_every_pair():
    import numpy as np

    from tessera.llm.jaccard import CountTree, Ratio

    rng = np.random.default_rng(3)
    ratio = Ratio(80, 100)
    base = rng.integers(0, 4, size=(40, 256))
    points = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, size=base.shape) * (rng.random(base.shape) < 0.05)) for _ in range(8)])
    sizes = points.sum(axis=1)
    comps = np.arange(len(points))
    tree = CountTree(points, sizes, comps)
    for k in range(0, len(points), 17):
        want = {j for j in range(len(points)) if j != k and 100 * sizes[j] >= 80 * sizes[k] and 100 * sizes[k] >= 80 * sizes[j] and np.minimum(points[j], points[k]).sum() >= ratio.least_overlap(sizes[j] + sizes[k])}
        assert want <= set(tree.near(points[k], int(sizes[k]), int(comps[k]), ratio).tolist())


def test_exact_dedup(spark, docs, none):
    from tessera.llm.exact_dedup import exact_dedup

    rows = corpus()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append((-len(r[1] or ""), r[0]))
    want = {}
    for body, members in groups.items():
        for n, i in members:
            want[i] = (min(members)[1], len(members), i == min(members)[1], hashlib.sha256(body.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in exact_dedup(docs).collect()} == want
    assert exact_dedup(none).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "ab"), (4, "ab"), (None, None)], "doc_id long, text string")
    assert sorted((r.group_size, r.kept) for r in exact_dedup(odd).collect()) == [(1, True), (3, False), (3, False), (3, True)]


def test_trie_spills_and_merges(monkeypatch, docs):
    from tessera.llm import exact_dedup as E

    want = sorted(map(tuple, E.exact_dedup(docs).collect()))
    monkeypatch.setattr(E, "RESIDENT", 200)
    assert sorted(map(tuple, E.exact_dedup(docs).collect())) == want


def test_mixing_reaches_targets(docs, none):
    from tessera.llm.mixing import mix_sources

    rows = mix_sources(docs).collect()
    assert {r.doc_id: r.size for r in rows} == {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sources[0], []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert math.isclose(sum(v[0].target for v in by.values()), total)
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and abs(sum(r.taken for r in v) - v[0].target) <= 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_sources(docs).collect()), key=str)
    assert mix_sources(none).count() == 0


def test_flow_is_of_least_cost():
    from tessera.llm.mixing import route, targets

    assert targets([10, 10, 80], [5, 2, 1], 3) == [30.0, 30.0, 40.0]
    # the pattern in both sources must serve the second, as only it can
    assert route([10, 10], [[0], [0, 1]], [10, 10], 3) == [[10], [0, 10]]
    sent = route([10, 10], [[0], [0, 1]], [25, 10], 3)
    assert [sum(s) for s in sent] in ([20, 15], [15, 20]) and sent[1][1] == 10


def test_line_dedup(spark, none):
    from tessera.llm.line_dedup import line_dedup

    a = "alpha beta gamma delta epsilon\nzeta eta theta iota kappa\nunique to the first one"
    rows = [(1, a), (2, "something before this\n" + "\n".join(a.split("\n")[:2]) + "\nsomething after"), (3, a), (4, "short\nalpha"), (5, None), (6, ""), (None, a), (7, "alpha beta gamma delta epsilon"), (8, "yes\nyes\nyes"), (9, "yes\nno")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))).collect()}
    assert got == {1: (a, 0), 2: ("something before this\nsomething after", 2), 3: ("", 3), 4: ("short\nalpha", 0), 5: (None, 0), 6: ("", 0), None: (a, 0), 7: ("", 1), 8: ("yes\nyes\nyes", 0), 9: ("yes\nno", 0)}
    assert line_dedup(none).count() == 0


def test_line_dedup_finds_every_block(spark):
    from tessera.llm.line_dedup import line_dedup

    rng = random.Random(23)
    long = [f"one two three four five {k}" for k in range(4)]
    short = [f"s{k} t{k}" for k in range(6)]
    rows = [(k, f"own words {k}\n{short[k]}\nmore of {k}") for k in range(6)]  # each short line has another owner
    rows += [(10, "\n".join(short)), (11, "\n".join(short)), (12, "\n".join(long)), (13, "\n".join(long[::-1]))]
    rows += [(100 + k, "\n".join(rng.choice(["a b", "c", "d e f", "", "g h i j k"]) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [(200, "first of two rows of one id"), (200, "second of two rows of one id"), (201, "second of two rows of one id"), (202, "first of two rows of one id")]
    got = [(r.doc_id, r.n_removed, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    blocks = {}  # of lines whose ends have words: the first document that has each
    for d, t in rows:
        lines = t.split("\n")
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if lines[i] and lines[j] and len(low(" ".join(lines[i : j + 1]))) >= 5:
                    blocks.setdefault(tuple(lines[i : j + 1]), d)
    want = []
    for d, t in rows:
        lines, cut = t.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if blocks.get(tuple(lines[i : j + 1]), d) < d:
                    cut |= set(range(i, j + 1))
        want.append((d, [x for k, x in enumerate(lines) if k not in cut and x]))
    assert sorted((d, [x for x in t.split("\n") if x]) for d, _, t in got) == sorted(want)
    assert {d: n for d, n, _ in got if d in (10, 11, 12, 13, 201, 202)} == {10: 0, 11: 6, 12: 0, 13: 4, 201: 1, 202: 1}


def test_patience_is_a_common_subsequence():
    from tessera.llm.line_dedup import patience

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert pairs or not set(a) & set(b)


def test_quality_learns_and_holds_out(spark, none):
    from tessera.llm.quality import held_out, quality_scores

    rng = random.Random(1)
    rows, labels = [], []
    for k in range(300):
        words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(30)]
        good = k % 3 > 0
        rows.append((k, " ".join(words) if good else " ".join(w + "%%%" for w in words)))
        labels.append((k, int(good)))
    rows += [(1000, None), (1001, ""), (None, "abc def")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slots", F.lit(1))
    got = {r.doc_id: r for r in quality_scores(d, spark.createDataFrame(labels + [(5, None)], "doc_id long, quality int")).withColumn("h", held_out("doc_id")).collect()}
    held = [r for r in got.values() if r.h and r.doc_id is not None and r.doc_id < 300]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert all((r.score >= 0.3) == (r.doc_id % 3 > 0) for r in held) and got[1000].score == got[1001].score
    assert {r.score for r in quality_scores(d, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
    assert quality_scores(none, spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_decontamination_finds_edited_passages(spark, none):
    from tessera.llm.decontamination import contamination, uncontaminated

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(30)] for _ in range(5)]
    noise = lambda n: [word() for _ in range(n)]
    edited = [w if k % 6 else word() for k, w in enumerate(items[1])]
    rows = [(1, " ".join(noise(40) + items[0] + noise(20))), (2, ", ".join(noise(10) + edited + noise(9)).upper()), (3, " ".join(noise(300))), (4, None), (5, ""), (None, " ".join(items[2])), (6, " ".join(items[3][:8] + noise(50)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit(1))
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(9, None), (10, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination(d, b).collect()}
    assert set(got) == {(1, 0), (2, 1), (None, 2)}
    assert (got[1, 0].score, got[1, 0].first_word, got[1, 0].end_word, got[1, 0].n_same) == (1.0, 40, 70, 30)
    assert sorted(r.doc_id for r in uncontaminated(d, b).collect()) == [3, 4, 5, 6]
    assert contamination(none, b).count() == 0 and contamination(d, b.limit(0)).count() == 0


def test_decontamination_loses_no_passage(spark):
    import numpy as np

    from tessera.llm.decontamination import contamination, smith_waterman, uncontaminated

    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(30)] for _ in range(5)] + [["Ñandú", "été", "übel", "ÇA", "œuvre", "Ärger"]]
    every = lambda t, n: [w if k % n else word() for k, w in enumerate(t)]
    texts = [every(items[0], 5), every(items[1], 3), [x for w in items[2] for x in (w, word())], items[3][:16], [w.upper() if k % 2 else w.lower() for k, w in enumerate(items[5])]]
    texts = [[word() for _ in range(40)] + t + [word() for _ in range(40)] for t in texts] + [items[4][k % 3 * 4 :] + [word()] for k in range(20)]
    texts += [[rng.choice(items[k % 5]) for _ in range(60)] for k in range(20)] + [every(items[k % 5], 2) for k in range(10)]  # many words of an item, few in order
    d = spark.createDataFrame([(k, ", ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    code: dict[str, int] = {}
    numbers = lambda t: np.array([code.setdefault(w.lower(), len(code)) for w in t])
    for least in (0.3, 0.5, 0.8):
        want = {(i, k): x for i, t in enumerate(texts) for k, m in enumerate(items) if (x := smith_waterman(numbers(m), numbers(t))[0] / (2 * len(m))) >= least}
        assert {(r.doc_id, r.item_id): r.score for r in contamination(d, b, least).collect()} == want
        assert {r.doc_id for r in uncontaminated(d, b, least).collect()} == set(range(len(texts))) - {i for i, _ in want}
        assert least != 0.5 or {(0, 0), (1, 1), (2, 2), (3, 3), (4, 5)} <= set(want)


def test_smith_waterman_in_two_rows():
    import numpy as np

    from tessera.llm import decontamination as D

    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = (rng.integers(0, 4, size=rng.integers(1, 12)) for _ in range(2))
        rows = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                rows[i + 1, j + 1] = max(0, rows[i, j] + (2 if a[i] == b[j] else -1), rows[i, j + 1] - 1, rows[i + 1, j] - 1)
        score, start, end, same = D.smith_waterman(a, b)
        assert score == rows.max()
        if score:  # the passage alone has the score
            assert start < end <= len(b) and D.smith_waterman(a, b[start:end])[0] == score and b[start] in a and b[end - 1] in a
            assert (score + 1) // 2 <= same <= min(len(a), end - start)


def test_long_and_short_items(spark):
    from tessera.llm.decontamination import contamination, uncontaminated

    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    long = [word() for _ in range(5000)]
    rows = [(1, " ".join(word() for _ in range(50)) + " " + " ".join(w if k % 7 else word() for k, w in enumerate(long))), (2, "some two words here"), (3, "two some words"), (4, " ".join(long[:1000])), (5, "Alone, it stands")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(long)), (2, "two words"), (3, "alone"), (4, " \n")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contamination(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (5, 3)} and got[2, 2] == 1.0 and got[1, 1] > 0.7
    assert [r.doc_id for r in uncontaminated(d, b).orderBy("doc_id").collect()] == [2, 3, 4, 5]


def test_columns_that_clash_stay(spark):
    from tessera.llm.decontamination import uncontaminated
    from tessera.llm.line_dedup import line_dedup
    from tessera.llm.quality import passing

    names = ["cut", "_lines", "_cut_key", "score", "text_key", "cut_lines", "text_lines", "owner_id", "_score", "key", "first", "owner", "lines", "words", "earlier", "turn", "label", "n"]
    rows = [(k, "the same five words here\n" + f"own line of {k}", *range(k, k + len(names))) for k in range(4)]
    d = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = sorted(map(tuple, line_dedup(d).collect()))
    assert [r[2:-1] for r in got] == [r[2:] for r in rows] and [r[-1] for r in got] == [0, 1, 1, 1]
    labels = spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, quality int")
    assert sorted(map(tuple, passing(d, labels).collect())) == rows
    assert sorted(map(tuple, uncontaminated(d, spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string")).collect())) == rows


def test_line_dedup_with_earlier_documents_between(spark):
    from tessera.llm.line_dedup import line_dedup

    parts = ["a1 b c d e", "f g h", "i j"], ["k l m", "n o", "p q"]
    rows = [(1, "\n".join(parts[0])), (2, "\n".join(parts[1])), (3, "\n".join([*parts[0], *parts[1], "own three"])), (4, "\n".join([*parts[0], *parts[1], "own four"]))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[4] == ("own four", 6) and got[3] == ("own three", 6) and got[1][1] == got[2][1] == 0


def test_personal_data(spark, none):
    from tessera.llm.pii import personal_data

    text = "é mail a.b@c.de, ip 1.2.3.4 not 1.2.3.400, card 4111 1111 1111 1111, call +1 (212) 555-0000 now"
    d = spark.createDataFrame([(1, text), (2, None), (None, "x@y.zz")], "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in personal_data(d).collect()}
    spans = [(k, m.start(), m.end()) for k, p in (("email", r"a\.b@c\.de"), ("ip", r"1\.2\.3\.4\b(?!0)"), ("card", "4111[ 1]+"), ("phone", r"\+1.*0000")) for m in re.finditer(p, text)][:4]
    spans = [(k, s, e - 1 if k == "card" and text[e - 1] == " " else e) for k, s, e in spans]
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: x[1]))
    assert got[1].spans == want and got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[2].spans == "" and got[None].spans == "email:0:6"
    assert personal_data(none).count() == 0


def test_contexts_disclose_identifiers(spark):
    from tessera.llm.pii import personal_data

    rows = [(k, f"please dial +1 (212) 555-{k:04d} for it") for k in range(30)] + [(100, "please dial (212) 555-7777 for it"), (101, "room 555-1234567 is there")]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "phone:12:26" and got[100].n_phone == 0 and got[101].spans == ""


def test_contexts_need_few_seeds(spark):
    from tessera.llm.pii import personal_data

    rows = [(k, f"please dial +1 (212) 555-{k:04d} for it") for k in range(6)] + [(100 + k, f"please dial (212) 555-7{k:03d} for it") for k in range(3)]  # a third unseen
    rows += [(200 + k, f"see page +1 (212) 556-{k:04d} now") for k in range(6)] + [(300 + k, f"see page {k + 10} now") for k in range(6)] + [(400, "see page (212) 555-9999 now")]  # as often contrary
    rows += [(500 + k, f"ring +1 (212) 557-{k:04d}") for k in range(2)] + [(600, "ring (212) 555-8888")]  # too few seeds
    got = {r.doc_id: r.spans for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + k] for k in range(3)] == ["phone:12:26"] * 3
    assert got[400] == "" and got[600] == "" and got[300] == ""


def test_contexts_of_any_length_and_dense_lines(spark):
    from tessera.llm.pii import personal_data

    long, word = "x" * 50 + "[at]" + "y" * 60 + ".org", "w" * 90
    rows = [(k, f"write mail q{k}@site{k}.org") for k in range(30)] + [(100, "write mail jo[at]ex.org"), (101, f"write mail {long}."), (102, "about jo[at]ex.org")]
    rows += [(200 + k, f"{word} +1 (212) 555-{k:04d}") for k in range(6)] + [(300, f"see {word} (212) 555-7777"), (301, f"v{word} (212) 555-7777")]
    rows += [(400 + k, f"phone +1 (212) 556-{k:04d}, ok") for k in range(20)]
    rows += [(500, "phone (212) 555-7777 a@b.com"), (501, "phone 555 123 4567 2024-05-01 10:30"), (502, "phone 12 now")]
    rows += [(600 + k, f'token = "{hashlib.sha1(str(k).encode()).hexdigest()}" here') for k in range(6)] + [(700, 'token = "opaque-value-1234" here'), (701, 'word "opaque-value-1234" there')]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "email:11:23" and got[101].spans == f"email:11:{11 + len(long)}" and got[102].spans == ""
    assert got[300].spans == f"phone:{5 + len(word)}:{19 + len(word)}" and got[301].spans == ""
    assert got[500].spans == "phone:6:20,email:21:28" and got[501].spans == "phone:6:18" and got[502].spans == ""
    assert got[600].secrets == "9:49" and got[700].secrets == "9:26" and got[701].secrets == "" and got[700].n_spans == 1 and got[600].spans == ""


def test_personal_data_against_brute_force(spark):
    from tessera.llm.pii import personal_data

    rng = random.Random(6)
    parts = ["a@b.co", "x.y+z@m-1.example.com", "1.2.3.4", "1.2.3.400", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (212) 555-0000", "+12", "é", "日本", "\n", " ", " ", ",", "9", "@", "word", "1-2-3", "...", "x" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["mail a@b.co " * 20_000 + "end"]

    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def brute(t):
        out = []
        patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
        for o, p in enumerate(patterns):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if o == 1 else True, 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][o]
                if ok:
                    out.append((m.start(), o, m.end()))
        return ",".join(f"{('email', 'ip', 'card', 'phone')[o]}:{s}:{e}" for s, o, e in sorted(out))

    got = {r.doc_id: r.base_sha256 for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: hashlib.sha256(brute(t).encode()).hexdigest() for k, t in enumerate(texts)}


def test_language_model(docs, none, spark):
    from tessera.llm.lm import lm_scores

    rows = {r[0]: low(r[1]) + [None] for r in corpus()}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in rows[i])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_scores(docs).collect()}
    for i, w in rows.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    assert lm_scores(none).count() == 0
    assert lm_scores(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().n_tokens == 1


def test_mixture_weights_sum_to_one_and_fit():
    import numpy as np

    from tessera.llm.lm import BUCKETS, CELLS, STEPS, learn

    cells = np.array([(5 * CELLS + 1 * STEPS) * CELLS + 10 * STEPS, (5 * CELLS + CELLS - 1) * CELLS + 2 * STEPS])
    w = learn(cells, np.array([900, 100]), 1000)
    assert w.shape == (BUCKETS, 3) and np.allclose(w.sum(axis=1), 1) and w[5, 0] > 0.7 and w[0, 0] == 0


def test_token_counts_after_edits(spark, docs, none):
    import os

    from tessera.llm import token_counts as T

    if not os.path.exists(T.VOCABULARY):
        pytest.skip("no vocabulary file")
    count = T.Counter(T.read_ranks(T.VOCABULARY))
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "'re", "'", "é", "9", "!", "word "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 30, 400])))
        tree = T.SegmentTree(T.build(text, count))
        for _ in range(3):
            at, cut, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 9]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 12])))
            a = min(at, len(text))
            want = text[:a] + new + text[a + cut :]
            text, _ = T.edit(text, tree, at, cut, new, count)
            assert text == want and tree.sums[1].tolist() == [len(text), len(count.encode(text)), len(count.all(text))]
    edits = F.array(F.struct(F.lit(2).alias("at"), F.lit(1).alias("removed"), F.lit("x y").alias("inserted")), F.lit(None))
    got = {r.doc_id: r for r in T.edited_counts(T.token_counts(docs.withColumn("edits", edits))).collect()}
    for r in corpus():
        t = r[1] or ""
        e = t[:2] + "x y" + t[3:]
        assert (got[r[0]].n_before, got[r[0]].text, got[r[0]].n_tokens) == (len(count.encode(t)), e, len(count.encode(e)))
    assert T.token_counts(none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<p>no</p>"</script></head><body><nav><a>menu</a></nav><div class="x1">{ad}</div>
<div class="main-column"><h1>{title}</h1><p><b>{one}<br>more &amp; more<p>{two}</p><aside>side</aside></div><div id="comments"><p>c</p></div><form>f</form><footer>foot</footer></body></html>"""


def test_html_text(spark):
    from tessera.llm.html_text import html_text

    rows = [(k, f"http://h.example.com/{k}", PAGE.format(ad="Subscribe to us", title=f"Title {k}", one=f"first  {k}", two=f"text &lt;{k}&gt;")) for k in range(8)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://b", "plain < text"), (23, "http://c", "<p>a<!-- open"), (24, "http://d", "<div>" * 3000 + "deep")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html_text(d).collect()}
    for k in range(8):
        assert got[k].text == f"Title {k}\nfirst {k} more & more\ntext <{k}>" and got[k].n_chars == len(got[k].text)
    assert [got[k].text for k in range(20, 25)] == ["", "", "plain < text", "a", "deep"]
    assert html_text(d.limit(0)).count() == 0


def test_html_articles_survive_class_words():
    from tessera.llm.html_text import tree_of

    text = lambda page: "\n".join(t for _, _, t in tree_of(page)[1])
    body = "<h1>Head</h1><p>Whole article of several words</p>"
    for page in (
        f'<div class="content no-sidebar">{body}</div>',
        f'<div id="page" class="site has-sidebar"><article>{body}</article></div>',
        f'<article class="post category-social tag-search">{body}</article>',
        f'<form id="all">{body}</form>',
        f'<div class="comments-open">{body}</div><nav>menu</nav>',
        f'<aside><div><main>{body}</main></div></aside>',
    ):
        assert text(page) == "Head\nWhole article of several words", page
    assert text(f'<article>{body}</article><div id="comments"><article class="comment">{body * 3}</article></div>') == "Head\nWhole article of several words"
    assert text(f'<div>{body}</div><div class="comments">{body * 3}</div>') == "Head\nWhole article of several words"
    assert text(f'{body}<form>mail</form><span class="ad">x</span><div class="ad-slot">y</div><p hidden>z</p>') == "Head\nWhole article of several words"


def test_wrapper_induction_without_names(spark, monkeypatch):
    from tessera.llm import html_text as H

    for name in ("CHROME", "CHROME_TAGS", "HEADS", "CENTRES", "FORMS"):
        monkeypatch.setattr(H, name, frozenset())
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for h, n in enumerate([40, 200, 5, 2, 1]):
        menu, foot, advert, notice = line(3), line(6), line(5), line(8)
        other, mine = line(4), []
        for k in range(n):
            paragraphs = [line(rng.randint(2, 9)) for _ in range(rng.randint(1, 7))]
            chosen = k % 2 == 0  # a notice within every second article, and an advert under every third page
            held = paragraphs[:1] + ([notice] if chosen else []) + paragraphs[1:]
            page = f"<ul><li><a>{menu}</a><li>{other}</ul><div><h2>{paragraphs[0]}</h2>" + "".join(f"<p>{x}</p>" for x in held) + "</div>" + (f"<table><tr><td>{advert}</td></tr></table>" if k % 3 == 0 else "") + f"<div>{foot}</div>"
            mine.append((f"http://h{h}.org/{k}", page))
            template = {menu, other, foot, notice} | ({advert} if n > 9 else set()) if n > 2 else set()
            if n == 5:
                template -= {advert}
            want[len(rows)] = [x for x in re.sub(r"<[^>]*>", "\n", page).split("\n") if x and x not in template]
            rows.append((len(rows), *mine[-1]))
        for _ in range(3 if n == 200 else 0):  # copies of a page don't make what it holds template
            want[len(rows)] = want[len(rows) - n]
            rows.append((len(rows), *mine[0]))
            n += 1
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(tuple, H.html_text(d.repartition(k)).collect())) for k in (1, 50)]
    assert got[0] == got[1]
    texts = {r[0]: r[2].split("\n") for r in got[0]}
    wrong = {k: (texts[k], w) for k, w in want.items() if texts[k] != w}
    assert not wrong, list(wrong.items())[:2]


def test_copies_of_an_article_are_no_template(spark):
    from tessera.llm.html_text import html_text

    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(8))
    body = [line() for _ in range(6)]
    pages = [f"<nav>n</nav><article>{''.join(f'<p>{x}</p>' for x in [*body[:5], line()])}</article>" for _ in range(4)] + [f"<article><p>{line()}</p></article>" for _ in range(2)]
    rows = [(k, "http://h/", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text.split("\n") for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k][:5] == body[:5] and len(got[k]) == 6 for k in range(4))


def test_heaviest_matching_agrees_with_recursion(monkeypatch):
    import numpy as np

    from tessera.llm import html_text as H

    rng = np.random.default_rng(8)
    for _ in range(200):
        n, m = rng.integers(0, 9, size=2)
        w = rng.integers(0, 4, size=(n, m)) * (rng.random((n, m)) < 0.6)
        best = np.zeros((n + 1, m + 1), dtype=int)
        for i in range(n):
            for j in range(m):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + w[i, j])
        for most in (1 << 20, 6, 1):
            monkeypatch.setattr(H, "AT_ONCE", most)
            weight, pairs = H.heaviest(n, m, lambda i: w[i])
            assert weight == best[n, m] == sum(w[i, j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and all(w[i, j] for i, j in pairs)


def test_long_and_deep_pages(spark):
    from tessera.llm.html_text import html_text

    long = lambda k: "<ul>" + "".join(f"<li>row {j} of {k if j % 9 else 0}</li>" for j in range(3000)) + "</ul><p>same</p>"
    deep = lambda k: "".join(f"<div>level {j} of {k}" for j in range(2500)) + "<p>same</p>"
    rows = [(k, "http://long/", long(k)) for k in range(1, 5)] + [(10 + k, "http://deep/", deep(k)) for k in range(1, 5)]
    got = {r.page_id: r.text.split("\n") for r in html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(1, 5):
        assert got[k] == [f"row {j} of {k}" for j in range(3000) if j % 9]
        assert got[10 + k] == [f"level {j} of {k}" for j in range(2500)]


def test_components(spark):
    from tessera.llm.graph import components

    edges = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 102), (102, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 102: 100, 103: 100}


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(25)]
    rows = [(k, " ".join(word() for _ in range(40)) + ".\n" + " ".join(word() for _ in range(20)), "en", f"s{k % 3}") for k in range(60)]
    rows += [(100, rows[5][1].split("\n")[0] + "\nanother line that follows it here", "en", "s1"), (101, rows[6][1].replace("\n", " ") + " end", "en", "s1"), (102, " ".join([word()] * 3 + item + [word()] * 9), "en", "s2")]
    rows += [(k, " ".join(word() + "%%%" for _ in range(30)), "en", "s0") for k in range(200, 260)]
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 200), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(60)) | {100}


@pytest.mark.parametrize("block", [2048, 50])
def test_jaccard_near_copies_make_few_rows(spark, monkeypatch, block):
    """Copies that mostly don't link with their pivot: the rows grow with the classes (and blocks), not with their pairs."""
    from tessera.llm import jaccard

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    base, rows = [word() for _ in range(300)], []
    for k in range(240):
        text = list(base)
        for at in rng.sample(range(5, 290, 5), 3 if k % 8 == 0 else 4):
            text[at] = word()
        rows.append((k * 7, " ".join(text)))
    sizes, keep = {}, jaccard.materialise

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs, 4, 85, 100).collect()}
    sets = {k: shingles(t, 4) for k, t in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low_, high = sorted((root[a], root[b]))
                root = {k: low_ if v == high else v for k, v in root.items()}
    assert got == root and len(set(root.values())) < len(root)
    assert block < len(rows) or max(sizes.values()) <= 2 * sizes["members"], sizes


def test_jaccard_texts_by_bit_map(spark):
    from tessera.llm.jaccard import with_texts

    docs = spark.createDataFrame([(k - 50, f"text {k}") for k in range(4000)] + [(None, "none"), (7, "again")], "doc_id long, text string")
    named = docs.where("doc_id % 3 = 0 or doc_id = 7").select("doc_id", F.lit(1).alias("cid")).distinct()
    want = sorted(map(tuple, docs.join(named, "doc_id").select("doc_id", "text").collect()))
    assert sorted(map(tuple, with_texts(named, docs).select("doc_id", "text").collect())) == want and len(want) > 1300


def test_jaccard_long_texts_stay_apart_by_fine_points(spark, monkeypatch):
    """Long unrelated texts that share a passage: counts in 256 groups can't keep them apart, and their texts went to one task for each shingle."""
    import numpy as np

    from tessera.llm import jaccard

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, texts = [word() for _ in range(300)], []
    for _ in range(14):
        at, own = rng.randrange(8000), [word() for _ in range(rng.randrange(8500, 9500))]
        texts.append(own[:at] + passage + own[at:])
    for source, edits in ((0, 100), (1, 150), (2, 400)):
        copy = list(texts[source])
        for at in rng.sample(range(len(copy)), edits):
            copy[at] = word()
        texts.append(copy)
    rows = [(k * 3, " ".join(t)) for k, t in enumerate(texts)] + [(900, "short text of its own")]
    sizes, keep = {}, jaccard.materialise

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    monkeypatch.setattr(jaccard, "sketch", lambda docs, words: np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))  # else all shared shingles come last
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs, 5, 80, 100).collect()}
    sets = {k: shingles(t, 5) for k, t in rows}
    want = {k: min(o for o in sets if 100 * len(sets[k] & sets[o]) >= 80 * len(sets[k] | sets[o])) for k in sets}
    assert got == want and want[14 * 3] == 0 and want[15 * 3] == 3 and want[16 * 3] == 48
    assert sizes["members"] > 20 and sizes["named"] <= 9, sizes


def test_fine_points_bound_the_intersection():
    import numpy as np

    from tessera.llm import jaccard

    rng = np.random.default_rng(12)
    pool = np.unique(rng.integers(0, 2**64, 600_000, dtype=np.uint64))
    crowded = pool[jaccard.mix(pool ^ np.uint64(0xC0FFEE)) % np.uint64(256) < np.uint64(3)]
    for values in (pool, crowded):
        for n in (1, 1024, 1025, 2048, 2049, 3000, 4000):
            for m in (n, max(1, n * 4 // 5), n * 5 // 4):
                a, b = (rng.choice(values[:6000], k, replace=False) for k in (n, m))
                (x, y), points = (jaccard.fine_points(v, np.array([0, len(v)])) for v in (a, b)), []
                for v, held in ((a, x[0]), (b, y[0])):
                    assert (held is None) == (len(v) <= 1024)
                    coarse = np.bincount((jaccard.mix(v ^ np.uint64(0xC0FFEE)) % np.uint64(256)).astype(np.int64), minlength=256)
                    points.append(jaccard.fine_point(held or jaccard.packed(coarse[None])[0], len(v)))
                    assert (points[-1].reshape(-1, 256).sum(axis=0) == coarse).all()
                assert len(np.intersect1d(a, b)) <= jaccard.most_shared(*points) <= min(n, m)


def test_near_duplicates_go_without_shuffled_texts(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm.jaccard import without

    rows = [(k - 50, f"text {k}", "en") for k in range(3000)] + [(None, "none", "en"), (7, "again", "en"), (8, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, asked string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for ids in (docs.where("doc_id % 3 = 0 or doc_id = 7"), docs.where("false"), docs.where("doc_id is null or doc_id = -50")):
        gone = {r.doc_id for r in ids.collect()} - {None}
        got = without(docs, ids)
        assert got.columns == docs.columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in gone)

    def shuffled() -> int:
        tracker = spark.sparkContext._jsc.sc().statusStore()
        stages = tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(400))
    rows = [(k, text()) for k in range(600)]
    rows += [(600 + k, rows[k][1] + " end") for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/texts")
    docs, size = spark.read.parquet(f"{tmp_path}/texts"), sum(len(t) for _, t in rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    before = shuffled()
    assert {r.doc_id for r in kept.collect()} == set(range(600))
    assert shuffled() - before < size / 20


def test_quality_holds_few_ngrams_at_a_time(monkeypatch):
    """A worker beside a full heap has little memory: 2 MB of text at a time made 100 MB more of n-grams than 512 KB."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import quality
    from tessera.llm.textkit import raw

    rng, seen, features = random.Random(14), [], quality.features
    monkeypatch.setattr(quality, "features", lambda off, part: (seen.append(len(part)), features(off, part))[1])
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.choice((5, 400, 3000)))) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(302)), pa.array([k % 2 for k in range(302)], pa.int32()), pa.array(texts)], ["turn", "label", "text"])
    score = quality.scorer(np.random.default_rng(15).normal(size=1 << quality.BITS).astype(np.float32), 0.1)
    scores = score(*raw(batch.column("text")))
    rows = [r for b in quality.vectors(iter([batch])) for r in b.to_pylist()]
    assert max(seen) <= 600_000 < sum(seen)
    monkeypatch.setattr(quality, "chunks", lambda off, data, *_: [(0, len(off) - 1, off, data)])
    assert (scores == score(*raw(batch.column("text")))).all()
    assert rows == [r for b in quality.vectors(iter([batch])) for r in b.to_pylist()]


def test_decontamination_holds_little_text_at_a_time(monkeypatch):
    """A worker beside a full heap has little memory: whole batches in lower case made 130 MB more than pieces of 2 MB."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import decontamination as D
    from tessera.llm.textkit import CHUNK

    rng, seen, back, folded = random.Random(16), [], [], D.folded
    item = " ".join(f"q{k}" for k in range(30))
    texts = [" ".join(f"W{rng.randrange(5000)}" for _ in range(rng.choice((5, 400, 9000)))) for _ in range(400)] + [None, ""]
    for k in (0, 7, 399):
        texts[k] += " " + item
    items = D.Items([(1, item)])
    items.seeded(np.zeros(len(items.keys), dtype=np.int64), 0.5)
    monkeypatch.setattr(D, "folded", lambda column: (seen.append(sum(len(x or "") for x in column.to_pylist())), folded(column))[1])
    monkeypatch.setattr(D, "give_back", lambda: back.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(402)), pa.array(texts)], ["doc_id", "text"])
    kept = [b.to_pydict() for b in D.clean(iter([batch.slice(0, 0), batch, batch.slice(5, 300)]), 1, items, 0.5)]
    want = [k for k in range(402) if k not in (0, 7, 399)]
    assert [i for b in kept for i in b["doc_id"]] == want + [k for k in range(5, 305) if k != 7]
    assert [t for b in kept for t in b["text"]][: len(want)] == [texts[k] for k in want]
    assert [r["doc_id"] for b in D.found(iter([batch]), items, 0.5) for r in b.to_pylist()] == [0, 7, 399]
    assert max(seen) <= CHUNK < sum(seen) and len(back) == 4


def test_personal_data_writes_few_tables(spark, monkeypatch):
    """Each file of a table on a local disk costs an executor a process or two; the rounds write none."""
    from tessera.llm import pii

    names, materialise = [], pii.materialise
    monkeypatch.setattr(pii, "materialise", lambda df, name: (names.append(name), materialise(df, name))[1])
    rows = [(k, f"token: {k}f3A{k}bC9dE7gH5jK{k}lM1nP tail") for k in range(6)] + [(6, "token: abc123def456ghi"), (7, "write to a@b.org")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6].secrets == "7:22" and got[7].spans == "email:9:16" and all(got[k].secrets for k in range(6))
    assert names == ["spans", "contexts"]
