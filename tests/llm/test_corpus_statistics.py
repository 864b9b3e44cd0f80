"""Collocations, hard negatives and lattice scores against brute force, and their defined results for odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from gradeflow.llm import collocations, hard_negatives, lattice

LOWER = {c: c + 32 for c in range(65, 91)}


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "word", "phrase", "f", "key", "row", "name", "score", "block", "part", "anchor", "a", "k", "suffix")})


# Collocations


def brute_phrases(rows, least, most_words=5):
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, most_words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def brute_collocations(rows, least, top=2000):
    out = []
    for lang, f in brute_phrases(rows, least).items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        candidates = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        found = []
        for w, a in candidates.items():
            inside = any(len(x) > len(w) and b >= a and any(x[i : i + len(w)] == w for i in range(len(x))) for x, b in candidates.items())
            if not inside:
                score, _, l, r = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, i, w.decode(), -a, l, r, n, -s) for i, (s, a, w, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def spoken(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ä", "日本", "b\x01", "b", "b\x01x", "zz", "new", "york"]
    return [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_beginnings_split_over_tasks_sum_to_the_counts():
    rng = np.random.default_rng(1)
    for trial in range(30):
        table = rng.integers(1, 4, (200, 5))
        for row in table:
            row[rng.integers(2, 6) :] = 0
        rows, n = np.unique(table, axis=0, return_counts=True)
        least = int(rng.integers(1, 12))
        cuts = np.sort(rng.integers(0, len(rows) + 1, rng.integers(0, 4)))
        found = collections.Counter()
        for own, times in zip(np.split(rows, cuts), np.split(n, cuts)):
            shuffled = rng.permutation(len(own))
            for row, depth, count in collocations.frequent_beginnings(own[shuffled], times[shuffled], least):
                found[tuple(own[shuffled][row][:depth].tolist())] += count
        want = collections.Counter(tuple(r[:k]) for r in table.tolist() for k in range(1, 6) if r[k - 1])
        assert {k: v for k, v in found.items() if v >= least} == {k: v for k, v in want.items() if v >= least}


@pytest.mark.parametrize("least", [1, 3, 25])
def test_collocations_are_those_of_a_plain_count(spark, monkeypatch, least):
    monkeypatch.setattr(collocations, "SORTED", 50)  # many tasks, so that beginnings are split
    rows = spoken(150, least) + [("en", "hot pair " * 300)] * 3 + [("de", None), (None, ""), ("fr", " . \t")]
    docs = clashing(spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate(rows)], "doc_id bigint, lang string, text string").repartition(5))
    got = collocations.collocations(docs, least=least, top=60)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, least, 60)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "bigint", "string", *["bigint"] * 5]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", "one two one two")], "lang string, text string")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**12 + 7
    found = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a b c", 3, big - 2)], "lang string, phrase string, words int, f bigint")
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 11), ("en", "c", big + 5)], "lang string, word string, n bigint")
    total = spark.createDataFrame([("en", 10**13 + 9)], "lang string, n bigint")
    found = found.unionByName(spark.createDataFrame([("en", "b c", 2, big - 2)], found.schema))
    got = {r["phrase"]: (r["l"], r["r"], r["score"]) for r in collocations._split_scores(found, counts, total).collect()}
    n = 10**13 + 9
    assert got["a b"] == (big, big + 11, 1000 * (big - 1) * n // (big * (big + 11)))
    cuts = [(1000 * (big - 2) * n // (l * r), k, l, r) for k, l, r in ((1, big, big - 2), (2, big - 1, big + 5))]
    assert got["a b c"] == (min(cuts)[2], min(cuts)[3], min(cuts)[0])


# Hard negatives


def brute_negatives(rows, positives=5, negatives=10, lowest=30, highest=90):
    own = {}
    for i, l, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2] and all(map(math.isfinite, r[2]))), key=lambda r: (r[0], r[1], r[2])):
        own.setdefault(i, (l, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in own.items():
        if a % 3 == 0:
            score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in own.items() if i != a}
            order = sorted(score, key=lambda i: (-score[i], i))
            for p in [i for i in order if own[i][0] == label][:positives]:
                fit = [i for i in order if own[i][0] != label and lowest * score[p] <= 100 * score[i] <= highest * score[p]]
                out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def vectors(n, seed, size=6, spread=4):
    rng = random.Random(seed)
    return [(i, rng.randrange(3), [rng.randint(-1, spread) / 8 for _ in range(size)]) for i in range(n)]


VECTORS = "vec_id bigint, label int, embedding array<double>"


@pytest.mark.parametrize("k", [(5, 10), (1, 1), (8, 3)])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 40)
    rows = vectors(150, sum(k)) + [(300 + i, i % 3, [0.5] * 6) for i in range(60)]  # a common vector: ties
    rows += [(3, 1, [0.25] * 6), (None, 1, [1.0] * 6), (400, None, [1.0] * 6), (402, 1, None), (405, 1, []), (408, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (411, 1, [math.nan] * 6), (414, 2, [math.inf] * 6)]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = hard_negatives.mine(df, lambda i: i % 3 == 0, positives=k[0], negatives=k[1])
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, *k)


def test_hard_negatives_of_odd_tables(spark):
    mine = lambda rows: hard_negatives.mine(spark.createDataFrame(rows, VECTORS), lambda i: i % 3 == 0).collect()
    assert mine([]) == [] and mine([(0, 1, [1.0])]) == [] and mine([(0, 1, [1.0]), (1, 2, [0.5])]) == []
    # Another than the usual size takes no part; a positive below zero has no window, one of zero only scores of zero.
    assert mine([(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.5, 0.0]), (4, 2, [1.0])]) == []
    assert [tuple(r) for r in mine([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 2.0]), (5, 2, [0.5, 0.0])])] == [(0, 1, 1, 2, 0, 0)]


def test_wide_products_are_exact():
    rng = np.random.default_rng(5)
    for bits in (10, 25, 30):
        a, b = (np.floor(rng.uniform(-(2.0**bits), 2.0**bits, (4, 3))) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        assert hard_negatives.products(a, b).tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.products(np.full((1, 2), 2.0**40), np.full((1, 2), 2.0**40))


def test_slots_keep_no_more_than_they_answer():
    best = hard_negatives.Best(2, 3, np.int64(-(2**63)))
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 5, (2, 400))
    for at in range(0, 400, 37):
        own = scores[:, at : at + 37]
        best.add(own, np.ones(own.shape, bool), np.arange(at, at + own.shape[1]))
    for a in range(2):
        want = sorted(range(400), key=lambda i: (-scores[a, i], i))[:3]
        assert best.id[best.owner == a].tolist() == want and len(best.id) == 6


# Lattice scores


def small_model(kind=spec.TrainerSpec.BPE):
    proto = spec.ModelProto()
    proto.trainer_spec.model_type = kind
    for k, piece in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "é", "▁b", "▁ba"]):
        proto.pieces.add(piece=piece, score=-float(k) if kind == spec.TrainerSpec.BPE else -2.0 - k / 4, type=1)
    proto.pieces.add(piece="<unk>", score=0, type=2)
    return proto.SerializeToString()


def segmentations(text, weights):
    if not text:
        yield []
    for end in range(1, len(text) + 1):
        if text[:end] in weights:
            for rest in segmentations(text[end:], weights):
                yield [text[:end], *rest]


@pytest.mark.parametrize("kind", [spec.TrainerSpec.BPE, spec.TrainerSpec.UNIGRAM])
def test_marginal_sums_all_segmentations(kind):
    weights = lattice.existing_weights(small_model(kind))
    assert math.isclose(sum(weights.values()), 1)
    own = lattice.Lattice(weights)
    for word in ("", "a", "abab", "bé", "zab", "▁a"):
        text = (lattice.MARK + word.encode()) if word else b""
        all_of = [(math.prod(weights[p] for p in s), s) for s in segmentations(text, {w for w in weights if w})] if word else [(weights[b""], [b""])]
        total = sum(p for p, _ in all_of)
        assert math.isclose(own.marginal(word.encode()), math.log(total), rel_tol=1e-9)
        want = collections.Counter()
        for p, s in all_of:
            for piece in s:
                want[piece] += p / total
        got = {}
        own.expected(word.encode(), got)
        assert got.keys() >= {k for k, v in want.items() if v > 1e-9} and all(math.isclose(v, want[k], rel_tol=1e-6, abs_tol=1e-9) for k, v in got.items())


def brute_scores(rows, model):
    read = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))] + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not held(i) for w in read(t))
    n, v = sum(c.values()), len(c)
    n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    given, expected = lattice.existing_weights(model), {}
    first = lattice.Lattice(given)
    for w in c:
        first.expected(w, expected)
    total = sum(expected.values()) + lattice.PRIOR
    spelled = lattice.Lattice({p: (expected.get(p, 0) + lattice.PRIOR * w) / total for p, w in given.items()})
    share = discount * v / n if n else 1.0
    p = lambda w: (max(c[w] - discount, 0) / n if n else 0) + share * math.exp(spelled.marginal(w))
    out = []
    for i, t in rows:
        own = read(t)
        out.append((i, held(i), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), sum(math.log10(p(w)) for w in own)))
    return out


def alike(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    return len(got) == len(want) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("frequent", [4, 60, 1 << 18])
def test_scores_are_the_same_wherever_words_are_looked_up(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    rng = random.Random(3)
    words = ["a", "ab", "AB", "aba", "bé", "zz", "x" * 200, "y" * 65, " ", "w\x1cw"]
    rows = [(i, " \x0b".join(rng.choice(words) for _ in range(rng.randint(0, 20)))) for i in range(120)]
    rows += [(3, "repeated id"), (3, "repeated id"), (None, "a b"), (None, None), (500, None), (501, ""), (502, "\n\t ")] + [(600 + i, f"only{i} here") for i in range(30)]
    path = tmp_path / "m.model"
    path.write_bytes(small_model())
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    got = lattice.score(docs, lattice.train(docs, str(path))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert alike(got.collect(), brute_scores(rows, path.read_bytes()))


def test_scores_without_training_texts(spark, tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(small_model())
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "ab " * k) for k, i in enumerate(held[:4])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert alike(lattice.score(docs, lattice.train(docs, str(path))).collect(), brute_scores(rows, path.read_bytes()))
    empty = docs.where("false")
    assert lattice.score(empty, lattice.train(empty, str(path))).collect() == []


def test_whole_numbers_round_down():
    column = pa.chunked_array([pa.array([[0.0, -0.001, 0.0039, 0.00391]], pa.list_(pa.float64()))])
    assert hard_negatives._whole(column).tolist() == [[0.0, -1.0, 0.0, 1.0]]
