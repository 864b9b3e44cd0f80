"""The operators against brute-force versions, and their defined results for odd rows."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from gradeflow.llm import ann, chat, decontaminate, html, language, line_dedup, secrets, sentencepiece_codec, toxicity, weighted_minhash
from gradeflow.llm.common import HAS_LETTER, folded, mix, word_hashes
from gradeflow.llm.graph import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, LONG), (4, "one two three four five six"), (4, "one two three four five six"), (None, "a row without an id here"), (7, "ß É 日本 \x00 \n\n !!")]


def docs(spark, rows):
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """With further columns named as the operators' own."""
    return df.withColumns({c: F.lit("x") for c in ("id", "line", "same", "words", "score", "spans", "size", "total", "h", "_bucket", "row", "band")})


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def made_texts(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "ing", "and", "ou", "er", "st", "re", "a", "on", "ly"]
    return [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(6, 30))) for _ in range(n)]


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


# Nearest neighbours


def test_hilbert_neighbours_are_adjacent():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = ann.hilbert(cells, 3)
    assert sorted(place.tolist()) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_search_finds_exact_neighbours_and_ignores_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(i, vectors[7]) for i in range(1000, 1040)]
    bad = [(5000, None), (5050, [0.0] * 8), (5100, [1.0] * 7 + [None]), (5150, [float("nan")] * 8), (5200, [float("inf")] + [1.0] * 7), (None, vectors[1]), (5250, [1.0, 2.0]), (50, vectors[50])]
    got = ann.search(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>"), lambda c: c % 50 == 0).collect()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    hits = total = 0
    for q in {r["query_id"] for r in got}:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        exact = sorted(((-round(float(unit[q] @ u), 12), i) for i, u in unit.items() if i != q))[:5]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        hits += len({r["vec_id"] for r in own} & {i for _, i in exact})
        total += 5
    assert {r["query_id"] for r in got} == {i for i in unit if i % 50 == 0}
    assert hits / total >= 0.9
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 1000), key=lambda r: r["rank"])] == [7, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in ann.search(few, lambda c: c % 50 == 0).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(few.limit(0), lambda c: c % 50 == 0).count() == 0


# Decontamination


def test_fm_index_finds_all_occurrences():
    rng = np.random.default_rng(5)
    for alphabet in (2, 5):
        text = rng.integers(1, alphabet + 1, 400)
        index = decontaminate.FMIndex(text)
        found = [text[i : i + n] for i in range(0, 390, 13) for n in (1, 3, 7)] + [rng.integers(1, alphabet + 1, 7) for _ in range(10)]
        table = np.zeros((len(found), 7), np.int64)
        for k, p in enumerate(found):
            table[k, 7 - len(p) :] = p
        which, low, high = index.search(table, np.array([len(p) for p in found]))
        places = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, low, high)}
        for k, p in enumerate(found):
            assert places.get(k, []) == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


def test_contamination_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 64)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 900)  # several blocks
    items = [(i, t) for i, t in enumerate(made_texts(12, 1))] + [(20, "three short words"), (21, None), (22, "!"), (23, "one two three four five six")]
    rng = random.Random(2)
    rows = list(ODD)
    for i, t in enumerate(made_texts(40, 9)):
        part = rng.choice(items[:13])[1].split()
        rows.append((100 + i, t + ".\n" + " ".join(part[: rng.randint(3, len(part))]).upper() + "; " + t if i % 2 else t))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    source = docs(spark, rows)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.summary(decontaminate.contamination(clashing(source), bench)).collect())
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    expected = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for p, its in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    names |= its
        expected.append((i or 0, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(expected)
    cleaned = decontaminate.without_spans(source, bench)
    assert cleaned.columns == source.columns
    assert not decontaminate.summary(decontaminate.contamination(cleaned.where("doc_id >= 100"), bench)).where("n_hit >= 10").count()
    kept = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(kept[e[0]] == dict(rows)[e[0]] for e in expected if e[0] >= 100 and not e[2])
    assert 4 not in kept  # every word is hit
    named = source.withColumns({c: F.lit("z") for c in ("spans", "items", "n_words", "_cut", "_key", "_row", "_text", "kept_0")})
    recut = decontaminate.without_spans(named, bench)
    assert recut.columns == named.columns and {r["doc_id"]: r["text"] for r in recut.collect()} == kept
    assert recut.where("spans = 'z' AND items = 'z' AND n_words = 'z' AND _cut = 'z' AND _key = 'z' AND _row = 'z' AND _text = 'z'").count() == recut.count()
    assert decontaminate.contamination(source, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.contamination(source.limit(0), bench).count() == 0


# SentencePiece


def test_encoding_is_the_library_s(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "  a  b", "\n", " \n x", "▁x ▁▁y", "a\n▁b", "日本語 😀 é", "</s><0x0A>", "a ", "x\n  \n", "tab\tq \r\n", "a" * 5000, LONG]
    got = sentencepiece_codec.encode(clashing(docs(spark, list(enumerate(texts)) + [(99, None)])), path).collect()
    for r in got:
        text = dict(enumerate(texts)).get(r["doc_id"]) or ""
        assert r["ids"] == lib.encode(text) and r["decoded"] == lib.decode(r["ids"]) and r["aligned"]
        source = text.encode()
        assert all(0 <= a <= b <= len(source) for a, b in zip(r["starts"], r["ends"]))
        assert not source or (r["starts"][0], r["ends"][-1]) == (0, len(source))
        assert all(b >= a for a, b in zip(r["ends"], r["starts"][1:]))


def test_numerals_are_no_letters():
    assert not any(map(HAS_LETTER.search, ["", "²", "½ 12", "Ⅷ", "१", "_", "!? \n"])) and all(map(HAS_LETTER.search, ["a²", "日", "é", "1st"]))


def test_ids_of_blanks_breaks_and_marks_are_the_library_s():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    lib, rng = sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(8)
    bits = ["a", "b", "the", "ing", " ", "  ", "   ", "\n", "\n\n", "\t", "▁", "é", "日本", "\x00", "\r\n", ".", "<0x0A>", "<s>", "</s>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(10_000)] + ["a  b \nc", " \n", "▁\n", "\n \n", "x \n\ny  z"]
    assert [ids.tolist() for ids in sentencepiece_codec.Codec(model).encode(texts)] == lib.encode(texts)


def test_character_map_takes_the_longest_prefix():
    # A double array for the single rule "ab" -> "x" beside "a" -> "yy".
    class Fixed(sentencepiece_codec.Normalizer):
        rules = {b"ab": b"x", b"a": b"yy"}

        def longest(self, source, at):
            best = max((k for k in self.rules if source.startswith(k, at)), key=len, default=None)
            return (len(best), self.replacements.index(self.rules[best])) if best else (0, -1)

    own = Fixed(spec.NormalizerSpec(add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False))
    own.units, own.replacements = [0], b"x\0yy\0"
    text, origin = own.mapped("cabaé".encode())
    assert text == "cxyyé".encode() and origin.tolist() == [0, 1, 3, 3, 4, 4, 6]


# Chat


def test_chat_round_trip_and_parts(spark):
    texts = ["", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nhi", "\\", "\\\\<\\|", "<<SYS>><s>", LONG, None]
    rows = [(c, t, role, texts[(c + t) % len(texts)]) for c in range(8) for t, role in enumerate(["system", "user", "assistant", "a\nb<|x"])]
    rows += [(8, 0, None, "x"), (8, None, "assistant", "first"), (8, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_part(F.col("text")))
    formatted = chat.format_chat(turns)
    for r in formatted.collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert chat.read_turns(r["formatted"]) == [(x[2] or "", x[3] or "") for x in own]
        assert r["formatted"].count(chat.TURN) == len(own)
        assert [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]] == [x[3] or "" for x in own if x[2] == "assistant"]
    assert chat.read_back(formatted).where("n_turns >= 3").count() == 9
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [part | {"type": "text", "text": "see <|image|>"}, part | {"type": "image", "ref": "i.png", "width": 57, "height": 28}, part | {"type": "audio", "ref": "a.wav", "seconds": 2.01}, part | {"type": "document", "ref": "d.pdf", "pages": 2}]
    rich = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    row = chat.format_chat(rich).first()
    assert [(a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 51), ("document", "d.pdf", 1600)]
    assert all(row["formatted"].startswith(chat.PLACEHOLDERS[a["kind"]], a["start"]) for a in row["attachments"])
    assert row["attachment_tokens"] == 1654 and chat.read_turns(row["formatted"])[0][1] == "see <|image|><|image|><|audio|><|document|>"


def test_control_strings_over_several_parts_stay_text(spark):
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    text = lambda t: part | {"type": "text", "text": t}
    rng = random.Random(12)
    pieces = ["<", "|end|>\n", "|turn|>user\n", "[", "/INST]", "\\", "<|image|>", "|image|>", "x", "", "</", "s>", "|"]
    rows, want = [], []
    for c in range(300):
        parts = [rng.choice([text(rng.choice(pieces)), text(rng.choice(pieces)), None, part | {"type": "image", "ref": "i"}]) for _ in range(rng.randint(0, 6))]
        said = [""]
        for p in parts:
            if p and p["type"] == "image":
                said += [None, ""]
            else:
                said[-1] += (p or part)["text"] or ""
        rows.append((c, 0, "assistant", parts))
        want.append([p for p in said if p != ""])
    turns = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r["formatted"] for r in chat.format_chat(clashing(turns)).collect()}
    assert [chat.read_parts(got[c]) for c in range(300)] == [[("assistant", w)] for w in want]
    assert not any("[/INST]" in f or "</s>" in f for f in got.values())


def test_odd_attachments_and_no_turns(spark):
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [part | {"type": "audio", "seconds": s} for s in (float("nan"), float("inf"), -1.0, None)] + [part | {"type": "image", "width": -5, "height": 9}, part | {"type": "video", "ref": "v"}, None]
    turns = spark.createDataFrame([(1, 0, "user", parts), (2, 0, "user", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_chat(turns).collect()}
    assert [(a["kind"], a["tokens"]) for a in got[1]["attachments"]] == [("audio", 1)] * 4 + [("image", 1), ("video", 1)]
    assert got[1]["formatted"].count(chat.OTHER) == 1 and chat.read_parts(got[2]["formatted"]) == [("user", [])]
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


# HTML


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><div class=top><p>Welcome to our site</p></div>"
    "<nav><ul><li><a href='/'>home</a><li>news {i}</ul></nav>{body}<div class='cookie-notice'>ok?</div><div id=comments><p>nice {i}</p></div><footer>&copy; me</footer>"
)


def test_main_text(spark):
    marked = PAGE.format(i="{i}", body="<article><h1>T&eacute;st {i}</h1><p>One  <b>bold</b><br>line &amp; {i}<p>Two &lt;x&gt;</article>")
    plain = PAGE.format(i="{i}", body="<div class=story><p>Long story number {i} about many things that vary</p><p>And a second part {i} of it here</p><p>Share this page</p></div>")
    rows = [(i, f"http://a.org/{i}", marked.replace("{i}", str(i))) for i in range(6)] + [(10 + i, f"https://B.org:80/{i}", plain.replace("{i}", str(i))) for i in range(6)]
    rows += [(20, None, None), (21, "http://c.org", ""), (22, "http://d.org/x", "<article><p>single</article>"), (23, "http://e.org", "just text <b>here"), (0, "http://a.org/0", marked.replace("{i}", "0"))]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3] == "Tést 3\nOne bold line & 3\nTwo <x>"
    assert got[13] == "Long story number 3 about many things that vary\nAnd a second part 3 of it here"
    assert (got[20], got[21], got[22], got[23]) == ("", "", "single", "just text here")
    assert html.main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_hints_of_furniture_never_take_the_whole_page_and_trees_may_be_deep(spark):
    text = "<h1>Title {i}</h1><p>Long story number {i} about many things that vary from page to page</p>"
    whole = {
        "a": "<body class='no-sidebar'><nav>menu</nav>" + text + "</body>",
        "b": "<body><form action='/'><nav>menu</nav>" + text + "<div class='share'>x</div></form></body>",
        "c": "<body><div class='banner'>ad</div><main class='with-sidebar'>" + text + "</main><div class='comments'><p>nice one</p></div></body>",
        "d": "<body>" + "<div>" * 3000 + text + "</div>" * 3000 + "</body>",
    }
    rows = [(i, f"http://{h}.org/{i}", t.replace("{i}", str(i))) for h, t in whole.items() for i in range(2)]
    got = {(r["url"][7], r["page_id"]): r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {(h, i): f"Title {i}\nLong story number {i} about many things that vary from page to page" for h in whole for i in range(2)}


# Toxicity and language


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i, t in enumerate(made_texts(800, 3)):
        bad = rng.random() < 0.3
        rows.append((i, t + (" vile scum" if bad else "")))
        labels.append((i, 1, int(bad)))
    source = docs(spark, rows + [(9001, None), (9002, "")])
    known = spark.createDataFrame(labels + [(1, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(clashing(source).drop("h", "id"), known)
    got = {r["doc_id"]: r for r in toxicity.score(source, model).collect()}
    truth = {i: y for i, _, y in labels}
    assert sum(got[i]["predicted"] == y for i, y in truth.items()) >= 0.97 * len(truth)
    assert got[9001]["score"] == got[9002]["score"] and 0 <= got[9001]["score"] <= 1
    assert toxicity.score(source, toxicity.train(source, known.limit(0))).where("predicted = 1").count() == 0


def test_toxic_words_count_each_for_itself_and_in_every_fold(spark):
    place = lambda w: int(mix(np.array([xxhash.xxh3_64_intdigest(w.encode())], np.uint64))[0] % np.uint64(1 << 19))
    own = place("common")
    met = next(w for w in (f"w{i}" for i in itertools.count()) if place(w) == own)  # meets an ordinary word in 2^19 counters
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows, labels = [], []
    for i, t in enumerate(made_texts(1600, 5)):
        bad = i % 10 == 0
        rows.append((i, t + (f" {met} vile" + (" scum" if fold(i) == 3 else "") if bad else " common")))
        labels.append((i, 1, int(bad)))
    model = toxicity.train(docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    probes = [(i, f"{rows[1][1]} {w}") for i, w in enumerate(["vile", met, "scum", "on"])]
    vile, other, late, none = (r["score"] for r in toxicity.score(docs(spark, probes), model).orderBy("doc_id").collect())
    assert other > none + 0.2 and late > none + 0.2 and vile > none + 0.2


def test_labels_meet_texts_by_one_kind_of_join(spark):
    rows = [(i, t) for i, t in enumerate(made_texts(40, 6))]
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(0, 40, 3)], "doc_id bigint, quality int, toxic int")
    got = toxicity._labelled(docs(spark, rows), known, "doc_id", "text", "toxic")
    found = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("BroadcastHashJoin") <= plan.count("LeftSemi")  # few labels, yet only the sieve is broadcast
    expected = {(i, rows[i][1].encode(), i % 2, zlib.crc32(str(i).encode()) % 4) for i in range(0, 40, 3) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {(r["id"], bytes(r["text"]), r["toxic"], r["fold"]) for r in found} == expected and len(found) == len(expected)


def kneser_ney(texts, slots, model):
    """Log ratios by word and by pair of one model, from plain dictionaries."""
    runs = [["<s>", *split(t), "</s>"] if split(t) else [] for t in texts]
    learned = [(r, s % 2) for r, s in zip(runs, slots) if s is not None and s // 2 != model - 1]
    d, n, met, after = 0.75, ({}, {}), ({}, {}), {}
    for r, c in learned:
        for pair in itertools.pairwise(r):
            n[c][pair] = n[c].get(pair, 0) + 1
    everywhere = {p for r, s in zip(runs, slots) if s is not None for p in itertools.pairwise(r)}
    for u, v in everywhere:
        after.setdefault(v, set()).add(u)
    for c in (0, 1):
        for (_, v), k in n[c].items():
            met[c][v] = met[c].get(v, 0) + k
    shared = lambda v: (len(after.get(v, ())) + 0.5) / (len(everywhere) + 0.5 * (len(after) + 1))
    both = {p: n[0].get(p, 0) + n[1].get(p, 0) for p in n[0].keys() | n[1].keys()}
    discounted = lambda table, u, v, lower: (lambda own: (max(table.get((u, v), 0) - d, 0) + d * len(own) * lower) / sum(own) if own else lower)([k for (left, _), k in table.items() if left == u])

    def by_word(w, c):
        total, taken = sum(met[c].values()), sum(min(k, d) for k in met[c].values())
        return (max(met[c].get(w, 0) - d, 0) + taken * shared(w)) / total if total else shared(w)

    def by_pair(u, v, c):
        return discounted(n[c], u, v, discounted(both, u, v, shared(v)) if (u, v) in both else 1.0)

    mixed = lambda p1, p0: math.log(1 - toxicity.TOXIC_SHARE + toxicity.TOXIC_SHARE * p1 / p0)
    words = lambda r: sum(mixed(by_word(w, 1), by_word(w, 0)) if w in after else 0.0 for w in r[1:-1])
    pairs = lambda r: sum(mixed(by_pair(u, v, 1), by_pair(u, v, 0)) for u, v in itertools.pairwise(r))
    return [(words(r), pairs(r), max(len(r) - 2, 0)) for r in runs]


def test_toxicity_ratios_are_those_of_kneser_ney(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(25)]
    texts = [" ".join(rng.choices(vocabulary, range(25, 0, -1), k=rng.randint(0, 30))) for _ in range(120)] + ["new new w1 words w2", None, "W3-w3"]
    folds = [zlib.crc32(str(i).encode()) % 4 for i in range(len(texts))]
    toxic = [rng.random() < 0.3 for _ in texts]
    slots = [toxicity.FOLDS.index(f) * 2 + int(y) if f != 2 and i < 110 else None for i, (f, y) in enumerate(zip(folds, toxic))]
    known = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(110)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(toxicity, "BLOCK_DOCS", 16)  # many small blocks
    source = docs(spark, list(enumerate(texts)))
    model = toxicity.train(source, known)
    rows = toxicity.as_bytes(source, "doc_id", "text").withColumn("mark", F.lit(-1))
    got = {r["doc_id"]: r for r in toxicity._ratios(rows, "doc_id", model.counts, model.parts).collect()}
    expected = kneser_ney(texts, slots, 0)
    assert len(got) == len(texts)
    for i, (by_word, by_pair, size) in enumerate(expected):
        assert (got[i]["by_word"], got[i]["by_pair"], got[i]["size"]) == (pytest.approx(by_word, abs=1e-5), pytest.approx(by_pair, abs=1e-5), size)
    crossed = model.calibration.withColumn("doc_id", F.lit(0).cast("long"))
    found = sorted((r["mark"], r["size"], r["by_word"], r["by_pair"]) for r in toxicity._ratios(crossed, "doc_id", model.counts, model.parts).collect())
    by_model = {k: kneser_ney(texts, slots, k) for k in (1, 2, 3)}
    others = sorted((s, by_model[s // 2 + 1][i][2], *by_model[s // 2 + 1][i][:2]) for i, s in enumerate(slots) if s is not None)
    assert [r[:2] for r in found] == [r[:2] for r in others]
    assert np.allclose([r[2:] for r in sorted(found, key=lambda r: (r[0], r[1], round(r[2], 4)))], [r[2:] for r in sorted(others, key=lambda r: (r[0], r[1], round(r[2], 4)))], atol=1e-4)


def test_toxicity_of_one_table_sends_its_pairs_once(spark, monkeypatch):
    rng = random.Random(10)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, range(60, 0, -1), k=rng.randint(0, 40)) + ["bad"] * (i % 7 == 0))) for i in range(300)]
    rows += [(None, "w1 w2"), (301, None), (302, ""), (302, "w3 bad"), (3, "w4 w5 bad")]  # ids may be null or repeat
    labels = [(i, 1, int(i % 7 == 0)) for i in range(0, 310, 2)] + [(3, 1, None), (3, 1, 0), (3, 1, 1), (None, 1, 1)]
    source, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(toxicity, "BLOCK_DOCS", 64)  # many small blocks
    kept = []
    monkeypatch.setattr(toxicity, "stored", lambda df, name: kept.append(df.cache()) or kept[-1])
    order = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"], r["predicted"]) for r in df.collect())
    for most, taught in ((20_000, known), (50, known), (50, known.limit(0))):
        kept.clear()
        monkeypatch.setattr(toxicity, "CALIBRATION_DOCS", most)
        together, apart = order(toxicity.train_and_score(source, taught)), order(toxicity.score(source, toxicity.train(source, taught)))
        ratios = [sorted((r["mark"], r["size"], round(r["by_word"], 3), round(r["by_pair"], 3), r["by_word"], r["by_pair"]) for r in df.collect()) for df in kept]
        assert len(together) == len(rows) and [r[:2] for r in ratios[0]] == [r[:2] for r in ratios[1]]
        assert np.allclose(*([r[4:] for r in x] for x in ratios), atol=2e-3)
        if most > 50:  # else it's open which rows of a repeated id are the last to be fitted on
            assert np.allclose([r[2] for r in together], [r[2] for r in apart], atol=1e-4)
        for df in kept:
            df.unpersist()


def test_op6_reads_and_packs_texts_once(spark, tmp_path, monkeypatch):
    from gradeflow.llm import queries

    docs(spark, list(enumerate(made_texts(120, 4)))).withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 120, 3)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    plans = []

    def stored(df, name):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(toxicity, "stored", stored)
    queries.QUERIES["op6_toxicity"](spark, str(tmp_path))
    final = plans[0].split("== Initial Plan ==")[0]
    assert sum("ReadSchema" in x and "text" in x.split("ReadSchema")[1] for x in final.splitlines()) == 1


def test_toxic_phrase_of_common_words(spark):
    rng = random.Random(9)
    common = [f"word{k}" for k in range(30)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = rng.choices(common, k=20)
        if bad:
            text[5:5], text[15:15] = ["word3", "word4", "word5"], ["word3", "word4", "word5"]
        else:
            text[5:5], text[10:10], text[15:15] = (rng.sample(["word3", "word4", "word5"], 1) * 2 for _ in range(3))
            text = [w for k, w in enumerate(text) if not (k and text[k - 1] + w in ("word3word4", "word4word5"))]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    source = docs(spark, rows)
    got = toxicity.score(source, toxicity.train(source, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))).collect()
    held = {r["doc_id"]: r["predicted"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(held[i] for i in held if i % 8 == 0) >= 0.9 * sum(i % 8 == 0 for i in held)
    assert sum(p == int(i % 8 == 0) for i, p in held.items()) >= 0.95 * len(held)


def test_language_spans_and_unknown(spark):
    rng = random.Random(6)
    stems = {"aa": ["thing", "the", "ough", "wha"], "bb": ["zció", "ñado", "que", "llo"], "cc": ["ждеш", "при", "вет"]}
    text = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(n))
    rows = [(i, text(lang, 40), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    mixed = text("aa", 60) + " " + text("bb", 30)
    rows += [(1000, mixed, None, "s", 0), (1001, None, None, "s", 0), (1002, "12 !! 3", None, "s", 0), (1003, "", "aa", "s", 0), (1004, LONG, None, "s", 0)]
    source = spark.createDataFrame(rows, DOCS)
    model = language.train(source)
    got = {r["doc_id"]: r for r in language.identify(clashing(source), model).collect()}
    assert all(got[i]["lang"] == r[2] and got[i]["score"] > 0.9 for i, r in enumerate(rows[:180]))
    spans = [(s["lang"], s["start"], s["end"]) for s in got[1000]["spans"]]
    assert [s[0] for s in spans] == ["aa", "bb"] and abs(spans[0][2] - mixed.index(mixed.split()[60])) < 40
    assert [(got[i]["lang"], got[i]["score"]) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    kept = language.of_one_language(clashing(source), model, 0.5)
    assert kept.columns == clashing(source).columns and {r["doc_id"] for r in kept.collect()} >= {*range(180), 1000}
    assert language.identify(source, language.train(source.limit(0))).where("lang != 'und'").count() == 0
    # Letters of a script that nobody taught are no evidence.
    strange = docs(spark, [(1, "ελληνικά γράμματα"), (2, "ελληνικά " + text("aa", 3)), (3, text("aa", 4) + " 12 -- 7")])
    said = {r["doc_id"]: (r["lang"], r["score"]) for r in language.identify(strange, model).collect()}
    assert said[1] == ("aa", 0.0) and said[2] == ("aa", 0.75) and said[3][0] == "aa" and said[3][1] > 0.9
    assert {r["doc_id"] for r in language.of_one_language(strange, model, 0.25).collect()} == {2, 3}


def test_best_path_is_viterbi():
    rng = np.random.default_rng(8)
    for n in (1, 4, 6):
        scores = rng.normal(0, 6, (n, 3)).astype(np.float32)
        value = lambda p: sum(float(scores[i, k]) for i, k in enumerate(p)) - 5.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=n)))
        assert math.isclose(value(language.best_path(scores, 5.0).tolist()), best, rel_tol=1e-5)


# Secrets


def test_secret_spans(spark):
    key = "AKIA" + "Q7" * 8
    weak = "aB3" + "xY9zK2mN4pQ8rS6tU1vW5" * 2
    texts = ["API-KEY api_key = 'abcdefghijkl'", f"é {key} and {weak}", weak, "deadbeef" * 4, "token=short", f"https://x.org {weak}", "paſſword=abcdefghijklmnop", "token=secret:abcdefghijklmnop"]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(clashing(docs(spark, list(enumerate(texts)) + [(50, None), (51, ""), (52, LONG)])))).collect()}
    assert got[0]["spans"] == "assign:8:31" and got[3]["spans"] == "hex:0:32" and got[4]["spans"] == got[2]["spans"] == got[6]["spans"] == got[50]["spans"] == ""
    assert got[1]["spans"] == f"access:2:22,weak_secret:27:{27 + len(weak)}" and got[1]["n_access"] == 1
    assert got[5]["spans"].startswith("weak_endpoint:0:13,weak_secret:14:")
    assert got[7]["spans"] == ""  # the short match takes the second keyword
    assert got[1]["base_sha256"] == hashlib.sha256(b"access:2:22").hexdigest()


def test_parts_link_over_a_whole_paragraph(spark):
    key, weak = "AKIA" + "Q7" * 8, "aB3" + "xY9zK2mN4pQ8rS6tU1vW5" * 2
    gap = " word" * 2000
    texts = [f"{key}{gap} {weak}", f"{weak}{gap} https://x.org {gap}", f"{key}{gap}\n\n{weak}"]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {0: ["access", "weak_secret"], 1: ["weak_secret", "weak_endpoint"], 2: ["access"]}


def test_linked_parts_by_trying_all_pairs():
    rng = random.Random(4)
    weak = "aB3" + "xY9zK2mN4pQ8rS6tU1vW5" * 2
    pieces = ["AKIA" + "Q7" * 8, weak, "https://x.org", "deadbeef" * 2, " ", " ", "\n\n", "word", f"token={weak}", f"password={'deadbeef' * 2}/{weak}", "\n \n"]
    linked = 0
    for _ in range(3000):
        text = "".join(x + rng.choice([" ", " ", "", "."]) for x in rng.choices(pieces, k=rng.randint(0, 9)))
        base = secrets.base_spans(text)
        cuts = [0, *(m.start() for m in secrets.SCOPE_END.finditer(text)), len(text) + 1]
        scope = lambda s: sum(c <= s for c in cuts[1:])
        parts = [("access" if k == 1 else "secret", s, e) for s, k, e in base]
        loose = [("weak", *m.span()) for m in secrets.WEAK.finditer(text) if secrets._mixed(m.group()) and not any(s < m.end() and m.start() < e for s, _, e in base)]
        ends = [("end", *m.span()) for m in secrets.ENDPOINT.finditer(text)]
        every = parts + loose + ends
        near = lambda p, kinds: any(q[0] in kinds and scope(q[1]) == scope(p[1]) for q in every if q != p)
        want = [(s, 3, e) for n, s, e in loose if near((n, s, e), ("access", "end"))] + [(s, 4, e) for n, s, e in ends if near((n, s, e), ("access", "secret", "weak"))]
        assert sorted(secrets.linked_spans(text, base)) == sorted(want)
        linked += len(want)
    assert linked > 1000
    inside = "password=" + "deadbeefdeadbeef/" * 4 + "/" + weak + "." + " https://x.org"
    assert [k for _, k, _ in secrets.linked_spans(inside, secrets.base_spans(inside))] == [4]


# Line dedup and near duplicates


def test_line_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 3)  # cells of several blocks
    rng = random.Random(11)
    base = made_texts(40, 12)
    rows = list(ODD[:5]) + [(7, ODD[6][1])]
    for i in range(60):
        rows.append((100 + i, "\n".join(edited(rng.choice(base), rng, rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randint(1, 4)))))
    got = {}
    for r in line_dedup.links(clashing(docs(spark, rows))).collect():
        got.setdefault((r["doc_id"], r["line_no"]), []).append((r["class_doc"], r["class_line"], r["n_links"], r["removed"]))
    lines = [((i, k), frozenset(split(x))) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [(p, s) for p, s in lines if s]
    for place, s in lines:
        alike = [q for q, o in lines if len(s & o) * 9 >= 4 * (len(s) + len(o))]
        first = min(q for q, o in lines if o == s)
        assert got[place][0] == (*first, len(alike) - 1, min(alike) < place), place
    kept = line_dedup.without_repeats(docs(spark, rows))
    gone = {p for p in got if got[p][0][3]}
    for r in kept.where("doc_id >= 100").collect():
        text = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"].split("\n") == [x for k, x in enumerate(text) if (r["doc_id"], k) not in gone] and r["n_chars"] == len(r["text"])
    assert {1, 2} <= {r["doc_id"] for r in kept.collect()}
    assert line_dedup.links(docs(spark, rows).limit(0)).count() == 0


def test_words_are_hashed_in_whole_arrays():
    rng = random.Random(21)
    alphabet = [b"a", b"B", b"7", b" ", b" ", b"\n", b".", "é".encode(), b"\x00"]
    texts = [None, b"", b"x", b" ", b"w" * 500 + b" " + b"w" * 64 + b" " + b"w" * 65] + [b"".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)]
    known = {}
    for t in texts:
        starts, ends, found = word_hashes(folded(t))
        own = [folded(t)[a:b] for a, b in zip(starts, ends)]
        assert own == [w.encode() for w in split((t or b"").decode())]
        for w, h in zip(own, found.tolist()):
            assert known.setdefault(w, h) == h
    assert len({h & line_dedup.WORD_BITS for h in known.values()}) == len(known) > 200


def test_prefixes_have_one_order(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 48, n) if k % 2 else rng.integers(0, 60, n)) for k, n in enumerate(rng.integers(1, 40, 200))]
    frequency = rng.integers(0, 5, line_dedup.COUNTERS)
    rule = line_dedup.Rule(0.8, frequency)
    column = line_dedup._packed(np.concatenate(sets).astype(np.uint64), np.array([len(s) for s in sets]))
    assert all((a == b).all() for a, b in zip(line_dedup._flat(column.slice(3, 5)), ([len(s) for s in sets[3:8]], np.concatenate(sets[3:8]))))
    row, word, position, sizes = rule.prefixes(column)
    monkeypatch.setattr(line_dedup, "_ROWS", 10)  # too many lines for one number a word
    assert all((a == b).all() for a, b in zip(rule.prefixes(column), (row, word, position, sizes)))
    for k, s in enumerate(sets):
        order = sorted(s.tolist(), key=lambda w: (frequency[w % line_dedup.COUNTERS], w % line_dedup.COUNTERS, w))
        assert word[row == k].tolist() == order[: len(s) - -(-4 * len(s) // 5) + 1]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(weighted_minhash, "BLOCK", 4)
    rng = random.Random(13)
    base = [" ".join(made_texts(8, 50 + k)) for k in range(30)]
    rows = list(ODD)
    for i in range(150):
        rows.append((100 + i, edited(base[i % 30], rng, rng.choice([0, 1, 1, 2]))))
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.classes(clashing(docs(spark, rows))).collect()}
    shingles = {i: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)} for i, t in rows if i is not None and i >= 100}
    jaccard = lambda a, b: len(a & b) / len(a | b)
    links = spark.createDataFrame([(a, b) for a in shingles for b in shingles if a < b and jaccard(shingles[a], shingles[b]) >= 0.8], "a bigint, b bigint")
    expected = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got[i] == expected.get(i, i) for i in shingles)
    assert got[1] == 1 and got[2] == 2 and got[4] == 4 and got[None] is None
    kept = [r["doc_id"] for r in weighted_minhash.first_of_class(docs(spark, rows)).collect()]
    assert sorted(i for i in kept if i) == sorted({c for c in got.values() if c}) and kept.count(None) == 1
    assert weighted_minhash.classes(docs(spark, rows).limit(0)).count() == 0


def test_rows_of_null_and_repeated_ids_are_documents_of_their_own(spark):
    x, y, z, w = "a line that comes twice here", "one more line of nothing else", "quite another text stands there", "some words found nowhere otherwise"
    rows = [(None, f"{x}\n{y}"), (None, f"{z}\n{x}"), (None, f"{w}\nlast of all of these"), (5, f"five has its own words\n{y}"), (5, f"other five of other words\nthat nobody else will say")]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeats(docs(spark, rows)).collect())
    assert kept == sorted([(0, f"{x}\n{y}"), (0, z), (0, rows[2][1]), (5, "five has its own words"), (5, rows[4][1])])
    long = [" ".join(t) for t in zip(made_texts(4, 71), made_texts(4, 72))]
    rows = [(5, long[0]), (5, long[1]), (9, long[1]), (9, long[2]), (None, long[2]), (None, long[3]), (None, long[3]), (None, ""), (None, "")]
    got = weighted_minhash.classes(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in got) == [(0, 0)] * 4 + [(0, 9), (5, 5), (5, 5), (9, 5), (9, 9)]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in weighted_minhash.first_of_class(docs(spark, rows)).collect())
    assert kept == sorted([(5, long[0]), (5, long[1]), (9, long[2]), (0, long[3]), (0, ""), (0, "")])


def test_weighted_samples_agree_with_similarity():
    rng = np.random.default_rng(2)
    code = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    one, two = np.sort(code[:500]), np.sort(code[100:])
    weight = {int(c): w for c, w in zip(code, rng.uniform(0.5, 3, 600).astype(np.float32))}
    sampler = weighted_minhash.Sampler(1500)
    sets = [(s, np.array([weight[int(c)] for c in s], np.float32)) for s in (one, two)]
    samples = [sampler(c, w, np.array([0])) for c, w in sets]
    assert abs((samples[0] == samples[1]).mean() - weighted_minhash.similarity(*sets)) < 0.05


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 90), (100, None)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {i: 0 for i in range(41)} | {90: 90, 100: 90}


# The registered queries


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == given.columns
        kept = spark.createDataFrame(after.collect(), given.schema)
    assert 0 < kept.count() <= given.count()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {r["doc_id"]: digest(",".join(map(str, lib.encode(r["text"] or "")))) for r in kept.collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == expected


@pytest.mark.parametrize("name", ["op2_decontaminate", "op4_chat", "op7_line_dedup"])
def test_query_matches_sql(spark, name):
    from gradeflow.llm import queries
    from tests.oracle import connect, difference

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name]) is None


def test_forgotten_words_change_no_language(monkeypatch):
    rng = np.random.default_rng(3)
    model = language.Model(["de", "en"], -rng.random((len(language.ORDERS) * language.BUCKETS, 2)).astype(np.float32), np.ones((len(language.SCRIPTS), 2), bool))
    texts = [b" ".join(b"w%d" % w for w in rng.integers(0, 3000, size)) for size in rng.integers(0, 200, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    def labelled():
        return [b.to_pydict() for b in language._labeller(model, "doc_id", 1.0)(iter([batch.slice(i, 7) for i in range(0, 60, 7)]))]

    whole = labelled()
    monkeypatch.setattr(language, "REMEMBERED", 50)
    assert labelled() == whole
    monkeypatch.setattr(language, "REMEMBERED_BYTES", 1)
    assert labelled() == whole
