import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from termloom.llm.lines import shared_lines
from termloom.llm.mixing import mix_sources
from termloom.llm.pieces import StrongestCut, split_oversized, split_text, strengths
from termloom.llm.repetition import repeated_characters, repetition, repetition_shares, window_hashes

from termloom.llm.sentences import USUAL, Document, sentence_units, settled
from termloom.llm.tokenizer import Encoder, encode_texts, merge, read_ranks, vocabulary

ODD = ["", " ", "a", "naïve café", "中文。分かち書き", "é" * 40, "\U0001f600\U0001f9ea" * 30, "<|endoftext|> x", "x" * 4000, "a\r\n\r\nb\tc  \n", "don't we'll I'VE 12345 ½²", "‍​﻿", "\x00\x01", "https://a.b/c?d=e&f"]


# --- problem 1

def test_strongest_cut_against_a_scan():
    rng = np.random.default_rng(1)
    strength = rng.integers(-1, 6, 900).astype(np.int8)
    best = StrongestCut(strength, 300)
    for _ in range(500):
        low = int(rng.integers(0, 899))
        high = int(min(899, low + rng.integers(0, 300)))
        top = strength[low : high + 1].max()
        assert best(low, high) == (low + int(np.flatnonzero(strength[low : high + 1] == top)[-1]), int(top))


def test_pieces_give_back_the_text():
    rng = random.Random(2)
    texts = ["x" * 1000, "word " * 500, "é" * 700, "a\r\n" * 400, "".join(rng.choice("ab .,\n\n!?中。") for _ in range(3000)), "Para one is here.\n\n" * 90]
    for text in texts:
        for limit, overlap in ((100, 20), (101, 0), (500, 200)):
            pieces = split_text(text, limit, overlap)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b in pieces)
            for (a, b), (c, d) in zip(pieces, pieces[1:]):
                assert b - overlap <= c <= b and d > b and (overlap == 0 or c < b)
            assert "".join([text[a:b] for a, b in pieces[:1]] + [text[p[1] : q[1]] for p, q in zip(pieces, pieces[1:])]) == text
    for a, b in split_text("é" * 700, 101, 20):
        assert b % 2 == 0 and a % 2 == 0
    paragraphs = "Para one is here.\n\n" * 90
    assert all(paragraphs[:b].endswith("\n\n") for _, b in split_text(paragraphs, 100, 20)[:-1])
    with pytest.raises(ValueError):
        split_text("x", 100, 50)


def test_strengths_are_ordered():
    text = "One, two three. Four\nfive\n\nsix"
    s = strengths(text)
    assert [int(s[text.index(w)]) for w in ("two", "three", "Four", "five", "six")] == [2, 1, 3, 4, 5] and s[2] == 0


def test_split_oversized_rows(spark):
    rows = [("a", "x" * 3000), ("b", "y " * 2000), ("b", "y " * 2000), ("c", None), ("d", ""), ("e", "\U0001f600" * 3001)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("piece", F.lit(1))
    got = split_oversized(df).collect()
    assert {r["doc_id"] for r in got} == {"b", "e"} and sum(r["piece_no"] == 0 for r in got) == 3
    assert all(len(r["piece"]) == r["end_pos"] - r["start_pos"] <= 3000 for r in got)
    assert split_oversized(df.limit(0)).collect() == []


# --- problem 5

CASES = [
    ('"Is it new?" asked Kim before noon. Wait... the end. No. 5 rose by 2.5 kg vs. 3.1 kg.', ['"Is it new?" asked Kim before noon.', "Wait... the end.", "No. 5 rose by 2.5 kg vs. 3.1 kg."]),
    ('Kim wrote: "It failed. We left." and slept. [It was cut.] The end!', ['Kim wrote: "It failed. We left." and slept.', "[It was cut.]", "The end!"]),
    ("J. K. Rowe et al. (1980) met Dr. Who, e.g. in Rome. Why? See https://a.example/x?q=5 now.", ["J. K. Rowe et al. (1980) met Dr. Who, e.g. in Rome.", "Why?", "See https://a.example/x?q=5 now."]),
    ("Notes on x\n- first item\n2. second\n(3) third\nText here. More text.", ["Notes on x", "- first item", "2. second", "(3) third", "Text here.", "More text."]),
    ("« Est-il là ? » demande Luc. Luc écrit : « Il cède. Il reste. » Fin…", ["« Est-il là ? » demande Luc.", "Luc écrit : « Il cède. Il reste. »", "Fin…"]),
    ("Am 5. Mai kam er z. B. zu Fuß, vgl. Abb. 33. Dr. Ost schrieb: „Es brach. Es blieb.“ Ende.", ["Am 5. Mai kam er z. B. zu Fuß, vgl. Abb. 33.", "Dr. Ost schrieb: „Es brach. Es blieb.“", "Ende."]),
    ("¡Qué día! «¿Es él?», preguntó Ana. ¿Por qué?", ["¡Qué día!", "«¿Es él?», preguntó Ana.", "¿Por qué?"]),
    ("«Где он?» — спросил Ост. В 1964 г. проф. Ост нашёл (см. рис. 3) слой…", ["«Где он?» — спросил Ост.", "В 1964 г. проф. Ост нашёл (см. рис. 3) слой…"]),
    ("他来了。“是吗？”他问。王写道：“坏了。还在。”为什么？词……好！", ["他来了。", "“是吗？”他问。", "王写道：“坏了。还在。”", "为什么？", "词……", "好！"]),
    ("「何か？」と王氏は尋ねた。王氏は「壊れた。残る。」と書いた。終わり", ["「何か？」と王氏は尋ねた。", "王氏は「壊れた。残る。」と書いた。", "終わり"]),
    ("“कहाँ है?” Kim ने पूछा। डॉ. Kim ने लिखा: “टूटा। बचा है।” कितना!", ["“कहाँ है?” Kim ने पूछा।", "डॉ. Kim ने लिखा: “टूटा। बचा है।”", "कितना!"]),
    ("ปี 2016 เมทริกซ์ลด คำว่า abc อยู่ใน ทำไม", ["ปี 2016 เมทริกซ์ลด", "คำว่า abc อยู่ใน", "ทำไม"]),
    ("«هل يغير؟» سأل Kim. قال د. Kim إن السجل بلغ 30.12 وحدة. لماذا؟", ["«هل يغير؟» سأل Kim.", "قال د. Kim إن السجل بلغ 30.12 وحدة.", "لماذا؟"]),
    ("It ended.The next began. It fell to 3. pH rose twice. pH fell.", ["It ended.", "The next began.", "It fell to 3.", "pH rose twice.", "pH fell."]),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_units(text, wanted):
    assert [text[a:b] for a, b in settled(text, USUAL)] == wanted


def test_wrapped_lines_are_joined():
    text = "The unit at the gate keeps five coarse samples of the old taevox in\nthe cellar. It was cold there, and nobody asked for it, see Vol. 3 and\nFig. 4 of the notes.\n\nNext one."
    assert len(settled(text, USUAL)) == 3


def test_the_document_settles_doubts():
    text = "Reg. x is old, reg. y new. It is in xyz. Nobody came. The xqz. of it, xqz. and more. See xqz. Kim there."
    found = [text[a:b] for a, b in settled(text, USUAL)]
    assert found[-1] == "See xqz. Kim there." and "It is in xyz." in found


def planted(name):
    """A text whose abbreviation stands in no list, shown by its own small-letter occurrences alone."""
    return f"The qorvex. unit is old, the qorvex. unit is cold. Then {name} came by, and {name} slept. They saw qorvex. {name} there. Nobody stayed in the vat. Few saw the vat and left."


def test_abbreviations_of_the_document_alone(spark, monkeypatch):
    text = planted("Hulm")
    wanted = ["The qorvex. unit is old, the qorvex. unit is cold.", "Then Hulm came by, and Hulm slept.", "They saw qorvex. Hulm there.", "Nobody stayed in the vat.", "Few saw the vat and left."]
    assert [text[a:b] for a, b in settled(text)] == wanted
    df = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert [text[r["start_pos"] : r["end_pos"]] for r in sentence_units(df).orderBy("unit_no").collect()] == wanted
    monkeypatch.setattr(Document, "abbreviation", lambda self, word: None)
    monkeypatch.setattr(Document, "kind", lambda self, name: 0)
    assert [text[a:b] for a, b in settled(text)] != wanted


def test_the_corpus_answers_what_the_document_leaves_open(spark):
    # "zot." is a title and "vor." goes on before numbers in the corpus; single documents show neither
    names = ["Arvin", "Belka", "Corto", "Delph", "Ervig", "Fanto", "Gorim", "Halva", "Irgon", "Jasko"]
    rows = [(f"d{i}", f"We met zot. {n} at noon. It was in vor. 5 of the list. Rain fell on the list. In the end we saw {n} go.") for i, n in enumerate(names)]
    rows.append(("lone", "He met zot. Quill again."))
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {}
    for r in sentence_units(df).orderBy("doc_id", "unit_no").collect():
        got.setdefault(r["doc_id"], []).append((r["start_pos"], r["end_pos"]))
    for d, text in rows[:-1]:
        assert [text[a:b] for a, b in got[d]][:2] == [text[: text.index(" It was")], "It was in vor. 5 of the list."]
    assert len(got["lone"]) == 1
    alone = df.where("doc_id = 'lone'")
    assert sentence_units(alone).count() == 2


def test_a_word_of_any_length_counts_as_a_beginning(spark):
    long = "Donaudampfschifffahrtsgesellschaftskapitän"
    rows = [(f"d{i}", f"Was it so? {long} ist da, vgl. x und vgl. yax. Es war vgl. {long} kam.") for i in range(5)]
    assert all(n == 4 for n in (sum(1 for r in sentence_units(spark.createDataFrame(rows, "doc_id string, text string")).collect() if r["doc_id"] == d) for d, _ in rows[:1]))


def test_long_lines_take_time_in_proportion():
    import time

    text = " ".join(f"Word{i % 997} qq{i}x. Kim{i % 313} went to b{i}. Sa{i % 77}" for i in range(12_000))
    began = time.process_time()
    assert len(text) > 500_000 and len(settled(text)) > 20_000
    assert time.process_time() - began < 3
    for odd in ("A." * 100_000, "(" * 100_000 + '" a. B ' * 10_000, '"' + "Ab. Cd. " * 30_000 + '"'):
        began = time.process_time()
        settled(odd)
        assert time.process_time() - began < 5


def test_units_keep_order_and_lose_no_letters(spark):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "Bc", ". ", "! ", "\n", "\n\n", '"', "«", "»", "(", ")", " ", "。", "中", "ก ", "3", "Dr. ", "…", "\r\n", "- ", "“", "”", "2. "]) for _ in range(rng.randrange(60)))
        at = 0
        for a, b in settled(text, USUAL):
            assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace()
            assert not any(c.isalnum() for c in text[at:a])
            at = b
        assert not any(c.isalnum() for c in text[at:])
    rows = [("a", "One. Two."), ("a", "One. Two."), ("n", None), ("e", ""), ("b", " \n "), ("p", "?!"), ("l", "Word here. " * 20000)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("start_pos", F.lit("x"))
    got = sentence_units(df).collect()
    assert sum(r["doc_id"] == "a" for r in got) == 4 and sum(r["doc_id"] == "l" for r in got) == 20000 and {r["doc_id"] for r in got} == {"a", "l"}
    assert sentence_units(df.limit(0)).collect() == []


# --- problem 8

@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_ranks(vocabulary()), cached=50)


def test_ids_equal_the_library_and_decode_back(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    theirs.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdeéß中の ก.,'\n\U0001f600019ÀЖ") for _ in range(rng.randrange(200))) for _ in range(200)]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == theirs.encode(text, add_special_tokens=False).ids and encoder.decode(ids) == text


def test_merge_against_rescanning():
    rng = random.Random(5)
    ranks = {bytes([b]): b for b in range(256)}
    for i in range(300):
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(bytes(rng.choice(b"abc") for _ in range(2)) if i < 6 else (a + b)[:6], 256 + i)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 30)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if piece not in ranks:
            assert merge(piece, ranks) == [ranks[p] for p in parts]


def test_encode_rows(spark, encoder):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r["doc_id"]: r["ids"] for r in encode_texts(df).collect()}
    assert got[0] == [] and got[len(ODD)] == [] and all(got[i] == encoder.encode(t) for i, t in enumerate(ODD))
    assert encode_texts(df.limit(0)).collect() == []


# --- problem 9

def test_mixture_meets_its_shares(spark):
    rng = random.Random(6)
    docs = [(i, "word " * rng.randrange(1, 60), rng.choice(["a"] * 8 + ["b"] * 3 + ["c", "unlisted", None])) for i in range(1500)]
    docs += [(10_000, None, "a"), (10_001, "", "b")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("slot", F.lit(1))
    rows = [("a", 0.5, 1), ("b", 0.2, 2), ("c", 0.2, 3), ("gone", 0.1, 5), (None, 0.1, 1), ("zero", 0.0, 1)]
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    selection, shares = mix_sources(documents, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"]["actual_share"] == 0.0
    for source, share in (("a", 5 / 9), ("b", 2 / 9), ("c", 2 / 9)):
        assert abs(got[source]["actual_share"] - share) < 0.02
    uses = selection.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("repeat_no").alias("k")).collect()
    assert all(r["n"] == r["k"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in uses)
    again = mix_sources(documents, targets)[0]
    assert sorted(map(tuple, selection.collect())) == sorted(map(tuple, again.collect()))
    capped = {r["source"]: r["n_uses"] for r in mix_sources(documents, targets, total=10**7)[1].collect()}
    stock = {s: sum(1 for _, t, x in docs if x == s and t) for s in "abc"}
    assert capped == {"a": stock["a"], "b": 2 * stock["b"], "c": 3 * stock["c"], "gone": 0}


def test_mixture_of_nothing(spark):
    documents = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, shares = mix_sources(documents, targets)
    assert selection.collect() == [] and [(r["source"], r["n_tokens"], r["actual_share"]) for r in shares.collect()] == [("a", 0, 0.0)]


# --- problem 10

def brute_repetition(text, window):
    reduced = regex.sub(r"[^\p{L}\p{M}\p{N}]+", "", text or "").lower()
    seen, covered = set(), [False] * len(reduced)
    for i in range(len(reduced) - window + 1):
        part = reduced[i : i + window]
        if part in seen:
            covered[i : i + window] = [True] * window
        seen.add(part)
    return len(reduced), sum(covered)


def test_repetition_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "Ba", "x y", "中文", "\U0001f600", "é", "é", "12", "--"]) for _ in range(rng.randrange(80)))
        for window in (1, 3, 7, 30):
            assert repetition(text, window) == brute_repetition(text, window)
    assert repetition("a" * 31) == (31, 30) and repetition("a" * 30) == (30, 0) and repetition(None) == (0, 0)


def test_colliding_hashes_are_checked(monkeypatch):
    from termloom.llm import repetition as module

    monkeypatch.setattr(module, "window_hashes", lambda codes, window: np.zeros(len(codes) - window + 1, dtype=np.uint64))
    codes = np.arange(200, dtype=np.uint32)
    assert repeated_characters(codes, 30) == 0


def test_hashes_depend_on_the_window_only():
    codes = np.random.default_rng(8).integers(0, 5, 400)
    for window in (1, 2, 5, 30, 31):
        h = window_hashes(codes, window)
        assert len(h) == 400 - window + 1
        by = {}
        for i, x in enumerate(h.tolist()):
            assert by.setdefault(tuple(codes[i : i + window]), x) == x
        assert len(set(by.values())) == len(by)


def test_repetition_rows(spark):
    rows = [(1, "The same long sentence is here again. " * 20), (2, None), (3, ""), (4, "a b c"), (1, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("x"))
    got = sorted((r["doc_id"], round(r["share"], 3)) for r in repetition_shares(df).collect())
    assert got[0] == (1, 0.0) and got[1][1] > 0.9 and got[2:] == [(2, 0.0), (3, 0.0), (4, 0.0)]
    assert repetition_shares(df.limit(0)).collect() == []


def test_shared_lines(spark):
    footer = "Read  MORE here"
    rows = [(i, f"Own text number {i}.\n{footer}\r\n\n  ", "a") for i in range(12)]
    rows += [(20, f"{footer}\n{footer}\nread more\u00a0here", "a"), (21, footer, "b"), (22, footer, None), (23, None, "a"), (24, "", None), (25, " \n ", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit("x")).withColumn("n_chars", F.lit(1))
    got = {r["doc_id"]: r for r in shared_lines(df).collect()}
    assert len(got) == len(rows)
    assert all((got[i]["n_lines"], got[i]["removed_lines"], got[i]["removed_chars"], got[i]["rejected"]) == (2, 1, 14, False) for i in range(12))
    assert (got[20]["n_lines"], got[20]["removed_lines"], got[20]["rejected"]) == (3, 3, True)
    assert [got[i]["removed_lines"] for i in (21, 22, 23, 24, 25)] == [0] * 5 and [got[i]["n_lines"] for i in (21, 22, 23, 24, 25)] == [1, 1, 0, 0, 0]
    assert not any(got[i]["rejected"] for i in (21, 22, 23, 24, 25))
    assert {r["doc_id"]: r["removed_lines"] for r in shared_lines(df, most=12, keep=0.0).collect()}[20] == 3
    assert shared_lines(df.limit(0)).collect() == []
