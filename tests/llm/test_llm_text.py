"""Tokens, packing, splitting, languages, look-alikes and scans against brute force."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.llm import bpe, langid, lookalike, packing, scans, split

HF = "/opt/tokenizers/byte_bpe_50k.json"
ALPHABET = "ab's'lvedmtr  \n\t1२²é中。　​!?,<|>\U0001f600\x1c\x85"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(HF)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def own(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def test_tokens_equal_the_library(reference):
    rnd = random.Random(5)
    texts = ["", " ", "\n\n", "don't we'll", "<|endoftext|>", "x" * 3000, "'s's", " 's", "''ll", *("".join(rnd.choices(ALPHABET, k=rnd.randrange(60))) for _ in range(4000))]
    assert own(bpe.Encoder(), texts) == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_tokens_equal_the_library_for_any_text(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(HF)
    t.encode_special_tokens = True
    assert own(ENCODER, [text])[0] == t.encode(text, add_special_tokens=False).ids


ENCODER = bpe.Encoder()


def test_offsets_and_decoding():
    text = "Ünï  don't\n中文 123!"
    parts = ENCODER.offsets(text)
    assert [p[0] for p in parts] == own(ENCODER, [text])[0]
    assert b"".join(text.encode()[a:b] for _, a, b in parts) == text.encode()
    assert ENCODER.decode([p[0] for p in parts]) == text


def test_scan_equals_a_plain_run():
    functions, compose, table, _, size = bpe.automaton()
    some = np.random.default_rng(1).choice(functions, 5000)
    state, want = 0, []
    for f in some:
        state = int(table[f, state])
        want.append(state)
    assert table[bpe.scan(some), 0].tolist() == want


def test_encode_frame(spark, reference):
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 7), (3, "", 7)], "id long, text string, ids int")
    rows = sorted((r["id"], r["tokens"]) for r in bpe.encode_texts(df, "text", ["id"], ids="tokens").collect())
    assert rows == [(1, reference(["a b"])[0]), (2, []), (3, []), (3, [])]
    assert bpe.encode_texts(df.limit(0), "text", ["id"], ids="tokens").count() == 0


def test_offsets_of_a_frame(spark):
    df = spark.createDataFrame([(1, "Ünï  don't\n中文 123!"), (2, None), (3, ""), (4, "a b")], "id long, text string")
    rows = bpe.encode_texts(df, "text", ["id", "text"], offsets="ends")
    for r in rows.collect():
        assert r["ends"] == [e for _, _, e in ENCODER.offsets(r["text"] or "")]
    back = bpe.decode_texts(rows, "ids", "ends", ["id", "text"]).collect()
    assert len(back) == 4 and all(r["decoded"] == (r["text"] or "") for r in back)


def test_packing_keeps_every_token_once():
    rnd = np.random.default_rng(0)
    sizes = np.concatenate([rnd.integers(0, 700, 3000), [2048, 2049, 5000, 0]])
    out = packing.pack_sizes(sizes, 2048)
    assert out.groupby("bin")["size"].sum().max() <= 2048
    assert out.groupby("item")["size"].sum().reindex(range(len(sizes))).tolist() == sizes.tolist()
    assert set(out[out["n_pieces"] > 1]["item"]) == set(np.flatnonzero(sizes > 2048))
    assert sizes.sum() / 2048 / out["bin"].nunique() > 0.97


def test_sum_of_squares_takes_the_best_place():
    rnd = random.Random(2)
    packer, gaps = packing.SumOfSquares(20), {}
    for _ in range(400):
        s = rnd.randint(1, 20)
        count = lambda g: sum(v == g for v in gaps.values()) if 0 < g < 20 else 0
        change = lambda g: ((count(g - s) + 1) ** 2 - count(g - s) ** 2 if g > s else 0) + ((count(g) - 1) ** 2 - count(g) ** 2 if g < 20 else 0)
        least = min(change(g) for g in {*(v for v in gaps.values() if v >= s), 20})
        number = packer.place(s)
        assert change(gaps.get(number, 20)) == least
        gaps[number] = gaps.get(number, 20) - s


def test_pack_frame(spark):
    df = spark.createDataFrame([(1, 5), (2, 12), (2, 12), (3, 0), (4, None), (None, 3)], "id long, n long")
    rows = packing.pack(df, "id", "n", 10).collect()
    assert sorted((r["id"] or 0, r["piece"], r["size"]) for r in rows) == [(0, 0, 3), (1, 0, 5), (2, 0, 10), (2, 1, 2), (3, 0, 0), (4, 0, 0)]
    assert packing.pack(df.limit(0), "id", "n", 10).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_pieces_are_whole_and_natural(seed):
    rnd = random.Random(seed)
    pool = ["word ", "longerword ", ". ", "。", "\n", "\n\n", "# Head\n", "## Sub\n", "- item\n", "1. x\n", "x" * rnd.randint(1, 90), "中文，"]
    text = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 400)))
    spans, forced = split.pieces(text, 100, 20)
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= (100 if k == 0 else 80) for k, (a, b) in enumerate(spans))
    if len(text) > 100:
        assert forced == bool(re.search(rf"[^\s{re.escape(split.MARKS)}]{{81}}", text))
    if not forced:
        for a, _ in spans[1:]:
            assert text[a - 1].isspace() or text[a].isspace() or text[a - 1] in split.MARKS or len(re.search(rf"[^\s{re.escape(split.MARKS)}]*$", text[:a])[0]) == 80


def test_headings_stay_with_their_sections_and_closed_nodes_whole():
    body = "A sentence of some words. " * 9
    text = f"# Guide\n\n{body}\n\n## Setup\n\n{body * 3}\n\n```\n# comment\n\nx = 1\n\n# other\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## End\n\n{body}"
    for limit, overlap in ((300, 20), (400, 100), (1000, 200)):
        spans, forced = split.pieces(text, limit, overlap)
        assert not forced and len(spans) > 1
        for a, b in spans[:-1]:
            assert not re.search(r"(?:\A|\n)#{1,6} [^\n]*\s*\Z", text[a:b]) or text[a:b].rstrip().endswith("```")
            for m in split.CLOSED.finditer(text):
                assert not m.start() < b < m.end()


def test_split_frame(spark):
    df = spark.createDataFrame([(1, "a " * 60, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x")], "id long, text string, piece string")
    rows = split.split_oversized(df, "text", ["id"], 100, 20).collect()
    assert sorted({(r["id"], r["n_pieces"]) for r in rows}) == [(1, 2), (3, 1), (4, 1)]
    assert all(len(r["piece"]) <= 100 for r in rows)
    with pytest.raises(ValueError):
        split.split_oversized(df, "text", ["id"], 100, 100)


@pytest.fixture(scope="module")
def samples(data):
    t = pq.read_table(f"{data}/lang_samples.parquet").to_pydict()
    return list(zip(t["lang"], t["text"]))


def test_held_out_languages(samples):
    models = langid.Models(s for k, s in enumerate(samples) if k % 4)
    held = [s for k, s in enumerate(samples) if k % 4 == 0]
    found = langid.Labeller(models).label([t for _, t in held])
    assert sum(models.langs[f[0][2]] == lang for f, (lang, _) in zip(found, held)) >= 0.99 * len(held)


def test_confidence_is_as_high_as_accuracy(samples):
    """On stretches of some 20 letters of held-out samples; all of 40 letters are right."""
    models = langid.Models(s for k, s in enumerate(samples) if k % 4)
    label = langid.Labeller(models).label
    for least, off in ((20, 0.01), (40, 0.005)):
        parts = []
        for lang, text in (s for k, s in enumerate(samples) if k % 4 == 0):
            at = 0
            for m in re.finditer(r"\w\b" if text.isascii() or " " in text else r"\w", text):
                if sum(c.isalpha() for c in text[at : m.end()]) >= least:
                    parts.append((lang, text[at : m.end()]))
                    at = m.end()
        found = [f[0] for f in label([t for _, t in parts])]
        right = [models.langs[f[2]] == lang for f, (lang, _) in zip(found, parts)]
        assert abs(np.mean([f[3] for f in found]) - np.mean(right)) < off and np.mean(right) > 0.99


def test_long_words_and_codes(samples):
    models = langid.Models(samples)
    label = langid.Labeller(models).label
    long, codes, mixed = label(["Seitenhälfte" * 8, "trennlinie_12/papier_7/seitenzahl_99", "The page is blank here. " + "trennlinie_12/papier_7/" * 5])
    assert [models.langs[f[0][2]] for f in (long, codes, mixed)] == ["de", "de", "en"]


def test_mixed_texts_and_edges(samples):
    models = langid.Models(samples)
    label = langid.Labeller(models).label
    de = "Der Textblock wartet auf die Bedienung. Die Seite ist leer und der Bogen beschädigt. "
    en = "The text block waits for the operator. The page is blank and the sheet is damaged. "
    names = lambda found: [(models.langs[f[2]] if f[2] >= 0 else None) for f in found]
    mixed, single, foreign, blank, none, digits = label([de + en, en, en + "Die Seite ist leer. ", "  ", None, "12 34."])
    assert names(mixed) == ["de", "en"] and mixed[0][1] == mixed[1][0] == len(de) and mixed[1][1] == len(de + en)
    assert names(single) == ["en"] and single[0][3] > 0.99 and names(foreign) == ["en"]
    assert names(blank) == names(none) == names(digits) == [None]


def test_bits_are_code_lengths(samples):
    """All successors of a context, escapes included, never have more than probability 1."""
    models = langid.Models(samples)
    for tree in models.cost:
        for escape, symbols in list(tree.values())[:500]:
            assert 2**-escape + sum(2**-b for b in symbols.values()) == pytest.approx(1)


ALIKE = [("ﬁle", "file"), ("Ａ１", "A1"), ("café", "café"), ("a b", "a b"), ("a​b", "ab"), ("сору", "copy"), ("⼈", "人"), ("ｶﾞ", "ガ"), ("a　b", "a b"), ("Οverview", "Overview")]
APART = [("a", "A"), ("e", "é"), ("l", "1"), ("O", "0"), ("²", "2"), ("①", "1"), ("a  b", "a b"), ("a\nb", "a b"), ("a\tb", "a b"), ("", " ")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    assert lookalike.table_form(a) == lookalike.table_form(b)


@pytest.mark.parametrize("a, b", APART)
def test_apart(a, b):
    assert lookalike.table_form(a) != lookalike.table_form(b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=20))
def test_table_form_is_idempotent(t):
    once = lookalike.table_form(t)
    assert lookalike.table_form(once) == once


def test_vocabulary():
    v = lookalike.Vocabulary(["layout", "слово", "drawer"])
    assert v.canonical("lаyоut, ﬁne сору​!") == "layout, fine copy!"
    assert v.canonical("слово") == "слово"
    assert v.spelling("layuot") is None and v.spelling("layot", 1) == "layout" and v.spelling("drawers", 1) == "drawer"


def test_the_vocabulary_decides_what_a_letter_of_several_shapes_is(spark):
    texts = ["Ӏayout", "layout", "Iayout", "Straβe", "Straße", "βeta", "la​уоut"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = lambda words: {tuple(r) for r in lookalike.alike_pairs(df, "id", "text", words).collect()}
    assert pairs(["layout", "Straße"]) == {(0, 1), (0, 6), (1, 6), (3, 4)}
    assert pairs([]) == {(0, 2), (1, 6)}
    genuine = spark.createDataFrame([(0, "сору"), (1, "copy")], "id long, text string")
    assert [r["text"] for r in lookalike.canonical_texts(genuine, "text", ["id"], ["сору"]).collect()] == ["сору"] * 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcеаоﬁ\u200b e\u0301é\u3000 ⼈Ａ,.-()1ʼ\u0302\n²ー\uff76\uff9eӀβ", max_size=15))
def test_without_a_vocabulary_the_table_decides(t):
    assert lookalike.Vocabulary([]).canonical(t) == lookalike.table_form(t)


def test_alike_pairs_by_brute_force(spark):
    texts = ["copy", "сору", "ｃｏｐｙ", "copy", "Copy", "", " ", " ", None, "file", "ﬁle"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(0, "copy", "z"), (None, "сору", "z")], "id long, text string, key string")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and lookalike.table_form(texts[a]) == lookalike.table_form(texts[b])}
    assert {tuple(r) for r in lookalike.alike_pairs(df, "id", "text").collect()} == want
    assert lookalike.alike_pairs(df.limit(0), "id", "text").count() == 0


PAGES = [
    "The feeder tray: Layout rules | 1\nThe scan job uses the cali-\nbrated scanner. Both pre-\nand post steps keep the spot-\ncolour plate. The (over sheet of the wid-\n- 1 -",
    "The feeder tray: Layout ru1es | 2\nth is smal1 (job 5). The cover sheet\nis here.\n\n   A new paragraph\nstarts here.\n- 2 -",
    "The feeder tray: Layout rules | 3\nThe page is the last one.\n- 3 -",
]


def test_scans(spark):
    clean = ["the calibrated scanner cover sheet width small spot-colour plate and pre post page last"] * 60
    pages = spark.createDataFrame([("d", k + 1, k, t, 1) for k, t in enumerate(PAGES)] + [("d", 1, 0, PAGES[0], 1), ("d", 9, 8, None, 1), ("e", None, 9, "", 1)], "doc string, page int, uid long, text string, kind int")
    texts = spark.createDataFrame([(t,) for t in clean] + [(None,)], "text string")
    found = scans.noise(pages, texts)
    rows = {tuple(r) for r in found.select("uid", "kind", "fixed").collect()}
    assert rows == {
        (0, "running_line", "The feeder tray: Layout rules | 1"), (1, "running_line", "The feeder tray: Layout ru1es | 2"), (2, "running_line", "The feeder tray: Layout rules | 3"),
        (0, "page_number", "- 1 -"), (1, "page_number", "- 2 -"), (2, "page_number", "- 3 -"),
        (0, "split_word", "calibrated"), (0, "split_word", "spot-colour"), (0, "split_word", "width"), (0, "misread", "cover"), (1, "misread", "small"),
    }
    out = [r["paragraph"] for r in scans.paragraphs(pages, found).orderBy("uid", "paragraph_no").collect()]
    assert out[0] == "The scan job uses the calibrated scanner. Both pre- and post steps keep the spot-colour plate. The cover sheet of the width is small (job 5). The cover sheet is here."
    assert out[1:] == ["A new paragraph starts here. The page is the last one."]
    assert scans.noise(pages.limit(0), texts).count() == 0


def test_running_lines_of_any_length_number_and_ending():
    long = "A running title " + "that goes on and on " * 10
    pages = [scans.Page(k, k + 1, f"Handbook\nAnnual Report\nSeries One\nBody text of {w} is here\nand more {w}\nExample Press Inc.\n{long}\n{k + 1}") for k, w in enumerate(["alpha", "bravo", "charlie", "delta"])]
    scans.analyse(pages)
    for p in pages:
        assert sorted(p.drop) == [0, 1, 2, 5, 6, 7] and p.drop[7] == "page_number" and {p.drop[i] for i in (0, 1, 2, 5, 6)} == {"running_line"}


def test_words_have_no_longest_length():
    assert scans.words("configuration/installation/maintenance/repairs " + "x" * 60) == ["configuration", "installation", "maintenance", "repairs", "x" * 60]
    assert scans.numbers("12345678") == (12345678,)


def test_two_confusions_and_pages_that_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(scans, "CROWDED", 3)
    long = "hyper" * 12
    clean = spark.createDataFrame([(f"commercial scanner office {long}",)] * 200, "text string")
    rows = [("d", 1, 0, f"the cornrnercial office, {long.replace('hyp', 'hvp', 1)}"), ("d", None, 1, "a sca1n1er 5"), (None, 2, 2, "a scan-\nner"), (None, None, 3, "2")]
    rows += [("e", 7, 10 + k, f"Same Title\nscamer {chr(103 + k) * 6}\n7") for k in range(9)]
    pages = spark.createDataFrame(rows, "doc string, page int, uid long, text string")
    found = {(r["uid"], r["kind"], r["fixed"]) for r in scans.noise(pages, clean).collect()}
    assert {(0, "misread", "commercial"), (2, "split_word", "scanner")} <= found
    assert not {f for f in found if f[0] == 3}
    assert {(10 + k, "misread", "scanner") for k in range(9)} <= found and {(10 + k, "page_number", "7") for k in range(9)} <= found


def crowded_pages(blocks: int, a_page: int) -> list[tuple[str, int, int, str]]:
    """Blocks in pairs: both of a pair have a title that hardly any other has, and a word is broken from one to the other."""
    rng = random.Random(1)
    known = ["".join(rng.choices(string.ascii_lowercase, k=9)) for _ in range(60)]
    line = lambda k: " ".join(rng.choices(known, k=k))
    out = []
    for k in range(0, blocks, 2):
        title = line(3)
        out.append(("d", 1 + k // a_page, k, f"{title}\n{line(6)}\n{line(5)} was cali-"))
        out.append(("d", 1 + (k + 1) // a_page, k + 1, f"{title}\nbrated for {line(5)}\n{line(8)}"))
    return out


@pytest.mark.parametrize("blocks, a_page", [(2000, 20), (1700, 1700)])
def test_neighbours_meet_however_many_blocks_a_page_has(spark, blocks, a_page):
    clean = spark.createDataFrame([("calibrated was for",)] * 20, "text string")
    rows = crowded_pages(blocks, a_page)
    found = {tuple(r) for r in scans.noise(spark.createDataFrame(rows, "doc string, page int, uid long, text string"), clean).select("uid", "kind", "fixed").collect()}
    assert {f for f in found if f[1] == "split_word"} == {(k, "split_word", "calibrated") for k in range(0, blocks, 2)}
    assert {f for f in found if f[1] == "running_line"} == {(uid, "running_line", text.split("\n")[0]) for _, _, uid, text in rows}


def test_groups_follow_the_order_of_pages(spark, monkeypatch):
    monkeypatch.setattr(scans, "CROWDED", 10)
    rows = [("d", k // 40, k, "text") for k in range(100)] + [("e", 1000 * k, 200 + k, "text") for k in range(4)] + [("d", None, 300, "text"), (None, 1, 301, "text")]
    groups: dict[tuple, list] = {}
    for r in scans.grouped(spark.createDataFrame(rows + rows[:9], "doc string, page int, uid long, text string")).distinct().collect():
        groups.setdefault((r["doc"], r["chunk"], r["part"]), []).append((r["uid"], r["own"]))
    assert sorted(uid for g in groups.values() for uid, own in g if own) == sorted(r[2] for r in rows)
    assert max(len(g) for g in groups.values()) == 20
    assert sorted(uid for uid, _ in groups["e", 0, 0]) == [200, 201, 202, 203]
    for g in groups.values():
        held, own = {uid for uid, _ in g}, {uid for uid, own in g if own}
        assert all({*range(max(0, uid - 5), min(100, uid + 6))} <= held for uid in own if uid < 100) and (max(own, default=0) < 300 or len(held) == 1)


@pytest.mark.parametrize("line, want", [("Page 3", (3,)), ("– 12 –", (12,)), ("[l]", (1, 50)), ("iv", (4,)), ("3/17", (3,)), ("第 5 頁", (5,)), ("70 %", (70,)), ("345 g/m²", ()), ("word", ())])
def test_page_numbers(line, want):
    assert scans.numbers(line) == want


def test_confusions_are_undone():
    assert "layout" in scans.spellings("la|yout".replace("|y", "y").replace("l", "1", 1)) and "column" in scans.spellings("colurnn")
    assert all(set(w) <= set(string.ascii_lowercase) for w in scans.spellings("f1rst"))


def test_queries_without_sql_run_on_the_smallest_tables(spark, data):
    from leafline.llm.queries import oracle_sql, queries

    for name, f in queries().items():
        if name not in oracle_sql():
            assert f(spark, data).distinct().count() == f(spark, data).count(), name


def test_blank_text_is_left_alone(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "id long, text string")
    assert [r["text"] for r in lookalike.canonical_texts(df, "text", ["id"]).orderBy("id").collect()] == [None, "", "  "]
    assert df.select(F.count("*")).first()[0] == 3
