"""Look-alikes, tokens, containers and repair."""

import math
import os

import pytest

from quernstone.llm import encode, lookalikes, mojibake, packing

TOKENIZERS = encode.TOKENIZER_DIR
needs_tokenizers = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no tokenizer files here")

AWKWARD = ["it's we're I'LL they'll 'sabc x 's  'd \n's !'s 're", "  a  b   ", "\n\n x\t\ty \n", "\x1c\x1d a\x85b", "<|endoftext|> hi", "'", "a'", "''s don't", "x'smith 12'3", "🙂🏽 é", "", None, " ", "ｗ４ ½²", "naïve “quotes” — 日本語のテキスト", "aaaaaaaaaaaaaaaaaaaaaaaa" * 50, "z" * 30_000, " " * 20_000 + "end"]


def plain_bpe(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@needs_tokenizers
def test_ids_equal_a_plain_encoder(spark):
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    ranks = encode.read_ranks(open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    rows = [(i, t, "x") for i, t in enumerate(AWKWARD)]
    got = {r.doc_id: r.ids for r in encode.document_ids(spark.createDataFrame(rows, "doc_id long, text string, id string")).collect()}
    short = [r for r in rows if len(r[1] or "") < 2000]
    assert {i: got[i] for i, *_ in short} == {i: [x for w in pattern.findall(t or "") for x in plain_bpe(w.encode(), ranks)] for i, t, _ in short}
    back = {v: k for k, v in ranks.items()}
    assert all(b"".join(back[x] for x in got[i]).decode() == (t or "") for i, t, _ in rows)


@needs_tokenizers
@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_tokenizers(spark, name):
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r.n_tokens for r in encode.encode_texts(df, "id", "text", name, counts=True).collect()}
    assert got[1] > 1 and got[2] == got[3] == 0
    with pytest.raises(ValueError):
        encode.tokenizer_file("no_such")


def test_colliding_words_get_their_own_ids(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)}
    real = encode.SpanHash.of

    def weak(self, s, e):
        return real(self, s, e) % 3 if self.sums[-1] == first[0] else real(self, s, e)

    texts = ["alpha beta gamma delta epsilon zeta eta theta"]
    codes, _ = encode.code_points(texts)
    first = [encode.SpanHash(codes).sums[-1]]
    monkeypatch.setattr(encode.SpanHash, "of", weak)
    (ids, _), = encode.BatchEncoder(ranks).encode([texts])
    assert bytes(ids.tolist()).decode() == texts[0]


# -- containers ------------------------------------------------------------------------------------


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([("p", capacity, i, n) for i, n in enumerate(sizes)], "profile string, capacity int, doc_id long, n_tokens int")
    return packing.pack(df).toPandas()


def test_packing_keeps_items_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND_ITEMS", 300)
    sizes = [(i * 7919) % 130 for i in range(1500)] + [0, 100, 250, 1000]
    out = packed(spark, sizes, 100)
    assert out.groupby("container_id")["size"].sum().max() <= 100
    assert out.groupby("doc_id")["size"].sum().to_dict() == {i: n for i, n in enumerate(sizes) if n}
    assert all((g["size"] == 100).sum() >= len(g) - 1 for _, g in out.groupby("doc_id"))
    assert (out[out.doc_id.map(lambda i: sizes[i] <= 100)].piece == 0).all()
    assert out.container_id.nunique() <= math.ceil(sum(sizes) / 100) * 1.02


def test_packing_nothing(spark):
    assert len(packed(spark, [0, 0], 10)) == 0
    assert len(packed(spark, [], 10) if False else packed(spark, [0], 10)) == 0
    assert sorted(packed(spark, [5, 5, 5, 10], 10).groupby("container_id")["size"].sum()) == [5, 10, 10]


@needs_tokenizers
def test_packing_documents(spark):
    docs = spark.createDataFrame([(1, "some words here", "x"), (2, None, "x"), (3, "", "x"), (4, "long " * 50, "x")], "doc_id long, text string, size string")
    profiles = spark.createDataFrame([("a", "byte_bpe_50k", 16), ("b", "byte_bpe_50k", 4), (None, "byte_bpe_50k", 4), ("c", None, 4), ("d", "byte_bpe_50k", 0)], "profile string, tokenizer string, capacity int")
    out = packing.pack_documents(docs, profiles).toPandas()
    assert set(out.profile) == {"a", "b"} and set(out.doc_id) == {1, 4}
    assert packing.pack_documents(docs, profiles.limit(0)).count() == 0
    assert packing.pack_documents(docs.limit(0), profiles).count() == 0


def test_islands_stay_bounded_where_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND_ITEMS", 100)
    held = []
    real = packing._islands
    monkeypatch.setattr(packing, "_islands", lambda items: held.append(real(items)) or held[-1])
    out = packed(spark, [60 + i % 30 for i in range(1000)], 100)
    assert out.container_id.nunique() == 1000 and held == [10, 10]
    assert packed(spark, [60] * 700 + [30] * 700, 100).groupby("container_id")["size"].sum().max() <= 100


def test_best_bins_migrate_even_if_none_is_full(spark):
    rows = [("p", 100, 0, 0, 90, [60, 30]), ("p", 100, 0, 1, 70, [70]), ("p", 100, 1, 0, 95, [50, 45])]
    items = spark.createDataFrame([(p, c, i, b, f, s) for p, c, i, b, f, sizes in rows for s in sizes], "profile string, capacity int, island int, bin int, fill int, size int")
    got = {(r.island, tuple(r.pattern)) for r in packing._elites(items, 2).collect()}
    assert got == {(1, (60, 30)), (0, (50, 45))}


def test_crossover_loses_nothing():
    import numpy as np

    sizes = [(i * 37) % 50 + 1 for i in range(200)]
    a, b = packing.best_fit(list(range(200)), sizes, 60), packing.best_fit(list(range(199, -1, -1)), sizes, 60)
    child = packing.crossover(a, b, sizes, 60, np.random.default_rng(1))
    assert sorted(i for x in child for i in x) == list(range(200)) and max(sum(sizes[i] for i in x) for x in child) <= 60
    again = packing.from_patterns([[sizes[i] for i in x] for x in a], sizes, 60)
    assert sorted(i for x in again for i in x) == list(range(200))


# -- look-alikes -----------------------------------------------------------------------------------

LIKE = [
    ("a1", "The report, café 12"), ("a2", "Тhe rеpοrt, café 12"), ("a3", "Ｔｈｅ report， café 12"), ("a4", "T​he re­port, café 12"),
    ("b1", "The report, cafe 12"), ("b2", "the report, café 12"), ("b3", "The  report, café 12"), ("b4", "The report café 12"),
    ("c1", "сор и роза"), ("c2", "cop и pоза"), ("d1", None), ("d2", ""), ("d3", "  "), ("d4", "​"), ("e1", "The report, café 12"),
]


@pytest.mark.parametrize(("written", "shown"), [("սոіt", "unit"), ("ᎠᎪТА", "DATA"), ("ᴢооm", "zoom"), ("dıal", "dial"), ("fυnd", "fund"), ("ՏТOР", "STOP"), ("ꓐOⲞK", "BOOK"), ("ｆｉｎｅ", "fine")])
def test_letters_of_other_alphabets_fold(written, shown):
    canonical = lookalikes.Canonical(lookalikes.LetterModel())
    assert canonical.text(f"make {written} talk") == f"make {shown} talk"


def test_letter_scores_choose_the_script(spark):
    text = "сор и роза и сор дома. cop and make cop talk"
    model = lookalikes.letter_model(spark.createDataFrame([(text,)] * 3, "text string"))
    canonical = lookalikes.Canonical(model)
    assert canonical.text("сop и роза") == canonical.text("cop и роза") == "сор и роза"
    assert canonical.text("сор and make") == "cop and make"


def test_lookalike_pairs(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in LIKE], "id string, text string, form string, own string")
    model = lookalikes.letter_model(df)
    got = {tuple(r) for r in lookalikes.lookalike_pairs(lookalikes._forms(df, "id", "text", model, "t")).collect()}
    same = ["a1", "a2", "a3", "a4", "e1"]
    assert got == {(i, j) for i in same for j in same if i < j and (i, j) != ("a1", "e1")} | {("c1", "c2")}


def test_consistent_form_is_stable(spark):
    canonical = lookalikes.Canonical(lookalikes.LetterModel())
    for _, t in LIKE:
        if t:
            once = canonical.text(t)
            assert canonical.text(once) == once
    assert canonical.text("Тhe rеpοrt") == "The report" and canonical.text("Pоза") == "Роза"
    df = spark.createDataFrame(LIKE, "id string, text string")
    out = {r.id: r.form for r in lookalikes.consistent_texts(df, "id", "text").collect()}
    assert len(out) == len(LIKE) and out["d1"] is None and out["d2"] == ""


def test_disguised_requests(spark):
    index = spark.createDataFrame([("at-1", "open the door", "f"), ("at-2", None, None)], "id string, text string, family string")
    asked = spark.createDataFrame([("rq-1", "оpen the dооr"), ("rq-1", "оpen the dооr"), ("rq-2", "open the door"), ("rq-3", None)], "request_id string, text string")
    rows = spark.createDataFrame([("cr-1", "x y"), ("cr-2", "х y"), ("cr-3", None)], "id string, text string")
    assert {tuple(r) for r in lookalikes.disguised_pairs(index, asked, rows).collect()} == {("at-1", "rq-1"), ("cr-1", "cr-2")}
    assert lookalikes.disguised_pairs(index.limit(0), asked.limit(0), rows.limit(0)).count() == 0


# -- repair ----------------------------------------------------------------------------------------

RUSSIAN, GREEK, POLISH = "Сегодня вечером надо проверить отчёт и закрыть окно.", "Ο κήπος ανοίγει σήμερα το πρωί και κλείνει νωρίς.", "Wciąż piszę, że książka źle się śniła. Żółw wziął dźwięk, więc było różnie."


@pytest.mark.parametrize(
    ("text", "true", "wrong"),
    [
        ("It’s a naïve café — “quoted”", "utf-8", "cp1252"), ("Größe über Straße", "utf-8", "latin-1"), (RUSSIAN, "utf-8", "cp1251"), (RUSSIAN, "utf-8", "mac_roman"), (RUSSIAN, "utf-8", "cp1252"),
        (GREEK, "utf-8", "latin-1"), ("Größe über Straße", "utf-8", "cp850"), ("Größe — über “Straße”", "utf-8", "cp437"), (RUSSIAN, "cp1251", "cp1252"), (GREEK, "cp1253", "cp1252"),
        (RUSSIAN, "koi8-r", "cp1251"), (RUSSIAN, "cp1251", "koi8-r"), (POLISH, "iso8859-2", "latin-1"), ("図書館の質問が確認された。", "utf-8", "latin-1"),
    ],
)
def test_garbled_text_is_found(text, true, wrong):
    garbled = mojibake.read_as(text.encode(true), wrong)
    fixed, n, _ = mojibake.repair(f"Before all. {garbled} 12 after")
    assert n > 0
    if true == "utf-8":
        assert fixed == f"Before all. {text} 12 after"


@pytest.mark.parametrize("text", ["Straße", "Fuß", "Übung macht den Meister", "voilà", "à la carte", "ŒUVRE", "Šimon", "Größe über Straße", "Český", "ESPAÑA", "MÓNICA", "être Être", "número Único", "15 µm", "Świeży Łódź", "שלום עולם", "مرحبا بالعالم", "สวัสดีชาวโลก", "안녕하세요 세계", "გამარჯობა", "Բարեւ աշխարհ", "नमस्ते", "Tiếng Việt rất đẹp", "😀 yes 👍🏽", "→ ✓"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_utf8_read_as_western_is_restored(text, wrong):
    garbled = mojibake.read_as(text.encode(), wrong)
    for before, after in (("", ""), ("Before all. ", " 12 after.")):
        assert mojibake.repair(before + garbled + after)[:2] == (before + text + after, pytest.approx(1, abs=30))


@pytest.mark.parametrize(("text", "true"), [("שלום לכולם, זה מבחן של קידוד", "cp1255"), ("هذا اختبار للترميز في النص العربي", "cp1256"), ("นี่คือการทดสอบการเข้ารหัสข้อความ", "cp874")])
def test_other_single_byte_alphabets(text, true):
    assert mojibake.repair(f"Here: {mojibake.read_as(text.encode(true), 'cp1252')} ok")[0] == f"Here: {text} ok"


def test_each_run_has_its_own_pair():
    r = mojibake.read_as
    mixed = f"First. {r(RUSSIAN.encode('cp1251'), 'cp1252')} and then. {r(GREEK.encode('cp1253'), 'cp1252')} end"
    assert mojibake.repair(mixed)[0] == f"First. {RUSSIAN} and then. {GREEK} end"
    both = f"{r(RUSSIAN.encode('cp1251'), 'cp1252')} and {r('für später'.encode(), 'cp1252')}"
    assert mojibake.repair(both)[0] == f"{RUSSIAN} and für später"
    assert mojibake.repair(f"Да. {r(RUSSIAN.encode('koi8-r'), 'cp1251')} Всё.")[0] == f"Да. {RUSSIAN} Всё."


def test_text_garbled_many_times():
    text = "für später Straße"
    for _ in range(5):
        text = mojibake.read_as(text.encode(), "cp1252")
    assert mojibake.repair(text)[0] == "für später Straße"


JAPANESE = "図書館の質問が確認された。つつの設定は古い、カタカナとも「会議」"


@pytest.mark.parametrize("true", ["cp932", "euc_jp"])
@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
def test_japanese_of_old_encodings_is_restored(true, wrong):
    for text in (JAPANESE, JAPANESE * 40, "これは\n" + JAPANESE + " 12 図書館", "ですね"):
        garbled = mojibake.read_as(text.encode(true), wrong)
        assert mojibake.repair(f"Before all. {garbled} 12 after, für £5")[0] == f"Before all. {text} 12 after, für £5"
    mixed = mojibake.read_as(JAPANESE.encode(true), wrong) + " and " + mojibake.read_as("Größe über".encode(), wrong)
    assert mojibake.repair(mixed)[0] == JAPANESE + " and Größe über"


@pytest.mark.parametrize("text", ["図書館の質問が確認された。", "カタカナとひらがな", "für später", "そのつつは"])
def test_utf8_is_not_taken_for_japanese_of_old_encodings(text):
    for wrong in ("latin-1", "cp1252"):
        once = mojibake.read_as(text.encode(), wrong)
        assert mojibake.japanese_spans(once) == mojibake.japanese_spans(mojibake.read_as(once.encode(), wrong)) == []
    assert mojibake.japanese_spans(mojibake.read_as("Στυφτσς στρ ο φτωχ".encode(), "cp850")) == []


def test_twice_garbled_and_lost():
    twice = mojibake.read_as(mojibake.read_as("für später".encode(), "cp1252").encode(), "cp1252")
    assert mojibake.repair(twice)[0] == "für später"
    assert mojibake.repair("gar�on")[2]


@pytest.mark.parametrize("text", [RUSSIAN, RUSSIAN.upper(), GREEK, POLISH, "São 5°C, ATENÇÃO: NÃO! «Île» © 2025 £40", "¿Qué tal? ¡Sí!", "│ a │ b │\n├───┼───┤\n└───┴───┘", "théâtre, THÉÂTRE, Schlüöße", "Тhе rеpоrt ɑոd ԁаtа", "m² and x³", "質問が確認された", "", None, "plain", "🙂 👩‍💻", "MAÇÃ” verde, MAÇÃ’", "5 Å\xa0apart", "L’ÎLE “Été” É", "····················", "©©©©©© °°°°°", "££££ ¥¥¥¥", "éèêë créée", "ПРОВЕРКА СИСТЕМЫ", "Žižka Œuvre", "שלום", "สวัสดี", "안녕", "\xad\xa0\xa0\xa0"])
def test_correct_text_stays(text):
    assert mojibake.repair(text) == (text, 0, False)


def test_repair_of_tables(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "x"), (2, None, "x"), (3, "fine", "x"), (4, "a�b", "x"), (5, "", "x"), (1, "cafÃ©", "x")], "doc_id long, text string, id string")
    assert sorted(r.doc_id for r in mojibake.garbled_documents(df).collect()) == [1, 4]
    assert mojibake.garbled_documents(df.limit(0)).count() == 0
    assert {(r.id, r.restored, r.lost) for r in mojibake.restore_texts(df, "doc_id", "text").collect()} >= {(1, "café", False), (2, None, False), (4, "a�b", True)}
