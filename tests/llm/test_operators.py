"""The corpus operators against plain versions on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("nearfield.llm")
from nearfield.llm import textgrid as tg  # noqa: E402
from nearfield.llm import decontaminate, language, line_dedup, media, ngram_join, pseudonyms, quality, token_files, url_rules, word_bpe  # noqa: E402

LONG = "word " * 20_000
TEXTS = [None, "", "   ", "a", "The cat sat on the mat and looked at the very old dog today.", "The cat sat on the mat and looked at the very old dog today.", "Ünïcode é — text\nwith lines\n\nand " + "x" * 300, LONG, "price 3.5, it's <|endoftext|> here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).unionAll(table(spark, ["no id"], [None]))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_hash(samples):
    """Cosine transform by its sum, loop by loop."""
    grey = samples.mean(axis=2)

    def shrunk(x):
        x = [row for row in x for _ in range(-(-32 // len(x)) if len(x) < 32 else 1)]
        edge = [k * len(x) // 32 for k in range(33)]
        return [np.mean(x[a:b], axis=0) for a, b in zip(edge, edge[1:])]

    small = np.array(shrunk(np.array(shrunk(grey)).T)).T
    cos = lambda k, i: np.cos(np.pi * (2 * i + 1) * k / 64)
    low = [round(sum(small[i, j] * cos(u, i) * cos(v, j) for i in range(32) for j in range(32)), 6) for u in range(8) for v in range(8)]
    middle = np.median(low[1:])
    return "".join(f"{int(''.join(str(int(x > middle)) for x in low[k : k + 8]), 2):02x}" for k in range(0, 64, 8))


def test_media(spark, docs, none):
    got = {r.doc_id: r for r in media.media_features(media.with_media(docs)).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256
    stored = {r.doc_id: bytes(r.media) for r in media.with_media(docs).collect()}
    for i in (4, 6, 7):
        assert got[i].feature == plain_hash(media.decode_png(stored[i])) and (got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    raw = zlib.decompress(stored[7][41 : 41 + int.from_bytes(stored[7][33:37], "big")])
    assert len({raw[k] for k in range(0, len(raw), 193)}) > 1  # rows have different filters
    assert media.media_features(media.with_media(none)).count() == 0


@pytest.mark.parametrize("kinds", [[0], [1, 0], [2, 2, 1], [3], [4], [0, 1, 2, 3, 4]])
def test_png_filters_and_checksums(kinds):
    x = np.random.default_rng(2).integers(0, 256, (13, 7, 3), np.uint8)
    f = np.array([kinds[i % len(kinds)] for i in range(13)], np.uint8)
    png = media.encode_png(x, f)
    assert (media.decode_png(png) == x).all()
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(png[:50] + bytes([png[50] ^ 1]) + png[51:])


def edit_one(a, b):
    """Equal, or one item more, less or other: words where both have five or more, else characters."""
    if a == b:
        return True
    if min(len(a), len(b)) < 20:
        return False
    a_words, b_words = a.split(" "), b.split(" ")
    if min(len(a_words), len(b_words)) >= 5:
        a, b = a_words, b_words
    elif max(len(a_words), len(b_words)) >= 5:
        return False
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(rows):
    """{(row, no)} that stay, of (doc_id, order within the doc_id, text) in any order."""
    seen, kept, of = [], set(), {}
    for n, (_, _, t) in sorted(enumerate(rows), key=lambda x: x[1][:2]):
        if rows[n] in of:
            continue
        of[rows[n]] = n
        for no, line in enumerate(t.split("\n")):
            line = line.strip(" ")
            if line:
                if not any(edit_one(line, e) for e in seen):
                    kept.add((n, no))
                seen.append(line)
    return kept


def test_lines(spark, none):
    rng = random.Random(5)
    words = ["ab", "cdé", "e", "fghi", "jk"]
    base = ["".join(rng.choice("abcé") for _ in range(rng.choice([20, 23, 24, 31, 63, 64, 127, 128, 200, 1100]))) for _ in range(12)]
    base += [" ".join(rng.choice(words) for _ in range(rng.choice([5, 6, 7, 8, 15, 16, 17, 40, 200]))).ljust(20, "x") for _ in range(25)]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(3):
            t = rng.choice(base)
            items, join = (t.split(" "), " ") if rng.random() < 0.6 else (list(t), "")
            k = rng.randrange(len(items))
            t = rng.choice([t, t, join.join([*items[:k], "q", *items[k + 1 :]]), join.join(items[:k] + items[k + 1 :]), join.join([*items[:k], "z", *items[k:]]), "short", "shorts"])
            lines.append(t)
        texts.append("\n".join(lines))
    want = brute_lines([(i, 0, t) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.no) for r in line_dedup.kept_lines(table(spark, texts)).collect()}
    assert got == {k for k in want}
    out = {r.doc_id: r for r in line_dedup.line_dedup(table(spark, [None, "", "a\n\nb", "a", "  "])).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == "a\n\nb" and out[2].n_lines == 3 and (out[3].text, out[3].n_dropped) == ("", 1) and out[4].text == "  "
    assert line_dedup.line_dedup(none).count() == 0
    assert line_dedup.deduplicated(table(spark, texts[:1] * 2)).columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]


def test_rows_of_one_id(spark):
    """Rows of one doc_id with other texts lose nothing of their own; equal rows get equal results."""
    from pyspark.sql import functions as F

    lone = "a sentence that no other document of these has in it"
    rows = [(0, "the very same line of quite a few words"), (1, "the very same line of quite b few words"), (1, lone), (1, lone), (2, "x\n" + lone + "\ny"), (None, lone)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("text"))
    order = {(r.doc_id, r.text): r.row for r in df.collect()}
    listed = [(d, order[d, t], t) for d, t in rows if d is not None]
    want = brute_lines(listed)
    got = {(r.doc_id, r.row, r.no) for r in line_dedup.kept_lines(df.select("doc_id", "text")).collect()}
    assert got == {(*listed[n][:2], no) for n, no in want}
    out = sorted(((r.doc_id if r.doc_id is not None else 9), r.text) for r in line_dedup.line_dedup(df.select("doc_id", "text")).collect())
    assert out == [(0, rows[0][1]), (1, ""), (1, lone), (1, lone), (2, "x\ny"), (9, lone)]


def test_shares_that_lines_leave(spark):
    texts = ["one two three four five six seven eight\nnine ten eleven twelve thirteen fourteen", "one two three four five six seven eight\nnine ten eleven twelve thirteen fourteen\nown end", "one two three four five six seven eight\nand this is a line of its own, long enough"]
    assert [r.doc_id for r in line_dedup.deduplicated(table(spark, texts), least=0.2).orderBy("doc_id").collect()] == [0, 2]
    assert [r.doc_id for r in line_dedup.deduplicated(table(spark, texts)).orderBy("doc_id").collect()] == [0, 1, 2]


CLASHES = ["row", "marks", "left", "stay", "found", "put", "between", "at", "line", "gram", "rep", "spans", "y", "id", "size", "gone", "shard", "part", "ids", "words"]


def test_clashing_columns_and_rows(spark):
    """Columns named as the operators' own are kept or ignored; repeated rows and null ids don't crash."""
    from pyspark.sql import functions as F

    df = table(spark, ["one two three four\nfive six", "one two three four\nfive six", None, "", "a@b.de 4111 1111 1111 1111"], [0, 0, 1, None, 2]).withColumns({c: F.lit(f"<{c}>") for c in CLASHES})
    items = spark.createDataFrame([(1, "one two three four five six", "x")], "item_id long, text string, spans string")
    whole = [line_dedup.line_dedup(df), line_dedup.deduplicated(df, least=0.2), pseudonyms.pseudonymised(df, "k"), language.confident(df), ngram_join.one_of_each(df), decontaminate.decontaminated(df, items, 3)]
    for out in whole:
        rows = out.collect()
        assert all(r[c] == f"<{c}>" for r in rows for c in CLASHES) and set(df.columns) <= set(out.columns)
    path = word_bpe.vocabulary("word_bpe_49k.json")
    labels = spark.createDataFrame([(0, 1, "x"), (0, 0, "x"), (2, 0, "y")], "doc_id long, quality int, text string")
    for out in (media.media_features(media.with_media(df)), word_bpe.digests(df, path), ngram_join.linked_components(df), decontaminate.contamination(df, items, 3), quality.scored(df, quality.learn(df, labels)), language.predict(df, None)):
        assert out.count() == 5
    again = pseudonyms.pseudonymised(pseudonyms.pseudonymised(df, "k"), "k")
    assert again.columns.count("n_found") == 1


def test_very_long_texts(spark, tmp_path):
    mail = "me@" + "a.b" + ".c" * 200_000
    texts = [mail, "1 " * 300_000, "9" * 500_000, "(017) " * 100_000, "ab12" * 200_000, "a@" * 300_000, "2024-02-2" * 60_000, "1.2." * 200_000, "word " * 200_000, "w" * 1_000_000, "x\n" * 300_000]
    df = table(spark, texts).repartition(4)
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "k").collect()}
    assert len(got) == len(texts) and got[0].n_found == 1 and got[0].text != mail and got[0].text[2:] == mail[2:] and all(len(got[i].text) == len(t) for i, t in enumerate(texts))
    assert line_dedup.line_dedup(df).count() == len(texts) == language.predict(df, None).count()


def test_pseudonyms(spark, docs, none):
    t = "Mail jo.X7@ex.com or +1 (017) 555-7713, card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; from 97.51.17.173 on 2024-02-29 and 31.12.1999 or 31/02/1999, token " + "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [r for r in pseudonyms.pseudonymised(table(spark, [t, "x " + t]), "k").orderBy("doc_id").collect()]
    a, b = rows[0].text, rows[1].text
    assert b == "x " + a
    for gone in ("jo.X7@", "555-7713", "4111 1111 1111 1111", "4111111111111111 ", "97.51.17.173", "2024-02-29", "04dbebab91ab"):
        assert gone not in a, gone
    assert "4111111111111112" in a and "31/02/1999" in a and re.search(r"\w\w\.\w\d@ex\.com", a)
    spaced, solid = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16})", a).groups()
    digits = [int(c) for c in solid]
    assert spaced.replace(" ", "") == solid and sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"on \d{4}-02-29 and \d\d\.\d\d\.\d{4}", a)
    got = {r.doc_id: r for r in pseudonyms.pseudonymised(docs, "k").collect()}
    assert all(got[i].text == t and got[i].n_found == 0 for i, t in enumerate(TEXTS))
    assert pseudonyms.pseudonymised(none, "k").count() == 0


def test_cards_beside_numbers(spark):
    lines = ["card 4111 1111 1111 1111 12/25", "4111111111111111 123", "12 4111111111111111", "4111 1111 1111 1111 2024-01-15 x", "1234 4111-1111-1111-1111 99 4012888888881881 7", "4111111111111111 12x", "4111111111111112 123", "7 " * 4000 + "x", "1" * 5000]
    got = [r for r in pseudonyms.pseudonymised(table(spark, lines), "k").orderBy("doc_id").collect()]
    one = re.match(r"\d{16}", got[1].text)[0]
    spaced = " ".join(one[i : i + 4] for i in (0, 4, 8, 12))
    assert one != "4111111111111111"
    assert [got[i].text for i in (0, 1, 2, 5)] == [f"card {spaced} 12/25", f"{one} 123", f"12 {one}", f"{one} 12x"]
    assert got[3].text.startswith(spaced) and "2024-01-15" not in got[3].text
    assert got[4].text.startswith(f"1234 {spaced.replace(' ', '-')} 99 ") and "4012888888881881" not in got[4].text
    assert [got[i].n_found for i in (0, 1, 2, 3, 4, 5, 6)] == [1, 1, 1, 2, 2, 1, 0] and got[6].text == lines[6] and got[8].text == lines[8]
    # longest first: a part of a longer valid number is not a card of its own
    assert len(got[7].text) == len(lines[7])


def plain_feistel(value, key, label, hexa=False, wide=False):
    groups = ["0123456789", *(x[: 6 if hexa else 26] for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), *(pseudonyms.ALPHABETS if wide else [])]
    of = {c: g for g in reversed(groups) for c in g}
    if len(value) == 1:
        if value not in of:
            return value
        order = sorted(of[value], key=lambda x: hashlib.sha256(f"{key}|{label}|single|{x}".encode()).digest())
        return order[of[value].index(value)]
    half = [value[: len(value) // 2], value[len(value) // 2 :]]
    for k in range(8):
        a, b = k % 2, 1 - k % 2
        digits = "".join(hashlib.sha256(f"{i}{key}|{label}|{k}|{half[b]}".encode()).hexdigest() for i in range(8))
        number = lambda i: int(digits[i % 64 * 8 : i % 64 * 8 + 8], 16)  # noqa: B023, E731
        half[a] = "".join(of[c][(of[c].index(c) + number(i)) % len(of[c])] if c in of else c for i, c in enumerate(half[a]))
    return "".join(half)


def test_feistel_permutes(spark):
    from pyspark.sql import functions as F

    for width, n in ((1, 10), (3, 1000)):
        df = spark.range(n).select(F.lpad(F.col("id").cast("string"), width, "0").alias("s"))
        out = [r[0] for r in df.select(pseudonyms.feistel(F.col("s"), "k", "t")).collect()]
        assert len(set(out)) == n and all(len(x) == width and x.isdigit() for x in out) and out != [r[0] for r in df.collect()]
    values = ["a", "Z", "7", "José.núñez", "пётр-1", "x_y", "Ωmega", "deadbeef01", "", "-"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    for hexa, wide in ((False, False), (True, False), (False, True)):
        got = [r[1] for r in df.select("i", pseudonyms.feistel(F.col("v"), "key", "email", hexa=hexa, wide=wide)).orderBy("i").collect()]
        assert got == [plain_feistel(v, "key", "email", hexa, wide) for v in values]


def test_pseudonyms_against_plain_ones(spark):
    """Addresses, secrets, telephone numbers and cards, found with Python's own patterns."""
    import regex

    texts = ["write josé.núñez@mail.example.org or b@c.de, k9@x.y", "key 0a1b2c3d4e5f60718293a4b5c6d7e8f9 end", "call (030) 555-1234 or 030-55-1234 now", "pay 4012888888881881 or 4012-8888-8888-1881!", "31.02.2020 is no day, 29.02.2021 neither"]
    got = [(r.text, r.n_found) for r in pseudonyms.pseudonymised(table(spark, texts), "k").orderBy("doc_id").collect()]
    mail = regex.sub(pseudonyms.EMAIL, lambda m: plain_feistel(m[0].split("@")[0], "k", "email", wide=True) + "@" + m[0].split("@")[1], texts[0])
    secret = regex.sub(pseudonyms.SECRET, lambda m: plain_feistel(m[0], "k", "secret", hexa=True), texts[1])

    def digits(template, new):
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in template)

    phone = regex.sub(pseudonyms.PHONE, lambda m: digits(m[0], plain_feistel("".join(c for c in m[0] if c.isdigit()), "k", "phone")), texts[2])
    body = plain_feistel("401288888888188", "k", "card")
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    card = body + str(-total % 10)
    cards = f"pay {card} or {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}!"
    assert got == [(mail, 3), (secret, 1), (phone, 2), (cards, 2), (texts[4], 0)]


def test_a_key_is_needed(spark, none):
    with pytest.raises(ValueError):
        pseudonyms.pseudonymised(none, "")


def test_language(spark, docs, none):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [r for r in language.op4(spark, d).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    model = language.learned(docs, language.F.lit(True))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 4)] == ["und", "und", "und", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert language.predict(none, language.learned(none, language.F.lit(True))).count() == 0


def test_letters_of_unseen_scripts():
    texts = [("a", "the cat sat on the mat " * 40_000), ("b", "der hund lief in den wald " * 40_000)]
    model = language.fit(texts, language.Pieces(["▁", "▁the", "▁der", "a", "t", "n"]))
    model.p[1] = 1e-9
    assert np.isfinite(model.word_scores(["語" * 48])).all()
    pred, sure = language.Scorer(model)(["der hund " * 50 + "語" * 60, "語" * 60])
    assert pred[0] == "b" and all(0 <= x <= 1 for x in sure)


def test_letters_only(spark):
    assert language.split_words("½ ² Ⅷ 12_3") == [] and language.split_words("a½b Ⅷc") == ["a", "b", "c"]
    model = language.fit([("en", "the cat")], language.Pieces(["▁", "the"]))
    assert language.Scorer(model)(["½ ² Ⅷ", None, "cat"])[0] == ["und", "und", "en"]
    df = spark.createDataFrame([(None, "x"), (1, "y")], "doc_id long, text string")
    assert {r.h for r in df.select(language.held_out().alias("h")).collect()} <= {True, False}


def test_counts_are_those_of_texts(spark):
    """The model from counts made in tasks is the model from whole texts; one EM round by hand."""
    rows = [(i, t, lang, "s", 1, 1) for i, (lang, t) in enumerate([("a", "ab ab b"), ("a", "ba"), ("b", "b b"), ("b", None), ("c", "")])]
    df = spark.createDataFrame(rows, SCHEMA)
    words = language.training_counts(df, ["a", "b", "c"])
    assert sorted(w for w in words if w[1]) == [("a", "ab", 2), ("a", "b", 1), ("a", "ba", 1), ("b", "b", 2)] and {w[0] for w in words if w[1] is None} == {"a", "b", "c"}
    pieces = language.Pieces(["▁", "a", "ab", "b", "▁b"])
    one, two = language.fit_counts(words, pieces), language.fit([(r[2], r[1]) for r in rows if r[1] is not None], pieces)
    assert one.languages == ["a", "b", "c"] and np.allclose(one.p, two.p)
    got = language.fit([("a", "ab")], pieces, rounds=1).p[:, 0]
    start = {p: 0.02 ** min(len(p), 4) ** 0.5 for p in pieces.id}
    ways = [("▁", "a", "b"), ("▁", "ab")]
    weight = [np.prod([start[p] for p in w]) for w in ways]
    total = 0.02 + sum(start.values())
    weight = [np.prod([start[p] / total for p in w]) for w in ways]
    expected = {p: 0.01 + sum(w.count(p) * x for w, x in zip(ways, weight)) / sum(weight) for p in pieces.id}
    whole = 0.01 + sum(expected.values())
    assert all(got[i] == pytest.approx(expected[p] / whole) for p, i in pieces.id.items())


def test_many_languages(spark, monkeypatch):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i % 7)}x" for i in range(205)]
    rows = [(i, f"{w} {w} {w}", f"l{i:03}", "s", 1, 1) for i, w in enumerate(words)]
    monkeypatch.setattr(language, "AT_ONCE", 60)
    model = language.learned(spark.createDataFrame(rows, SCHEMA), language.F.lit(True))
    assert model.languages == [f"l{i:03}" for i in range(205)]
    pred, _ = language.Scorer(model)([words[204], words[0]])
    assert pred == ["l204", "l000"]


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(["▁", "▁a", "a", "ab", "b"])
    p = np.zeros((7, 1))
    p[2:, 0] = [0.1, 0.2, 0.3, 0.25, 0.15]
    got = np.exp(language.Model(pieces, ["x"], p).word_scores(["ab"]))[0, 0]
    assert got == pytest.approx(0.1 * 0.3 * 0.15 + 0.1 * 0.25 + 0.2 * 0.15)


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    path = word_bpe.vocabulary("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in word_bpe.digests(docs, path).collect()}
    back = {r.doc_id: r for r in word_bpe.decode(word_bpe.encode(docs, path), path).collect()}
    once = {r.doc_id: r for r in word_bpe.encoded_and_decoded(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        text = tk.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (back[i].ids, back[i].text) == (once[i].ids, once[i].text) == (ids, text)
    assert word_bpe.digests(none, path).count() == 0


def test_word_tables(spark, docs):
    """Small chunks: each has its distinct words once, and ids don't depend on the chunks."""
    path = word_bpe.vocabulary("word_bpe_49k.json")
    two = docs.repartition(2, "doc_id")
    tables = spark.read.parquet(word_bpe.word_tables(two, path, 3))
    words = [(r.part, r.at, w) for r in tables.collect() for w in bytes(r.words).split(b" ")]
    assert len(words) == len(set(words)) and {w for *_, w in words} == {w for r in docs.collect() for w in (r.text or "").encode().split()}
    assert {r.doc_id: r.ids for r in word_bpe.encode(two, path, 3).collect()} == {r.doc_id: r.ids for r in word_bpe.encode(docs, path).collect()}


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = word_bpe.vocabulary("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    for length, rows in ((16, 4), (1024, 256)):
        where = f"file://{tmp_path}/{length}"
        manifest = token_files.write(docs, where, path, 2, length, rows, shards=3)
        got = {r.doc_id: r for r in token_files.read(manifest, where).collect()}
        start = got[None].n_tokens
        for i, t in enumerate(TEXTS):
            ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
            assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
        f = token_files.TokenFile(manifest.orderBy("shard").first().ids_path, where)
        assert all(len(f.sequence(k)) == length for k in range(len(f))) and f.mask(len(f) - 1).dtype == bool and len(f.mask(0)) == length
    assert token_files.read(token_files.write(none, f"file://{tmp_path}/none", path, 2), f"file://{tmp_path}/none").count() == 0


def test_urls(spark):
    urls = [None, "", "no-scheme.net/", "http://A.B.NET/x", "https://net/", "https://net", "http://x.example.net/en/1?q", "http://x.example.net/en", "http://example.com/de/", "http://notexample.com/de/", "http://a.org/fr/x#y", "http://a.org/x/fr/", "http://x.net?://example.org/fr/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, extra int")
    got = {r.page_id: r for r in url_rules.judged(pages, url_rules.rule_table(spark)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = max(((len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert tuple(got[i]) == (i, host, path, fit[1], fit[2]), u
    assert url_rules.judged(pages.limit(0), url_rules.rule_table(spark)).count() == 0


def plain_cotraining(docs, labels, labelled, rounds, each):
    """Co-training on dense rows, fitted by Newton steps."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t, "source": s, "lang": g, "n_chars": n} for d, t, g, s, n, _ in docs])
    dense = {}
    for v, (f, size) in quality.VIEWS.items():
        whole = np.zeros((len(docs), size))
        for i, (c, x) in enumerate(f(rows)):
            np.add.at(whole[i], c, x)
        dense[v] = whole[:, (whole != 0).any(axis=0)]  # a weight without data stays 0
    known = {d: y for d, y in labels}
    fold = {d: int(tg.mix(np.array([d], np.int64).view(np.uint64))[0]) % 4 == 0 for d in known}
    place = {r[0]: i for i, r in enumerate(docs)}

    def fit(x, y):
        w, share = np.zeros(x.shape[1]), np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum())
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (share * (p - y)) + 1e-3 * w)
        return w

    held = {v: {d: y for d, y in known.items() if not fold[d]} for v in dense}
    own = [d for d in known if fold[d]]
    share = np.mean([y for d, y in known.items() if not fold[d]])
    for k in range(rounds + 1):
        models = {}
        for v, x in dense.items():
            m = quality.Logistic(x.shape[1])
            m.w = fit(x[[place[d] for d in held[v]]], np.array(list(held[v].values()), float))
            if len({known[d] for d in own}) == 2:
                m.calibrate(x[[place[d] for d in own]] @ m.w, np.array([known[d] for d in own], float))
            models[v] = m
        if k == rounds:
            return {d: [float(models[v].log_odds(dense[v][i] @ models[v].w)) for v in dense] for d, i in place.items()}
        new = {}
        for v, x in dense.items():
            odds = {d: models[v].a * (x[place[d]] @ models[v].w) + models[v].b for d in place if d not in known}
            sure = np.log(0.9 / 0.1)
            good = sorted((d for d in odds if odds[d] >= sure), key=lambda d: (-odds[d], d))[: round(each * share)]
            bad = sorted((d for d in odds if odds[d] <= -sure), key=lambda d: (odds[d], d))[: round(each * (1 - share))]
            new[v] = [(d, 1) for d in good] + [(d, 0) for d in bad]
        for v in dense:
            for other in dense:
                if other != v:
                    for d, y in new[v]:
                        held[other].setdefault(d, y)


def test_quality_against_plain_cotraining(spark, monkeypatch):
    monkeypatch.setattr(quality, "TOLERANCE", 1e-9)
    rng = random.Random(3)
    good, bad = [f"g{i}" for i in range(9)], [f"b{i}" for i in range(9)]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.choice([4, 30]))), "en", "web" if i % 2 and rng.random() < 0.9 else "junk", rng.choice([50, 5000]), 1) for i in range(120)]
    labels = [(i, i % 2) for i in range(60)]
    df = spark.createDataFrame(docs + docs[:9], SCHEMA)  # some rows twice
    known = spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int")
    model = quality.learn(df, known, rounds=2, each=10)
    want = plain_cotraining(docs, labels, 4000, 2, 10)
    assert len(model.held_out) == 3
    for r in quality.scored(df, model).collect():
        z = want[r.doc_id]
        p = [1 / (1 + np.exp(-x)) for x in (*z, sum(z) / 2)]
        assert (r.text_quality, r.meta_quality, r.quality) == pytest.approx(tuple(p), abs=2e-3), r.doc_id


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.quality for r in quality.scored(docs, quality.learn(docs, labels)).collect()} == {0.5}
    assert quality.scored(none, quality.learn(none, labels)).count() == 0
    d = "/root/testdata/sf0.01"
    table_, known = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    # the classifiers have seen none of the documents that they are judged by
    truth = {r.doc_id: r.quality for r in known.where("doc_id % 3 = 0").collect()}
    model = quality.learn(table_, known.where("doc_id % 3 <> 0"))
    rows = [(r.quality, truth[r.doc_id]) for r in quality.scored(table_, model).collect() if truth.get(r.doc_id) is not None]
    assert quality.auc(np.array([p for p, _ in rows]), np.array([y for _, y in rows])) > 0.95
    assert model.held_out[-1]["text"] >= model.held_out[0]["text"] - 0.02


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    c = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= percent * len(sets[i] | sets[j]) and c[i] != c[j]:
                lo, hi = sorted((c[i], c[j]))
                c = [lo if k == hi else k for k in c]
    return {i: (len(s), k) for i, (s, k) in enumerate(zip(sets, c))}


@pytest.mark.parametrize(("n", "percent", "few"), [(3, 90, 20), (5, 80, 0)])
def test_jaccard(spark, docs, none, monkeypatch, n, percent, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = random.Random(n * percent)
    words = [f"w{i}" for i in range(60)]
    seeds = [[rng.choice(words) for _ in range(rng.choice([3, 9, 40, 120]))] for _ in range(8)]
    texts = list(TEXTS)
    for _ in range(70):
        s = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            s[rng.randrange(len(s))] = rng.choice(words)
        texts.append(" ".join(s))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(table(spark, texts), n, percent).collect()}
    assert got == brute_components(texts, n, percent)
    if few:
        assert ngram_join.linked_components(none, n, percent).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_equal_parts(spark, percent):
    rng = random.Random(percent)
    texts = ["a b", ""]
    for m in (3, 7, 20, 60, 300):
        base = [f"w{rng.randrange(900)}" for _ in range(m)]
        for edits in (0, 1, 2, 4, m // 40):
            s = list(base)
            for _ in range(edits):
                s[rng.randrange(len(s))] = "x"
            texts += [" ".join(s), " ".join(s + base[: m // 12])]
    keys = {r.doc_id: (r.n, set(r["keys"])) for r in ngram_join.part_keys(table(spark, texts), 3, percent).collect()}
    grams = [{tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} if t else set() for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if grams[j] and 100 * len(grams[i] & grams[j]) >= percent * len(grams[i] | grams[j])]
    assert len(near) > 30 and all(keys[i][1] & keys[j][1] for i, j in near)
    assert all(n == len(g) for (n, _), g in zip((keys[i] for i in range(len(texts))), grams)) and not keys[1][1]


def test_contamination(spark, docs, none):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(k))) for i, k in enumerate([12, 15, 10, 3, 1])] + [(50, None), (51, "--"), (None, "w1 w2")]
    texts = [None, "", "W1, " * 5] + [" ".join([rng.choice(words) for _ in range(8)] + (items[k % 3][1].split()[: 9 + k % 5] if k % 2 else []) + ["zz"]) for k in range(20)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = [(i, w[k : k + 10]) for i, t in items if i is not None and (w := split(t)) for k in range(max(1, len(w) - 9))]
    for block, slop in ((32 << 20, 0), (60, 2), (60, 1)):
        got = {r.doc_id: r for r in decontaminate.contamination(table(spark, texts), tests, slop=slop, block_bytes=block).collect()}
        for d, t in enumerate(texts):
            w, hit, own, near = split(t), set(), set(), set()
            for i, x in windows:
                for k in range(len(w) - len(x) + 1):
                    if w[k : k + len(x)] == x:
                        hit.update(range(k, k + len(x)))
                        own.add(str(i))
                if any(all(word in w[max(0, k + j - slop) : max(0, k + j + slop + 1)] for j, word in enumerate(x)) for k in range(-slop, len(w) + slop)):
                    near.add(str(i))
            assert (got[d].n_words, got[d].n_hit, got[d]["items"], got[d].near_items) == (len(w), len(hit), sorted(own), sorted(near)), (d, slop)
    only = decontaminate.contamination(table(spark, texts), tests, slop=0, short=False).collect()
    assert {i for r in only for i in r["items"]} <= {"0", "1", "2"}
    assert decontaminate.contamination(none, tests).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, tests.limit(0)).collect()} == {0}


def test_pipeline(spark):
    """Five stages against plain versions of four of them; the languages are those that the operator tells."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r.text for r in language.confident(docs).collect()}
    told = {r.doc_id: r for r in language.predict(docs, language.learned(docs, language.F.lit(True))).collect()}
    assert set(rows) == {i for i, r in told.items() if r.lang_pred != "und" and r.score >= 0.5}
    ids = sorted(rows)
    kept, left = brute_lines([(i, 0, rows[i]) for i in ids]), {}
    for n, i in enumerate(ids):
        lines = rows[i].split("\n")
        stay = [x for no, x in enumerate(lines) if not x.strip(" ") or (n, no) in kept]
        text = "\n".join(stay)
        if len(stay) == len(lines) or text.replace("\n", " ").strip(" ") and len(text) >= 0.2 * len(rows[i]):
            left[i] = text
    ids = sorted(left)
    comp = brute_components([left[i] for i in ids], 5, 80)
    ids = [i for n, i in enumerate(ids) if comp[n][1] == n]
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in [split(r.text or "")] for k in range(len(w) - 9)}
    clean = [i for i in ids if not any(tuple(w[k : k + 10]) in windows for w in [split(left[i])] for k in range(len(w) - 9))]
    tk = Tokenizer.from_file(word_bpe.vocabulary("word_bpe_49k.json"))
    want = {}
    for i in clean:
        e = tk.encode(left[i], add_special_tokens=False).ids
        want[i] = (e, tk.decode(e, skip_special_tokens=False))
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "ids", "text"] and {r.doc_id: (r.ids, r.text) for r in out.collect()} == want


def test_storage(spark):
    from nearfield.llm import storage

    assert [storage.size_of(x) for x in ("64m", "4194304b", "10000", "1KB", "-1", "0")] == [64 << 20, 4 << 20, 10000, 1024, -1, 0]
    assert storage.spare(["A", "a_"], "a") == "a__"
    with pytest.raises(ValueError):
        storage.open_fs("wasb://x/y")


def test_missing_words_are_encoded_together():
    from nearfield.llm import token_files, wordtable

    path = word_bpe.vocabulary(token_files.VOCABULARY)
    t = wordtable.tokenizer(path)

    class Counted:
        texts = 0

        def __getattr__(self, name):
            return getattr(t, name)

        def encode_batch_fast(self, texts, **more):
            Counted.texts += len(texts)
            return t.encode_batch_fast(texts, **more)

    table, spaced = wordtable.WordTable(path), wordtable.WordTable(path, " ")
    spaced.t = Counted()
    many = " ".join(f"wort{i}" for i in range(2000))
    texts = ["a", "", " ", " a", "a ", "a  b", "a\n b", "a \nb", "a\t \tb", "\n", " \n", "x 's it's", "a <|endoftext|> b", "<|endoftext|>", "a  b", "Ġ Ġx", "é é ́", "\U0001f600 1 2,3", "z\r\nq\x0b w\x0c", "\x1c \x1c", many, many + " neu"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, table.type).tobytes() for x in texts]
    assert token_files._table_ids(table, spaced, [x.encode() for x in texts]) == want
    assert Counted.texts < 50  # not one for each of 2000 words
    few = wordtable.WordTable(path, " ", 10)  # words that the table lost amid the texts come back
    assert [token_files._table_ids(table, few, [x.encode()])[0] for x in texts * 2] == want * 2
    assert token_files._table_ids(table, few, [x.encode() for x in texts]) == want
