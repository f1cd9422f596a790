"""Unification, encoding, garbled text and pairs."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import encode, garbled, pairs, unify
from pageloom.session import table


def form(*texts):
    return unify.unify_array(pa.array(texts, pa.string())).to_pylist()


def test_look_alikes_become_equal_and_others_stay_apart():
    same = [("Cοmpare the cοntеxt", "Compare the context"), ("ｐｒｏｍｐｔ　１２", "prompt 12"), ("⽂⻅⻚", "文见页"), ("buﬀer ﬁle", "buffer file"), ("a\u200bb\xadc\ufeff", "abc"), ("e\u0301te\u0301", "été"), ("a\xa0b\u2007c\u202fd", "a b c d"), ("a\r\nb\rc", "a\nb\nc"), ("co‑op", "co-op"), ("вepa", "вера"), ("ㅤx", "x"), ("ﾊﾟ", "パ"), ("한", "\u1112\u1161\u11ab")]
    for a, b in same:
        assert form(a) == form(b), (a, b)
    for a, b in [("e", "é"), ("x2", "x²"), ("x2", "x②"), ("A", "a"), ("–", "-"), ("👩\u200d💻", "👩💻"), ("l", "1")]:
        assert form(a) != form(b), (a, b)
    assert form(None, "", " ") == [None, "", " "]
    assert form("а в России", "Вера и Ева", "Вера") == ["а в России", "Вера и Ева", "Bepa"]


def test_composition_equals_nfc():
    random.seed(5)
    chars = [c for c in map(chr, [*range(0xA0, 0x250), *range(0x300, 0x345), *range(0x1E00, 0x1F00), *range(0xAC00, 0xAC80), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]) if unicodedata.category(c) != "Cn" and unify._folded(c) == unicodedata.normalize("NFD", c)]
    texts = ["".join(random.choice(chars) for _ in range(random.randint(0, 14))) for _ in range(1500)]
    assert form(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_pairs_of_look_alikes(spark):
    df = spark.createDataFrame([("a", "slide"), ("b", "ｓlide"), ("b", "ｓlide"), ("c", "slide"), ("d", None), (None, "slide"), ("e", ""), ("f", "Slide")], "k string, t string")
    assert sorted(map(tuple, unify.look_alikes(df, "k", "t").collect())) == [("a", "b"), ("b", "c")]
    assert unify.look_alikes(df.limit(0), "k", "t").count() == 0
    assert unify.unify(df.withColumn("unified", df.k), "t").columns == ["k", "t", "unified"]


def test_joined_ids_equal_those_of_the_whole():
    plain = encode._encoder(Path(encode.TOKENIZER).read_bytes()).encode_ordinary
    enc = lambda x: np.array(plain(x), np.int32)
    random.seed(1)
    atoms = ["a", "b", " ", "  ", "\n", "\n\n", "'", "'s", "'r", "e", "ll", "1", "é", "中", "!", "don't", "\t", "🙂"]
    for _ in range(3000):
        chunks = ["".join(random.choice(atoms) for _ in range(random.randint(1, 6))) for _ in range(random.randint(1, 6))]
        ids, safe, kept = [], [], []
        for c in chunks:
            ids.append(enc(c))
            safe.append(encode._settled(c))
            kept.append(len(ids[-1]) - len(enc(c[safe[-1] :])))
        assert encode.join_ids(chunks, ids, safe, kept, enc).tolist() == plain("".join(chunks))


def test_settled_place_is_that_of_the_whole_chunk():
    pattern = encode._pattern()
    random.seed(5)
    for _ in range(400):
        c = "".join(random.choice(["word", " ", "中文", "，", "1", "'s", "\n", "  ", "é", "!?", "x" * 70]) for _ in range(random.randint(1, 400)))
        starts = [m.start() for m in pattern.finditer(c)]
        assert encode._settled(c) == (starts[-2] if len(starts) > 1 else 0)


def test_token_ids_of_a_table(spark):
    random.seed(2)
    long = " ".join(random.choice(["alpha", "beta's", "中文", "\n\n", "x" * 40, "  "]) for _ in range(9000))
    rows = [(1, long), (2, long[5000:] + "tail"), (3, ""), (4, None), (5, "<|endoftext|>"), (5, "<|endoftext|>"), (6, "y" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    enc = encode._encoder(Path(encode.TOKENIZER).read_bytes()).encode_ordinary
    got = {r.doc_id: list(r.ids) for r in encode.token_ids(df, "doc_id", "text").collect()}
    assert got == {k: enc(t) if t else [] for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df, ["doc_id"], "text").distinct().collect()} == {k: len(v) for k, v in got.items()}
    assert encode.token_ids(df.limit(0), "doc_id", "text").count() == 0


CLEAN = ["Les étudiants doivent d’abord comparer deux choses : la détection d’en-tête et le modèle.", "It’s the “task planner” that matters — not the gradient step.", "Häufig wird übersehen, dass die Größenprüfung größer ist.", "После каждого изменения фильтр шума строится заново.", "学生应当先比较稀疏检索器与缓存层，再修改答案评估。", "Además, la reescritura de consultas reduce el tamaño que la detección necesita leer."]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t,) for t in CLEAN for _ in range(30)], "text string")
    return garbled.train(df, "text")


def test_garbled_texts_come_back(model):
    scorer = garbled.Scorer(model)

    def undo(text):
        out, at = [], 0
        for b, e, _, original in garbled.label(text, scorer):
            out += [text[at:b], original]
            at = e
        return "".join(out) + text[at:]

    for t in CLEAN:
        assert garbled.label(t, scorer) == []
        for read in ("cp1251", "mac-roman", "cp437", "cp850"):
            assert undo(t.encode().decode(read, "replace")) == t or "�" in t.encode().decode(read, "replace"), (t, read)
        assert undo(t.encode().decode("latin-1")) == t
    assert undo(CLEAN[3].encode("cp1251").decode("latin-1")) == CLEAN[3]
    assert undo(CLEAN[4].encode("gb18030").decode("latin-1")) == CLEAN[4]
    assert garbled.label("A reader who sees “Ã©” has opened it wrong, `donâ€™t` too.", scorer) == []
    assert [s for _, _, s, _ in garbled.label("It�s lost", scorer)] == ["lost"]


def test_restore_table(spark, model):
    bad = CLEAN[0].encode().decode("latin-1")
    df = spark.createDataFrame([(1, bad), (2, CLEAN[1]), (3, None), (4, ""), (5, "sound\n" + bad)], "doc_id long, text string")
    got = {r.doc_id: (r.restored, bool(r.pairs)) for r in garbled.restore(df, "doc_id", "text", model).collect()}
    assert got == {1: (CLEAN[0], True), 2: (CLEAN[1], False), 3: (None, False), 4: ("", False), 5: ("sound\n" + CLEAN[0], True)}
    assert garbled.restore(df.limit(0), "doc_id", "text").count() == 0


Q = "How does the vector index interact with the cache layer in section 4.2 of notes_0001?"


@pytest.mark.parametrize(
    ("answer", "defect"),
    [
        (None, "empty"), ("  \n", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("\u200b", "empty"), ("（无）", "empty"),
        (Q, "copy"), ("Q: " + Q.lower(), "copy"), (Q.replace("vector ", ""), "copy"), (Q + "\n" + Q, "copy"), (Q + "\nThe cache layer is stored next to the vector index.", None),
        ("I'm sorry, but I can't help with the cache layer. Please ask your lecturer.", "refusal"), ("抱歉，我无法回答关于缓存层的问题。请联系课程组。", "refusal"), ("Sorry for the confusion earlier. The cache layer is small.", None), ("I can't say for certain, but the cache layer keeps 40 entries per index.", None),
        ("Die Größenprüfung ist größer als der Vektorindex und die Liste wird nach jeder Änderung erneuert.", "wrong_language"), ("当缓存层超过30项时，向量索引会更慢。", "wrong_language"), ("BM25", None), ("O(n log n)", None), ("12 ms", None), ("Yes.", None),
        ("The cache layer keeps 40 entries. The steps are:", "truncated"), ("The cache layer keeps 40 entries per request and the", "truncated"), ("It keeps forty.\n\n```python\nfor d in x:\n    f(d, k=", "truncated"), ("The steps are:\n1. one\n2.", "truncated"), ("The cache layer is (", "truncated"),
        ("The steps are:\n- cache layer\n- vector index", None), ("It is stored next to the cache.\n\n```python\nk = 1\n```", None), ("The cache layer remains unchanged (k = 4)", None),
    ],
)
def test_defects(answer, defect):
    assert pairs.defect(Q, unify.unify_array(pa.array([answer], pa.string()))[0].as_py()) == defect


def test_asked_language_and_null_question():
    assert pairs.defect(Q + " Answer in German.", "Die Größenprüfung ist größer als der Vektorindex und die Liste wird erneuert.") is None
    assert pairs.defect(None, "A whole sentence.") is None


def test_tiling_counts_each_token_once():
    assert pairs.tile(list("abcabc"), list("abc")) == (6, 3)
    assert pairs.tile(list("xaby"), list("abz")) == (2, 2)
    assert pairs.tile([], list("ab")) == (0, 0)


def test_defects_of_a_table(spark, sf):
    df = table(spark, sf, "session_turns")
    out = pairs.defects(df, "id", "user_original", "assistant_final")
    assert out.count() == df.select("id").distinct().count()
    assert pairs.defects(df.limit(0), "id", "user_original", "assistant_final").count() == 0


def test_characters_with_a_byte_dropped_come_back(spark):
    words = [*CLEAN, "Übungen: Schließlich muss die Größe stimmen. Über alles.", "AVALIAÇÃO da recuperação", "O ruído falha às vezes e leva à frente."]
    model = garbled.train(spark.createDataFrame([(t,) for t in words for _ in range(30)], "text string"), "text")
    scorer = garbled.Scorer(model)
    bad = {"# Ãbungen": "# Übungen", "SchlieÃlich muss": "Schließlich muss", "AVALIAÃÃO 8": "AVALIAÇÃO 8", "Itâs the": "It’s the", "falha Ã s vezes": "falha às vezes"}
    for text, sound in bad.items():
        out, at = [], 0
        for b, e, _, original in garbled.label(text, scorer):
            out += [text[at:b], original]
            at = e
        assert "".join(out) + text[at:] == sound
    for t in (*words, "an “é” of another table"):
        assert garbled.label(t, scorer) == []


def test_single_characters_that_look_usual_are_found(spark):
    bad = {"le manifeste de lÆindex": "le manifeste de l’index", "# AVALIAÃÃO 8.1": "# AVALIAÇÃO 8.1"}
    texts = ["\n".join([*CLEAN, "le manifeste de l’index", "AVALIAÇÃO da recuperação"] * 100)] * 20 + [*bad]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = garbled.restore(df, "doc_id", "text").collect()
    assert {texts[r.doc_id]: r.restored for r in got if r.pairs} == bad
    assert all(r.restored == texts[r.doc_id] for r in got if not r.pairs)


def test_parser_of_markup_quotes_and_emphasis():
    q = "What does the cache keep?"
    whole = ['He said "the cache is small."', "<table><tr><td>a</td></tr></table>", "<ul><li>one<li>two</ul>", "It is **small** and __fast__.", 'A 5" screen is enough.', "`<b>` is a tag.", "line<br>next."]
    broken = ['He said "the cache is small.', "<table><tr><td>one", "It is **small and fast.", "See <b>the cache.", "```\ncode", "It keeps (two entries."]
    assert [pairs.open_ends(x) for x in whole] == [[]] * len(whole)
    assert all(pairs.defect(q, x) == "truncated" for x in broken)
    assert pairs.defect("What is the status?", "Unknown.") is None and pairs.defect("What is the status?", "None") == "empty"
    assert pairs.defect("キャッシュとは何ですか。", "申し訳ありませんが、そのご質問にはお答えできません。") == "refusal"
