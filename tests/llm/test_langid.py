import random

import numpy as np
import pytest
from cases import awkward_rows, sentence
from pyspark.sql import functions as F

from vellum.llm import langid


def parse(symbols, sample):
    """Phrases by definition, in blocks: each the longest match in the sample, one symbol at least."""
    text, count = "".join(map(chr, sample)), 0
    for at in range(0, len(symbols), langid.BLOCK):
        block = "".join(map(chr, symbols[at : at + langid.BLOCK]))
        i = 0
        while i < len(block):
            n = 1
            while i + n < len(block) and block[i : i + n + 1] in text:
                n += 1
            i, count = i + n, count + 1
    return count


def test_phrases():
    rng = random.Random(3)
    samples = {"a": [sentence(rng, 60, "abcd")], "b": [sentence(rng, 60, "cdef")], "c": [sentence(rng, 3, "xyz")]}
    model = langid.Model(samples, 10_000)
    table = langid.symbol_table(model.symbols)
    texts = [sentence(rng, n, stem) for n, stem in ((1, "ab"), (30, "abcdefgh"), (300, "bcde"), (50, "xyzé"))] + ["", "!?", "q"]
    symbols, sizes, letters = langid.encode(texts, table)
    got = model.phrases(symbols, sizes)
    ends = np.cumsum(sizes)
    for k, lang in enumerate(model.langs):
        sample = [x for t in samples[lang] for x in [*langid.encode([t], table)[0].tolist(), 0]]
        for i in range(len(texts)):
            assert got[k, i] == parse(symbols[ends[i] - sizes[i] : ends[i]].tolist(), sample)
    assert letters.tolist() == [True] * 4 + [False, False, True]


def test_predictions():
    """The language with the smallest ``phrases * log2(labelled symbols) / symbols``, ties to the first by name."""
    rng = random.Random(8)
    same = sentence(rng, 60, "z")
    samples = {"q": [sentence(rng, 80, "abcd")], "p": [sentence(rng, 40, "abcd")], "r": [sentence(rng, 60, "cdef")], "s": [same], "t": [same]}
    model = langid.Model(samples, 10_000)
    table = langid.symbol_table(model.symbols)
    texts = [sentence(rng, rng.randint(1, 90), rng.choice(["ab", "abcd", "cdef", "def", "zz", "xyz"])) for _ in range(120)] + ["", "12", "zz zzz z zz", "Z zzz zz z"]
    names, scores = model.predict(texts, table)
    for text, name, score in zip(texts, names, scores, strict=True):
        symbols, sizes, _ = langid.encode([text], table)
        if not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0)
            continue
        entropy = []
        for lang in sorted(samples):
            sample = [x for t in samples[lang] for x in [*langid.encode([t], table)[0].tolist(), 0]]
            entropy.append(parse(symbols.tolist(), sample) * np.log2(len(sample) + 2) / sizes[0])
        first, second = sorted(entropy)[:2]
        assert name == sorted(samples)[entropy.index(first)] and abs(score - (1 - first / second)) < 1e-9
    assert names[-2:] == ["s", "s"] and set(names) >= {"p", "q", "r", "s", "und"}


def test_automaton():
    """It accepts exactly the substrings."""
    rng = random.Random(4)
    text = [rng.randint(0, 2) for _ in range(60)]
    sam = langid.SuffixAutomaton(text)

    def accepts(word):
        s = 0
        for c in word:
            if c not in sam.next[s]:
                return False
            s = sam.next[s][c]
        return True

    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    assert all(map(accepts, inside))
    for _ in range(2000):
        word = tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 8)))
        assert accepts(word) == (word in inside)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.count() > 150 and got.where("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_inputs_of_a_prediction(spark, sf_dir):
    """Only the text counts, and only labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.expr(langid.HELD_OUT)
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    a, b = (langid.language_report(d).select("doc_id", "lang_pred", "score") for d in (docs, other))
    assert a.exceptAll(b).count() == 0 and a.where("lang_pred = 'xx'").count() == 0


def test_awkward(awkward, clashing, nothing):
    got = langid.language_report(clashing)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(awkward_rows())
    for r in langid.identify(awkward, langid.Model({"en": ["abc def"]}, 100)).collect():
        und = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == und and (r["score"] == 0) == und
    assert langid.language_report(nothing).count() == 0
    assert {r["lang_pred"] for r in langid.language_report(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


@pytest.mark.parametrize("text", ["a\x00b", "\U0010ffff a", "İı ſ"])
def test_odd_characters(text):
    model = langid.Model({"x": [text + " abc"], "y": ["zzz"]}, 100)
    assert model.predict([text], langid.symbol_table(model.symbols))[0] == ["x"]


def test_letters_apart():
    """Languages of scripts with more letters than symbols are told apart, however many scripts there are."""
    rng = random.Random(6)
    starts = {"a": 0x4E00, "b": 0x5E00, "c": 0x6E00, "d": 0x0430, "e": 0x0905, "f": 0xAC00}
    write = lambda lang, n: "".join(chr(starts[lang] + rng.randrange(20 if lang == "d" else 40 if lang == "e" else 90)) for _ in range(n))
    model = langid.Model({lang: [write(lang, 800)] for lang in starts}, 20_000)
    texts = [write(lang, n) for lang in starts for n in (5, 20, 100)]
    table = langid.symbol_table(model.symbols)
    assert model.predict(texts, table)[0] == [lang for lang in starts for _ in range(3)]
    codes = {langid.encode([c], table)[0].tobytes() for c in set("".join(texts))}
    assert len(codes) == len(set("".join(texts)))


def test_lengths(spark):
    """Languages that only have short or only long documents are learnt too."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, 8, "abcd"), "short") for i in range(300)] + [(300 + i, sentence(rng, 4000, "efgh"), "long") for i in range(3)]
    rows += [(400 + i, sentence(rng, 100, "ijkl"), "usual") for i in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["long", "short", "usual"] and min(model.bits) > 12
    texts = [sentence(rng, 10, stem) for stem in ("efgh", "abcd", "ijkl")]
    assert model.predict(texts, langid.symbol_table(model.symbols))[0] == model.langs
