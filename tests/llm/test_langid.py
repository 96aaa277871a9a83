import random

import numpy as np
from conftest import sentence
from pyspark.sql import functions as F

from pointloom.llm import langid

FR = "le la les de des un une et est dans pour que qui sur avec par pas plus son ses ont été cette mais comme nous vous elle faire être".split()


def plain_phrases(text, sample):
    """Greedy longest phrases by substring search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + size] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_against_search():
    rng = random.Random(1)
    texts = {"a": " ".join(rng.choice(["ab", "ba", "abc", "cab"]) for _ in range(60)), "b": " ".join(rng.choice(["xy", "yx", "xa"]) for _ in range(60))}
    m = langid.train(texts)
    probe = ["abc ab", "xyx", "", "abcabx qq ab", "  ab\n\ncab!!ba 12", "zzz", "a" * 50, "Ünï ab"]
    codes, n = langid.letters_of(probe, m.symbols, m.blank)
    found = langid.phrases(codes, n, m)
    for i, t in enumerate(probe):
        clean = "".join(c if c.isalpha() else " " for c in t.lower()).lstrip()
        line = "".join(c for k, c in enumerate(clean) if c != " " or k == 0 or clean[k - 1] != " ")
        assert n[i] == len(line)
        for j, lang in enumerate(m.languages):
            sample = "".join(c if c.isalpha() else " " for c in texts[lang])
            assert found[i, j] == plain_phrases(line, sample), (t, lang)


def test_many_letters_against_search():
    """Letters without a column of their own are found all the same."""
    rng = random.Random(4)
    texts = {"zh": "".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 400) for _ in range(1500)), "ja": "".join(chr(rng.choice([0x3042, 0x30A2, 0x4E00]) + rng.randrange(60)) for _ in range(1500)), "en": "the cat sat on the mat"}
    m = langid.train(texts, alphabet=20)
    assert len(m.rare)
    probe = [texts["zh"][100:160], texts["ja"][7:90], "the mat 日本", texts["zh"][5:9] + "、" + texts["ja"][3:30], "cat" + texts["zh"][:40]]
    codes, n = langid.letters_of(probe, m.symbols, m.blank)
    found = langid.phrases(codes, n, m)
    for i, t in enumerate(probe):
        clean = "".join(c if c.isalpha() else " " for c in t.lower())
        for j, lang in enumerate(m.languages):
            assert found[i, j] == plain_phrases(clean, texts[lang]), (t, lang)


def test_texts_without_letters_and_rare_scripts(spark):
    rng = random.Random(6)
    han, kana = ([chr(a + i) for i in range(n)] for a, n in ((0x4E00, 900), (0x3041, 80)))
    rows = [(i, "".join(rng.choice(han) for _ in range(200)), "zh") for i in range(60)]
    rows += [(100 + i, "".join(rng.choice(kana + han[:50]) for _ in range(200)), "ja") for i in range(60)]
    rows += [(200 + i, sentence(rng, 40), "en") for i in range(60)] + [(300, "a", "xx"), (301, "!?", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(df)
    assert "yy" not in model.languages
    asked = spark.createDataFrame([("😀😀", "und"), ("、。", "und"), ("12!", "und"), (" ", "und"), ("𝟙٣", "und"), (rows[3][1], "zh"), (rows[70][1], "ja"), ("the said what were", "en")], "text string, want string")
    assert all(r.lang_pred == r.want and 0 <= r.score <= 1 for r in langid.predict(asked, model).collect())


def test_short_samples_win_nothing(spark):
    """A label with a few letters, or all of whose lines another language has, takes no other language's texts."""
    rng = random.Random(7)
    rows = [(i, sentence(rng, 60), "en") for i in range(60)] + [(100 + i, " ".join(rng.choice(FR) for _ in range(60)), "fr") for i in range(60)]
    rows += [(i + 500, "ok", "xx") for i in range(4)] + [(i + 600, rows[0][1], "zz") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(df.where("lang IN ('en', 'fr')"), langid.learned(df)).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97


def test_automaton_holds_all_substrings():
    step = langid.suffix_automaton([0, 1, 0, 0, 1, 2])
    text = [0, 1, 0, 0, 1, 2]
    for a in range(6):
        for b in range(a + 1, 7):
            s = 0
            for c in text[a:b]:
                s = step[s][c]


def test_query(spark, folder):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 60) if i % 2 else " ".join(rng.choice(FR) for _ in range(60)), "en" if i % 2 else "fr", "s") for i in range(120)]
    rows += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "12 !!", "en", None), (203, sentence(rng, 40_000), None, "s"), (None, "the cat", "en", "s"), (1, rows[1][1], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.op2_language_id(spark, folder(documents=df)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    by = got.set_index("doc_id").lang_pred
    assert (by[200], by[201], by[202], by[203]) == ("und", "und", "und", "en")
    want = {r[0]: r[2] for r in rows[:120]}
    assert np.mean([by[i] == want[i] for i in want if i != 1]) == 1.0
    assert got.held_out.sum() > 0
    assert langid.op2_language_id(spark, folder(documents=df.limit(0))).count() == 0


def test_no_labels_gives_und(spark, odd):
    from pyspark.sql import functions as F

    model = langid.learned(odd.withColumn("lang", F.lit(None).cast("string")))
    out = langid.predict(odd, model)
    assert {r.lang_pred for r in out.select("lang_pred").collect()} == {"und"}
    assert out.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score", "bits"]


def test_a_filter_on_the_result_judges_no_text_twice(spark, odd):
    """Spark pushes a filter below a function that it takes for free, which then runs on either side of it."""
    from pointloom.llm import quality

    model = langid.learned(odd.withColumn("lang", F.lit("en")))
    told = langid.predict(odd, model).where("lang_pred <> 'und'")
    good = quality.score(odd, quality.Model(np.zeros(1), np.ones(1), {}, 0.8)).where("predicted = 1").select("doc_id", "score")
    for df in (told, good):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert told.count() == langid.predict(odd, model).toPandas().lang_pred.ne("und").sum() and good.count() == odd.count()
