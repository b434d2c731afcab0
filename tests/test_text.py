import pytest
from pyspark.sql import functions as F

from defectlab.functions import stem
from defectlab.functions import text as tx
from defectlab.functions.stem import stem_word
from defectlab.operators import features as ft


def one(spark, made, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(made(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("value", "kind", "result"),
    [(None, "string", ""), (5, "int", "5"), ("  A\t b\n C ", "string", "a b c"), ("A  b\u0085\x1cC", "string", "a b c")],
)
def test_clean_text(spark, value, kind, result):
    assert one(spark, tx.clean_text, value, kind) == result


def test_short_words(spark):
    made = lambda c: tx.collapse_blanks(tx.drop_short_words(c))
    assert one(spark, made, "if the ok_x é le node") == "the ok_x node"
    assert one(spark, made, "a-b abc-de d1 d12") == "- abc- d12"


def test_strip_comments(spark):
    assert one(spark, tx.strip_comments, "a # x\nb /* c\nd */ e") == "a \nb  e"


def test_normalize(spark):
    assert one(spark, tx.normalize_script, "It's  MY\tpackage\x00 'node'\n中") == "its package node"
    assert one(spark, lambda c: tx.normalize_script(c, True), "foo::bar{baz}=>qux!") == "foo bar baz qux"


def test_non_blank(spark):
    df = spark.createDataFrame([("x",), (" \t",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(tx.non_blank(F.col("v"))).collect()] == [True, False, False, False]


def brute_windows(text, stride, width, block=512):
    code = " ".join(text.split())
    if len(code.split()) < block - 2:
        return [code]
    return [code[s : min(s + width, len(code))] for s in range(0, len(code), stride)]


@pytest.mark.parametrize(("stride", "width"), [(510, 510), (510, 508), (100, 250)])
@pytest.mark.parametrize("words", [30, 509, 510, 3000])
def test_windows(spark, words, stride, width):
    text = "  ".join(f"w{i}é\U0001f600"[: 2 + i % 5] for i in range(words))
    made = lambda c: tx.char_windows(c, 512, stride, width)
    assert one(spark, made, text) == brute_windows(text, stride, width)


@pytest.mark.parametrize(("words", "kept"), [(0, 2), (3, 5), (6, 8), (20, 8)])
def test_fit_length(spark, words, kept):
    fitted = one(spark, lambda c: tx.fit_length(c, 8), " ".join(f"t{i}" for i in range(words)))
    assert fitted.tokens == ["<s>", *[f"t{i}" for i in range(min(words, 6))], "</s>"] + ["<pad>"] * (8 - kept)
    assert fitted.mask == [1] * kept + [0] * (8 - kept)


# Published examples of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam",
    "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "formality": "formal", "sensitivity": "sensit", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "defensible": "defens",
    "irritant": "irrit", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "roll": "roll",
    "is": "is", "yes": "ye", "yttrium": "yttrium", "generalizations": "gener", "oscillators": "oscil",
}


def test_stems():
    assert {w: stem_word(w) for w in STEMS} == STEMS


def test_stemmed_text_and_vocabulary(spark):
    df = spark.createDataFrame([("caresses ponies caress  cats",), (None,)], "v string")
    assert [r.stemmed for r in ft.stemmed(df, "v").collect()] == ["caress poni caress cat", None]
    stems = ft.stem_vocabulary(ft.token_counts(df, "v"))
    assert {r.stem: (r.n, r.tokens) for r in ft.conflate(stems).collect()} == {"caress": (2, 2), "poni": (1, 1), "cat": (1, 1)}


def test_remembered_stems_stay_few():
    known = stem._Known()
    for i in range(400_000):
        assert known["caresses"] == "caress" and known[f"w{i}"] == f"w{i}"
    assert known["x" * 1000] == "x" * 1000
    held = [*known, *getattr(known, "old", ())]
    assert len(held) <= 300_001 and max(map(len, held)) <= 40 and "caresses" in held


def test_stemmed_batches_of_any_size(spark):
    rows = [(i, None if i % 5 == 0 else f"ponies caresses w{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, v string").coalesce(1)
    found = {r.id: r.stemmed for r in ft.stemmed(df, "v").collect()}
    assert found == {i: v and f"poni caress w{i}" for i, v in rows}
    assert ft.stemmed(df.where("id < 0"), "v").collect() == []
