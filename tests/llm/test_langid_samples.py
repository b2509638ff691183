from presswork.llm import langid as li

from .cases import frame


def test_a_language_whose_first_texts_are_blank_has_a_model(spark):
    texts = ["", " ", "\n"] + ["ka to mi"] * 9 + ["sch ung"] * 8 + [""] * 3 + ["eit"]
    langs = ["aa"] * 12 + ["bb"] * 8 + ["cc"] * 4  # of cc, the one text that isn't blank is held out
    assert set(li.samples(frame(spark, texts, langs))) == {"aa", "bb"}
