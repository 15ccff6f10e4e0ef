"""The word rule of the quality rules: texts without common words and texts of another language."""

import random

from quarry.llm import quality_rules

COMMON = {"en": "the of and to in a is that for it".split(), "de": "der die und den von zu das mit sich des".split()}


def words(rng, n, lang, share):
    """n words of which a share is common in lang; the others are invented."""
    return [rng.choice(COMMON[lang]) if rng.random() < share else "".join(rng.choices("bdfgklmnprst", k=rng.randint(4, 8))) for _ in range(n)]


def test_no_common_words_and_another_language(spark):
    rng = random.Random(5)
    rows = [(i, lang, " ".join(words(rng, 150, lang, 0.2))) for i in range(200) for lang in COMMON]
    rows += [(1000 + i, "en", " ".join(words(rng, 150, "en", 0))) for i in range(5)]
    rows += [(2000 + i, "en", " ".join(words(rng, 150, "de", 0.2))) for i in range(5)]
    # a language that the words don't cover: nobody is expected to use them
    rows += [(3000 + i, "xx", " ".join(words(rng, 150, "en", 0.01 if i else 0))) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality(d).where("doc_id >= 1000").collect()}
    assert not any(kept[i] for i in kept if i < 3000)
    assert all(kept[i] for i in kept if i >= 3000)
    got = quality_rules.quality(d).where("doc_id < 1000").selectExpr("count_if(kept)", "count(*)").first()
    assert got[0] >= 0.99 * got[1]
    good = {r.doc_id for r in quality_rules.keep_good(d).select("doc_id").collect()}
    assert not any(1000 <= i < 3000 for i in good)
