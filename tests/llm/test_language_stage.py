import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

from embedmesh.llm import langid  # noqa: E402

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu", "len"], "bb": ["sch", "ung", "keit", "ein", "pf"], "cc": ["é", "eau", "tion", "oi", "ç"], "dd": ["wha", "the", "ly", "ough", "st"]}
FOREIGN = [
    "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Все смешалось в доме.",
    "學而時習之不亦說乎有朋自遠方來不亦樂乎人不知而不慍不亦君子乎其為人也孝弟而好犯上者鮮矣不好犯上而好作亂者未之有也",
    "Τη γλώσσα μου έδωσαν ελληνική το σπίτι φτωχικό στις αμμουδιές του Ομήρου μονάχη έγνοια η γλώσσα μου",
    "xqzv bnwj gkfd pxvq zzjw hqkd vbxn fgjq wpzx qqvk jdhx bzfw nvkq xjgp dwqz hvbk",
    "fjdkgs qwxzpv mbhnyr dgjfkl vxcnbz wqjrty phgkdf zmxvbn qjwxyd kfghjd bvnxcz rtwqyp",
]


def made(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(2, 6))) for _ in range(n))


def test_foreign_texts_and_gibberish_go(spark):
    rng = random.Random(3)
    langs = sorted(SYLLABLES)
    rows = [(i, made(langs[i % 4], rng.randrange(20, 150), rng), langs[i % 4]) for i in range(400)]
    rows += [(1000 + i, " ".join([t] * 4), None) for i, t in enumerate(FOREIGN)]
    rows += [(2000 + i, " ".join(made(x, 120, rng) for x in langs), None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert not [i for i in got if i >= 1000]
    held = {r.doc_id for r in docs.where("doc_id < 1000").where(langid.held_out()).collect()}
    assert len(held) > 50 and len(held - got) <= 1 and len(got) >= 396
