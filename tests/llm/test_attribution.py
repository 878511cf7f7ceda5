import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from embedmesh.llm import attribution

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def slow(text, rule):
    """Character by character, from the other library's tokens."""
    if not text:
        return [(0, 0, 0, 0)]
    chars = {b: c for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    spelled = [LIBRARY.id_to_token(i) for i in LIBRARY.encode(text, add_special_tokens=False).ids]
    section = []
    n = 0
    for ch in text:
        section += [n] * len(ch.encode())
        n += ch == "\n"
    counts, at = [0] * (n + 1), 0
    for token in spelled:
        own = section[at : at + len(token)]
        at += len(token)
        counts[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
    starts = [0, *(i + 1 for i, ch in enumerate(text) if ch == "\n")]
    return [(i, a, b, c) for i, (a, b, c) in enumerate(zip(starts, [*starts[1:], len(text)], counts))]


def noise(rng, n):
    return "".join(rng.choice(["the", "ing", " ", "\n", "\n\n", "\n \n", "é", "中", "😀", "tion", "1", "  "]) for _ in range(n))


@pytest.mark.parametrize("rule", attribution.RULES)
def test_against_brute_force(rule):
    own, rng = attribution.encoder(PATH, PATTERN), random.Random(1)
    for text in ["", None, "\n", "\n\n\n", "a\n", "\na", "é\n\n\n\né", *(noise(rng, rng.randrange(1, 80)) for _ in range(300))]:
        assert attribution.count_text(text, own, rule) == slow(text, rule), text


def test_most_takes_the_larger_part():
    assert attribution.allocate(np.array([2, 7, 8]), np.array([0, 4, 6]), "most").tolist() == [0, 0, 2]
    with pytest.raises(ValueError, match="rule"):
        attribution.allocate(np.array([1]), np.array([0]), "half")


def test_frames(spark):
    rows = [(1, "a b\nc", 1), (2, None, 1), (None, "x\n", 1), (3, "w " * 60000, 1), (4, "s\ns", 1), (4, "s\ns", 1)]
    got = attribution.count_sections(spark.createDataFrame(rows, "doc_id long, text string, section int"), PATH, PATTERN).collect()
    assert [(r.section, r.start, r.end, r.n_tokens) for r in got if r.doc_id == 1] == [(0, 0, 4, 3), (1, 4, 5, 1)]
    assert [(r.section, r.n_tokens) for r in got if r.doc_id == 2] == [(0, 0)]
    assert [(r.section, r.n_tokens) for r in got if r.doc_id is None] == [(0, 2), (1, 0)]
    assert sum(r.n_tokens for r in got if r.doc_id == 3) == len(LIBRARY.encode("w " * 60000, add_special_tokens=False).ids)
    assert len([r for r in got if r.doc_id == 4]) == 4
    assert attribution.count_sections(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []
