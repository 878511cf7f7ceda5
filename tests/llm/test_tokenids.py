import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from embedmesh.llm import tokenids
from embedmesh.llm.bytebpe import PATTERN, encoder, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = [
    "it's we'll  they're 'tis ''s 's't o'dd'd x'   'll", " a  b\n\n c\t\td ", "\n", "   ", "a ", " a", "a\r\n  \n b", "é½²x 12a _b-c", "$$ &&&  --", "中文 кот 日本", "x y 　z", "\x1c a",
    "end<|endoftext|>end", "\U0001f600 ok", "", "don't'tx", "'", "a'", "'re", "1's",
]


def noise(rng, n):
    return "".join(rng.choice("ab'sterevmld \n\t12é½_-$中 ") for _ in range(n))


def test_pieces_follow_the_pattern():
    rng = random.Random(4)
    for text in [*HARD, *(noise(rng, rng.randrange(1, 60)) for _ in range(3000))]:
        if text and (cut := pieces(text)) is not None:
            assert cut == PATTERN.findall(text), text


def test_ids_are_the_librarys():
    own, library, rng = encoder(PATH), Tokenizer.from_file(PATH), random.Random(5)
    texts = [*HARD, *(noise(rng, rng.randrange(1, 400)) for _ in range(400)), None, ""]
    for text, ids in zip(texts, own.ids(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i * 3, noise(rng, rng.randrange(0, 300)), 1) for i in range(300)]
    rows += [(2, None, 1), (4, "", 1), (5, "long word " * 20000, 1), (7, "same", 1), (7, "same", 1), (7, "other", 1), *((2000 + i, t, 1) for i, t in enumerate(HARD))]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(5)
    folder = f"file://{tmp_path}/out"
    files = tokenids.write(df, folder, PATH, files=4)
    got = tokenids.read(spark, folder, files, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((d, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for d, t, _ in rows)
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(d for d, _, _ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    reader = tokenids.Reader(files[1]["path"], folder)
    k = len(reader.doc_ids) // 2
    assert tuple(reader.document(k)) in {x for d, x in want if d == reader.doc_ids[k]}
    (tmp_path / "out" / "dictionary").write_bytes(b"another")
    with pytest.raises(ValueError, match="another dictionary"):
        tokenids.Reader(files[0]["path"], folder)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    files = tokenids.write(df, f"file://{tmp_path}/none", PATH)
    missing = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    folder = f"file://{tmp_path}/null"
    got = tokenids.read(spark, folder, tokenids.write(missing, folder, PATH, files=2)).collect()
    assert sorted((r.start, r.doc_id, r.n_tokens) for r in got) == [(0, None, 3), (3, 1, 1)]
    assert files == [] and tokenids.read(spark, f"file://{tmp_path}/none", files).collect() == []
