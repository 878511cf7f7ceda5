import random

from embedmesh.llm import simhash


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(7))


def exact(a, b, width=5):
    x, y = (set(simhash.shingle_hashes(t, width, 0).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}


def test_pairs_inside_a_family_are_found(spark):
    """Thousands share a long passage (0.65), which links none of them; pairs among them are alike to 0.85 to 0.9."""
    rng = random.Random(4)
    passage = [word(rng) for _ in range(200)]
    rows = [(i, " ".join(passage + [word(rng) for _ in range(54)])) for i in range(3000)]
    pairs = []
    for k in range(60):
        words = rows[50 * k][1].split(" ")
        words[-16:] = [word(rng) for _ in range(16)]
        pairs.append((50 * k, 5000 + k))
        rows.append((5000 + k, " ".join(words)))
    texts = dict(rows)
    assert all(0.85 <= exact(texts[a], texts[b]) <= 0.9 for a, b in pairs)
    assert 0.63 < exact(texts[1], texts[2]) < 0.67
    got = components(spark, rows)
    assert all(got[a] == got[b] for a, b in pairs)
    assert len(set(got.values())) > 2800
    assert len(set(got.values())) == 3000


def test_links_are_exact(spark):
    """Pairs at 0.8 or a little more link as often as they meet in a table; pairs below never do."""
    rng = random.Random(5)
    rows, near, far = [], [], []
    for k in range(240):
        words = [word(rng) for _ in range(204)]
        other = words[:]
        # 200 shingles, the last n of which differ: (200 - n) / (200 + n)
        n = 22 if k % 2 else 25
        other[-n:] = [word(rng) for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        j = exact(rows[-2][1], rows[-1][1])
        (near if j >= 0.8 else far).append(2 * k)
        assert (0.8 <= j < 0.81) if k % 2 else (0.77 < j < 0.78)
    got = components(spark, rows)
    found = sum(got[i + 1] == i for i in near)
    assert found >= 0.93 * len(near)
    assert all(got[i + 1] == i + 1 for i in far)


def test_repeated_lines_count_once(spark):
    rng = random.Random(6)
    line = " ".join(word(rng) for _ in range(9)) + " "
    one, other = (" ".join(word(rng) for _ in range(150)) for _ in range(2))
    same = " ".join(word(rng) for _ in range(60)) + " "
    rows = [(1, one + " " + line * 400), (2, other + " " + line * 400), (3, same * 2 + line * 3), (4, same * 40 + line * 900), (5, None), (6, "")]
    assert exact(rows[0][1], rows[1][1]) < 0.1 and exact(rows[2][1], rows[3][1]) > 0.8
    assert components(spark, rows) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 5}


def test_dense_buckets_lose_nothing(spark):
    """All copies of a hub are a little under 0.8 from each other, but each has a partner at over 0.85."""
    rng = random.Random(7)
    passage = [word(rng) for _ in range(180)]
    rows = []
    for k in range(150):
        own = [word(rng) for _ in range(24)]
        rows += [(2 * k, " ".join(passage + own)), (2 * k + 1, " ".join(passage + own[:14] + [word(rng) for _ in range(10)]))]
    texts = dict(rows)
    assert 0.75 < exact(texts[0], texts[2]) < 0.8 < 0.85 < exact(texts[0], texts[1])
    got = components(spark, rows)
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(150))
