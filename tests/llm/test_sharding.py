import zlib

from embedmesh.llm.sharding import shard_by_bytes


def brute(rows, shards):
    """Sorted by id (null first), crc32 and size; a row goes where its middle byte falls."""
    thin = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    total, at, out, slots = sum(x[3] for x in thin), 0, [], {}
    for known, i, crc, size in thin:
        shard = min(shards - 1, (2 * at + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((i if known else None, size, crc, "bytes", shard, slots[shard], None, at))
        at += size
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = [(i, "é" * (i * 37 % 211)) for i in range(-5, 150)] + [(7, "again"), (7, "again"), (7, None), (None, "no id"), (None, None), (1 << 62, ""), (300, "long " * 3000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, shard string").repartition(3)
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "start"]
    for shards, ranges in ((24, None), (3, 1), (5, 50)):
        got = shard_by_bytes(df, shards, ranges=ranges)
        assert got.columns == names and sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, shards)


def test_sizes_are_near_equal_and_slots_gapless(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('w', CAST(pmod(hash(id), 300) AS INT)) AS text")
    got = shard_by_bytes(df).collect()
    sizes, slots = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 308
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_one_hot_text_and_an_empty_table(spark):
    hot = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a copy' ELSE concat('text ', id) END AS text")
    assert shard_by_bytes(hot).count() == 900
    assert shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
