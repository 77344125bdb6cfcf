import hashlib
import random

import pytest

import corpus_pipeline
from wordloom.llm import mixing, sharding


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    held = {}
    while True:
        rest = sum(sizes.values()) - sum(held.values())
        free = [s for s in order if s not in held]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: 3.0 * sizes[s] for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return held | t
        held |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, tmp_path, seed):
    r = random.Random(seed)
    names = ["a", "é", "Z", None, "b", "", "huge"]
    docs = [(k, " ".join("w" * r.randrange(1, 400)), r.choice(names[:-1])) for k in range(150)]
    docs += [(1000 + k, "x y\x0bz" * 300, "huge") for k in range(60)] + [(5000, None, "none"), (5001, "", "a"), (5, docs[5][1], docs[5][2]), (None, "q", "tiny")]
    spark.createDataFrame([(i, t, s, 3) for i, t, s in docs], "doc_id long, text string, source string, size int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op5_mix_sources(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = waterfill(sizes)
    source = {i: s for i, _, s in docs}
    taken = {}
    for x in rows:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= x.taken <= 3 * x.size
        taken[s] = taken.get(s, 0) + x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6, s
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op5_mix_sources(spark, str(tmp_path)).collect()))


def test_small_sources_meet_their_targets(spark):
    """Sources of far less than a block beside large ones, as documents of the operator and of the pipeline's stage."""
    r = random.Random(4)
    docs = [(k, " ".join("w" * 2000), "big") for k in range(100)] + [(1000 + k, " ".join("w" * 900), "mid") for k in range(20)]
    docs += [(2000 + k, " ".join("w" * r.randrange(5, 90)), f"tail{k % 40}") for k in range(120)]
    rows = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    taken, target = {}, {}
    for x in mixing.mix(mixing.sized(rows)).collect():
        taken[x.source] = taken.get(x.source, 0) + x.taken
        target[x.source] = x.target
    assert len(target) == 42
    for s, t in target.items():
        assert t > 0 and abs(taken[s] - t) <= 0.5 + 1e-6, s
    kept = {x.doc_id for x in corpus_pipeline.mixing_stage(spark, rows, None).collect()}
    assert {i for i, _, s in docs if s.startswith("tail")} <= kept


def test_taken_is_what_slots_take(spark):
    """Blocks cut from the lines word by word, and the slots they are joined to."""
    r = random.Random(9)
    docs = [(k % 70, r.choice([0, 1, 5, 40, 300]), r.choice(["a", "b", "b", "b", None]), k) for k in range(120)]
    frame = spark.createDataFrame(docs, "doc_id long, size long, source string, before long")
    lines = mixing.placed(frame)
    rows = lines.collect()
    owner = {}  # (place, word of the line) -> row, for the words to take
    for x in rows:
        for turn in range(3):
            for w in range(x.size):
                at = turn * x.source_size + x.start + w
                if at < x.words:
                    assert (x.place, at) not in owner
                    owner[x.place, at] = (x.start, turn, w)
    blocks = {}
    for (place, at), (start, _, w) in owner.items():
        blocks.setdefault((place, at // 64), []).append((start, w))
    plan = mixing.schedule(lines.select("source", "place", "target").distinct(), 64).collect()
    assert sorted((x.place, x["rank"]) for x in plan) == sorted(blocks)
    assert sorted(x.slot for x in plan) == list(range(len(blocks)))
    slot = {x.slot: (x.place, x["rank"]) for x in plan}
    got = {}
    for x in mixing.deliver(lines, block=64).collect():
        got.setdefault(slot[x.slot], []).extend((x.start, w) for w in range(x["first"], x["last"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in blocks.items()}
    mixed = mixing.mix(frame, block=64)
    assert mixed.columns == [*frame.columns, "source_size", "target", "taken"]
    want = {}
    for (place, at), (start, *_) in owner.items():
        want[place, start] = want.get((place, start), 0) + 1
    expected = sorted((x.row["before"], want.get((x.place, x.start), 0) if x.size else 0) for x in rows)
    assert sorted((x["before"], x.taken) for x in mixed.collect()) == expected


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 1, 100_000.0), ("b", 2, 300_000.0), (None, 3, 0.0)], "source string, place int, target double")
    rows = sorted(mixing.schedule(t, 1000).collect())
    assert [x.slot for x in rows] == list(range(400))
    seen = {"a": 0, "b": 0}
    for x in rows:
        assert x["rank"] == seen[x.source]
        seen[x.source] += 1
        assert abs(seen["b"] - 0.75 * (x.slot + 1)) < 5


def test_empty_mix(spark):
    assert mixing.mix(mixing.sized(spark.createDataFrame([], "doc_id long, text string, source string"))).count() == 0


def test_table_is_filled_by_turns():
    names = ("b", "a", "c")
    table = sharding.fill(names, 307)
    counts = [table.count(k) for k in range(3)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == 307
    h = lambda kind, s: int.from_bytes(hashlib.sha256(f"{kind}:{s}".encode()).digest()[:8], "big")
    order = {s: [(h("offset", s) % 307 + i * (h("skip", s) % 306 + 1)) % 307 for i in range(307)] for s in names}
    taken = {}
    while len(taken) < 307:
        for s in sorted(names):
            free = [p for p in order[s] if p not in taken]
            if free:
                taken[free[0]] = s
    assert [names[k] for k in table] == [taken[i] for i in range(307)]
    fewer = sharding.fill(names[:2], 307)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer, strict=True))
    assert moved < 160


def test_place(spark):
    docs = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (None, "z", None)], "doc_id long, shard string, slot_ int")
    assert sharding.place(docs).columns == ["doc_id", "slot_", "slot", "shard"]
    table = sharding.fill()
    for x in sharding.place(docs).collect():
        slot = int(hashlib.md5(b"" if x.doc_id is None else str(x.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (x.slot, x.shard) == (slot, sharding.SHARDS[table[slot]])
    assert sharding.place(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.fill(("a",), 100)
