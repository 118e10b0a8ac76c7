import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quarry.llm import mixing, packing
from tests.llm.test_ops import SCHEMA, VOCAB, awkward, copies, empty, frame, prose  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    rows = copies(r, 10, 4)
    n = len(rows)
    rows += [(n + i, " ".join(w + "###" for w in prose(r, 40).split()), "en", "src1") for i in range(5)]
    rows += [(n + 5 + i, prose(r, 30) + " moron scum trash", "en", "src1") for i in range(5)]
    rows += [(n + 10 + i, prose(r, 60), "en", f"src{1 + i % 3}") for i in range(30)]
    return frame(spark, rows)


def test_stages_take_effect(spark, docs, tmp_path):
    seen = {"start": docs}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {k: Counter(x["doc_id"] for x in v.select("doc_id").collect()) for k, v in seen.items()}
    text = {k: {x["doc_id"]: x["text"] for x in v.collect()} for k, v in seen.items() if "text" in v.columns}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(seen[n].columns == docs.columns for n in names[:-1])
    bad = {i for i, t in text["start"].items() if "###" in t or "moron" in t}
    assert ids["quality_rules"] == ids["start"] - Counter({i: 1 for i in bad})
    # One of each family of copies stays, the smallest id; documents with a shared passage only all stay.
    family = [set(range(4 * k, 4 * k + 4)) for k in range(10)]
    kept = set(ids["near_duplicates"])
    assert all(min(f) in kept for f in family) and sum(len(f & kept) - 1 for f in family) <= 2
    assert set(range(40, 80)) <= kept
    # The shared passage of 60 words stays once.
    passage = " ".join(text["start"][40].split()[80:140])
    assert sum(passage in t for t in text["repeated_passages"].values()) == 1
    assert all(len(t.split()) >= 150 for i, t in text["repeated_passages"].items() if 40 <= i < 80)
    assert set(ids["source_mix"]) <= set(ids["repeated_passages"])
    want = Counter(x["doc_id"] for x in mixing.positions(seen["repeated_passages"]).collect())
    assert ids["source_mix"] == want and max(want.values()) > 1
    placed = defaultdict(int)
    for x in seen["best_fit_packing"].collect():
        placed[x["doc_id"]] += x["size"]
    assert placed == {i: n * len(text["source_mix"][i].split()) for i, n in ids["source_mix"].items()}
    rows = seen["best_fit_packing"].collect()
    for shard in {x["shard"] for x in rows}:
        assert packing.check_bins([(x["bin"], x["offset"], x["size"]) for x in rows if x["shard"] == shard], 2048)


def test_sequences_follow_the_curriculum(spark, tmp_path):
    r = random.Random(30)
    # A large source that loses share and a small one that gains it, and is repeated.
    rows = [(i, prose(r, r.randint(100, 400)), "en", "big" if i % 20 else "small") for i in range(2400)]
    of = {i: s for i, _, _, s in rows}
    stages = dict(corpus_pipeline.STAGES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        stages["source_mix"](spark, frame(spark, rows), "").write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "mix"))
        mixed = spark.read.parquet(str(tmp_path / "mix"))
        outs = [packing.pack_in_order(mixed, shard_tokens=t).collect() for t in (60_000, 10**9)] + [packing.pack_in_order(mixed.orderBy("doc_id"), shard_tokens=60_000).collect()]
        default = stages["best_fit_packing"](spark, mixed, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = Counter()
    for x in mixed.collect():
        want[x["doc_id"]] += len(x["text"].split())
    for out in (*outs, default):
        got = Counter()
        for x in out:
            got[x["doc_id"]] += x["size"]
        assert got == want
        for shard in {x["shard"] for x in out}:
            assert packing.check_bins([(x["bin"], x["offset"], x["size"]) for x in out if x["shard"] == shard], 2048)
    for out in (outs[0], outs[1], default):
        out = sorted(out, key=lambda x: (x["shard"], x["bin"], x["offset"]))
        share = []
        for q in range(4):
            part = out[q * len(out) // 4 : (q + 1) * len(out) // 4]
            share.append(sum(x["size"] for x in part if of[x["doc_id"]] == "small") / sum(x["size"] for x in part))
        assert share[0] < share[1] < share[2] < share[3] and share[3] > 1.8 * share[0], share
    # Shards are ranges of the schedule, in its order.
    at = defaultdict(list)
    for x in mixing.positions(frame(spark, rows)).collect():
        at[x["doc_id"]].append(x["position"])
    once = {i: v[0] for i, v in at.items() if len(v) == 1}
    shards = defaultdict(list)
    for x in outs[0]:
        if x["doc_id"] in once:
            shards[x["shard"]].append(once[x["doc_id"]])
    keys = sorted(shards)
    assert len(keys) > 3 and all(max(shards[a]) <= min(shards[b]) for a, b in zip(keys, keys[1:]))
    # The order of a table that isn't a plain file scan counts as well.
    by_id = defaultdict(list)
    for x in outs[2]:
        by_id[x["shard"]].append(x["doc_id"])
    keys = sorted(by_id)
    assert len(keys) > 3 and all(max(by_id[a]) <= min(by_id[b]) for a, b in zip(keys, keys[1:]))


def test_awkward_tables_run_through(spark, awkward, empty, tmp_path):  # noqa: F811
    seen = {}
    for label, start in (("a", awkward), ("e", empty)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, "").write.parquet(str(tmp_path / label / name))
            now = spark.read.parquet(str(tmp_path / label / name))
            seen[label, name] = now
    ids = lambda name: sorted((x["doc_id"] for x in seen["a", name].select("doc_id").collect()), key=str)
    # Null, blank and shouting texts go; of the copies of document 1 one stays, and rows without an id.
    assert ids("quality_rules") == [1, 1, 10, 12, 2, 6, 7, 8, 9, None]
    assert ids("near_duplicates") == ids("repeated_passages") == [1, 10, 12, 6, 7, 8, None]
    assert set(ids("source_mix")) <= {1, 6, 7, 8, 10, 12} and {6, 7, 10, 12} <= set(ids("source_mix"))
    assert all(seen["a", name].columns == awkward.columns for name, _ in corpus_pipeline.STAGES[:-1])
    words = {x["doc_id"]: len((x["text"] or "").split()) for x in awkward.collect()}
    placed = Counter()
    for x in seen["a", "best_fit_packing"].collect():
        placed[x["doc_id"]] += x["size"]
    assert placed == {i: n * words[i] for i, n in Counter(ids("source_mix")).items()}
    assert all(seen["e", name].count() == 0 for name, _ in corpus_pipeline.STAGES)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "size", "shard", "bin", "offset"] and out.count() > 50
