"""Operators 7 and 10 and the pipeline."""

import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from lakeprobe.llm import mixing as M
from lakeprobe.llm import sharding as S
from lakeprobe.llm.decontaminate import Index, words
from lakeprobe.llm.toxicity import score_text, train
from tests.conftest import SF
from tests.llm.test_pairs import _jaccard, _leaks


def _check_shards(rows, n, tolerance, largest):
    slots, size = defaultdict(list), defaultdict(int)
    for shard, slot, b in rows:
        slots[shard].append(slot)
        size[shard] += b
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    each = sum(size.values()) / n
    assert all(abs(v - each) <= 2 * (tolerance * each + largest) for v in size.values())
    assert set(slots) <= set(range(n))


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = S.op7_sharding(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        b = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
    _check_shards([(r.shard, r.slot, r["size"]) for r in rows], 8, S.TOLERANCE, max(r["size"] for r in rows))
    order = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        order[text[r.doc_id]].append((r.shard, r.slot))
    for places in order.values():  # equal texts are neighbours
        assert all(b[0] > a[0] or b[1] - a[1] <= 2 for a, b in zip(places, places[1:]))


def test_a_hot_text_is_cut_and_small_cells_are_refined(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(
        F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    key = S.copy_key(F.col("text"), F.col("doc_id"))
    out = S.shard(df, key, S.text_size(F.col("text")), 8, 0.01, cell_rows=40)
    rows = [(r["shard"], r["slot"], r["b"]) for r in out.withColumn("b", S.text_size(F.col("text"))).collect()]
    assert len(rows) == 3000
    _check_shards(rows, 8, 0.01, 50)


def test_shard_order_and_edges(spark):
    df = spark.createDataFrame([(5, None, 1), (5, None, 2), (None, "a", 3), (1, "b", 4)], "doc_id long, text string, key_ int")
    out = S.shard(df, F.coalesce("doc_id", F.lit(0)), S.text_size(F.col("text")), 2)
    rows = sorted((r["shard"], r["slot"], r["key_"]) for r in out.collect())
    assert [k for _, _, k in rows][:2] == [3, 4] and {k for _, _, k in rows[2:]} == {1, 2}
    assert S.shard(df.limit(0), F.col("doc_id"), F.lit(1)).count() == 0
    assert S.op7_sharding(df).count() == 4
    with pytest.raises(ValueError):
        S.shard(df.withColumn("Slot", F.lit(1)), F.col("doc_id"), F.lit(1))


def _schedule(weights, blocks):
    """The slots of all blocks, and the first slot that some source cannot fill, held
    against the fluid shares on both sides up to it."""
    units = M.exact_units(weights)
    q, slots, got, end = sum(units.values()), {}, dict.fromkeys(units, 0), None
    for t, s, j in M.pfair(units, blocks):
        if j == blocks[s]:
            end = t if end is None else end
            continue
        slots[s, j] = t
        got[s] += 1
        if end is None:
            assert all(abs(got[x] - M.Fraction(n * (t + 1), q)) < 1 for x, n in units.items())
    return slots, end


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.5, "b": 0.5}, {"a": 0.9, "b": 0.07, "c": 0.03},
                                     {i: 1 + i ** 2 for i in range(90)}, {i: 1e-9 + (i == 0) for i in range(80)}])
def test_pfair_deviates_less_than_a_block(weights):
    slots, end = _schedule(weights, dict.fromkeys(weights, 700))
    assert len(slots) == 700 * len(weights) and len(set(slots.values())) == len(slots) and end >= 700


def _check_mix(rows, weights, block):
    """Every row lies in the slot of the block that its first byte falls into; a schedule
    of exact weights says which slot that is."""
    total = defaultdict(int)
    for r in rows:
        total[r["source"]] += r["size"]
    name = lambda s: "n" if s is None else f"s{s}"
    weights = {s: weights.get(s, 0) for s in total} if weights else {s: b ** M.ALPHA for s, b in total.items()}
    weights = {s: w for s, w in weights.items() if w > 0}
    blocks = {name(s): max(1, -(-total[s] // block)) for s in weights}
    slots, end = _schedule({name(s): w for s, w in weights.items()}, blocks)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for s, own in by.items():
        own.sort(key=lambda r: r["mix_offset"])
        at = 0
        for r in own:
            assert r["mix_offset"] == at
            at += r["size"]
            if s in weights:
                assert r["mix_slot"] == slots[name(s), r["mix_offset"] // block]
                assert r["in_mix"] == (r["mix_slot"] < end)
            else:
                assert r["mix_slot"] is None and not r["in_mix"]


def test_other_partitions_give_the_same_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    mixes = [M.mix(d, block_bytes=4096).drop("m") for d in (docs, docs.repartition(5), docs.orderBy(F.desc("n_chars")).coalesce(2))]
    first, *others = [sorted((r.doc_id, r.mix_slot, r.mix_offset, r.in_mix) for r in m.collect()) for m in mixes]
    assert all(first == o for o in others) and len(first) == docs.count()


def test_thousands_of_equal_rows_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 20)
    df = spark.createDataFrame([("a", "same", 10)] * 900 + [("a", f"t{i}", 10) for i in range(300)], "source string, t string, size long").repartition(3)
    rows = [r.asDict() for r in M.mix(df, size=F.col("size"), weights={"a": 1}, block_bytes=30).collect()]
    _check_mix(rows, {"a": 1}, 30)
    plan = M.mix(df, size=F.col("size"), block_bytes=30)._jdf.queryExecution().toString()
    assert "sub_" in plan


def test_blocks_grow_with_the_bytes():
    assert M.block_size(0) == M.block_size(2_000_000 << 16) == 1 << 16
    assert M.block_size((2_000_000 << 16) + 1) == 1 << 17
    assert M.block_size(100 << 40) == 1 << 26 and (100 << 40) / (1 << 26) <= M.MAX_BLOCKS


def test_mix_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    d = docs.select("doc_id", "source", S.text_size(F.col("text")).alias("size"))
    rows = M.mix(d, size=F.col("size"), block_bytes=4096).collect()
    assert len(rows) == docs.count()
    _check_mix([r.asDict() for r in rows], None, 4096)
    ordered = M.in_order(M.mix(d, size=F.col("size"), block_bytes=4096)).collect()
    places = [(r.mix_slot, r.mix_offset) for r in ordered]
    assert places == sorted(places)


def test_mix_hot_source_and_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    df = spark.range(2000).select((F.col("id") % 7).alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").when(
        F.col("id") % 2 == 0, "b").alias("source"), F.lit("some text").alias("text"), F.lit(1).alias("key_"))
    out = M.mix(df, weights={"hot": 0.5, None: 0.5}, block_bytes=100)
    rows = [r.asDict() | {"size": 10} for r in out.collect()]
    assert len(rows) == 2000 and out.columns[:4] == df.columns
    _check_mix(rows, {"hot": 0.5, None: 0.5}, 100)
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df.withColumn("source", F.lit(None).cast("string"))).filter("in_mix").count() == 2000
    with pytest.raises(ValueError):
        M.mix(df.withColumn("in_mix", F.lit(1)))


def test_exact_weights_hold_over_many_cycles():
    weights = {"big": 0.9999 - 1 / 7, "odd": 1 / 7, "rare": 1e-4}
    total, units = sum(map(M.Fraction, weights.values())), M.exact_units(weights)
    share = {s: M.Fraction(w) / total for s, w in weights.items()}
    assert {s: M.Fraction(n, sum(units.values())) for s, n in units.items()} == share
    got, n = defaultdict(int), 200_000
    for t, s, j in M.pfair(units, dict.fromkeys(units, 10 ** 9)):
        if t == n:
            break
        assert j == got[s]
        got[s] += 1
        assert abs(got[s] - share[s] * (t + 1)) < 1
        if t % 97 == 0:
            assert all(abs(got[x] - share[x] * (t + 1)) < 1 for x in units)
    assert got["rare"] in (19, 20, 21)


def test_a_rare_source_does_not_end_the_mix_early(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 700)
    df = spark.range(6000).select(F.when(F.col("id") == 0, "rare").otherwise("big").alias("source"))
    for limit in (M.BROADCAST, 10):
        monkeypatch.setattr(M, "BROADCAST", limit)
        rows = M.mix(df, size=F.lit(10), weights={"big": 0.9999, "rare": 1e-4}, block_bytes=10).collect()
        slots = sorted(r.mix_slot for r in rows)
        assert len(rows) == 6000 and len(set(slots)) == 6000 and slots[-1] < 6002
        assert sum(r.in_mix for r in rows) >= 5999  # with whole slots of 1,024 some 1,024


def test_mix_without_bytes(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 0), ("b", 0), ("c", 5), (None, 10)], "source string, size long")
    rows = M.mix(df, size=F.col("size"), weights={"a": 1, "b": 2, None: 3}, block_bytes=10).collect()
    assert all((r.mix_slot is None) == (r.source == "c") for r in rows) and len(rows) == 6
    end = min(r.mix_slot for r in rows if r.source == "b")
    assert all(r.in_mix == (r.mix_slot is not None and r.mix_slot < end) for r in rows)


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 250")
    rows = {r.doc_id: r for r in docs.collect()}
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = [i for i in sorted(rows) if score_text(rows[i].text, model)[0] < 0.5]
    _, root = _jaccard([rows[i].text for i in clean])
    alone = [i for k, i in enumerate(clean) if root[k] == k]
    index = Index([words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    left = [i for i in alone if not index.search([rows[i].text])[0]]
    assert all(not _leaks(rows[i].text, index) for i in left[:40])

    d, steps = docs, []
    for _, stage in C.STAGES:
        d = C.stored(stage(spark, d, SF))
        steps.append(sorted(r.doc_id for r in d.select("doc_id").collect()))
        if stage is not C.STAGES[-1][1]:
            assert d.columns == docs.columns
    assert steps == [clean, alone, left, left, left]
    got = d.withColumn("b", S.text_size(F.col("text"))).collect()
    _check_shards([(r.shard, r.slot, r.b) for r in got], 8, S.TOLERANCE, max(r.b for r in got))
    assert all(r.text == rows[r.doc_id].text for r in got)


def test_scratch_tables_are_removed(spark, tmp_path):
    from lakeprobe.llm.common import cleanup, stored
    from lakeprobe.session import ensure_checkpoint_dir
    cleanup(spark)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("llm-")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    d = docs
    for _, stage in C.STAGES:
        d = stored(stage(spark, d, SF))
    d.write.parquet(str(tmp_path / "out"))
    made = {f for f in os.listdir(folder) if f.startswith("llm-")} - before
    assert len(made) > 5 and cleanup(spark) == len(made)
    assert {f for f in os.listdir(folder) if f.startswith("llm-")} == before and cleanup(spark) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_pipeline_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", None, 3), (2, "a b", "en", "t", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for df, n in ((docs, 3), (docs.limit(0), 0)):
        d = df
        for _, stage in C.STAGES:
            d = C.stored(stage(spark, d, SF))
        assert d.count() == n
