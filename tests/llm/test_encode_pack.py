import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cueweave.llm.encode import TrieEncoder, encode, read_vocabulary, token_counts, vocabulary_path, word_pattern
from cueweave.llm.packing import BoundedBestFit, _merge_group, fill_report, pack

public = pytest.importorskip("public_tokenizers")


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def samples():
    rnd = random.Random(1)
    alphabet = "aAeé \n\t\x85 　'sт中ｶ゛👩1½٣<|endoftext|>the and"
    made = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    return [*made, "<|endoftext|>", "a" * 3000, " " * 300, "the " * 500, "", None, "タイミングは327ミリ秒ほど早めたほうが読みやすい。"]


def test_ids_match_the_public_library(spark):
    texts = samples()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode(df, "doc_id", "text").collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)
    counts = {r.doc_id: r.tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert all(counts[i] == len(ids) for i, ids in got.items())
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_another_vocabulary_and_a_small_store(monkeypatch):
    import base64

    import tiktoken

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr("cueweave.llm.encode.KEPT_WORDS", 50)
    encoder = TrieEncoder(read_vocabulary(path, word_pattern()))
    texts = [t for t in samples() if t]
    for at in range(0, len(texts), 97):
        part = texts[at : at + 97]
        flat, offsets = encoder.encode_batch(part)
        for i, text in enumerate(part):
            assert flat[offsets[i] : offsets[i + 1]].tolist() == plain.encode_ordinary(text)


def test_best_fit_is_bounded():
    packer = BoundedBestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4, 9, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    assert len(packer.open_windows()) <= 2


def checked(spark, sizes, capacities, **settings):
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n int").withColumns({"shard": F.lit("x"), "item": F.lit(1)})
    rows = pack(df, "id", "n", capacities, **settings).collect()
    for b, capacity in enumerate(capacities):
        boxes, items = defaultdict(list), defaultdict(list)
        for r in rows:
            if r.budget == b:
                assert r.capacity == capacity
                boxes[r.container_id].append((r.start_in_container, r.size))
                items[r.id].append((r.piece, r.start_in_item, r.size))
        for spans in boxes.values():
            at = 0
            for start, size in sorted(spans):
                assert start == at
                at += size
            assert at <= capacity
        for i, n in enumerate(sizes):
            pieces, want = sorted(items[i]), max(0, n or 0)
            assert sum(size for *_, size in pieces) == want and [p for p, *_ in pieces] == list(range(len(pieces)))
            assert len(pieces) == 1 or want > capacity
            assert all(size == capacity for *_, size in pieces[:-1])
    return rows


def test_pack_places_everything_once(spark):
    rnd = random.Random(3)
    sizes = [rnd.choice([0, 1, 3, 17, 40, 99, 256, 300, 1000, None, -2]) for _ in range(900)]
    rows = checked(spark, sizes, [64, 256], spaces=8, rows_per_shard=40)
    fills = {r.capacity: r.fill for r in fill_report(spark.createDataFrame(rows)).collect()}
    assert min(fills.values()) > 0.9
    again = checked(spark, sizes, [64, 256], spaces=8, rows_per_shard=40)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    checked(spark, [], [5])
    checked(spark, [120_000, 3], [1, 2])
    checked(spark, [5, 5, 7], [5])
    with pytest.raises(ValueError):
        checked(spark, [1], [0])


def test_merge_tree_is_bounded(spark):
    """300 shards: a group that saw more than FAN_IN times the open windows of a shard would raise."""
    rnd = random.Random(5)
    sizes = [rnd.randrange(60, 100) for _ in range(2_100)]
    rows = checked(spark, sizes, [100, 128], spaces=4, rows_per_shard=7)
    assert len({r.container_id.split("-")[0] for r in rows}) > 200
    with pytest.raises(ValueError, match="windows in one group"):
        frame = pd.DataFrame({"budget": 0, "shard": range(65), "window": 0, "fill": 1, "part": 0})
        _merge_group([100], 4)(frame)
    left = _merge_group([100], 4)(frame[:64].assign(fill=60))
    assert left["open"].sum() == 4 and len(left) == 64
    small = checked(spark, [10] * 400, [1_000], spaces=4, rows_per_shard=7)
    assert fill_report(spark.createDataFrame(small)).first().containers <= 8
