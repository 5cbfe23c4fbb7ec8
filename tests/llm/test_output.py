"""Mixing, token shards and the pipeline: exact round trips and brute force."""

import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import decontaminate, mixing, quality, token_store
from brindle.llm.queries import tokenizer_file

DATA = "/root/testdata/sf0.001"


def fluid(weights, blocks, until):
    """How far each source is after each slot if all that are left are served at once by their weights."""
    done, w = [Fraction(0)] * len(blocks), [Fraction(x) for x in weights]
    yield list(done)
    for _ in range(until):
        slot = Fraction(1)
        while slot:
            live = [s for s in range(len(blocks)) if done[s] < blocks[s]]
            total = sum(w[s] for s in live)
            step = min(slot, *((blocks[s] - done[s]) * total / w[s] for s in live))
            for s in live:
                done[s] += step * w[s] / total
            slot -= step
        yield list(done)


def test_schedule_stays_within_a_block_of_the_weights():
    rng = random.Random(1)
    for k in range(60):
        n = rng.randint(1, 12)
        weights = [rng.random() ** 3 + 1e-4 for _ in range(n)] if k % 3 else [1.0] * n
        blocks = [rng.randint(0, 40) for _ in range(n)]
        slots = mixing.slots_of(weights, blocks)
        assert sorted(x for own in slots for x in own) == list(range(sum(blocks))) and [len(own) for own in slots] == blocks
        assert all(own == sorted(own) for own in slots)
        done, at = [0] * n, {t: s for s, own in enumerate(slots) for t in own}
        for t, want in enumerate(fluid(weights, blocks, sum(blocks))):
            assert all(abs(d - x) < 1 for d, x in zip(done, want, strict=True))
            if t in at:
                done[at[t]] += 1


@pytest.mark.parametrize("weights", [[1.0, 1.0, 1.0], [0.9995] + [0.0005 / 400] * 400, [0.7, 0.2, 0.1 - 1e-9, 1e-9]], ids=["thirds", "tiny", "nines"])
def test_target_weights_hold_over_many_slots(weights):
    """Blocks enough that none runs out: less than one from the target weights in each of 10^5 slots."""
    total, until = math.fsum(weights), 100_000
    slots = mixing.slots_of(weights, [math.ceil(until * w / total) + 1 for w in weights])
    for own, w in zip(slots, weights, strict=True):
        for i, t in enumerate(x for x in own if x < until):
            assert abs(i - t * w / total) < 1 + 1e-6 and abs(i + 1 - (t + 1) * w / total) < 1 + 1e-6


@pytest.mark.parametrize("bucket_rows", [20_000, 40])
def test_mix(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs, block_chars=3000, weights={f"src{i}": 1.0 + i for i in range(20)}).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    by = {}
    for r in got:
        by.setdefault(r["mix_source"], []).append(r)
    slots = {}
    for s, own in by.items():
        own.sort(key=lambda r: r["mix_offset"])
        at = 0
        for r in own:
            assert r["mix_offset"] == at and r["mix_block"] == at // 3000
            at += max(1, len(r["text"] or ""))
            assert slots.setdefault(r["mix_slot"], (s, r["mix_block"])) == (s, r["mix_block"])
    ordered = [r["doc_id"] for r in sorted(got, key=lambda r: (r["mix_slot"], r["mix_offset"]))]
    out = mixing.mixed_order(docs, block_chars=3000, weights={f"src{i}": 1.0 + i for i in range(20)})
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == ordered


def plain_mix(rows, block, weights=None):
    """(id, slot, offset) of rows (id, source, chars, hash): slot by slot, of the released blocks the one due first."""
    sources = sorted({r[1] for r in rows})
    at, chars = {}, dict.fromkeys(sources, 0)
    for d, s, n, _ in sorted(rows, key=lambda r: r[3]):
        at[d] = (s, chars[s])
        chars[s] += n
    blocks = [-(-chars[s] // block) for s in sources]
    far = list(fluid([(weights or {}).get(s, chars[s] ** 0.5) for s in sources], blocks, sum(blocks)))
    released = {(k, i): max(t for t, x in enumerate(far) if x[k] <= i) for k, n in enumerate(blocks) for i in range(n)}
    due = {(k, i): min(t for t, x in enumerate(far) if x[k] >= i + 1) for k, n in enumerate(blocks) for i in range(n)}
    done, slot_of = [0] * len(blocks), {}
    for t in range(sum(blocks)):
        _, k = min((due[k, done[k]], k) for k, n in enumerate(blocks) if done[k] < n and released[k, done[k]] <= t)
        slot_of[sources[k], done[k]] = t
        done[k] += 1
    return {d: (slot_of[s, o // block], o) for d, (s, o) in at.items()}


def hashed(docs):
    rows = docs.selectExpr("doc_id", "coalesce(source, '') as s", "greatest(coalesce(length(text), 0), 1) as n", "xxhash64(doc_id, text) as h").collect()
    return [(r["doc_id"], r["s"], r["n"], r["h"]) for r in rows]


@pytest.mark.parametrize("block", [700, 5000, 100_000])
def test_mix_is_a_plain_run_slot_by_slot(spark, block):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: (r["mix_slot"], r["mix_offset"]) for r in mixing.mix(docs, block_chars=block).collect()}
    assert got == plain_mix(hashed(docs), block)


def test_mix_edges(spark):
    schema = "doc_id long, text string, source string, mix_slot string, s string"
    rows = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "", "a", "x", "y"), (2, "z" * 250_000, "b", None, None), (3, "q", "b", None, None)]
    got = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["mix_slot"] is not None for r in got) and {r["mix_source"] for r in got} == {"", "a", "b"}
    assert {r["s"] for r in got} == {"y", None}
    assert not mixing.mix(spark.createDataFrame([], schema)).collect()
    many = spark.range(mixing.MAX_SOURCES + 1).selectExpr("id as doc_id", "'t' as text", "cast(id as string) as source")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(many)


TEXTS = [None, "", " \n", "a b <|endoftext|>x", "I'M it's 12 ΣΣ \x1c é́ İx", "A.b,c;d#e'f g1h2", "x ́e <|ENDOFTEXT|>", "word " * 30_000, "ab\x00cd", "ﬁ ﷺ 漢字。"]


def test_ids_are_the_tokenizers():
    import pyarrow as pa

    tokenizer, encoder = Tokenizer.from_file(tokenizer_file()), token_store.Encoder(tokenizer_file(), 2)
    rng = random.Random(3)
    alphabet = "abcABC .,;'\"!?-_#$%1 2\n\té ß́İ<|>"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    for part in (texts, [t for t in texts if "<|" not in (t or "")]):
        got = encoder.encode(pa.array(part, pa.string()))
        assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in part]


def test_round_trip(spark, tmp_path):
    tokenizer = Tokenizer.from_file(tokenizer_file())
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5, "same"), (5, "same"), (5, "other"), (2**62, "far")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string").repartition(3)
    manifest = token_store.write_shards(df, tokenizer_file(), shard_bytes=20_000, folder=f"file://{tmp_path}/shards")
    assert manifest.count() > 2 and not list(tmp_path.glob("shards/.*"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_shards(manifest).collect())
    at, order = 0, []
    for start, doc, n, _ in got:
        assert start == at
        at += n
        order.append(-(2**63) if doc is None else doc)
    assert order == sorted(order)
    crc = lambda t: zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((d is None, d or 0, c) for _, d, _, c in got) == sorted((d is None, d or 0, crc(t)) for d, t in rows)
    shards = [token_store.Shard(r["uri"]) for r in manifest.collect()]
    for doc, t in rows:
        found = [ids.tolist() for s in shards for ids in s.get(doc)]
        assert len(found) == sum(1 for d, _ in rows if d == doc) and tokenizer.encode(t or "", add_special_tokens=False).ids + [2] in found
    assert not any(s.get(999_999) for s in shards)
    empty = token_store.write_shards(df.limit(0), tokenizer_file())
    assert empty.count() == 0 and not token_store.read_shards(empty).collect()


def test_shard_blocks_and_filter(tmp_path):
    import io

    class Out(io.BytesIO):
        pass

    out = Out()
    writer = token_store.ShardWriter(out, 2)
    for i in range(0, 4000, 2):
        writer.add(token_store.encode_key(i - 1000), i.to_bytes(8, "little") + np.arange(i % 300, dtype="<u2").tobytes())
    with pytest.raises(ValueError, match="ascend"):
        writer.add(token_store.encode_key(-5000), bytes(8))
    writer.close()
    (tmp_path / "s.sst").write_bytes(out.getvalue())
    shard = token_store.Shard(f"file://{tmp_path}/s.sst")
    assert len(shard.blocks) > 1 and shard.entries == 2000
    assert [len(shard.get(i - 1000)[0]) for i in range(0, 4000, 2)] == [i % 300 for i in range(0, 4000, 2)]
    assert sum(shard.may_hold(token_store.encode_key(i)) for i in range(10_001, 20_001)) < 300
    data = bytearray(out.getvalue())
    data[10] ^= 255
    (tmp_path / "bad.sst").write_bytes(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.Shard(f"file://{tmp_path}/bad.sst"))


def test_pipeline_is_its_stages_by_brute_force(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)

    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()

    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [(d, t) for d, t in rows if find(d) == d]
    items = [decontaminate.normal(r["text"]) for r in bench.collect()]
    clean = [(d, t) for d, t in kept if not any(decontaminate.best_match(i, decontaminate.normal(t))[0] <= decontaminate.budget(len(i) - 2, 0.06) for i in items)]
    tokenizer, at, want = Tokenizer.from_file(tokenizer_file()), 0, []
    mixed = plain_mix(hashed(docs.where(docs["doc_id"].isin([d for d, _ in clean]))), 100_000)
    for d, t in sorted(clean, key=lambda r: mixed[r[0]]):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == sorted(want) and [w[0] for w in want] != sorted(w[0] for w in want) and len(clean) < len(kept) < len(rows) < docs.count()


def test_pipeline_stages_keep_rows_of_repeated_and_null_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(3, long), (7, long), (7, long + " " + " ".join(f"more{i}" for i in range(40))), (None, long), (None, "alone"), (9, None), (9, ""), (9, None), (5, "alone"), (4, "a"), (4, "a")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, place string").repartition(3)
    df.write.parquet(f"{tmp_path}/d")
    for docs in (spark.read.parquet(f"{tmp_path}/d"), df):
        kept = corpus_pipeline.ngram_jaccard_join(spark, docs, DATA)
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted([(3, long), rows[2], (5, "alone"), (9, None), (9, ""), (9, None), (4, "a")], key=str)
        assert not corpus_pipeline.ngram_jaccard_join(spark, docs.limit(0), DATA).collect()
    out = corpus_pipeline.token_output(spark, spark.read.parquet(f"{tmp_path}/d"), DATA).collect()
    assert len(out) == len(rows)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_all_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and no rows at all."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, mix_slot int, item_id int, h1 string, comp string"
    rest = (None, None, None, None, "x", 1, 2, "y", "z")
    texts = [None, "", " ", "The end. " * 3, "many words " * 40_000, "\u0000\ufffd", "a"]
    rows = [(i, t, *rest[1:]) for i, t in enumerate(texts)] * 2 + [(None, t, "en", None, 5, "x", 1, 2, "y", "z") for t in texts]
    for name, part in (("odd", rows), ("none", [])):
        spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/{name}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            out = stage(spark, docs, DATA)
            got = out.collect()
            assert len(got) <= len(part)
            if k < 4:
                assert out.columns == docs.columns
                assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
            if k in (3, 4):
                assert len(got) == len(part)


def test_encoder_forgets_and_goes_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "KNOWN_WORDS", 50)
    tokenizer, encoder = Tokenizer.from_file(tokenizer_file()), token_store.Encoder(tokenizer_file(), 2)
    rng = random.Random(5)
    for _ in range(40):
        texts = [" ".join(rng.choice(["the", "of", "it's"] + ["x" * k + "y9" for k in range(30)] + ["qu" * k for k in range(30)]) for _ in range(20)) for _ in range(2)]
        assert [g.tolist() for g in encoder.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert len(encoder.known) < 100


def test_queries_are_registered():
    import __spark_entry__ as entry

    known = entry.queries()
    assert [n for k in range(1, 11) for n in known if n.startswith(f"op{k}_")] and "pipeline" in known
    assert all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 11))
    assert {"op4_url_filters", "op5_embedding_near_dedup", "op8_ngram_jaccard_join"} <= set(entry.oracle_sql())
