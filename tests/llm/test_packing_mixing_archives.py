"""Packing, mixing, WARC archives and the pipeline."""

import base64
import gzip
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import mixing, packing, warc
from leafmill.llm._shared import new_folder, written

DOCS = "doc_id long, text string, source string, length long, mix string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, -1, "clash") for r in rows], DOCS)


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.vocabulary()), packing.tokenizer(packing.vocabulary())
    assert fast.fast is not None
    rng = random.Random(0)
    texts = ["", " ", "Hello  world's\n\n\tx", "été ñandú ßü 漢字 🙂‍", "<|endoftext|> inside", "a" * 5000, "1234567 !!! ---"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert fast.ids(t) == slow.encode(t, add_special_tokens=False).ids, t


def test_packing_is_gapless_and_tight(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 1500))), "s") for i in range(120)]
    rows += [(500, None, "s"), (501, "", "s"), (0, rows[0][1], "s"), (502, "w " * 5000, None)]
    frame = docs(spark, rows)
    out = packing.packed(written(packing.pieces(frame, packing.vocabulary()), "t")).toPandas()
    tok = packing.tokenizer(packing.vocabulary())
    total = 0
    for i, text, _ in rows:
        ids = tok.ids(text or "") + [2]
        total += len(ids)
        own = out[out.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert list(own.start) == list(np.cumsum([0, *own.length[:-1]])) and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 1024).all() and (len(ids) <= 1024) == (len(own) == 1)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    assert out.length.sum() == total
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 1024
    assert out.sequence_id.nunique() <= -(-total // 1024) + 8
    assert packing.packed(written(packing.pieces(docs(spark, []), packing.vocabulary()), "e")).count() == 0


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_plans_use_up_the_histogram(n):
    rng = np.random.default_rng(n)
    h = np.bincount(np.minimum(1024, rng.lognormal(5.5, 1, n).astype(int) + 1), minlength=1025)
    used = np.zeros(1025, int)
    total = 0
    for content, times in packing.plan(h):
        assert sum(content) <= 1024
        total += times
        for c in content:
            used[c] += times
    assert (used == h).all() and total <= 1.03 * -(-int((h * np.arange(1025)).sum()) // 1024) + 2


def test_sequences_hold_the_ids(spark):
    frame = docs(spark, [(1, "alpha beta", "s"), (2, "gamma", "s")])
    rows = written(packing.pieces(frame, packing.vocabulary(), with_ids=True), "ids")
    (seq,) = packing.sequences(packing.packed(rows)).collect()
    assert sorted(seq.ids) == sorted(packing.tokenizer(packing.vocabulary()).ids("alpha beta") + packing.tokenizer(packing.vocabulary()).ids("gamma") + [2, 2])


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i, s in enumerate(["a"] * 300 + ["b"] * 20 + ["c"] * 5)] + [(900, None, None), (901, "x y", None), (902, "", "b"), (5, "w " * 6, "a")]
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "length", "mix"]
    got = mixed.select("doc_id", "source", "mix.*").collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert all(0 <= p < 1 for p in r.positions)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-9 and abs(sum(r.taken for r in v) - v[0].target) <= 1
    again = mixing.mix(docs(spark, rows).repartition(7)).select("doc_id", "mix.*").collect()
    assert sorted(map(str, again)) == sorted(map(str, (r for r in mixed.select("doc_id", "mix.*").collect())))
    out = mixing.training_rows(mixed)
    assert out.columns == ["doc_id", "text", "source", "length", "position"]
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in got)
    order = [r.position for r in out.collect()]
    assert order == sorted(order)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_positions_follow_the_schedule(spark):
    falling, share = "0", [0.0, 0.25, 0.5, 0.75, 0.999]
    rows = spark.createDataFrame([(s,) for s in share], "s double").selectExpr("s", f"{mixing.position_sql(falling, 's')} AS t").collect()
    for r in rows:  # the area under 1.5 - t up to the position
        assert abs(1.5 * r.t - r.t * r.t / 2 - r.s) < 1e-9


def test_archives_round_trip(spark):
    warc.register(spark)
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c/", None), (4, "http://d/", ""), (5, "http://e/", "WARC/1.1\r\n\r\nfake" * 50), (5, "http://e/", "WARC/1.1\r\n\r\nfake" * 50)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    for compression in ("gzip", "none"):
        path = new_folder(spark, "warc-test")
        warc.page_records(frame).write.format("warc").option("path", path).option("compression", compression).mode("append").save()
        back = spark.read.format("warc").option("path", path).load()
        full = back.filter("record_type = 'response'").collect()
        want = {1: "<p>é</p>", 3: "", 5: rows[4][2]}
        assert sorted(warc_id(r.record_id) for r in full) == [1, 3, 5, 5]
        for r in full:
            raw = want[warc_id(r.record_id)].encode()
            assert bytes(r.payload) == raw and r.payload_bytes == len(raw)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        again = {warc_id(r.record_id): (warc_id(r.refers_to), r.payload_bytes, r.payload) for r in back.filter(F.col("record_type") == "revisit").collect()}
        assert again == {2: (1, len("<p>é</p>".encode()), None), 4: (3, 0, None)}
        some = spark.read.format("warc").schema("record_id string, target_uri string").option("path", path).load()
        assert some.filter("target_uri = 'http://d/'").count() == 1 and some.filter("record_id IS NOT NULL AND NOT target_uri LIKE 'http%'").count() == 0
    small = warc.page_records(frame, revisit_bytes=3).filter("record_type = 'revisit'").collect()
    assert [warc_id(r.record_id) for r in small] == [2]
    empty = new_folder(spark, "warc-empty")
    warc.page_records(frame.limit(0)).write.format("warc").option("path", empty).mode("append").save()
    assert spark.read.format("warc").option("path", empty).load().count() == 0


def response(payload, told, block_more=b""):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: " + told + b"\r\n\r\n" + payload
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (len(block) + len(block_more)) + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    warc.register(spark)
    whole = response(b"0123456789", b"5") + response(b"abc", b"12, 12")
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))  # one member, no sizes
    (tmp_path / "c.warc.gz").write_bytes(warc.member(response(b"x" * 70_000, b"1")) + warc.member(response(b"yz", b"2")))
    back = spark.read.format("warc").option("path", str(tmp_path)).load().select("payload_bytes", "payload").collect()
    assert sorted((r.payload_bytes, len(r.payload)) for r in back) == [(2, 2), (3, 3), (3, 3), (10, 10), (10, 10), (70_000, 70_000)]


def test_damaged_archives(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "a.warc").write_bytes(response(b"one", b"3") + b"noise\r\nmore\r\n" + response(b"two", b"3") + response(b"cut", b"3", b"more")[:-9])
    packed = warc.member(response(b"three", b"5"))
    (tmp_path / "b.warc.gz").write_bytes(packed + packed[:-20])
    read = spark.read.format("warc").option("path", str(tmp_path))
    with pytest.raises(Exception, match="damaged archive"):
        read.load().collect()
    rows = read.option("damaged", "count").load().select("record_type", "payload").collect()
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == [b"one", b"three", b"two"]
    assert sum(r.record_type == "damaged" for r in rows) >= 2


@pytest.mark.parametrize("size", (0, 1, 30, 10**6, 2**32 + 5, 2**64 - 1))
def test_wrong_member_sizes_end_and_lose_nothing(spark, tmp_path, size):
    warc.register(spark)
    packed = [warc.member(response(bytes([65 + i]) * 50, b"50")) for i in range(4)]
    at = len(warc._MEMBER)
    packed[1] = packed[1][:at] + size.to_bytes(8, "little") + packed[1][at + 8 :]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed))
    rows = spark.read.format("warc").option("path", str(tmp_path)).load().select("payload").collect()
    assert sorted(bytes(r.payload) for r in rows) == [bytes([65 + i]) * 50 for i in range(4)]


def test_member_sizes_have_64_bits():
    import struct

    one = warc.member(b"x" * 1000)
    assert struct.unpack_from("<QQ", one, len(warc._MEMBER)) == (len(one), 1000) and gzip.decompress(one) == b"x" * 1000


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    import io

    raw = b"".join(warc.member(response(bytes([i]) * 3_000_000, b"9")) for i in range(4))
    reader = warc.WarcReader("x", ["record_id"])
    inflated = 0
    real = gzip._GzipReader.read

    def count(self, size=-1):
        nonlocal inflated
        out = real(self, size)
        inflated += len(out)
        return out

    monkeypatch.setattr(gzip._GzipReader, "read", count)
    rows = [r for stream, one in warc._members(io.BytesIO(raw)) for r in reader.records(stream, one)]
    assert rows == [("<urn:page:1>",)] * 4 and 0 < inflated < 1_500_000


def warc_id(urn):
    return int(urn.removeprefix("<urn:page:").removesuffix(">"))


def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    draw = random.Random(1)
    text = "\n".join("The " + " ".join(draw.choice(["river", "stone", "garden", "market", "window", "letter", "of", "and", "with", "a"]) for _ in range(12)) + " was there." for _ in range(30))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text.replace("rivers", "markets") + " And one more line of words here.", "en", None, 1), (4, "ab " * 30_000, "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {1} and all(0 < r.length <= 1024 for r in out)
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_stages_keep_what_they_should(spark):
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, written(stage(spark, frame, folder), "stage")
        if name != "packing":
            assert frame.columns == columns
        if name in ("near-dedup", "secret scan"):
            assert {r.doc_id for r in frame.collect()} <= {r.doc_id for r in before.collect()}
        if name == "secret scan":
            assert frame.count() == before.count()
    assert frame.filter("length > 1024").count() == 0 and frame.count() > 0
