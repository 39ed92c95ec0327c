"""Work that is larger than its input: results without the pairs between, dealt over tasks."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark import catalog, media_catalog
from tidemark.functions import batches, encryption, rates
from tidemark.operators import dealing, tracks
from tidemark.plans import playlists
from tidemark.sources import hls, media, sinks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_without_pairs_are_those_of_the_pairs(spark):
    draw = random.Random(5)
    rows = [(draw.choice([0, 1, 2, None]), i, draw.choice(["video", "audio"]), draw.choice(["aac", "opus"]), draw.choice([True, False, None]), draw.choice([0, 1, 2, 3, 4, None])) for i in range(200)]
    rows += [(9, 1000, "video", "avc", False, 1), (9, 1001, "audio", "aac", False, 1), (9, 1002, "audio", "aac", False, 2)]
    t = spark.createDataFrame(rows, "file int, track long, type string, codec string, only_key boolean, meet int")
    side = lambda kind, name: t.filter(F.col("type") == kind).select("file", F.col("track").alias(name), "meet")
    want = playlists.arrange(t.drop("meet"), side("video", "a").join(side("audio", "b"), ["file", "meet"]).select("file", "a", "b"), ["file"])
    got = playlists.arrange_alike(t, ["file"], "meet")
    key = lambda r: tuple(map(str, r))
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_one_class_of_variants_is_many_tasks(spark):
    t = spark.range(6000).select(F.lit(1).alias("file"), F.col("id").alias("track"), F.when(F.col("id") < 3000, "video").otherwise("audio").alias("type"), F.lit("aac").alias("codec"), F.lit(False).alias("only_key"), F.lit(0).alias("meet"))
    got = playlists.arrange_alike(t, ["file"], "meet").select(F.size("audio").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert len(got) == 3000 and {r["n"] for r in got} == {3000}
    assert len({r["p"] for r in got}) > 4


def test_pairs_need_no_comparison_with_each_other(spark):
    rows = [(1, 1, [3, 5, 5]), (1, 2, [5, 3]), (1, 2, [8]), (1, 3, [8, 3]), (1, 4, [None, 9]), (1, 5, [None, 7]), (2, 6, [3]), (None, 7, [3]), (None, 8, [3]), (1, None, [3]), (1, 9, None)]
    t = spark.createDataFrame(rows, "file int, track int, members array<int>")
    got = tracks.pairs(t, t, "file", "track", "members")
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 2, 3), (1, 3, 1), (1, 3, 2)]
    assert "Aggregate" not in plan(got).split("Join")[0]


def test_one_bit_of_pairs_is_many_tasks(spark):
    t = spark.range(1200).select(F.lit(1).alias("file"), F.col("id").alias("track"), F.array(F.lit(1), F.lit(2)).alias("members"))
    got = tracks.pairs(t, t, "file", "track", "members").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 1200 * 1199 and len(got) > 3


def test_a_small_table_is_many_tasks(spark):
    assert dealing.deal(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() >= 12


class Kept:
    """Stands for a table: keeps the function that is applied to its batches."""

    dtypes = [("file_id", "string"), ("content", "binary")]

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):  # noqa: N802
        self.f = f
        return self


def test_small_files_share_a_batch():
    files = [media_catalog._flac({"title": f"t{i}"}) for i in range(500)]
    table = pa.table({"file_id": [str(i) for i in range(500)], "content": pa.array(files, pa.binary())})
    out = list(media.tags(Kept()).f(iter(table.to_batches(max_chunksize=100))))
    assert len(out) == 1 and out[0].column("title").to_pylist() == [f"t{i}" for i in range(500)]
    big = [media_catalog._mp3({"title": "x"}) * 1000] * 12
    table = pa.table({"file_id": [str(i) for i in range(12)], "content": pa.array(big, pa.binary())})
    out = list(media.packets(Kept()).f(iter(table.to_batches())))
    assert len(out) > 2 and max(b.nbytes for b in out) < 8_000_000


def test_tagged_files_are_many_tasks(spark):
    files = media_catalog._tagged(spark, "/root/testdata/sf0.001", media_catalog._flac)
    assert files.rdd.getNumPartitions() >= 12


def test_rates_are_fitted_without_a_batch_for_each_track(spark):
    rows = [(k, i, float(i * 3600)) for k in range(300) for i in range(20)] + [(900, 0, None), (901, 0, 5.0), (902, 0, 0.0), (902, 1, None), (902, 2, 10.0), (None, 0, 0.0), (None, 1, 3600.0)]
    t = spark.createDataFrame(rows, "track int, seq int, ticks double")
    for most in (256, 10, None):
        got = rates.fit_rates(t, ["track"], 90000.0, most)
        assert "FlatMapGroupsInArrow" not in plan(got)
        assert {r["track"]: r["rate"] for r in got.collect()} == {None: 25.0, **dict.fromkeys(range(300), 25.0), 900: None, 901: None, 902: None}


def test_frames_are_made_where_their_tracks_are(spark):
    got = catalog.QUERIES["frame_fit"](spark, "/root/testdata/sf0.001")
    made = got._jdf.queryExecution().executedPlan().toString()
    assert made.count("Exchange") == 1 and made.index("Generate") < made.index("Exchange")


def test_batches_come_in_pieces():
    sizes = [0, 10, 3_000_000, 500, 9_000_000, 1, None, 2_000_000, 2_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([None if n is None else bytes(n) for n in sizes], pa.binary())], names=["i", "b"])
    out = list(batches.pieces(batch))
    assert [p.column(0).to_pylist() for p in out] == [[0, 1, 2, 3], [4], [5, 6, 7], [8]]
    assert list(batches.pieces(batch.slice(0, 0))) == []


def test_encryption_sends_on_few_bytes_at_once():
    rows = Kept()
    rows.dtypes = [("data", "binary"), ("iv", "binary"), ("parts", "array<struct<clear:int,protected:int>>")]
    encryption._stage(rows, lambda r: r["data"][::-1], "clear", ["data"])
    batch = pa.RecordBatch.from_pylist([{"data": bytes([i]) * 100_000, "iv": b"12345678", "parts": None} for i in range(200)])
    out = list(rows.f(iter([batch, batch])))
    assert max(p.nbytes for p in out) < 12_000_000 and sum(p.num_rows for p in out) == 400
    assert [x[0] for p in out[: len(out) // 2] for x in p.column("clear").to_pylist()] == list(range(200))


def test_counters_run_over_64_bits(spark):
    part = "array<struct<clear:int,protected:int>>"
    data, key = bytes(range(256)) * 40, bytes(16)
    for iv in ("ffffffffffffffff", "00000000000000ffffffffffffffffff", "ff" * 16, "0123456789abcdef01ffffffffffff7f", "00ffffffffffffffffffffffffffff80"):
        row = spark.createDataFrame([(data, key, bytes.fromhex(iv), None)], f"data binary, key binary, iv binary, parts {part}")
        start = int(iv.ljust(32, "0"), 16)
        counters = b"".join(((start + i) % (1 << 128)).to_bytes(16, "big") for i in range(640))
        stream = spark.createDataFrame([(counters, key)], "c binary, key binary").select(F.aes_encrypt("c", "key", F.lit("ECB"), F.lit("PKCS")).alias("s")).first()["s"]
        assert bytes(encryption.decrypt_ctr(row).first()["clear"]) == bytes(a ^ b for a, b in zip(data, stream[:10240], strict=True))


def test_segments_are_written_and_read_once(spark):
    got = plan(catalog.QUERIES["hls_segments"](spark, "/root/testdata/sf0.001"))
    assert len(re.findall(r"FlatMapCoGroupsInArrow|MapInArrow run\(file_id[^)]*_track", got)) == 1


def test_playlists_still_name_the_segments(spark):
    frames = media_catalog._frames(spark, "/root/testdata/sf0.001").filter("file_id < 'f3'")
    rows = media_catalog._video(frames).unionByName(media_catalog._audio(frames))
    timed = rows.withColumns({"timestamp": F.when(F.col("track_id") == 1, F.col("pts_ticks") / 25).otherwise(F.col("pts_ticks") / 48000), "byte_length": F.octet_length("data")})
    files = sinks.write_hls(media_catalog._tracks(frames.select("file_id").distinct()), timed, 960_000).collect()
    for one in {r["file_id"] for r in files}:
        mine = {r["name"]: bytes(r["content"]) for r in files if r["file_id"] == one}
        lists = [n for n in mine if n.endswith(".m3u8") and not n.endswith("-master.m3u8")]
        assert len(lists) == 1 and {lists[0].replace(".m3u8", "-master.m3u8"), *lists} == {n for n in mine if n.endswith(".m3u8")}
        assert {s["path"].rsplit("/")[-1] for s in hls.parse_media_playlist(lists[0], mine[lists[0]].decode())} == {n for n in mine if n.endswith(".ts")}
