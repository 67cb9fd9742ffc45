"""Stream output == batch output for the streamed steps."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from precis.functions import text as tx
from precis.functions.arrays import ids_text
from precis.operators import packing as pk
from precis.operators import vocab as vc
from precis.plans import catalog as C
from precis.sources import tables as tb
from precis.streaming import streams as st


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_pack_equals_batch(spark):
    got = C.QUERIES["stream_pack"](spark, SF_SMALL)
    C._MEMO.clear()
    v = C.train_vocab(spark, SF_SMALL)
    docs = tb.read_table(spark, SF_SMALL, "documents")
    a = docs.select(F.col("doc_id").cast("string").alias("id"), tx.whitespace_tokens("text").alias("st"),
                    tx.whitespace_tokens(tx.first_line("text")).alias("tt"))
    ids = vc.encode_columns(a, [("st", "si", None), ("tt", "ti", None)], v)
    p = ids.select("id", pk.pack_lm("si", "ti").alias("p"))
    p = pk.filter_by_length(p, "p.tokens", 2048)
    want = p.select("id", ids_text("p.tokens").alias("tokens"), F.col("p.length").cast("bigint").alias("length"))
    assert _rows(got, ["id", "tokens", "length"]) == _rows(want, ["id", "tokens", "length"])


def _several_files(docs, folder, n=3):
    """The rows of ``docs`` in n files named in order of arrival."""
    import shutil
    folder.mkdir()
    for i in range(n):
        part = folder.parent / f"{folder.name}-{i}"
        docs.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).coalesce(1).write.parquet(str(part))
        shutil.copy(next(part.glob("*.parquet")), folder / f"part{i}.parquet")
    return str(folder)


def test_stream_summarize_equals_batch(spark, tmp_path):
    """Several micro-batches, each run twice: the result is the batch result, and every translation is remembered once."""
    from precis.operators import translate as tr
    C._MEMO.clear()
    prof = C.language_profiles(spark, SF_SMALL)
    docs = tb.read_table(spark, SF_SMALL, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    want = tr.summarize_multilingual(docs, prof, spark.createDataFrame([], tr.TM_SCHEMA), tr.marker_translator, pause=0.0)
    src = _several_files(docs, tmp_path / "in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    memory, batches = st.TranslationMemory(spark, str(tmp_path / "memory")), []

    def twice(stream, tag, fn, schema):
        def again(batch, batch_id):
            first = _rows(fn(batch, batch_id), schema.names)
            assert _rows(fn(batch, batch_id), schema.names) == first  # a replayed batch
            batches.append(batch_id)
            return fn(batch, batch_id)
        return st.run_batches_to_table(stream, tag, again, schema)

    cols = ["id", "detected", "summary_en", "summary", "ok"]
    got = st.stream_summarize(stream, "test", prof, tr.marker_translator, memory, pause=0.0, run=twice)
    assert _rows(got, cols) == _rows(want, cols) and len(batches) == 3
    known = [tuple(r) for r in memory.before(99).select("key", "src", "tgt").collect()]
    assert len(known) == len(set(known)) > 0 and memory.before(0).count() == 0


def test_stream_summarize_works_out_its_seed_once(spark, tmp_path):
    """What is known before the stream is read from a written table by every micro-batch; it counts as known there."""
    from precis.operators import translate as tr
    C._MEMO.clear()
    prof = C.language_profiles(spark, SF_SMALL)
    docs = tb.read_table(spark, SF_SMALL, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    seed = C.train_memory(spark, SF_SMALL)
    n = seed.count()
    memory = st.TranslationMemory(spark, str(tmp_path / "memory"), seed.mapInPandas(counted, tr.TM_SCHEMA))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(_several_files(docs, tmp_path / "in"))
    got = st.stream_summarize(stream, "test", prof, tr.marker_translator, memory, pause=0.0)
    assert got.count() == docs.count() and n > 0 and seen.value == n
    assert memory.before(0).count() == n and memory.before(99).count() > n


def test_multilingual_summaries_of_repeated_and_missing_keys(spark):
    """Rows meet by their key in each of three joins; a row without a key is left out."""
    from precis.operators import translate as tr
    C._MEMO.clear()
    prof = C.language_profiles(spark, SF_SMALL)
    text = tb.read_table(spark, SF_SMALL, "documents").where("lang = 'de'").select("text").first()[0]
    rows = [("a", text), ("b", text), ("b", "Only this. " + text), (None, text), ("c", None)]
    docs = spark.createDataFrame(rows, "id string, text string")
    got = tr.summarize_multilingual(docs, prof, spark.createDataFrame([], tr.TM_SCHEMA), tr.marker_translator, pause=0.0)
    assert {r["id"]: r["count"] for r in got.groupBy("id").count().collect()} == {"a": 1, "b": 256, "c": 1}
    assert got.where("id = 'b'").select("summary_en").distinct().count() == 2


def test_stream_takes_files_by_their_bytes(spark, tmp_path):
    """Files of a bounded number of bytes are a micro-batch, a larger one alone, and every row comes."""
    docs = spark.createDataFrame([(i, "w " * 50) for i in range(400)], "doc_id bigint, text string")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))

    def batches(max_bytes):
        seen = []
        run = lambda b, i: (seen.append(i), b)[1]
        s = st.read_stream(spark, str(tmp_path), "documents", max_bytes=max_bytes)
        assert st.run_batches_to_table(s, "test-bytes", run, docs.schema).distinct().count() == 400
        return len(seen)

    assert batches(1) == 8 and batches(1 << 30) == 1


def test_buckets_over_several_batches_and_a_replay(spark, tmp_path):
    """Every id is emitted once, what is left is less than a batch, and running the last micro-batch again changes nothing."""
    rows = [(f"{i:04d}", 5 + 60 * (i % 7) + 500 * (i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame(rows, "id string, length int")
    src = _several_files(docs, tmp_path / "in", 4)
    shards = st.shards_by_volume(docs, rows_per_shard=50)
    assert len(shards) == 5 and max(shards) > 1
    sink, ckpt = str(tmp_path / "sink"), str(tmp_path / "ckpt")

    def run():
        s = spark.readStream.schema("id string, length int").option("maxFilesPerTrigger", 1).parquet(src)
        q = (st.stream_bucket_batches(s, shards=shards).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(st.BUCKET_OUT_SCHEMA).parquet(sink).collect())

    got = run()
    length = dict(rows)
    assert len({r[4] for r in got}) == len(got) and all(length[r[4]] == r[5] for r in got)
    size = [16, 8, 4, 2, 1]
    bucket = lambda n: sum(n >= b for b in (128, 256, 512, 1024))
    import hashlib
    held, sent = {}, {}
    for i, n in rows:
        k = (bucket(n), int(hashlib.md5(i.encode()).hexdigest()[:8], 16) % shards[bucket(n)])
        held[k] = held.get(k, 0) + 1
    for r in got:
        sent.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    for k, n in held.items():
        assert sorted(sent.get(k, [])) == [(b, x) for b in range(n // size[k[0]]) for x in range(size[k[0]])]
    commits = sorted((int(p.name), p) for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit())
    assert len(commits) >= 4
    commits[-1][1].unlink()
    crc = commits[-1][1].parent / f".{commits[-1][1].name}.crc"
    if crc.exists():
        crc.unlink()
    assert run() == got


def test_stream_buckets_keep_partial_state(spark, tmp_path):
    import shutil
    src = tmp_path / "in"
    src.mkdir()
    # two arrivals of the same bucket: 10 rows then 10 rows -> one batch of 16 after the second
    for i, rng in enumerate([range(0, 10), range(10, 20)]):
        spark.createDataFrame([(f"{j:03d}", 5) for j in rng], "id string, length int") \
            .coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        f = next((tmp_path / f"part{i}").glob("*.parquet"))
        shutil.copy(f, src / f"part{i}.parquet")
    s = spark.readStream.schema("id string, length int").option("maxFilesPerTrigger", 1).parquet(str(src))
    out = st.run_to_table(st.stream_bucket_batches(s), "test-buckets")
    rows = out.collect()
    assert len(rows) == 16 and {r.batch for r in rows} == {0} and len({r.id for r in rows}) == 16


def test_stream_buckets_return_every_row_in_order_of_id(spark, tmp_path):
    """The query returns the rows of its full batches, from a table of several files too; ids in a batch are in order."""
    from precis.plans import catalog
    docs = spark.createDataFrame([(i, "w " * (3 + i % 5)) for i in range(100, 900)], "doc_id bigint, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["stream_bucket_batches"](spark, str(tmp_path)).collect()
    assert got and set(got[0].asDict()) == {"bucket", "shard", "batch", "slot", "id", "length"}
    at = sorted((r.bucket, r.shard, r.batch, r.slot, r.id) for r in got)
    assert len({r[4] for r in at}) == len(at)
    keys = {r[:2] for r in at}
    assert len(keys) == 2 and all(r[3] == i % 16 for i, r in enumerate(at))
    for k in keys:
        ids = [r[4] for r in at if r[:2] == k]
        assert ids == sorted(ids)


def test_stream_limit(spark):
    s = st.read_stream(spark, SF_SMALL, "documents").select("doc_id")
    assert st.run_to_table(st.stream_limit(s, 7), "test-limit").count() == 7
