"""Streaming variants of the incremental steps. State and progress live in a folder; a query restarted with the same folder
goes on where it stopped."""

from __future__ import annotations

import contextlib
import heapq
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lodeflow.functions.text import clean_text, digest
from lodeflow.operators import dedup
from lodeflow.operators.dedup import MAX_CHARS, MIN_CHARS
from lodeflow.operators.order import ranks
from lodeflow.operators.packing import PORTION, place_documents
from lodeflow.operators.tokenizers import Tokenizer
from lodeflow.session import materialize, work_root


def clean_stream(stream: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Texts that pass the gates, with their digest; without state."""
    rows = stream.where(F.col(text_col).isNotNull()).withColumn("clean", clean_text(F.col(text_col)))
    return rows.where(F.length("clean").between(min_chars, max_chars)).withColumn("digest", digest(F.col("clean")))


def first_seen(stream: DataFrame, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first arrival of each digest. With an event time the state is bounded: copies further apart than ``delay`` both
    come out, which is weaker than the batch operator. Without one the state grows with the distinct texts."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])
    return stream.dropDuplicates(["digest"])


def windowed_counts(stream: DataFrame, event_time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per window of event time, closed ``delay`` after the window's end."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *by).agg(F.count("*").alias("n"))


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run_available(
    stream: DataFrame, name: str, output: str = "append", each_batch: Callable[[DataFrame, int], None] | None = None, folder: str | None = None, interval: str | None = None, group_rows: int | None = None, arrow_rows: int | None = None
) -> DataFrame:
    """Runs a stream over all that is there, in batches, and returns what it has written so far, exactly once.

    folder: where state, progress and output live. A run that names the folder of an earlier one, finished or broken off,
    goes on where that stopped. Without it a run has a folder of its own. interval: a batch is begun at each such interval
    of time, and the run ends when nothing is left. With ``each_batch`` the caller's function is the sink and the result is
    the stream's schema without rows. group_rows: the most rows of a row group in the versions that are written.
    arrow_rows: the most rows that Python stages of this stream get or gather at once; a started query keeps its own settings.
    """
    spark: SparkSession = stream.sparkSession
    root = folder or f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(output).option("checkpointLocation", f"{root}/state")
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    if each_batch:
        writer = writer.foreachBatch(each_batch)
    elif output == "append":
        writer = writer.format("parquet").option("path", f"{root}/out")
    else:
        # a version of the changed rows for each batch; a batch that is run again overwrites its own
        limit = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
        writer = writer.foreachBatch(lambda batch, k: batch.write.options(**limit).mode("overwrite").parquet(f"{root}/out/batch={k}"))
    before = spark.conf.get(_ARROW_ROWS)
    try:
        if arrow_rows:
            spark.conf.set(_ARROW_ROWS, arrow_rows)
        running = writer.start()
    finally:
        spark.conf.set(_ARROW_ROWS, before)
    if interval:
        running.processAllAvailable()
        running.stop()
    else:
        running.awaitTermination()
    if each_batch:
        return spark.createDataFrame([], stream.schema)
    if output == "append":
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    if output == "complete":
        return found.join(F.broadcast(found.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    return found


def flushed(batch: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds ``chunk``: each n rows in order are one, as a bounded buffer would be flushed."""
    return ranks(batch, order, "_rank").withColumn("chunk", F.floor(F.col("_rank") / F.lit(n))).drop("_rank")


_OPEN = "seq BIGINT, doc BIGINT, ids BINARY, docs BINARY"


def packed_stream(stream: DataFrame, tokenizer: Tokenizer, max_len: int, id_col: str = "row_id", text_col: str = "clean", lane: str | None = None, pad_id: int = -1) -> DataFrame:
    """(``lane``, ``seq``, ``input_ids``, ``document_ids``, ``closed``) in update mode: packing goes on across batches.

    What a lane keeps between batches is its open sequence, at most ``max_len`` places. A batch puts out the sequences it
    closed and the open one as it stands, so the last version of each is the packing of all rows in order of arrival,
    within a batch of the id. Lanes are packed apart; without one there is a single lane. Of a batch's texts a lane holds a
    sorted run at a time, the others are in files.
    """
    eos = tokenizer.eos_id
    encode = getattr(tokenizer, "encode_array", None) or (lambda text: np.array(tokenizer.encode(text), np.int32))
    one = lambda x: np.array([x], np.int32)

    def run(key, batches, state):
        seq, doc, ids, docs = 0, 0, [], []
        if state.exists:
            seq, doc, a, b = state.get
            ids, docs = ([np.frombuffer(x, np.int32)] for x in (a, b))
        used, out = sum(map(len, ids)), []

        def put(closed: bool) -> None:
            filled = (np.pad(_joined(x), (0, max_len - used), constant_values=fill) for x, fill in ((ids, pad_id), (docs, -1)))
            out.append((key[0], seq, *(zlib.compress(x.tobytes(), 1) for x in filled), closed))

        for _, text in _by_id(r for pdf in batches for r in zip(pdf["id"].tolist(), pdf["text"].tolist())):
            tokens = encode(text)
            for _, _, start, size, last, _ in place_documents([len(tokens)], max_len, used):
                if max_len - used <= 1:
                    put(True)
                    seq, ids, docs, used = seq + 1, [], [], 0
                    if len(out) >= 100:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                ids += [tokens[start : start + size], one(eos if last else pad_id)]
                docs += [np.full(size, doc, np.int32), one(doc if last else -1)]
                used += size + 1
            doc += 1
        if used:
            put(False)
        state.update((seq, doc, _joined(ids).tobytes(), _joined(docs).tobytes()))
        yield pd.DataFrame(out, columns=names)

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PORTION // max_len)
        for batch in batches:
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * max_len)
                of = lambda c: np.frombuffer(b"".join(map(zlib.decompress, part.column(c).to_pylist())), np.int32)
                lists = {c: pa.ListArray.from_arrays(offsets, pa.array(of(c))) for c in names[2:4]}
                yield pa.RecordBatch.from_arrays([lists[c] if c in lists else part.column(c) for c in names], names)

    names = ["lane", "seq", "input_ids", "document_ids", "closed"]
    rows = stream.select((F.col(lane) if lane else F.lit(0)).cast("bigint").alias("lane"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = "lane BIGINT, seq BIGINT, input_ids {0}, document_ids {0}, closed BOOLEAN"
    # vectors leave the operator compressed: it gathers as many as an Arrow batch may have rows, whatever their size
    packed = rows.groupBy("lane").applyInPandasWithState(run, kinds.format("BINARY"), _OPEN, "update", GroupStateTimeout.NoTimeout)
    return packed.mapInArrow(spread_out, kinds.format("ARRAY<INT>"))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _by_id(rows: Iterable[tuple[int, str]], limit: int = 16_000_000) -> Iterator[tuple[int, str]]:
    """Rows in order of the id, by sorted runs of ``limit`` characters in files that are merged."""
    with contextlib.ExitStack() as files:
        runs, own, held = [], [], 0
        for row in rows:
            own.append(row)
            held += len(row[1])
            if held >= limit:
                runs.append(files.enter_context(tempfile.TemporaryFile()))
                for r in sorted(own, key=itemgetter(0)):
                    pickle.dump(r, runs[-1])
                runs[-1].seek(0)
                own, held = [], 0
        yield from heapq.merge(*map(_loaded, runs), sorted(own, key=itemgetter(0)), key=itemgetter(0))


def _loaded(file) -> Iterator[tuple[int, str]]:
    with contextlib.suppress(EOFError):
        while True:
            yield pickle.load(file)


def every(interval: int, action: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """An action for each ``interval``-th batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id % interval == 0:
            action(batch, batch_id)

    return run


def near_new(batch_signed: DataFrame, stored_signed: DataFrame, threshold: float = 0.8, stored_bands: DataFrame | None = None) -> DataFrame:
    """(``id``) of the new rows that are near duplicates of stored or earlier new rows; ids of new rows are the larger ones.

    Of what is stored only the last row of each bucket that a new row falls into can be a neighbour, so the stored bands are
    probed by key and nothing stored is sorted. stored_bands: those of ``dedup.bands_of``, kept beside the sketches.
    """
    new = materialize(dedup.bands_of(batch_signed), "new-bands")
    kept = dedup.bands_of(stored_signed) if stored_bands is None else stored_bands
    last = kept.join(new.select("band", "key").distinct(), ["band", "key"], "left_semi").groupBy("band", "key").agg(F.max("id").alias("id"))
    pairs = dedup.bucket_pairs(new.unionByName(last))
    both = batch_signed.unionByName(stored_signed.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(*batch_signed.columns))
    near = dedup.compared(pairs, both).where(F.col("similarity") >= threshold - 1e-9).select("id").distinct()
    return near.join(batch_signed.select("id"), "id", "left_semi")
