"""Documents that arrive in chunks: (doc_id, seq, chunk BINARY, is_last).

In batch, chunks are put together by an ordered aggregate. As a stream, a
document's chunks are state, keyed by document, each written once, until all up to
its last one are there, whatever order and micro-batches they come in; then the
document goes on whole, so results don't depend on how it was cut, and anything
that works on pages, nodes, selectors, paths and axes among it, works on a stream
of chunks. Too large a document is an error at once, its state is dropped, and
chunks that are new after that say the parser ended.

What is kept of a document, chunks that never got complete and the mark that it
was done, goes ``ttl_ms`` after it was last written; with None it stays, as fits
streams that end.

Defined cases: a chunk that comes again is passed over; a null chunk is empty; a
document without a last chunk gives nothing; a null id is a document's id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.dom import ParseOptions, parse
from .incremental import TERMINATED

DAY_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def chunked(pages: DataFrame, size: int, id_col: str = "page_id", raw_col: str = "raw") -> DataFrame:
    """A BINARY column cut into chunks of so many bytes; an empty document is one empty chunk."""
    n = F.greatest(F.ceil(F.octet_length(raw_col) / F.lit(size)), F.lit(1)).cast("int")
    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(raw_col).alias("raw"), n.alias("n"))
    rows = rows.withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("doc_id", "seq", F.expr(f"substring(raw, seq * {size} + 1, {size})").alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("is_last"))


def assemble(chunks: DataFrame) -> DataFrame:
    """(doc_id, raw): each document's chunks in order of seq, put together at once."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.hex(F.coalesce("chunk", F.lit(b""))).alias("chunk"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["chunk"]), "")
    return chunks.groupBy("doc_id").agg(F.unhex(joined).alias("raw"))


def parse_chunks(chunks: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Batch: the documents of a table of chunks, as sources.dom.parse gives them."""
    return parse(assemble(chunks), "doc_id", "raw", options)


class Assembler(StatefulProcessor):
    """Of each document: its chunks by seq, and (number of the last one or -1, bytes, chunks, how it ended)."""

    def __init__(self, options: ParseOptions, ttl_ms: int | None):
        self.options, self.ttl_ms = options, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "seq int", "chunk binary", self.ttl_ms)
        self.about = handle.getValueState("about", "last int, size long, n int, ended string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last, size, n, ended = self.about.get() or (-1, 0, 0, None)
        kept, new = n > 0, {}  # whether chunks are state; chunks that aren't yet, and needn't be if the document ends here
        out: list[tuple] = []
        for r in sorted(rows, key=lambda r: r.seq):
            seq, chunk = r.seq, r.chunk or b""
            if ended == "Done" and seq <= last or not ended and (seq in new or kept and self.chunks.containsKey((seq,))):
                continue  # again
            if ended:
                out.append((None, TERMINATED))
                continue
            size, n = size + len(chunk), n + 1
            last = seq if r.is_last else last
            new[seq] = chunk
            if error := self.options.check(size):
                out.append((None, error))
                ended = "Error"
            elif n == last + 1:
                parts = new | {k[0]: bytes(v[0]) for k, v in self.chunks.iterator()} if kept else new
                out.append((b"".join(parts[k] for k in sorted(parts)), None))
                ended = "Done"
            if ended:
                new = {}
                if kept:
                    self.chunks.clear()
        for seq, chunk in new.items():
            self.chunks.updateValue((seq,), (chunk,))
        self.about.update((last, size, n, ended))
        for raw, error in out:
            yield Row(doc_id=key[0], raw=raw, error=error)

    def close(self) -> None:
        pass


def assemble_stream(chunks: DataFrame, options: ParseOptions = ParseOptions(), ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Streaming: (doc_id, raw, error), a row per document once its last chunk is there, or at its first error, and a row per new chunk
    after that. The session's state store must be RocksDB's."""
    spark = chunks.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    rows = chunks.select("doc_id", F.col("seq").cast("int").alias("seq"), "chunk", "is_last")
    return rows.groupBy("doc_id").transformWithState(Assembler(options, ttl_ms), f"doc_id {kind}, raw binary, error string", "Append", "None" if ttl_ms is None else "ProcessingTime")


def parse_stream(chunks: DataFrame, options: ParseOptions = ParseOptions(), ttl_ms: int | None = DAY_MS) -> DataFrame:
    """Streaming: the documents of a stream of chunks, nodes and all, as sources.dom.parse gives them, errors as rows."""
    return parse(assemble_stream(chunks, options, ttl_ms), "doc_id", "raw", options, "error")
