"""One document that comes piece by piece: tokens or a tree, the same as if it had come at once.

What a piece may still change is held back: a construct that hasn't ended, a
character reference at the end. What is held is looked at again once it has grown
by a quarter, so a long comment in small pieces takes time linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import Decoder, decode_stream
from ..sources.builder import TreeBuilder
from ..sources.dom import ParseOptions
from ..sources.tokenizer import Sink, TokenList, scan
from ..sources.tree import Tree

TERMINATED = "ParserTerminated"


class StreamTokenizer:
    """Feeds a sink; without one, on_token gets each token, or finish() returns them all."""

    def __init__(self, sink: Sink | None = None, on_token: Callable[[dict], None] | None = None):
        self.sink = sink if sink is not None else TokenList(on_token)
        self.held: list[str] = []
        self.buffered = self.wait = 0

    def feed(self, text: str) -> None:
        if not text or not self.sink.should_continue():
            return
        self.held.append(text)
        self.buffered += len(text)
        if self.buffered >= self.wait:
            html = "".join(self.held)
            rest = html[scan(html, self.sink, final=False) :]
            self.held, self.buffered = [rest], len(rest)
            self.wait = len(rest) + len(rest) // 4 + 1

    def finish(self) -> list[dict] | None:
        if self.sink.should_continue():
            scan("".join(self.held), self.sink)
        self.held, self.buffered = [], 0
        return self.sink.finish() if isinstance(self.sink, TokenList) else None


class StreamParser:
    """Bytes of one document to its tree. A size beyond the limit, of the bytes or of the text, ends the parser with an error; calls
    after that, or after finish, raise ParserTerminated."""

    def __init__(self, options: ParseOptions = ParseOptions()):
        self.options, self.ended = options, False
        self.raw = self.decoded = 0
        self.decoder = Decoder()
        self.builder = TreeBuilder()
        self.tokens = StreamTokenizer(self.builder)

    def _check(self, size: int) -> None:
        if error := self.options.check(size):
            self.ended = True
            raise ValueError(error)

    def _text(self, text: str) -> None:
        self.decoded += len(text.encode("utf-8", "surrogatepass"))
        self._check(self.decoded)
        self.tokens.feed(text)

    def feed(self, chunk: bytes) -> None:
        if self.ended:
            raise ValueError(TERMINATED)
        self.raw += len(chunk)
        self._check(self.raw)
        self._text(self.decoder.feed(chunk))

    def finish(self) -> Tree:
        if self.ended:
            raise ValueError(TERMINATED)
        self._text(self.decoder.finish())
        self.ended = True
        self.tokens.finish()
        return Tree(self.builder.finish())


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, seq, text) of chunks (doc_id, seq, chunk): each document's bytes decoded as they are read, in order of seq, a character
    that two chunks share in the later one. The encoding is detected from the document's first bytes."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        pieces: list[tuple[int, str]] = []
        at = -1
        seqs = table.column("seq").to_pylist()

        def read() -> Iterable[bytes]:
            nonlocal at
            for k, chunk in enumerate(table.column("chunk")):
                at = k
                yield chunk.as_py() or b""

        for text in decode_stream(iter(read())):
            pieces.append((seqs[at], text))
        ids = table.column("doc_id").take(pa.array([0] * len(pieces), pa.int32())).combine_chunks()
        return pa.table({"doc_id": ids, "seq": pa.array([s for s, _ in pieces], pa.int32()), "text": pa.array([t for _, t in pieces], pa.string())})

    rows = chunks.select("doc_id", F.col("seq").cast("int").alias("seq"), "chunk")
    return rows.groupBy("doc_id").applyInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, seq int, text string")
