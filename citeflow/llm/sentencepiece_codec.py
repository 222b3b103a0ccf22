"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model holds a white-space marker after another character, so no merge crosses the start of a marked
word. A task lists the marked words of a stretch of texts, segments each distinct one once with the library, and joins
ids (and decoded surfaces) back by position. The table belongs to the task and is emptied when it has ``TABLE``
entries; a shuffled table of all words would have to move every word occurrence twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK = "▁"
#: Distinct chunks that a task keeps, and characters that it handles at once.
TABLE, STRETCH = 200_000, 1 << 19
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """The chunk table of one Python worker over one model file."""

    _open: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError(f"{path}: a piece crosses a white-space marker")
        self.ids: dict[str, str] = {}
        self.surface: dict[str, str] = {}

    @classmethod
    def at(cls, path: str) -> "Codec":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks that the table lacks, each once."""
        if len(self.ids) > TABLE:
            self.ids.clear()
            self.surface.clear()
        new = [c for c in chunks if c not in self.ids]
        # the library puts the first marker itself; alone it is a piece of its own, as the library drops empty input
        coded = self.model.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)
        coded = [[self.model.piece_to_id(MARK)] if c == MARK else x for c, x in zip(new, coded)]
        for c, ids, text in zip(new, coded, self.model.decode(coded, num_threads=1)):
            self.ids[c] = ",".join(map(str, ids))
            self.surface[c] = " " + text if c != MARK else " "

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text's chunks in order, some ``STRETCH`` characters at a time, cut where a chunk starts."""
        marked = MARK + text.replace(" ", MARK)
        at = 0
        while at < len(marked):
            end = at + STRETCH
            while end < len(marked) and not (marked[end] == MARK and marked[end - 1] != MARK):
                end += 1
            yield _CHUNK.findall(marked, at, end)
            at = end


def _coded(codec: Codec, texts: list[str]) -> list[list[list[str]]]:
    lists = [list(codec.stretches(t)) if t else [] for t in texts]
    codec.learn({c for parts in lists for part in parts for c in part})
    return lists


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_tokens, ids_sha, text_sha = [], [], []

            def settle(group: list[str]) -> None:
                if len(group) == 1 and len(group[0]) > STRETCH:  # one long text, a stretch at a time
                    parts = ([p] for p in codec.stretches(group[0]))
                    _hash(codec, parts, n_tokens, ids_sha, text_sha)
                    return
                for parts in _coded(codec, group):
                    _hash(codec, ([p] for p in parts), n_tokens, ids_sha, text_sha, known=True)

            group, size = [], 0
            for t in texts:
                t = t.as_py()
                if group and size + len(t) > STRETCH:
                    settle(group)
                    group, size = [], 0
                group.append(t)
                size += len(t)
            if group:
                settle(group)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                names=[*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _hash(codec: Codec, parts, n_tokens: list, ids_sha: list, text_sha: list, known: bool = False) -> None:
    """Digests of one text, whose chunks come in parts."""
    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
    for (chunks,) in parts:
        if not known:
            codec.learn(set(chunks))
        ids = ",".join([codec.ids[c] for c in chunks])
        a.update((("," if n else "") + ids).encode())
        text = "".join([codec.surface[c] for c in chunks])
        b.update((text if n else text[1:]).encode())
        n += ids.count(",") + 1
    n_tokens.append(n)
    ids_sha.append(a.hexdigest())
    text_sha.append(b.hexdigest())


def encode_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    Exactly the library's encode() without begin or end ids, then its decode(ids). Null texts count as empty: no ids,
    empty decoded text. Repeated rows get a row each, other columns are not read, an empty table gives no rows. Narrow:
    no shuffle, so a lost executor repeats its own tasks only.
    """
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(path: str):
    """A pandas UDF from a text column to its ids (array<int>); null gives no ids."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec, out = Codec.at(path), []
        for t in texts:
            own: list[int] = []
            for chunks in codec.stretches(t) if t else ():
                codec.learn(set(chunks))
                own += [int(x) for c in chunks for x in codec.ids[c].split(",")]
            out.append(own)
        return texts.__class__(out, index=texts.index, dtype=object)

    return ids


def decode_column(path: str):
    """A pandas UDF from ids (array<int>) to the decoded text; null gives null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        model = Codec.at(path).model
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return text
