"""Token counts with a digest cache.

A count is stored under two digests: of the text as the tokenizer first normalises it, and of the tokenizer's file.
Documents join the cache by digest; only distinct texts that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, row_key, scratch_dir, text_or_empty

#: Distinct words that a Python worker keeps.
TABLE = 1_000_000
#: Missing digests, of some 100 bytes each, that are told to every task at most.
FEW = 100_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def drops_spaces(path: str) -> bool:
    """Whether the tokenizer turns white-space runs into a space that its pre-tokenizer then removes, so that texts
    that differ in white space only have equal counts and words can be counted one by one."""
    if not path.endswith(".json"):
        return False
    with open(path) as f:
        spec = json.load(f)

    def parts(x: dict | None, many: str) -> list[dict]:
        return [] if not x else x.get(many, [x])

    run = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    removed = [p for p in parts(spec.get("pre_tokenizer"), "pretokenizers") if p.get("type") == "Split" and p.get("behavior") == "Removed" and p.get("invert")]
    special = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    excludes = bool(removed) and all(re.search(r"\\s|^'", x) or re.fullmatch(r"\[(\\p\{\w\})+\]\+?", x) for x in removed[0]["pattern"]["Regex"].split("|"))
    return run in parts(spec.get("normalizer"), "normalizers") and excludes and special


class Counter:
    """Counts of one Python worker over one tokenizer file."""

    _open: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words: dict[bytes, int] | None = {} if drops_spaces(path) else None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import tokenizers

            coder = tokenizers.Tokenizer.from_file(path)
            coder.no_truncation()
            coder.no_padding()
            self.encode = lambda texts: [len(x) for x in coder.encode_batch_fast(texts, add_special_tokens=False)]

    @classmethod
    def at(cls, path: str) -> "Counter":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def count(self, text: bytes) -> int:
        """Tokens of a whole text. Where white space never enters a token, each distinct word is encoded once."""
        if self.words is None:
            return self.encode([text.decode()])[0]
        known, parts = self.words, text.split()
        try:
            return sum([known[w] for w in parts])
        except KeyError:
            if len(known) > TABLE:
                known.clear()
            new = [w for w in set(parts) if w not in known]
            for at in range(0, len(new), 10_000):
                some = new[at : at + 10_000]
                known.update(zip(some, self.encode([w.decode() for w in some])))
            return sum([known[w] for w in parts])


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.at(path)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def content_digest(path: str, name: str = "text") -> Column:
    text = text_or_empty(name)
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES, " ") if drops_spaces(path) else text, 256))


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer version; a cache that isn't there yet is empty."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _one_text_each(docs: DataFrame, missing: DataFrame) -> DataFrame:
    """(digest, text) for each row of ``missing`` (digest, ident, mark): the text of one row of that key. Few misses
    are told to every task, so that other texts stay where they are; beyond that texts move by key. Repeats of a row
    are left out before they move, in each task but for one."""
    ident, mark = row_key()
    texts = docs.select(ident.alias("ident"), mark.alias("mark"), text_or_empty().cast("binary").alias("text"))
    first = F.row_number().over(Window.partitionBy("ident", "mark").orderBy("mark"))
    one = lambda rows: rows.withColumn("place", first).where("place = 1").drop("place")
    if missing.count() <= FEW:
        return one(texts.join(F.broadcast(missing), ["ident", "mark"])).select("digest", "text")
    return one(texts).join(missing, ["ident", "mark"]).select("digest", "text")


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path`` is a tokenizers .json or a sentencepiece .model file that executors can open; ``cache`` a folder of
    Parquet that is read and appended to (a new one in the shared scratch folder if none is given). No begin, end or
    added special tokens; special strings inside texts as the library takes them. Null texts count as empty: no
    tokens. Repeated rows get a row each, and a digest is encoded and stored once however often it occurs. Other
    columns are not read, an empty table gives no rows. A text is encoded whole, in one task; where words can be
    counted one by one it takes memory for its words only, else what the library needs for the whole text.
    """
    spark = docs.sparkSession
    cache = cache or f"{scratch_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    name, scratch = version(path), Scratch(spark)
    ident, mark = row_key()
    keyed = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), content_digest(path).alias("digest"), ident.alias("ident"), mark.alias("mark"))
    keyed = scratch.keep(keyed, "keyed")
    one = keyed.groupBy("digest").agg(F.min(F.struct("ident", "mark")).alias("k"))
    missing = scratch.keep(one.join(read_cache(spark, cache, name), "digest", "left_anti").select("digest", "k.ident", "k.mark"), "missing")
    new = _one_text_each(docs, missing).mapInArrow(_count(path), "digest binary, n_tokens long")
    new.select("digest", F.lit(name).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    wanted = read_cache(spark, cache, name).join(keyed.select("digest").distinct(), "digest", "left_semi")
    counts = scratch.keep(wanted, "counts")  # a table, so that the rows of a frequent digest can be split
    out = keyed.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
