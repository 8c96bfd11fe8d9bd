"""Problem 8: encoding of the whole corpus with a public tokenizer.

Byte-level BPE encodes each pre-token by itself, so each distinct pre-token of the corpus is encoded once and its ids are
joined back to every place it stands.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.session import spooled

TOKENIZER_DIR = os.environ.get("WRENFIELD_TOKENIZERS", "/opt/tokenizers")

# The pre-token pattern of byte_bpe_50k; white space is spelled out, as Java's \s is ASCII only.
_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def ranks_path(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> str:
    return f"{directory}/{name}.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODERS: dict[str, object] = {}


def _coder(path: str):
    """The encoder of a vocabulary file, once a Python worker."""
    if path not in _CODERS:
        import tiktoken

        # Pre-tokens are cut beforehand, so the pattern takes whatever comes as one.
        _CODERS[path] = tiktoken.Encoding(path, pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})
    return _CODERS[path]


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


#: Words that are told in the place where they stand: the most frequent ones, by the characters they have at most. What is
#: sent to every task for that is 16 MB of each kind at most.
FREQUENT = {64: 65_536, 4096: 1024}


def _told(words: DataFrame) -> pa.Table:
    """(word, ids) of the ``FREQUENT`` words of (word, n, ids), and last, for all others, -1."""
    kinds, shorter = [], 0
    for longest, most in FREQUENT.items():
        fit = words.where((F.length("word") > shorter) & (F.length("word") <= longest))
        kinds.append(fit.orderBy(F.col("n").desc(), "word").limit(most).select("word", "ids").toArrow())
        shorter = longest
    other = pa.table({"word": pa.array([None], pa.string()), "ids": pa.array([[-1]], pa.list_(pa.int32()))})
    columns = [t.select(["word", "ids"]).cast(other.schema) for t in kinds]
    return pa.concat_tables([*columns, other]).combine_chunks()


def resolved(batch: pa.RecordBatch, told: pa.Table) -> pa.RecordBatch:
    """(id, ids, rare) of a batch of (id, words): the ids of all told words in order, -1 for each other word, and these."""
    lists = batch.column("words")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    names = told.column("word").combine_chunks()
    at = pc.index_in(values, value_set=names.slice(0, len(names) - 1))
    rare = pc.is_null(at)
    ids = told.column("ids").combine_chunks().take(pc.fill_null(at, len(names) - 1))
    upto = lambda n: pa.array(np.append(0, np.cumsum(np.asarray(n, dtype=np.int64)))[offsets].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [batch.column("id"), pa.ListArray.from_arrays(upto(pc.list_value_length(ids)), ids.flatten()), pa.ListArray.from_arrays(upto(pc.cast(rare, pa.int8())), values.filter(rare))],
        names=["id", "ids", "rare"],
    )


def encoded(documents: DataFrame, *, id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(``id``, ``ids``): the token ids of each document, without special tokens; text that looks like one is plain text.

    Null and empty texts have the empty list. Rows are as many as documents'; ids are taken to be unique, as rare words of
    rows of one id would be put together.

    The distinct pre-tokens of the corpus are found by a pre-aggregated shuffle and encoded once. Ids of the most frequent
    ones, which are nearly all occurrences, are joined back in place by a bounded table (``FREQUENT``); no other word can be
    hot, so their occurrences are exploded with their positions, joined in a shuffle and put back by document and position.
    """
    path = ranks or ranks_path()
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    docs = documents.select(F.col(id).alias("id"), pre_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "ids": [coder.encode_ordinary(w) for w in batch["word"]]})

    counted = docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = spooled(counted.mapInPandas(encode, "word string, n bigint, ids array<int>"))
    told = _told(words)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                yield resolved(batch.slice(start, 1024), told)

    kind = documents.schema[id].dataType.simpleString()
    known = spooled(docs.mapInArrow(resolve, f"id {kind}, ids array<int>, rare array<string>"))
    asked = known.where("size(rare) > 0").select("id", F.posexplode("rare").alias("at", "word"))
    found = asked.join(words.select("word", F.col("ids").alias("own")), "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "own"))), lambda x: x["own"]).alias("found"))

    @F.pandas_udf("array<int>")
    def spliced(ids: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for own, words in zip(ids, found):
            parts = np.split(own, np.flatnonzero(own == -1))
            out.append(np.concatenate([parts[0], *[np.concatenate([w, part[1:]]) for w, part in zip(words, parts[1:])]]).astype(np.int32))
        return pd.Series(out, dtype=object)

    rest = known.where("size(rare) > 0").select("id", "ids").join(found, "id").select("id", spliced("ids", "found").alias("ids"))
    return known.where("size(rare) = 0").select("id", "ids").union(rest).withColumnRenamed("id", id)


def decoded(tokens: DataFrame, *, id: str = "doc_id", ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """(``id``, ``text``): the text of each list of ids; the empty list gives the empty text.

    Joins the table of token bytes, whose size is that of the vocabulary (about 50,000 rows), and puts bytes in order.
    """
    path = ranks or ranks_path()
    spark = tokens.sparkSession
    table = spark.createDataFrame(pd.DataFrame([(i, b) for b, i in read_ranks(path).items()], columns=["token", "bytes"]), "token int, bytes binary")
    rows = tokens.select(F.col(id).alias("id"), F.posexplode(F.col(ids)).alias("at", "token"))
    pieces = rows.join(F.broadcast(table), "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("hex")))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["hex"]), "")), "UTF-8")
    return tokens.select(F.col(id).alias("id")).join(pieces, "id", "left").select(F.col("id").alias(id), F.coalesce(text, F.lit("")).alias("text"))
