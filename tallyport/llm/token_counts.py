"""Token counts: prefix dynamic programming over the words of a text.

count[0] = 0 and count[i] = count[i - 1] + tokens(word i): the exact count of every prefix that ends with a word.
A prefix that ends inside a word adds the count of that word's own prefix, which depends on this word alone.
From these counts any truncation or budget question is a search, and no text is encoded again. The prefix counts of all texts are
stored as a table; the query reads each text's total from its last entry.

Special strings of the tokenizer start with "<|" and hold no white space, so a word that has them is encoded by itself, by the
library, and the sums go on behind it.

Defined results: null and empty texts have 0 bytes and 0 tokens and no prefix; texts of any length are counted whole; repeated rows are counted each by itself; rows
with a null id stay; other columns of the input are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, freed, groups, spread, text_column
from .word_bpe import default_path, ids_of, word_ids

LIMIT = 2048


class PrefixCounts:
    """Exact token counts of every prefix of one text: `ends` are byte offsets after each word, `counts` the tokens up to there."""

    def __init__(self, text: str, path: str):
        self.text = text.encode()
        self.memo = word_ids(path)
        self.ends = word_ends(np.frombuffer(self.text, np.uint8), np.array([0, len(self.text)]))
        self.counts = np.cumsum(counts_of(self.text.split(), self.memo))

    def count(self, n_bytes: int) -> int:
        """Tokens of the first n_bytes bytes; a cut inside a character leaves that character out."""
        head = self.text[:n_bytes].decode("utf-8", "ignore").encode()
        k = bisect_right(self.ends, len(head))
        last = head[self.ends[k - 1] if k else 0 :].split()
        return (int(self.counts[k - 1]) if k else 0) + (int(counts_of(last, self.memo)[0]) if last else 0)

    def fit(self, budget: int) -> int:
        """Bytes of the longest prefix of whole words with at most budget tokens."""
        k = bisect_right(self.counts, budget)
        return int(self.ends[k - 1]) if k else 0


def counts_of(words: list[bytes], memo) -> np.ndarray:
    """Tokens of each word."""
    special = [b"<|" in w for w in words]
    if not any(special):
        return memo.counts([w.lower() for w in words])
    out = np.zeros(len(words), np.int64)
    out[[not x for x in special]] = memo.counts([w.lower() for w, x in zip(words, special, strict=True) if not x])
    out[special] = [len(memo.whole(w)) for w, x in zip(words, special, strict=True) if x]
    return out


def word_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places behind the words of texts that stand one behind another in `data`."""
    inside = np.append(~((data == 32) | ((data >= 9) & (data <= 13))), False)
    ends = inside[:-1] & ~inside[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = inside[last]
    return np.flatnonzero(ends) + 1


def prefix_arrays(texts: pa.Array, memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before each text and in all, bytes up to each word's end in its text, tokens up to there) of texts without nulls."""
    raw = texts.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = word_ends(data, offsets)
    at = np.append(0, np.searchsorted(ends, offsets[1:], "right"))
    n = np.diff(at)
    rows, _, special = ids_of(texts, memo)
    c, plain = np.zeros(len(ends), np.int64), np.ones(len(texts), bool)
    plain[special] = False
    c[np.repeat(plain, n)] = memo.count[rows[rows != memo.row[b""]]]
    for i in special:
        c[at[i] : at[i + 1]] = counts_of(raw[i].as_py().split(), memo)
    total = np.append(0, np.cumsum(c))
    return at, ends - np.repeat(offsets[:-1], n), total[1:] - np.repeat(total[at[:-1]], n)


def _prefixes(path: str):
    def run(batches):
        memo = word_ids(path)
        for batch in batches:
            every = pc.fill_null(batch.column("text"), "")
            for lo, hi in groups(every):
                texts = every.slice(lo, hi - lo)
                at, ends, counts = prefix_arrays(texts, memo)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pc.binary_length(texts).cast(pa.int64()), *lists], names=["doc_id", "n_bytes", "prefix_bytes", "prefix_tokens"])

    return freed(run)


def prefix_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, prefix_bytes, prefix_tokens of each document: an entry for each word, where it ends and the tokens of the text up to there."""
    narrow = spread(text_column(docs, id_col, text_col), "doc_id")
    return narrow.mapInArrow(_prefixes(path or default_path()), f"doc_id {dict(narrow.dtypes)['doc_id']}, n_bytes long, prefix_bytes array<int>, prefix_tokens array<int>")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document, from the stored table of prefix counts. No shuffle."""
    # rising numbers are small as differences
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
    stored = Workspace(docs.sparkSession).save(prefix_table(docs, path, id_col, text_col), "prefixes", **options)
    n_tokens = F.coalesce(F.get("prefix_tokens", F.size("prefix_tokens") - 1), F.lit(0)).cast("long")
    return stored.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
