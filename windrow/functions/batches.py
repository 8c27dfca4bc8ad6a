"""Text helpers that the corpus operators share."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab and the four line breaks of ASCII.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\t\n\v\f\r"


def words_of(text: str | None) -> list[str]:
    """Words of a whole text; the five other blanks become spaces first, so that split(" ") sees one separator."""
    if not text:
        return []
    for blank in BLANKS:
        if blank in text:
            text = text.replace(blank, " ")
    return list(filter(None, text.split(" ")))


def lower_az(text: str) -> str:
    """Lower-case A-Z only: bytes.lower() touches no byte beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def slices(batches: Iterable[pa.RecordBatch], chars: int = 6_000_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in pieces of bounded text size, whatever the size of the Arrow batches; null texts are empty."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = held = 0
        for i, text in enumerate(texts):
            texts[i] = text or ""
            held += len(texts[i])
            if held >= chars:
                yield ids[at : i + 1], texts[at : i + 1]
                at, held = i + 1, 0
        if at < len(ids):
            yield ids[at:], texts[at:]


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit number a word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def offsets(counts: Iterable[int] | np.ndarray) -> np.ndarray:
    """Starts of consecutive runs of the given lengths, and the end."""
    if not isinstance(counts, np.ndarray):
        counts = np.fromiter(counts, np.int64)
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbours in h (runs across documents are the caller's to leave out)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that every operator needs, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def one_each(rows: DataFrame, *others: str) -> DataFrame:
    """One row an id of doc_id, text and ``others``: the one whose text has the smallest hash, however often an id stands."""
    ranked = rows.select("doc_id", "text", *others, F.xxhash64("text").alias("h"))
    return ranked.groupBy("doc_id", *others).agg(F.min(F.struct("h", "text")).alias("x")).select("doc_id", F.col("x.text").alias("text"), *others)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the fixed folds."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over unsigned 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def numbered(words: list[str]) -> tuple[np.ndarray, list[str]]:
    """The place of each word in the list of distinct words, and that list."""
    known: dict[str, int] = {}
    place = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return place, list(known)


def word_bytes(words: list[str], mark: bytes = b"\x01") -> tuple[np.ndarray, np.ndarray]:
    """All words as UTF-8 in one array, each between two marks, and the starts of the words in it (and the end)."""
    raw = [mark + w.encode("utf-8", "surrogatepass") + mark for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), offsets(map(len, raw))


def run_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs; empty runs give zero."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]
