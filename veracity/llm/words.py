"""Word splitting shared by the corpus operators (runs inside tasks on Arrow batches)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split on the bytes 20 and 09-0D; null gives no words.

    ``bytes.split()`` splits on exactly those six bytes.
    """
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of many texts at a time: their number in each, each word's place in the distinct words, and those words' hashes.

    Arrow's white space are the six bytes of ``words``; it lowers A-Z alone.
    """
    whole = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(whole)
    # an empty text is split into one empty word
    some = pc.greater(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)
    n = np.where(some, pc.list_value_length(split).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    coded = split.filter(pa.array(some)).flatten().dictionary_encode()
    return n, coded.indices.to_numpy(zero_copy_only=False), word_hashes(coded.dictionary.cast(pa.binary()).to_pylist())


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit fingerprints of its ``width``-word shingles.

    A text with fewer words is one shingle, its whole sequence; one without words has none.
    """
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = word_hashes([w for d in docs for w in d])
    rolled = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in flat[at : at + n]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out
